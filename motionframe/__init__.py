"""Keypoint and sensor track analytics on Spark DataFrames."""

from motionframe.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
