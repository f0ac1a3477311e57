"""Summaries of per-entity speed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from motionframe.operators.series import SEGMENT_FRAMES, rms_of, track_sums


def _stats(value: str) -> list:
    return [F.avg(value).alias("rms_speed_mean"), F.stddev_samp(value).alias("rms_speed_std"),
            F.count(value).alias("n_entities")]


def energy_summary(energy: DataFrame, keys: Sequence[str] = ("grp", "idx")) -> DataFrame:
    """Mean, sample deviation and count of speed per channel; NULL speeds excluded."""
    return energy.where(F.col("rms_speed").isNotNull()).groupBy(*keys).agg(*_stats("rms_speed"))


def energy_by_class(energy: DataFrame) -> DataFrame:
    """The same per class; channels without any speed stay, with count 0."""
    return energy.groupBy("class", "grp", "idx").agg(*_stats("rms_speed"))


def scope_summary(energy: DataFrame) -> DataFrame:
    """Per-class and global summaries in one pass; `class` is NULL on global rows."""
    grouped = energy.groupingSets(
        [[F.col("grp"), F.col("idx"), F.col("class")], [F.col("grp"), F.col("idx")]],
        F.col("grp"), F.col("idx"), F.col("class"))
    return grouped.agg(F.grouping("class").cast("int").alias("is_global"), *_stats("rms_speed"))


def axis_energy_share(tracks: DataFrame, *, segment_frames: int = SEGMENT_FRAMES,
                      whole_entities: bool = False) -> DataFrame:
    """Mean speed per group over xyz and over xy, and the share of energy along z.

    With `whole_entities`, an entity that is read by several tasks is an error.
    """
    parts = track_sums(tracks, ("x", "y", "z"), segment_frames=segment_frames, whole_entities=whole_entities)
    per = parts.groupBy("entity_id", "grp", "row").agg(
        rms_of(("x", "y", "z")).alias("rms_xyz"), rms_of(("x", "y")).alias("rms_xy"))
    out = per.groupBy("grp").agg(
        F.avg("rms_xyz").alias("rms_xyz"), F.avg("rms_xy").alias("rms_xy"),
        F.avg(F.col("rms_xyz") * F.col("rms_xyz")).alias("e_xyz"),
        F.avg(F.col("rms_xy") * F.col("rms_xy")).alias("e_xy"))
    return out.select("grp", "rms_xyz", "rms_xy",
                      F.when(F.col("e_xyz") != 0, 1 - F.col("e_xy") / F.col("e_xyz")).alias("z_share"))
