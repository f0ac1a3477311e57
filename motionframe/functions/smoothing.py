"""Savitzky-Golay weights."""

from __future__ import annotations

import numpy as np

# Farthest neighbour that can influence a smoothed frame: the last frame takes the
# polynomial of the last full window, which for window 7 starts 6 frames earlier.
REACH = 6


def hat_matrix(window: int, order: int) -> np.ndarray:
    """Row i holds the weights of a least-squares polynomial evaluated at position i."""
    x = np.arange(window, dtype=float) - window // 2
    design = np.vander(x, order + 1, increasing=True)
    return design @ np.linalg.pinv(design)
