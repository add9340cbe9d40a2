"""Places of points on a Hilbert curve, for any number of dimensions (J. Skilling, Programming the Hilbert curve, 2004)."""

from __future__ import annotations

import numpy as np


def cells(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    """The grid cell of each row of ``x`` in the box from ``lo`` to ``hi``, ``2 ** bits`` cells a side."""
    side = np.where(hi > lo, hi - lo, 1.0)
    share = np.clip((x - lo) / side, 0, 1)
    return np.minimum((share * (1 << bits)).astype(np.uint32), np.uint32((1 << bits) - 1))


def keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (row, byte) whose order is the order of the cells along the curve."""
    axes = grid.astype(np.uint32).T.copy()  # a row for each dimension
    d = len(axes)
    for level in range(bits - 1, 0, -1):  # undo the turns of the cubes, from the largest
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for axis in axes:
            set_ = (axis & bit) != 0
            swap = np.where(set_, 0, (axes[0] ^ axis) & below).astype(np.uint32)
            axes[0] ^= np.where(set_, below, swap)
            axis ^= swap  # nothing for the first axis itself
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint32(level)) & 1, np.uint32((1 << level) - 1), np.uint32(0))
    axes ^= turn
    planes = [(axis >> np.uint32(level)) & 1 for level in range(bits - 1, -1, -1) for axis in axes]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)
