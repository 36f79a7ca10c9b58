"""Hilbert curve keys of points on a grid, vectorised (Skilling, "Programming the Hilbert curve", 2004)."""

from __future__ import annotations

import numpy as np


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """The place along the curve of each row of ``points``: whole numbers of ``bits`` bits, dims * bits < 64."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    # From coordinates to the transposed key: undo the excess work of each level.
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - one
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[dims - 1] & q) > 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << one | (x[i] >> np.uint64(b) & one)
    return key.astype(np.int64)
