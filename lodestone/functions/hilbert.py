"""Hilbert order of grid points in any number of dimensions, vectorised over points."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (n x d, values below ``2**bits``).

    The published transposed-axes method: undo the excess work of each level from the highest bit
    down, Gray-encode, then interleave the bits. ``d * bits`` must be at most 63.
    """
    axes = np.ascontiguousarray(cells.T).astype(np.uint64)
    d = len(axes)
    if d * bits > 63:
        raise ValueError("d * bits must be at most 63")
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = (one << np.uint64(level)) - one
        for i in range(d):
            turn = ((axes[i] >> np.uint64(level)) & one).astype(bool)
            swap = (axes[0] ^ axes[i]) & low
            axes[0] ^= np.where(turn, low, swap)
            if i:
                axes[i] ^= np.where(turn, np.uint64(0), swap)
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    flip = np.zeros(axes.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        on = ((axes[d - 1] >> np.uint64(level)) & one).astype(bool)
        flip ^= np.where(on, (one << np.uint64(level)) - one, np.uint64(0))
    axes ^= flip
    key = np.zeros(axes.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((axes[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)
