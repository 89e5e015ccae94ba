"""Hilbert curve keys for batches of points (numpy, vectorised over points)."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells.

    ``cells`` is (n, dims) with values in [0, 2**bits); dims * bits must stay
    below 64. Neighbouring keys are neighbouring cells. The steps are the usual
    transpose form: undo the rotations from the top bit down, Gray-code the
    axes, then interleave the bits.
    """
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("dims * bits must be at most 63")
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            if d:
                x[d] = x[d] ^ swap
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    parity = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        parity = np.where((x[-1] & q) != 0, parity ^ (q - one), parity)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | (((x[d] ^ parity) >> np.uint64(b)) & one)
    return key.astype(np.int64)
