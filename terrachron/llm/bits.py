"""Majority votes over the bits of 64-bit hashes, vectorised for many groups at once."""

from __future__ import annotations

import numpy as np

#: For each byte value, its eight bits spread over the eight bytes of a word: sums of up to 255 words never carry.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
LANES = 255


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``sizes`` hashes, the word whose bits are set in over half of the group; 0 for empty groups."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full].astype(np.int64)
    spread = SPREAD[np.ascontiguousarray(hashes, np.uint64).view(np.uint8)].reshape(-1, 8)
    parts = -(-sizes // LANES)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes - first * LANES, parts) + np.arange(parts.sum()) * LANES
    lanes = np.add.reduceat(spread, starts, axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
    out[full] = bits.view(np.uint64).ravel()
    return out
