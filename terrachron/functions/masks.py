"""How many of a year's sets share a member with each of its sets, by sums over subsets of bit masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Up to so many sets in a year are compared one by one.
FEW = 16_384


def _subset_sums(masks: list[np.ndarray], counts: list[np.ndarray], bits: int) -> np.ndarray:
    """Of each mask, the count of all sets inside it."""
    total = sum(int(c.sum()) for c in counts)
    sums = np.zeros(1 << bits, np.int32 if total < 2**31 else np.int64)
    for m, c in zip(masks, counts, strict=True):
        np.add.at(sums, m, c.astype(sums.dtype))
    for i in range(bits):
        halves = sums.reshape(-1, 2, 1 << i)
        halves[:, 1] += halves[:, 0]
    return sums


def met_by_year(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows (y, asked, mask, n), each year's in one task, those with counts (asked = 0) before those that ask: (y, mask, met)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        year, masks, counts, sums = None, [], [], None
        for batch in batches:
            ys, asked, mask, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("y", "asked", "mask", "n"))
            edges = np.flatnonzero((ys[1:] != ys[:-1]) | (asked[1:] != asked[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(ys)], strict=True):
                if a == b:
                    continue
                if ys[a] != year:
                    year, masks, counts, sums = ys[a], [], [], None
                if asked[a] == 0:
                    masks.append(mask[a:b].copy())
                    counts.append(n[a:b].copy())
                    continue
                q = mask[a:b]
                if sums is None and sum(map(len, masks)) > FEW:
                    sums = _subset_sums(masks, counts, bits)
                    masks, counts = [], []
                if sums is not None:
                    met = (sums[-1] - sums[((1 << bits) - 1) ^ q]).astype(np.int64)
                else:
                    every, held = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (masks, counts))
                    met = np.concatenate([((q[i : i + 256, None] & every[None]) != 0) @ held for i in range(0, len(q), 256)])
                yield pa.RecordBatch.from_arrays([pa.array(ys[a:b], pa.int32()), pa.array(q, pa.int64()), pa.array(met, pa.int64())], names=["y", "mask", "met"])

    return run
