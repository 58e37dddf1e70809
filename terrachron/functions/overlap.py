"""The area that two shapes share, by a scan over their edges.

Vertices and crossings cut the plane into upright slabs in which no edges cross, so what both shapes cover in a slab is
a row of trapezoids. Areas are on the sphere, by Simpson's rule over the width of each trapezoid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .spatial import EARTH_KM

#: A square metre.
ROUNDING = 1e-6


def _edges(polygons) -> np.ndarray:
    """(x1, y1, x2, y2) of all edges from left to right; upright ones bound no slab."""
    out = []
    for rings in polygons if polygons is not None else ():
        for ring in rings:
            points = np.array([(p["lon"], p["lat"]) for p in ring], float).reshape(-1, 2)
            if len(points) > 1:
                out.append(np.concatenate([points[:-1], points[1:]], axis=1))
    edges = np.concatenate(out) if out else np.zeros((0, 4))
    back = edges[:, 0] > edges[:, 2]
    edges[back] = edges[back][:, [2, 3, 0, 1]]
    return edges[edges[:, 0] < edges[:, 2]]


def _crossing_xs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where edges of ``a`` cross edges of ``b``; blocks of rows, so memory is bounded by the second list."""
    out = []
    for at in range(0, len(a), 256):
        p = a[at : at + 256, None]
        r, s = p[..., 2:] - p[..., :2], b[None, :, 2:] - b[None, :, :2]
        cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
        d = b[None, :, :2] - p[..., :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / cross
            u = (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / cross
        hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out.append((p[..., 0] + t * r[..., 0])[hit])
    return np.concatenate(out) if out else np.zeros(0)


def _covered(edges: np.ndarray, x0: float, x1: float) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) heights at the left, middle and right of a slab of the stretches inside, by the even-odd rule."""
    e = edges[(edges[:, 0] <= x0) & (edges[:, 2] >= x1)]
    xs = np.array([x0, (x0 + x1) / 2, x1])
    y = e[:, 1:2] + (xs - e[:, 0:1]) * ((e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]))[:, None]
    y = y[np.argsort(y[:, 1], kind="stable")]
    y = y[: len(y) // 2 * 2]
    return y[0::2], y[1::2]


def shared_parts(a, b) -> list[float]:
    """Square kilometres of each part that two shapes share, largest first; parts that meet in more than a point are one.

    Edges that differ by the rounding of doubles alone share nothing: parts under ROUNDING are none."""
    ea, eb = _edges(a), _edges(b)
    if not len(ea) or not len(eb):
        return []
    low, high = max(ea[:, 0].min(), eb[:, 0].min()), min(ea[:, 2].max(), eb[:, 2].max())
    if low >= high:
        return []
    near = [e[(e[:, 0] < high) & (e[:, 2] > low)] for e in (ea, eb)]
    xs = np.concatenate([*(e[:, [0, 2]].ravel() for e in near), _crossing_xs(*near), _crossing_xs(near[0], near[0]), _crossing_xs(near[1], near[1]), [low, high]])
    xs = np.unique(xs[(xs >= low) & (xs <= high)])
    areas: list[float] = []
    root: list[int] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    before: list[tuple[float, float, int]] = []
    for x0, x1 in zip(xs[:-1], xs[1:], strict=True):
        (lo_a, hi_a), (lo_b, hi_b) = _covered(near[0], x0, x1), _covered(near[1], x0, x1)
        now = []
        i = j = 0
        while i < len(lo_a) and j < len(lo_b):
            bottom, top = (lo_a[i] if lo_a[i][1] > lo_b[j][1] else lo_b[j]), (hi_a[i] if hi_a[i][1] < hi_b[j][1] else hi_b[j])
            if top[1] > bottom[1]:
                height = np.sin(np.radians(top)) - np.sin(np.radians(bottom))
                areas.append(float(EARTH_KM**2 * np.radians(x1 - x0) * (height[0] + 4 * height[1] + height[2]) / 6))
                k = len(root)
                root.append(k)
                now.append((float(bottom[2]), float(top[2]), k))
                for b0, t0, other in before:
                    if min(t0, float(top[0])) > max(b0, float(bottom[0])):
                        root[find(k)] = find(other)
            if hi_a[i][1] < hi_b[j][1]:
                i += 1
            else:
                j += 1
        before = now
    total: dict[int, float] = {}
    for k, area in enumerate(areas):
        total[find(k)] = total.get(find(k), 0.0) + area
    return sorted((x for x in total.values() if x >= ROUNDING), reverse=True)


@F.pandas_udf(ArrayType(DoubleType()))
def _parts(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([shared_parts(x, y) for x, y in zip(a, b, strict=True)])


def overlap_parts(a: Column, b: Column) -> Column:
    return _parts(a, b)
