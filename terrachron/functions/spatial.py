"""Spatial expressions: distances, boxes, points in polygons, rings; Columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
EARTH_KM_FLAGS = 6371.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(float(x)))


def has_coordinates(lon="lon", lat="lat") -> Column:
    x, y = col(lon), col(lat)
    return F.coalesce(~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf")), F.lit(False))


def real_coordinates(lon="lon", lat="lat") -> Column:
    return has_coordinates(lon, lat) & F.coalesce(col(lon).between(-180, 180) & col(lat).between(-90, 90), F.lit(False))


def haversine_km(lon1, lat1, lon2, lat2, radius: float = EARTH_KM) -> Column:
    x1, y1, x2, y2 = map(col, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2.0) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2.0)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * radius)


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    x1, y1, x2, y2 = map(col, (lon1, lat1, lon2, lat2))
    p1, p2, d = F.radians(y1), F.radians(y2), F.radians(x2 - x1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def compass_point(bearing) -> Column:
    at = F.pmod(F.floor(F.pmod(col(bearing), F.lit(360.0)) / 45 + 0.5), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS)), at + 1)


def format_km(km) -> Column:
    return F.when(col(km) < 1, "under 1 km").otherwise(F.concat(F.floor(col(km) + 0.5).cast("string"), F.lit(" km")))


def destination(lon, lat, bearing, km) -> tuple[Column, Column]:
    d, b, p1, l1 = col(km) / EARTH_KM, F.radians(col(bearing)), F.radians(col(lat)), F.radians(col(lon))
    p2 = F.asin(F.sin(p1) * F.cos(d) + F.cos(p1) * F.sin(d) * F.cos(b))
    l2 = l1 + F.atan2(F.sin(b) * F.sin(d) * F.cos(p1), F.cos(d) - F.sin(p1) * F.sin(p2))
    return F.degrees(l2), F.degrees(p2)


def circle_ring(lon, lat, km, points: int = 72) -> Column:
    """Points on a circle, the first once more at the end."""

    def at(i: Column) -> Column:
        x, y = destination(lon, lat, i * (360.0 / points), km)
        return F.struct(x.alias("lon"), y.alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: at(F.pmod(i, F.lit(points)).cast("double")))


def circle_box(lon: float, lat: float, km: float) -> tuple[float, float, float, float]:
    """The box of a circle given as parameters; all longitudes at a pole or over the 180th meridian."""
    angle = km / EARTH_KM
    south, north = max(-90.0, lat - math.degrees(angle)), min(90.0, lat + math.degrees(angle))
    west, east = -180.0, 180.0
    if -90 < south and north < 90 and (ratio := math.sin(angle) / math.cos(math.radians(lat))) < 1:
        half = math.degrees(math.asin(ratio))
        if -180 <= lon - half and lon + half <= 180:
            west, east = lon - half, lon + half
    return west, south, east, north


def in_box(box: tuple[float, float, float, float], lon="lon", lat="lat") -> Column:
    w, s, e, n = box
    return col(lon).between(w, e) & col(lat).between(s, n)


def in_circle(lon0: float, lat0: float, km: float, lon="lon", lat="lat") -> Column:
    """The circle's box, then the distance."""
    return in_box(circle_box(lon0, lat0, km), lon, lat) & (haversine_km(F.lit(float(lon0)), F.lit(float(lat0)), lon, lat) <= km)


def decimal_places(x, most: int = 6) -> Column:
    """Decimals a stored number was written with, up to ``most``."""
    v = col(x)
    out = F.lit(most)
    for n in range(most - 1, -1, -1):
        scaled = v * (10.0**n)
        out = F.when(F.abs(scaled - F.floor(scaled + 0.5)) < 1e-6, n).otherwise(out)
    return out


def low_precision_pin(lon="lon", lat="lat", quality="location_quality") -> Column:
    return F.coalesce((col(quality) == "precise") & (decimal_places(lon) <= 1) & (decimal_places(lat) <= 1), F.lit(False))


def shown_quality(lon="lon", lat="lat", quality="location_quality") -> Column:
    """The stored quality; a rounded precise pin is shown as approximate, no coordinates as none."""
    return F.when(~real_coordinates(lon, lat), "none").when(low_precision_pin(lon, lat, quality), "approximate").otherwise(col(quality))


def looks_swapped(box: tuple[float, float, float, float], lon="lon", lat="lat") -> Column:
    return ~in_box(box, lon, lat) & in_box(box, lat, lon)


def mercator(lon="lon", lat="lat") -> tuple[Column, Column]:
    """Web-Mercator x and y in 0..1."""
    y = F.radians(col(lat))
    return (col(lon) + 180) / 360, (F.lit(1.0) - F.log(F.tan(y) + 1 / F.cos(y)) / math.pi) / 2


def edges(ring: Column) -> Column:
    """Each position of a ring with the one before it, the last before the first."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    return F.zip_with(ring, before, lambda p, q: F.struct(p["lon"].alias("xi"), p["lat"].alias("yi"), q["lon"].alias("xj"), q["lat"].alias("yj")))


def in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule."""
    crossed = F.filter(edges(ring), lambda e: ((e["yi"] > lat) != (e["yj"] > lat)) & (lon < (e["xj"] - e["xi"]) * (lat - e["yi"]) / F.when(e["yj"] == e["yi"], 1.0).otherwise(e["yj"] - e["yi"]) + e["xi"]))
    return F.size(crossed) % 2 == 1


def in_polygon(rings: Column, lon: Column, lat: Column) -> Column:
    return in_ring(F.get(rings, F.lit(0)), lon, lat) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), lambda r: in_ring(r, lon, lat))


def in_polygons(polygons: Column, lon: Column, lat: Column) -> Column:
    return F.exists(polygons, lambda rings: in_polygon(rings, lon, lat))


def polygons_box(polygons: Column) -> Column:
    """Box of the outer rings."""
    points = F.flatten(F.transform(polygons, lambda rings: F.get(rings, F.lit(0))))
    xs, ys = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n"))


def _cross(e: Column) -> Column:
    return e["xj"] * e["yi"] - e["xi"] * e["yj"]


def ring_area(ring: Column) -> Column:
    """Signed shoelace area."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + _cross(e)) / 2


def ring_centroid(ring: Column) -> Column:
    a = ring_area(ring) * 6
    x = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["xi"] + e["xj"]) * _cross(e))
    y = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["yi"] + e["yj"]) * _cross(e))
    return F.when(a != 0, F.struct((x / a).alias("lon"), (y / a).alias("lat")))


def largest_part(polygons: Column) -> Column:
    """The polygon whose outer ring has the largest area."""
    sized = F.transform(polygons, lambda rings: F.struct(F.abs(ring_area(F.get(rings, F.lit(0)))).alias("area"), rings.alias("rings")))
    return F.array_max(sized)["rings"]


def label_anchor(polygons: Column) -> Column:
    """The largest part's centroid where it lies inside the shape; else null."""
    at = ring_centroid(F.get(largest_part(polygons), F.lit(0)))
    return F.when(in_polygons(polygons, at["lon"], at["lat"]), at)


def segment_km(lon: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column, radius: float = EARTH_KM_FLAGS) -> Column:
    """Distance from a point to a segment, on a local plane."""
    per_degree = math.pi * radius / 180
    kx = F.cos(F.radians(lat)) * per_degree
    px, py, qx, qy = (ax - lon) * kx, (ay - lat) * per_degree, (bx - lon) * kx, (by - lat) * per_degree
    dx, dy = qx - px, qy - py
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(px * dx + py * dy) / F.when(length > 0, length).otherwise(1.0)))).otherwise(0.0)
    return F.sqrt(F.pow(px + t * dx, 2.0) + F.pow(py + t * dy, 2.0))


def vertex_count(polygons: Column) -> Column:
    return F.size(F.flatten(F.flatten(polygons)))


def fine_count(polygons: Column) -> Column:
    """Positions with more than three decimals."""
    fine = lambda v: F.abs(v * 1000 - F.floor(v * 1000 + 0.5)) > 1e-6
    return F.size(F.filter(F.flatten(F.flatten(polygons)), lambda p: fine(p["lon"]) | fine(p["lat"])))


def geometry_hash(polygons: Column) -> Column:
    return F.sha2(F.to_json(polygons), 256)


def ring_problems(polygons: Column) -> Column:
    """Structure findings: rings of fewer than four positions, rings not closed, positions that are no numbers."""
    rings = F.flatten(polygons)
    short = F.size(F.filter(rings, lambda r: F.size(r) < 4))
    open_ = F.size(F.filter(rings, lambda r: (F.size(r) > 0) & (F.get(r, F.lit(0)) != F.element_at(r, -1))))
    odd = F.size(F.filter(F.flatten(rings), lambda p: ~real_coordinates(p["lon"], p["lat"])))
    told = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + word)))
    return F.array_compact(F.array(told(short, "rings with fewer than 4 positions"), told(open_, "rings not closed"), told(odd, "positions not numbers in range")))


def drop_collinear(ring: Column) -> Column:
    """A ring without repeated positions and without positions on the line between their neighbours; both ends stay."""
    once = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    n = F.size(once)

    def keep(p: Column, i: Column) -> Column:
        a, b = F.get(once, i - 1), F.get(once, i + 1)
        straight = (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) == (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])
        return (i == 0) | (i == n - 1) | ~straight

    return F.filter(once, keep)


def cells_in_box(cells: Column, size: float, box: tuple[float, float, float, float]) -> Column:
    """Of grid cells named "<west>_<south>", those that touch the box."""
    w, s, e, n = box
    part = lambda c, i: F.element_at(F.split(c, "_"), i).cast("double")
    return F.filter(cells, lambda c: (part(c, 1) < e) & (part(c, 1) + size > w) & (part(c, 2) < n) & (part(c, 2) + size > s))
