"""Points, borders and years: spatial joins, histories of places, checks of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial as S
from ..functions import temporal as T
from ..functions.overlap import overlap_parts
from ..session import settle
from . import joins as J

CELL = 4.0
INCLUDED = "-included"


def with_cells(features: DataFrame, size: float = CELL) -> DataFrame:
    """A row for each grid cell that a feature's box touches."""
    boxed = features.withColumn("_box", S.polygons_box(F.col("polygons")))
    return boxed.withColumn("_cell", F.explode(J.box_cells(F.col("_box.w"), F.col("_box.s"), F.col("_box.e"), F.col("_box.n"), size)))


def features_at(points: DataFrame, features: DataFrame, lon: str = "lon", lat: str = "lat", size: float = CELL) -> DataFrame:
    """Points with every feature they lie in: cells, then boxes, then the even-odd rule."""
    placed = points.withColumn("_cell", J.point_cell(F.col(lon), F.col(lat), size))
    pairs = placed.join(with_cells(features, size), "_cell")
    in_box = F.col(lon).between(F.col("_box.w"), F.col("_box.e")) & F.col(lat).between(F.col("_box.s"), F.col("_box.n"))
    return pairs.where(in_box).where(S.in_polygons(F.col("polygons"), F.col(lon), F.col(lat))).drop("_cell", "_box")


def folded(hits: DataFrame, by: list[str]) -> DataFrame:
    """Of the features at a point in a year: an "-included" one goes under those drawn on top of it."""
    under = F.coalesce(F.endswith("status", F.lit(INCLUDED)), F.lit(False))
    over = F.max((~under).cast("int")).over(Window.partitionBy(*by)) == 1
    return hits.withColumn("_over", over).where(~(F.col("_over") & under)).drop("_over")


def place_history(points: DataFrame, features: DataFrame, min_year: int, max_year: int, key: str = "id") -> DataFrame:
    """(id, start, end, names): years with the same shown features as one period; a year without any is a period of its own kind."""
    hits = features_at(points.select(key, "lon", "lat"), features).select(key, "name", "status", "start_year", "end_year")
    years = hits.withColumn("year", F.explode(F.sequence(F.greatest(F.col("start_year"), F.lit(min_year)), F.greatest(F.least(F.col("end_year"), F.lit(max_year)), F.greatest(F.col("start_year"), F.lit(min_year))))))
    years = years.where(F.col("year").between(F.col("start_year"), F.col("end_year")) & (F.col("year") <= max_year))
    shown = folded(years, [key, "year"]).groupBy(key, "year").agg(F.array_join(F.array_sort(F.collect_set("name")), " + ").alias("names"))
    spine = points.select(key).distinct().withColumn("year", F.explode(F.sequence(F.lit(min_year), F.lit(max_year))))
    full = spine.join(shown, [key, "year"], "left").withColumn("names", F.coalesce("names", F.lit("")))
    return J.islands(full, [key], "year", ["names"]).select(key, "names", "start", "end")


def records_at(points: DataFrame, features: DataFrame, year: int) -> DataFrame:
    """Points with the features active in a year, folded."""
    active = features.where(F.lit(year).between(F.col("start_year"), F.col("end_year")))
    return folded(features_at(points, active), ["id"])


def pin_check(events: DataFrame, features: DataFrame, names_of: DataFrame, tolerance_km: float = 5.0, reach_deg: float = 1.0) -> DataFrame:
    """(id, inside): precise pins against the shapes of their countries in their start year; inside, or within the tolerance of an edge. Without a tolerance only inside counts.

    ``names_of``: (country, shape)."""
    pins = events.where(F.col("location_quality") == "precise").select("id", "lon", "lat", T.year_of("date_start").alias("year"), F.explode("countries").alias("country"))
    pins = pins.join(names_of, "country")
    shapes = features.select(F.col("name").alias("shape"), "start_year", "end_year", "polygons")
    found = pins.join(shapes, "shape").where(F.col("year").between(F.col("start_year"), F.col("end_year")))
    box = S.polygons_box(F.col("polygons"))
    near_box = F.col("lon").between(box["w"] - reach_deg, box["e"] + reach_deg) & F.col("lat").between(box["s"] - reach_deg, box["n"] + reach_deg)
    segments = F.flatten(F.transform(F.flatten("polygons"), S.edges))
    away = F.array_min(F.transform(segments, lambda s: S.segment_km(F.col("lon"), F.col("lat"), s["xj"], s["yj"], s["xi"], s["yi"])))
    ok = near_box & S.in_polygons(F.col("polygons"), F.col("lon"), F.col("lat"))
    if tolerance_km > 0:
        ok = ok | (near_box & F.when(near_box, away <= tolerance_km).otherwise(False))
    return found.groupBy("id").agg(F.max(F.coalesce(ok, F.lit(False))).alias("inside"))


def segments(features: DataFrame) -> DataFrame:
    """(name, start_year, end_year, part, ring, seg, ax, ay, bx, by): one row for each edge."""
    rings = features.select("name", "start_year", "end_year", F.posexplode("polygons").alias("part", "rings"))
    rings = rings.select("name", "start_year", "end_year", "part", F.posexplode("rings").alias("ring", "points"))
    pairs = F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda p, q: F.struct(p["lon"].alias("ax"), p["lat"].alias("ay"), q["lon"].alias("bx"), q["lat"].alias("by")))
    out = rings.select("name", "start_year", "end_year", "part", "ring", F.posexplode(pairs).alias("seg", "e"))
    return out.select("name", "start_year", "end_year", "part", "ring", "seg", "e.*")


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def crossings(features: DataFrame, size: float = CELL) -> DataFrame:
    """(name, start_year, end_year, sid, sid2, lon, lat): edges of one feature that properly cross, met in grid cells, and where they do."""
    s = segments(features)
    ends = lambda f, a, b: f(F.col(a), F.col(b))
    cells = J.box_cells(ends(F.least, "ax", "bx"), ends(F.least, "ay", "by"), ends(F.greatest, "ax", "bx"), ends(F.greatest, "ay", "by"), size)
    a = s.withColumn("_cell", F.explode(cells)).withColumn("sid", F.struct("part", "ring", "seg"))
    b = a.select("name", "start_year", "end_year", "_cell", F.col("sid").alias("sid2"), *(F.col(c).alias(f"{c}2") for c in ("ax", "ay", "bx", "by")))
    pairs = a.join(J.shuffled(b), ["name", "start_year", "end_year", "_cell"]).where("sid < sid2")
    c = {n: F.col(n) for n in ("ax", "ay", "bx", "by", "ax2", "ay2", "bx2", "by2")}
    one = _side(c["ax"], c["ay"], c["bx"], c["by"], c["ax2"], c["ay2"]) * _side(c["ax"], c["ay"], c["bx"], c["by"], c["bx2"], c["by2"])
    two = _side(c["ax2"], c["ay2"], c["bx2"], c["by2"], c["ax"], c["ay"]) * _side(c["ax2"], c["ay2"], c["bx2"], c["by2"], c["bx"], c["by"])
    cross = (c["bx"] - c["ax"]) * (c["by2"] - c["ay2"]) - (c["by"] - c["ay"]) * (c["bx2"] - c["ax2"])  # not zero where edges cross
    along = ((c["ax2"] - c["ax"]) * (c["by2"] - c["ay2"]) - (c["ay2"] - c["ay"]) * (c["bx2"] - c["ax2"])) / F.nullif(cross, F.lit(0.0))
    at = (c["ax"] + along * (c["bx"] - c["ax"])).alias("lon"), (c["ay"] + along * (c["by"] - c["ay"])).alias("lat")
    return pairs.where((one < 0) & (two < 0)).select("name", "start_year", "end_year", "sid", "sid2", *at).distinct()


def ring_findings(features: DataFrame, accepted: DataFrame, size: float = CELL) -> DataFrame:
    """(name, start_year, end_year, finding, n): crossings of a feature's rings with themselves, known or not, and with each other; accepted ones that are gone.

    ``accepted`` (name, start_year, end_year, lon, lat) lists crossings within a ring that the source is known to have,
    told by their place to six decimals. Crossings between two rings are never accepted."""
    of, place = ["name", "start_year", "end_year"], [F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")]
    met = crossings(features, size)
    same = (F.col("sid.part") == F.col("sid2.part")) & (F.col("sid.ring") == F.col("sid2.ring"))
    known = accepted.select(*of, *place).distinct()
    alone = met.where(same).select(*of, *place)
    by = [*of, "lon", "lat"]
    found = alone.join(J.shuffled(known.withColumn("is_known", F.lit(True))), by, "left")
    rows = found.select(*of, F.when(F.col("is_known"), "accepted crossing").otherwise("ring crosses itself").alias("finding"))
    rows = rows.unionByName(met.where(~same).select(*of, F.lit("rings cross").alias("finding")))
    rows = rows.unionByName(known.join(J.shuffled(alone), by, "left_anti").select(*of, F.lit("accepted crossing no longer found").alias("finding")))
    return rows.groupBy(*of, "finding").agg(F.count("*").alias("n"))


def geometry_findings(features: DataFrame, accepted: DataFrame, size: float = CELL) -> DataFrame:
    """(name, start_year, end_year, finding, n): the structure of rings, then their crossings as ``ring_findings`` tells them; shapes that are not well formed are not looked at for crossings."""
    told = features.withColumn("problems", S.ring_problems(F.col("polygons")))
    broken = told.where(F.size("problems") > 0).select("name", "start_year", "end_year", F.explode("problems").alias("p"))
    count = F.substring_index("p", " ", 1).cast("long")
    rows = broken.select("name", "start_year", "end_year", F.expr("substring(p, instr(p, ' ') + 1)").alias("finding"), count.alias("n"))
    return rows.unionByName(ring_findings(told.where(F.size("problems") == 0).drop("problems"), accepted, size))


def border_checks(features: DataFrame, baseline: DataFrame, accepted: DataFrame, base: Column, size: float = CELL) -> DataFrame:
    """(check, name, start_year, finding): geometry, continuity of names, overlaps that are not meant, and the baseline of geometries, in one table.

    ``baseline`` (key, vertices, fine, sha) is keyed by ``name@start_year``. Slivers are counted in one row a feature."""
    from .compare import geometry_baseline

    geometry = geometry_findings(features, accepted, size).where("finding <> 'accepted crossing'").select(F.lit("geometry").alias("check"), "name", "start_year", F.concat_ws(" ", "n", "finding").alias("finding"))
    names = continuity(features, base).select(F.lit("continuity").alias("check"), "name", "start_year", F.col("problem").alias("finding"))
    pairs = overlap_findings(features).where("intentional IS NULL OR NOT intentional")
    meet = pairs.select(F.lit("overlap").alias("check"), F.col("a").alias("name"), F.col("first_year").alias("start_year"), F.concat(F.when(F.col("intentional").isNull(), "sliver with ").otherwise("overlaps "), "b").alias("finding"))
    p = F.col("polygons")
    now = features.select(F.concat_ws("@", "name", F.col("start_year").cast("string")).alias("key"), S.vertex_count(p).alias("vertices"), S.fine_count(p).alias("fine"), S.geometry_hash(p).alias("sha"))
    changed = geometry_baseline(now, baseline)
    at = F.regexp_extract("key", r"@(-?\d+)$", 1).cast("int")
    told = changed.select(F.lit("baseline").alias("check"), F.regexp_replace("key", r"@-?\d+$", "").alias("name"), at.alias("start_year"), F.col("problem").alias("finding"))
    return geometry.unionByName(names).unionByName(meet).unionByName(told)


def same_year_overlaps(features: DataFrame, step: float = 0.5) -> DataFrame:
    """(a, b, first_year, last_year, area, intentional): features that hold in the same years and share area.

    The area counts lattice points ``step`` degrees apart that lie in both: an approximation."""
    f = with_cells(features).select("name", "status", "start_year", "end_year", "polygons", "_box", "_cell")
    g = f.select(*(F.col(c).alias(f"{c}2") for c in ("name", "status", "start_year", "end_year", "polygons", "_box")), "_cell")
    years = (F.col("start_year") <= F.col("end_year2")) & (F.col("start_year2") <= F.col("end_year"))
    touch = (F.col("_box.w") < F.col("_box2.e")) & (F.col("_box2.w") < F.col("_box.e")) & (F.col("_box.s") < F.col("_box2.n")) & (F.col("_box2.s") < F.col("_box.n"))
    pairs = f.join(g, "_cell").where((F.col("name") < F.col("name2")) & years & touch).dropDuplicates(["name", "name2", "start_year", "start_year2"])
    xs, ys = (
        F.sequence(F.ceil(F.greatest(F.col(f"_box.{a}"), F.col(f"_box2.{a}")) / step), F.greatest(F.floor(F.least(F.col(f"_box.{b}"), F.col(f"_box2.{b}")) / step), F.ceil(F.greatest(F.col(f"_box.{a}"), F.col(f"_box2.{a}")) / step)))
        for a, b in (("w", "e"), ("s", "n"))
    )
    grid = pairs.withColumn("gx", F.explode(xs)).withColumn("gy", F.explode(ys))
    px, py = F.col("gx") * step + step / 7, F.col("gy") * step + step / 7
    both = S.in_polygons(F.col("polygons"), px, py) & S.in_polygons(F.col("polygons2"), px, py)
    counted = grid.groupBy("name", "name2", "start_year", "start_year2", "end_year", "end_year2", "status", "status2").agg(F.count_if(both).alias("points")).where("points > 0")
    meant = F.coalesce(F.endswith("status", F.lit(INCLUDED)), F.lit(False)) | F.coalesce(F.endswith("status2", F.lit(INCLUDED)), F.lit(False))
    return counted.select(
        F.col("name").alias("a"), F.col("name2").alias("b"), F.greatest("start_year", "start_year2").alias("first_year"), F.least("end_year", "end_year2").alias("last_year"),
        (F.col("points") * step * step).alias("area"), meant.alias("intentional"),
    )


OVERLAP_KM2 = 0.5
#: Statuses of shapes that are drawn under others on purpose (fixed values).
OVERLAYS = ("occupied-territory-included", "shared-sovereignty-included")


#: Cells of 2**level degrees, for boxes of every size.
FINEST, COARSEST = -20, 9


def touching_boxes(boxed: DataFrame, of: list[str], years: Column) -> DataFrame:
    """Pairs of rows (of, and again with a 2) of ``boxed`` (of, _box) whose boxes share area, the lesser (first, third) column of ``of`` first; ``years`` holds for both.

    A box has the cells of the least size that it fits in, four at most, and visits cells of the larger sizes that others
    have: boxes of one size meet in small cells, however large others are. Each pair counts in the cell of its lower left corner alone."""
    side = F.greatest(F.col("_box.e") - F.col("_box.w"), F.col("_box.n") - F.col("_box.s"), F.lit(2.0**FINEST))
    placed = boxed.select(*of, "_box", F.least(F.ceil(F.log2(side)).cast("int"), F.lit(COARSEST)).alias("_level"))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect() if r[0] is not None)  # at most the sizes there are

    def cells(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        xs, ys = (F.sequence(F.floor(F.col(f"_box.{a}") / size), F.floor(F.col(f"_box.{b}") / size)) for a, b in (("w", "e"), ("s", "n")))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))))

    home = placed.select(*of, "_box", F.explode(cells(F.col("_level"))).alias("_cell"))
    there = F.filter(F.array(*map(F.lit, levels)), lambda level: level >= F.col("_level")) if levels else F.array().cast("array<int>")
    visit = placed.select(*(F.col(c).alias(f"{c}2") for c in of), F.col("_box").alias("_box2"), F.explode(F.flatten(F.transform(there, cells))).alias("_cell"), F.col("_level").alias("_level2"))
    touch = (F.col("_box.w") < F.col("_box2.e")) & (F.col("_box2.w") < F.col("_box.e")) & (F.col("_box.s") < F.col("_box2.n")) & (F.col("_box2.s") < F.col("_box.n"))
    size = F.pow(F.lit(2.0), F.col("_cell.level"))
    corner = (F.floor(F.greatest("_box.w", "_box2.w") / size) == F.col("_cell.x")) & (F.floor(F.greatest("_box.s", "_box2.s") / size) == F.col("_cell.y"))
    key = lambda tail: F.struct(*(F.col(f"{of[i]}{tail}").alias(of[i]) for i in (0, 2)))
    ordered = F.when(F.col("_level2") == F.col("_cell.level"), key("") < key("2")).otherwise(key("") != key("2"))
    met = home.join(J.shuffled(visit), "_cell").where(ordered & years & touch & corner).withColumn("_turn", key("2") < key(""))
    return met.select(*(F.when(F.col("_turn"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in of), *(F.when(F.col("_turn"), F.col(c)).otherwise(F.col(f"{c}2")).alias(f"{c}2") for c in of)).distinct()


def overlap_findings(features: DataFrame, least: float = OVERLAP_KM2, overlays: tuple[str, ...] = OVERLAYS) -> DataFrame:
    """(a, b, first_year, last_year, km2, parts, slivers, intentional): pairs of features that hold in the same years and share area.

    The area is that of an edge scan; ``slivers`` counts the shared parts under ``least``, and a pair that shares less
    than that in all is one sliver, told by a null ``intentional``. An overlay over a shape with a status is meant. Each
    pair is measured once, whatever its years and the cells in which the boxes meet."""
    of = ["name", "status", "start_year", "end_year"]
    boxed = features.withColumn("_box", S.polygons_box(F.col("polygons"))).where("_box.w IS NOT NULL AND _box.s IS NOT NULL")
    years = (F.col("start_year") <= F.col("end_year2")) & (F.col("start_year2") <= F.col("end_year"))
    pairs = touching_boxes(boxed, of, years)
    shapes = features.select("name", "start_year", "polygons")
    others = shapes.select(F.col("name").alias("name2"), F.col("start_year").alias("start_year2"), F.col("polygons").alias("polygons2"))
    both = pairs.join(J.shuffled(shapes), ["name", "start_year"]).join(J.shuffled(others), ["name2", "start_year2"])
    found = both.withColumn("found", overlap_parts(F.col("polygons"), F.col("polygons2"))).where(F.size("found") > 0)
    km2 = F.aggregate("found", F.lit(0.0), lambda x, y: x + y)
    over = F.coalesce(F.col("status").isin(*overlays), F.lit(False)) & F.col("status2").isNotNull() | F.coalesce(F.col("status2").isin(*overlays), F.lit(False)) & F.col("status").isNotNull()
    return found.withColumn("km2", km2).where("km2 > 0").select(
        F.col("name").alias("a"), F.col("name2").alias("b"), F.greatest("start_year", "start_year2").alias("first_year"), F.least("end_year", "end_year2").alias("last_year"), "km2",
        F.size("found").alias("parts"), F.size(F.filter("found", lambda x: x < least)).alias("slivers"), F.when(F.col("km2") >= least, over).alias("intentional"),
    )


def continuity(features: DataFrame, base: Column) -> DataFrame:
    """(base, name, start_year, problem): overlaps and gaps between the periods of one name."""
    f = features.withColumn("base", base)
    before = F.lag("end_year").over(Window.partitionBy("base").orderBy("start_year", "end_year"))
    told = F.when(before >= F.col("start_year"), "overlap").when(before < F.col("start_year") - 1, "gap")
    return f.withColumn("problem", told).where("problem IS NOT NULL").select("base", "name", "start_year", "problem")


def decades_of(features: DataFrame, min_year: int, max_year: int) -> DataFrame:
    """A copy of each feature for every decade it touches, clamped to the years shown."""
    first, last = T.decade_floor(F.greatest(F.col("start_year"), F.lit(min_year))), T.decade_floor(F.least(F.col("end_year"), F.lit(max_year)))
    return features.where((F.col("start_year") <= max_year) & (F.col("end_year") >= min_year)).withColumn("decade", F.explode(F.sequence(first, last, F.lit(10))))


def measure_points(points: DataFrame, features: DataFrame, search_km: float = 10.0) -> DataFrame:
    """(id, km, shape): the nearest border edge within ``search_km`` of each reference point."""
    s = segments(features)
    pad = search_km / 100
    cells = J.box_cells(F.least("ax", "bx") - pad, F.least("ay", "by") - pad, F.greatest("ax", "bx") + pad, F.greatest("ay", "by") + pad, CELL)
    near = points.withColumn("_cell", J.point_cell(F.col("lon"), F.col("lat"), CELL)).join(s.withColumn("_cell", F.explode(cells)), "_cell")
    near = near.withColumn("d", S.segment_km(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("d") <= search_km)
    best = near.groupBy("id").agg(F.min(F.struct("d", "name")).alias("best"))
    return points.select("id").join(best, "id", "left").select("id", F.col("best.d").alias("km"), F.col("best.name").alias("shape"))


SHARED_KM = 0.3


def shared_segments(edges: DataFrame, features: DataFrame, shared_km: float = SHARED_KM, size: float = CELL) -> DataFrame:
    """``edges`` (as ``segments`` gives them) that another feature shares in some years: (other, first_year, last_year) for each such feature.

    An edge is shared where its middle lies in the other feature, or no further than ``shared_km`` from one of its edges;
    what is left over is coast, or the end of what is mapped. Middles meet features and edges by grid cell."""
    key = ["name", "start_year", "end_year", "part", "ring", "seg"]
    middles = edges.select(*key, ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"))
    of = ("name", "start_year", "end_year")
    theirs = features.select(*(F.col(c).alias(f"other_{c}") for c in of), "polygons")
    inside = features_at(middles, theirs, "mx", "my", size).select(*key, *(f"other_{c}" for c in of))
    pad = shared_km / 100
    wide = pad / F.greatest(F.lit(0.02), F.cos(F.radians(F.greatest(F.abs("ay"), F.abs("by")) + pad)))
    cells = J.box_cells(F.least("ax", "bx") - wide, F.least("ay", "by") - pad, F.greatest("ax", "bx") + wide, F.greatest("ay", "by") + pad, size)
    lines = segments(features).withColumn("_cell", F.explode(cells)).select(*(F.col(c).alias(f"other_{c}") for c in of), "ax", "ay", "bx", "by", "_cell")
    near = middles.withColumn("_cell", J.point_cell(F.col("mx"), F.col("my"), size)).join(lines, "_cell")
    near = near.where(S.segment_km(F.col("mx"), F.col("my"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= shared_km).select(inside.columns)
    years = F.greatest("start_year", "other_start_year").alias("first_year"), F.least("end_year", "other_end_year").alias("last_year")
    both = inside.unionByName(near).where((F.col("other_name") != F.col("name")) | (F.col("other_start_year") != F.col("start_year")))
    return both.select(*key, F.col("other_name").alias("other"), *years).where("first_year <= last_year").distinct()


def measure_shared(points: DataFrame, features: DataFrame, search_km: float = 10.0, shared_km: float = SHARED_KM, size: float = CELL) -> DataFrame:
    """(id, year, km, between): the nearest edge that two features share in a point's year, within ``search_km``, and which two meet there; nulls where there is none.

    ``points``: (id, lon, lat, year). An edge that is nearer, but of one feature alone, is passed over. Each edge near
    some point is looked at once, however many points and years it is near."""
    s = segments(features)
    pad = search_km / 100
    wide = pad / F.greatest(F.lit(0.02), F.cos(F.radians(F.greatest(F.abs("ay"), F.abs("by")) + pad)))
    cells = J.box_cells(F.least("ax", "bx") - wide, F.least("ay", "by") - pad, F.greatest("ax", "bx") + wide, F.greatest("ay", "by") + pad, size)
    met = points.withColumn("_cell", J.point_cell(F.col("lon"), F.col("lat"), size)).join(s.withColumn("_cell", F.explode(cells)), "_cell").where(F.col("year").between(F.col("start_year"), F.col("end_year")))
    near = met.withColumn("d", S.segment_km(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("d") <= search_km).drop("_cell")
    near = settle(near)
    key = ["name", "start_year", "end_year", "part", "ring", "seg"]
    shared = shared_segments(near.select(*key, "ax", "ay", "bx", "by").distinct(), features, shared_km, size)
    found = near.join(shared, key).where(F.col("year").between(F.col("first_year"), F.col("last_year")))
    best = found.groupBy("id", "year").agg(F.min(F.struct(F.round("d", 9).alias("d"), F.array_sort(F.array("name", "other")).alias("between"))).alias("best"))
    return points.select("id", "year").join(best, ["id", "year"], "left").select("id", "year", F.col("best.d").alias("km"), F.col("best.between").alias("between"))


def split_periods(features: DataFrame, cuts: DataFrame, key: str = "cell") -> DataFrame:
    """Features cut at the years of ``cuts`` (key, year): one row for each sub-interval (sub_start, sub_end)."""
    years = cuts.groupBy(key).agg(F.collect_set("year").alias("cut_years"))
    joined = features.join(years, key, "left")
    inner = F.filter(F.coalesce("cut_years", F.array()), lambda y: (y > F.col("start_year")) & (y <= F.col("end_year")))
    starts = F.array_sort(F.array_distinct(F.concat(F.array("start_year"), inner)))
    spans = F.transform(starts, lambda s, i: F.struct(s.alias("sub_start"), F.coalesce(F.get(starts, i + 1) - 1, F.col("end_year")).alias("sub_end")))
    return joined.withColumn("_span", F.explode(spans)).select(*features.columns, "_span.sub_start", "_span.sub_end")


def resolve_properties(parts: DataFrame, flags: DataFrame, splits: DataFrame, key: str = "cell") -> DataFrame:
    """Sub-intervals with the label that holds in their first year: a flag's, else a split's, else the name.

    ``flags`` and ``splits``: (key, from_year, to_year, label)."""
    out = parts
    for name, table in (("_flag", flags), ("_split", splits)):
        t = table.select(F.col(key).alias("_k"), "from_year", "to_year", F.col("label").alias(name))
        out = out.join(t, (F.col(key) == F.col("_k")) & F.col("sub_start").between(F.col("from_year"), F.col("to_year")), "left").drop("_k", "from_year", "to_year")
    return out.withColumn("label", F.coalesce("_flag", "_split", "name")).drop("_flag", "_split")


def cut_neighbours(features: DataFrame, key: str = "cell") -> DataFrame:
    """Features cut where an overlay of their place begins or ends."""
    over = features.where(F.col("status") == "disputed").select(key, F.explode(F.array(F.col("start_year"), F.col("end_year") + 1)).alias("year"))
    return split_periods(features.where("status IS NULL OR status <> 'disputed'"), over, key)


STATUS_LABELS = {"disputed": "Disputed", "occupied-territory-included": "Includes occupied territory"}


def status_label(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv]), status), status, F.lit(""))


def is_dashed(status: Column) -> Column:
    return F.coalesce(status.rlike("disputed|mandate"), F.lit(False))


def overlay_sets(features: DataFrame, year: int, key: str = "cell") -> DataFrame:
    """(name, overlays): the disputed shapes on top of each other shape of its place in a year."""
    active = features.where(F.lit(year).between(F.col("start_year"), F.col("end_year")))
    over = active.where(F.col("status") == "disputed").groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("overlays"))
    return active.where("status IS NULL OR status <> 'disputed'").join(over, key, "left").select("name", F.coalesce("overlays", F.array().cast("array<string>")).alias("overlays"))


def placeholders(features: DataFrame, group: Column) -> DataFrame:
    """(grp, start_year, end_year, members): one outline for the members of each group that hold in the same years."""
    return features.withColumn("grp", group).groupBy("grp", "start_year", "end_year").agg(F.count("*").alias("members"))


def with_additions(features: DataFrame, additions: DataFrame) -> DataFrame:
    """The features and the entries that have no source record (``added``); columns that one side lacks are null there."""
    return features.withColumn("added", F.lit(False)).unionByName(additions.withColumn("added", F.lit(True)), allowMissingColumns=True)
