"""Queries of shared borders, overlaps, country tags from places and predecessor states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import INSIDE_SQL, features, table
from ..operators import borders as B
from .registry import query


@query("f31_shared_borders", """
, p AS (SELECT c_custkey AS id, CAST(c_custkey % 25 AS INT) AS k, c_custkey % 2 AS corner, CASE c_custkey % 3 WHEN 0 THEN 1996 WHEN 1 THEN 2005 ELSE 1990 END AS year, 0.01 + (c_custkey % 7) / 200.0 AS o FROM customer),
q AS (SELECT p.*, x0, y0, n_name, (SELECT n_name FROM fn f WHERE f.k = p.k + 1 AND p.k % 5 < 4) AS east, (SELECT n_name FROM fn f WHERE f.k = p.k - 5) AS south, CASE WHEN year = 1996 THEN ' (phase 1)' ELSE '' END AS tail FROM p JOIN fn USING (k)),
r AS (SELECT *, CASE WHEN year = 1990 THEN NULL WHEN corner = 1 AND south IS NOT NULL THEN south ELSE east END AS other FROM q)
SELECT id, CAST(year AS INT) AS year, CASE WHEN other IS NULL THEN NULL WHEN corner = 1 AND other = south THEN round(0.004 * pi() * 6371 / 180, 4)
  ELSE round((CASE WHEN corner = 1 THEN 0.05 ELSE o END) * cos(radians(y0 + CASE WHEN corner = 1 THEN 0.004 ELSE 5.6 END)) * pi() * 6371 / 180, 4) END AS km,
  CASE WHEN other IS NOT NULL THEN array_to_string(list_sort([n_name || tail, other || tail]), ' + ') END AS between FROM r""", "ft")  # fmt: skip
def shared_borders(spark, d):
    """Points beside the eastern edge of a cell, or in its south-eastern corner, where the southern edge is nearer but may be coast."""
    c = F.col("c_custkey")
    at = table(spark, d, "customer").select(c.alias("id"), (c % 25).cast("int").alias("cell"), (c % 2 == 1).alias("corner"), F.when(c % 3 == 0, 1996).when(c % 3 == 1, 2005).otherwise(1990).alias("year"), (F.lit(0.01) + (c % 7) / 200.0).alias("o"))
    f = features(spark, d)
    cells = f.select("cell", "x0", "y0").distinct()
    points = at.join(cells, "cell").select("id", "year", (F.col("x0") + 18 - F.when(F.col("corner"), 0.05).otherwise(F.col("o"))).alias("lon"), (F.col("y0") + F.when(F.col("corner"), 0.004).otherwise(5.6)).alias("lat"))
    return B.measure_shared(points, f).select("id", "year", F.round("km", 4).alias("km"), F.array_join("between", " + ").alias("between"))


@query("f33_overlap_areas", """
, s AS (SELECT *, y0 + 3 AS bottom, y0 + 8 AS top, CASE WHEN cell % 6 = 0 THEN 3.0 ELSE 5.0 END AS width FROM ft WHERE overlay = 1)
SELECT least(f.name, s.name) AS a, greatest(f.name, s.name) AS b, greatest(f.start_year, s.start_year) AS first_year, least(f.end_year, s.end_year) AS last_year,
  round(6371.0088 ** 2 * radians(width) * (sin(radians(top)) - sin(radians(bottom))), 3) AS km2, 1 AS parts, 0 AS slivers, true AS intentional
FROM s JOIN ft f ON f.cell = s.cell AND f.overlay = 0 AND f.start_year <= s.end_year AND s.start_year <= f.end_year""", "ft")
def overlap_areas(spark, d):
    return B.overlap_findings(features(spark, d)).withColumn("km2", F.round("km2", 3))


@query("f33_crossed_areas", """
WITH c AS (SELECT c_custkey AS k, (c_custkey % 64) * 2.0 - 64 AS x, (c_custkey // 64 % 32) * 2.0 - 32 AS y FROM customer)
SELECT 'Area ' || k AS a, 'Band ' || k AS b, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS slivers, CASE WHEN k % 3 <> 1 THEN false END AS intentional,
  CAST(CASE WHEN k % 3 = 0 THEN 0.5 WHEN k % 3 = 1 THEN 0.0 ELSE 0.25 END AS DOUBLE) AS square_degrees FROM c WHERE k < 2048""")
def crossed_areas(spark, d):
    """A square and a band over it: one that a gap cuts in two, a sliver, and a triangle; the areas in square degrees, as their latitude allows."""
    k = F.col("c_custkey").cast("long")
    at = table(spark, d, "customer").where(k < 2048).select(k.alias("k"), ((k % 64) * 2.0 - 64).alias("x"), ((F.floor(k / 64) % 32) * 2.0 - 32).alias("y"))

    def ring(*points):
        return F.array(*(F.struct((F.col("x") + px).alias("lon"), (F.col("y") + py).alias("lat")) for px, py in points))

    area = at.select(F.concat(F.lit("Area "), "k").alias("name"), "k", F.array(F.array(ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))).alias("polygons"))
    two = F.array(F.array(ring((-0.25, 0), (0.25, 0), (0.25, 1), (-0.25, 1), (-0.25, 0))), F.array(ring((0.75, 0), (1.25, 0), (1.25, 1), (0.75, 1), (0.75, 0))))
    sliver = F.array(F.array(ring((0.999, 0.999), (1.2, 0.999), (1.2, 1.2), (0.999, 1.2), (0.999, 0.999))))
    triangle = F.array(F.array(ring((0.5, 0.5), (1.5, -0.5), (1.5, 1.5), (0.5, 0.5))))
    band = at.select(F.concat(F.lit("Band "), "k").alias("name"), "k", F.when(F.col("k") % 3 == 0, two).when(F.col("k") % 3 == 1, sliver).otherwise(triangle).alias("polygons"))
    both = area.unionByName(band).select("name", F.lit(None).cast("string").alias("status"), F.lit(1990).alias("start_year"), F.lit(1999).alias("end_year"), "polygons")
    found = B.overlap_findings(both).where("split(a, ' ')[1] = split(b, ' ')[1]").join(at.select(F.concat(F.lit("Area "), "k").alias("a"), (F.col("y") + 0.5).alias("middle")), "a")
    degrees = F.col("km2") / (F.lit(111.19508) ** 2 * F.cos(F.radians("middle")))
    return found.select("a", "b", "parts", "slivers", "intentional", F.round(degrees, 2).alias("square_degrees"))


@query("g21_stabbing_years", """
WITH RECURSIVE p AS (SELECT DISTINCT 1900 + c_custkey % 97 AS s, 1900 + c_custkey % 97 + c_custkey % 13 AS e FROM customer), q AS (SELECT s, least(e, (SELECT max(s) FROM p)) AS e FROM p),
g(year) AS (SELECT min(e) FROM q UNION ALL SELECT (SELECT min(e) FROM q WHERE s > g.year) FROM g WHERE (SELECT min(e) FROM q WHERE s > g.year) IS NOT NULL)
SELECT CAST(year AS BIGINT) AS year FROM g""")
def stabbing_years(spark, d):
    from ..operators import report as G

    k = F.col("c_custkey")
    return G.minimum_years(table(spark, d, "customer").select((k % 97 + 1900).alias("start_year"), (k % 97 + 1900 + k % 13).alias("end_year")), close_open=True)


def _places(spark, d):
    """(claims, within): every fourth supplier is a place with countries of its own, the others lie in the one before; some lie in each other."""
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    own = rows.where(s % 4 == 0)
    outside = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("Other "), i.cast("string")))
    claims = own.select(s.alias("place"), F.col("n_name").alias("country"), F.lit(True).alias("tracked"), F.lit(True).alias("sovereign"))
    others = own.select(s.alias("place"), F.explode(F.slice(outside, F.lit(1), (s % 3).cast("int"))).alias("country"), F.lit(False).alias("tracked"), F.lit(True).alias("sovereign"))
    former = own.where(s % 8 == 0).select(s.alias("place"), F.lit("Former").alias("country"), F.lit(False).alias("tracked"), F.lit(False).alias("sovereign"))
    within = rows.where(s % 4 != 0).select(s.alias("place"), F.when(s % 20 == 13, s + 1).otherwise(s - 1).alias("parent"))
    return claims.unionByName(others).unionByName(former), within


ROOTS = """
roots AS (SELECT s_suppkey AS place, n_name, CASE WHEN s_suppkey % 20 IN (13, 14, 15) THEN NULL ELSE s_suppkey - s_suppkey % 4 END AS root FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tags AS (SELECT r.place, r.root, o.n_name AS tag, r.root % 3 AS outside FROM roots r JOIN roots o ON o.place = r.root)"""


@query("f28_place_tags", "WITH" + ROOTS + """
SELECT place, 1 AS inside, outside, outside <= 1 AS lends, tag AS tags FROM tags""")
def place_tags(spark, d):
    from ..operators import places as P

    return P.place_tags(*_places(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query("f28_outside_tags", "," + ROOTS + """,
lies AS (SELECT DISTINCT l_orderkey AS n, l_suppkey AS place FROM lineitem), g AS (SELECT DISTINCT n, tag, outside <= 1 AS lends FROM lies JOIN tags USING (place)),
t AS (SELECT id, n, countries, CASE WHEN n % 7 = 0 THEN [] ELSE countries[1:1] END AS direct, unnest(list_concat(countries, ['-'])) AS c FROM ev),
r AS (SELECT t.*, c <> '-' AND NOT list_contains(direct, c) AND EXISTS (SELECT 1 FROM g WHERE g.n = t.n AND tag = c AND NOT lends) AND NOT EXISTS (SELECT 1 FROM g WHERE g.n = t.n AND tag = c AND lends) AS out FROM t)
SELECT id, coalesce(string_agg(c, ',' ORDER BY c) FILTER (out), '') AS removed, coalesce(string_agg(c, ',' ORDER BY c) FILTER (NOT out AND c <> '-'), '') AS countries FROM r GROUP BY id""", "ev")
def outside_tags(spark, d):
    from ..adapters import events
    from ..operators import places as P

    direct = F.when(F.col("n") % 7 == 0, F.array().cast("array<string>")).otherwise(F.slice("countries", 1, 1))
    at = table(spark, d, "lineitem").select(F.concat(F.lit("o-"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_suppkey").alias("place"))
    out = P.outside_tags(events(spark, d).select("id", "countries", direct.alias("direct")), at, P.place_tags(*_places(spark, d)))
    return out.select("id", F.array_join("removed", ",").alias("removed"), F.array_join("countries", ",").alias("countries"))


@query("f29_predecessor_tags", f"""
, pe AS (SELECT id, n, lon, lat, 'OLD_' || (n % 10) AS state FROM ev WHERE n % 3 = 0 AND n % 10 < 7),
pt AS (SELECT DISTINCT id, 'point' AS kind, '' AS value, replace(ft.name, ' (phase 1)', '') AS c FROM pe JOIN ft ON overlay = 0 AND 2005 BETWEEN start_year AND end_year AND {INSIDE_SQL.format(x="lon", y="lat")}),
pl AS (SELECT DISTINCT id, 'place' AS kind, CAST(l_suppkey AS VARCHAR) AS value, n_name AS c FROM pe JOIN lineitem ON l_orderkey = n JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 6 <> 0),
v AS (SELECT id, kind, value, string_agg(c, '+' ORDER BY c) AS cs FROM (SELECT * FROM pt UNION ALL SELECT * FROM pl) GROUP BY ALL),
w AS (SELECT id, string_agg(kind || ' ' || value || '=' || cs, ';' ORDER BY kind DESC, value) AS via FROM v GROUP BY id),
x AS (SELECT id, string_agg(DISTINCT c, ',' ORDER BY c) AS countries FROM (SELECT * FROM pt UNION ALL SELECT * FROM pl) GROUP BY id)
SELECT pe.id, state AS predecessors, coalesce(via, '') AS via, coalesce(countries, '') AS countries FROM pe LEFT JOIN w USING (id) LEFT JOIN x USING (id)""", "ev ft")
def predecessor_tags(spark, d):
    from ..adapters import events
    from ..operators import places as P

    n = F.col("n")
    states = F.when(n % 3 == 0, F.array(F.concat(F.lit("OLD_"), (n % 10).cast("string")), F.lit("Other"))).otherwise(F.array(F.lit("Other")))
    former = table(spark, d, "nation").where("n_nationkey < 7").select(F.concat(F.lit("OLD_"), F.col("n_nationkey").cast("string")).alias("state"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    claims = s.select(F.col("s_suppkey").alias("place"), F.when(F.col("s_suppkey") % 6 == 0, "OLD_1").otherwise(F.col("n_name")).alias("country"), F.lit(True).alias("tracked"))
    at = table(spark, d, "lineitem").select(F.concat(F.lit("o-"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_suppkey").alias("place"))
    f = features(spark, d).where("status IS NULL OR status <> 'disputed'")
    names = f.select(F.replace("name", F.lit(" (phase 1)"), F.lit("")).alias("country"), F.col("name").alias("shape")).distinct()
    out = P.predecessor_tags(events(spark, d).select("id", "lon", "lat", states.alias("states")), former, at, claims, f, names, 2005)
    told = F.transform("via", lambda v: F.concat(v["kind"], F.lit(" "), F.when(v["kind"] == "point", "").otherwise(v["value"]), F.lit("="), F.array_join(v["countries"], "+")))
    return out.select("id", F.array_join("predecessors", ",").alias("predecessors"), F.array_join(F.concat(F.filter(told, lambda t: F.startswith(t, F.lit("point"))), F.filter(told, lambda t: F.startswith(t, F.lit("place")))), ";").alias("via"), F.array_join("countries", ",").alias("countries"))


def _areas(spark, d):
    """An area for each customer, over two spans of years: whole squares, bow ties, rings left open and rings of three positions; every fifth name has a gap, every seventh an overlap in years.

    Areas of two customers share nothing, as the SQL has it: each key up to 44 million has a place of its own."""
    k = F.col("c_custkey").cast("long")
    at = table(spark, d, "customer").select(k.alias("k"), ((k % 11520) / 32 - 180).alias("x"), ((F.floor(k / 11520) % 3840) / 32 - 60).alias("y"))

    def ring(*points):
        return F.array(*(F.struct((F.col("x") + px * 3 / 128).alias("lon"), (F.col("y") + py * 3 / 128).alias("lat")) for px, py in points))

    square, tie = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))
    open_, short = ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((0, 0), (1, 0), (0, 0))
    shape = F.when(F.col("k") % 11 == 3, tie).when(F.col("k") % 11 == 5, open_).when(F.col("k") % 11 == 7, short).otherwise(square)
    first = F.struct(F.lit(1990).alias("start_year"), F.lit(1994).alias("end_year"))
    second = F.struct(F.when(F.col("k") % 5 == 0, 1996).when(F.col("k") % 7 == 0, 1994).otherwise(1995).alias("start_year"), F.lit(1999).alias("end_year"))
    return at.select("k", F.concat(F.lit("Area "), F.col("k").cast("string")).alias("name"), F.lit(None).cast("string").alias("status"), F.array(F.array(shape)).alias("polygons"), F.inline(F.array(first, second)))


AREAS_SQL = """
WITH c AS (SELECT c_custkey AS k, 'Area ' || c_custkey AS name, CASE WHEN c_custkey % 5 = 0 THEN 1996 WHEN c_custkey % 7 = 0 THEN 1994 ELSE 1995 END AS second FROM customer),
a AS (SELECT k, name, 1990 AS start_year FROM c UNION ALL SELECT k, name, second FROM c),
g AS (SELECT name, start_year, CASE k % 11 WHEN 3 THEN '1 ring crosses itself' WHEN 5 THEN '1 rings not closed' WHEN 7 THEN '1 rings with fewer than 4 positions' END AS finding FROM a)"""


@query("k43_geometry_findings", AREAS_SQL + " SELECT name, start_year, finding FROM g WHERE finding IS NOT NULL")
def geometry_findings(spark, d):
    areas = _areas(spark, d)
    none = areas.where("false").select("name", "start_year", "end_year", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return B.geometry_findings(areas, none).select("name", "start_year", F.concat_ws(" ", "n", "finding").alias("finding"))


@query("k44_border_checks", AREAS_SQL + """
SELECT 'geometry' AS "check", name, start_year, finding FROM g WHERE finding IS NOT NULL
UNION ALL SELECT 'continuity', name, second, CASE WHEN second = 1996 THEN 'gap' ELSE 'overlap' END FROM c WHERE second <> 1995
UNION ALL SELECT 'overlap', name, 1994, 'overlaps ' || name FROM c WHERE second = 1994 AND k % 11 <> 7
UNION ALL SELECT 'baseline', name, start_year, CASE WHEN k % 13 = 0 THEN 'new' WHEN k % 13 = 1 THEN 'fewer vertices' ELSE 'changed' END FROM a WHERE k % 13 < 3
UNION ALL SELECT 'baseline', 'Lost ' || k, 1980, 'gone' FROM c WHERE k % 13 = 5""")
def border_checks(spark, d):
    from ..functions import spatial as S

    areas, p, k = _areas(spark, d), F.col("polygons"), F.col("k")
    none = areas.where("false").select("name", "start_year", "end_year", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    then = areas.where(k % 13 != 0).select(
        F.concat_ws("@", "name", F.col("start_year").cast("string")).alias("key"), (S.vertex_count(p) + F.when(k % 13 == 1, 1).otherwise(0)).alias("vertices"), S.fine_count(p).alias("fine"), F.when(k % 13 == 2, "x").otherwise(S.geometry_hash(p)).alias("sha")
    )
    gone = table(spark, d, "customer").where("c_custkey % 13 = 5").select(F.concat(F.lit("Lost "), F.col("c_custkey").cast("string"), F.lit("@1980")).alias("key"), F.lit(5).alias("vertices"), F.lit(0).alias("fine"), F.lit("y").alias("sha"))
    return B.border_checks(areas.drop("k"), then.unionByName(gone), none, F.col("name"))


@query("j09_changed_geometry", "WITH c AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 10 = 0) SELECT n = 0 AS same, 2 * n AS only_left, n AS only_right FROM c")
def changed_geometry(spark, d):
    """Areas against the same ones, of which every tenth is missing in both spans and has another shape once."""
    from ..operators import compare as C

    areas = _areas(spark, d)
    moved = F.transform("polygons", lambda rings: F.transform(rings, lambda r: F.transform(r, lambda q: F.struct((q["lon"] + 0.25).alias("lon"), q["lat"].alias("lat")))))
    other = areas.where("k % 10 <> 0").unionByName(areas.where("k % 10 = 0 AND start_year = 1990").withColumn("polygons", moved))
    return C.same_geometries(areas, other)
