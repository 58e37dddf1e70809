"""Queries of joins: parents, relatedness, groups, borders and histories of places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import CLASS_EDGES, INSIDE_SQL, events, features, table
from ..functions import temporal as T
from ..operators import borders as B
from ..operators import duplicates as D
from ..operators import joins as J
from ..operators import relate as R
from ..session import settle
from .registry import query

_EDGES = ", ed AS (SELECT DISTINCT id, parent_qid FROM ev WHERE parent_qid IS NOT NULL AND parent_qid <> wikidata_qid)"
_DAY = "(CAST(date_start AS DATE) - DATE '1970-01-01')"
_HAV = "2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"


@query("f01_part_of", _EDGES + """
SELECT ed.id, ed.parent_qid, o.id AS parent_id, coalesce(o.title, ed.parent_qid) AS label FROM ed LEFT JOIN ev o ON o.wikidata_qid = ed.parent_qid""", "ev")
def part_of(spark, d):
    return R.resolve_part_of(events(spark, d))


@query("f02_includes", _EDGES + """
SELECT o.id AS parent_id, count(*) AS n, string_agg(k.id, ',' ORDER BY k.date_start, k.id) AS children
FROM ed JOIN ev o ON o.wikidata_qid = ed.parent_qid JOIN ev k ON k.id = ed.id GROUP BY o.id""", "ev")
def includes(spark, d):
    return R.includes(events(spark, d)).withColumn("children", F.array_join("children", ","))


_PAIRS = _EDGES + f"""
, sh AS (SELECT DISTINCT a.id, b.id AS other, abs(x.day - y.day)::DOUBLE AS d FROM ed a JOIN ed b ON a.parent_qid = b.parent_qid AND a.id <> b.id
         JOIN (SELECT id, {_DAY} AS day FROM ev) x ON x.id = a.id JOIN (SELECT id, {_DAY} AS day FROM ev) y ON y.id = b.id),
nb AS (SELECT a.id, b.id AS other, {_HAV} AS d FROM ev a JOIN ev b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.5 AND a.location_quality = 'precise' AND b.location_quality = 'precise' WHERE {_HAV} <= 50),
dy AS (SELECT id, {_DAY} AS day FROM ev WHERE date_precision = 'day'),
st AS (SELECT a.id, b.id AS other, abs(a.day - b.day)::DOUBLE AS d FROM dy a JOIN dy b ON a.id <> b.id AND abs(a.day - b.day) <= 183)
"""


@query("f03_shared_parent", _PAIRS + "SELECT id, other, d FROM sh", "ev")
def shared_parent(spark, d):
    return R.shared_parent(events(spark, d))


@query("f04_nearby", _PAIRS + "SELECT id, other, round(d, 4) AS d FROM nb", "ev")
def nearby(spark, d):
    return R.nearby(events(spark, d), places=4)


@query("f05_same_time", _PAIRS + "SELECT id, count(*) AS n, sum(d) AS days FROM st GROUP BY id", "ev")
def same_time(spark, d):
    return R.same_time_sums(events(spark, d)).select("id", "n", F.col("d").alias("days"))


@query("f06_related", _PAIRS + """
, own AS (SELECT ed.id, o.id AS other FROM ed JOIN ev o ON o.wikidata_qid = ed.parent_qid), known AS (SELECT id, other FROM own UNION SELECT other, id FROM own),
g1 AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d NULLS LAST, other) AS place FROM sh WHERE (id, other) NOT IN (SELECT (id, other) FROM known)),
t1 AS (SELECT id, other, place FROM g1 WHERE place <= 5),
g2 AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d, other) AS place FROM nb WHERE (id, other) NOT IN (SELECT (id, other) FROM known) AND (id, other) NOT IN (SELECT (id, other) FROM t1)),
t2 AS (SELECT id, other, place FROM g2 WHERE place <= 5),
g3 AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d, other) AS place FROM st WHERE (id, other) NOT IN (SELECT (id, other) FROM known)
       AND (id, other) NOT IN (SELECT (id, other) FROM t1) AND (id, other) NOT IN (SELECT (id, other) FROM t2))
SELECT id, other, 'shared_parent' AS grp, place FROM t1 UNION ALL SELECT id, other, 'nearby', place FROM t2 UNION ALL SELECT id, other, 'same_time', place FROM g3 WHERE place <= 5""", "ev")
def related(spark, d):
    return R.related(events(spark, d))


@query("f07_group_closure", _EDGES + """
, cl AS (SELECT id, parent_qid AS group_qid FROM ed UNION SELECT cl.id, ed.parent_qid FROM cl JOIN ev o ON o.wikidata_qid = cl.group_qid JOIN ed ON ed.id = o.id)
SELECT id, group_qid FROM cl""", "ev")
def group_closure(spark, d):
    return R.group_closure(events(spark, d))


_GROUPS = _EDGES + """
, cl AS (SELECT id, parent_qid AS group_qid FROM ed UNION SELECT cl.id, ed.parent_qid FROM cl JOIN ev o ON o.wikidata_qid = cl.group_qid JOIN ed ON ed.id = o.id),
mb AS (SELECT group_qid, id FROM cl UNION SELECT wikidata_qid, id FROM ev), sz AS (SELECT group_qid, count(*) AS size FROM mb GROUP BY 1)
"""


@query("f08_widest_groups", _GROUPS + """
, sm AS (SELECT mb.group_qid, mb.id, size FROM mb JOIN sz USING (group_qid) WHERE size <= 60),
hd AS (SELECT a.group_qid AS a, b.group_qid AS b FROM sm a JOIN sm b ON a.id = b.id AND a.group_qid <> b.group_qid GROUP BY a.group_qid, b.group_qid, a.size, b.size
       HAVING count(*) = a.size AND (b.size > a.size OR b.group_qid < a.group_qid)),
ow AS (SELECT cl.id, cl.group_qid, size FROM cl JOIN sz USING (group_qid)),
us AS (SELECT * FROM ow WHERE size <= 60 AND NOT EXISTS (SELECT 1 FROM hd JOIN ow o2 ON o2.id = ow.id AND o2.group_qid = hd.b AND o2.size <= 60 WHERE hd.a = ow.group_qid))
SELECT id, group_qid, size FROM us UNION ALL
SELECT id, group_qid, size FROM ow WHERE id NOT IN (SELECT id FROM us) AND size = (SELECT min(o3.size) FROM ow o3 WHERE o3.id = ow.id)""", "ev")
def widest_groups(spark, d):
    return R.widest_groups(events(spark, d))


@query("f10_via_groups", _GROUPS + """
SELECT group_qid, count(*) AS size, arg_min(mb.id, struct_pack(d := date_start, i := mb.id)) AS first_id FROM mb JOIN ev ON ev.id = mb.id GROUP BY 1 HAVING count(*) >= 3""", "ev")
def via_groups(spark, d):
    return R.via_groups(events(spark, d))


@query("f09_neighbours", """
, tg AS (SELECT id, CAST(substr(date_start, 1, 4) AS INT) AS y, unnest(countries) AS c FROM ev)
SELECT a.id, count(DISTINCT b.id) AS n FROM tg a JOIN tg b ON a.c = b.c AND abs(a.y - b.y) <= 1 AND a.id <> b.id GROUP BY a.id""", "ev")
def neighbours(spark, d):
    return R.neighbours(events(spark, d))


@query("f12_country_shapes", """
SELECT ev.id, ft.name, ft.start_year FROM (SELECT id, CAST(substr(date_start, 1, 4) AS INT) AS y, unnest(countries) AS c FROM ev) ev
JOIN ft ON (ft.name = c OR ft.name = c || ' (phase 1)') AND y BETWEEN start_year AND end_year""", "ev ft")
def country_shapes(spark, d):
    shapes = features(spark, d).where("status IS NULL OR status <> 'disputed'").select("name", "start_year", "end_year", F.replace("name", F.lit(" (phase 1)"), F.lit("")).alias("country"))
    tags = events(spark, d).select("id", T.year_of("date_start").alias("y"), F.explode("countries").alias("country"))
    return J.interval_join(tags, shapes, "country", "y", "start_year", "end_year").select("id", "name", "start_year")


@query("f15_place_history", f"""
, hit AS (SELECT id, name, status, start_year, end_year FROM ev JOIN ft ON {INSIDE_SQL.format(x='lon', y='lat')}),
yr AS (SELECT id, name, status, unnest(generate_series(greatest(start_year, 1994), least(end_year, 2002))) AS year FROM hit WHERE end_year >= 1994 AND start_year <= 2002),
fo AS (SELECT *, max(CASE WHEN status IS NOT NULL AND ends_with(status, '-included') THEN 0 ELSE 1 END) OVER (PARTITION BY id, year) AS over_one FROM yr),
sh AS (SELECT id, year, array_to_string(list_sort(list(DISTINCT name)), ' + ') AS names FROM fo WHERE NOT (over_one = 1 AND status IS NOT NULL AND ends_with(status, '-included')) GROUP BY 1, 2),
fu AS (SELECT ev.id, g.year, coalesce(names, '') AS names FROM ev CROSS JOIN (SELECT unnest(generate_series(1994, 2002)) AS year) g LEFT JOIN sh ON sh.id = ev.id AND sh.year = g.year),
ru AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY year) AS run FROM (SELECT *, CASE WHEN lag(names) OVER (PARTITION BY id ORDER BY year) = names THEN 0 ELSE 1 END AS fresh FROM fu))
SELECT id, names, min(year) AS start, max(year) AS "end" FROM ru GROUP BY id, names, run""", "ev ft")
def place_history(spark, d):
    return B.place_history(events(spark, d), features(spark, d), 1994, 2002)


@query("f16_events_near", f"""
SELECT b.id, b.title, b.date_start, floor({_HAV} * 10 + 0.5) / 10 AS km FROM (SELECT 20.0::DOUBLE AS lon, 10.0::DOUBLE AS lat) a JOIN ev b ON b.location_quality = 'precise' WHERE {_HAV} <= 600""", "ev")
def events_near(spark, d):
    return R.events_near(events(spark, d), 20, 10, 600).select("id", "title", "date_start", "km")


@query("f17_pin_check", f"""
, tg AS (SELECT id, lon, lat, CAST(substr(date_start, 1, 4) AS INT) AS y, unnest(countries) AS c FROM ev WHERE location_quality = 'precise')
SELECT id, bool_or({INSIDE_SQL.format(x='lon', y='lat')}) AS inside FROM tg JOIN ft ON (ft.name = c OR ft.name = c || ' (phase 1)') AND y BETWEEN start_year AND end_year GROUP BY id""", "ev ft")
def pin_check(spark, d):
    f = features(spark, d).where("status IS NULL OR status <> 'disputed'")
    names = f.select(F.replace("name", F.lit(" (phase 1)"), F.lit("")).alias("country"), F.col("name").alias("shape")).distinct()
    return B.pin_check(events(spark, d), f, names, tolerance_km=0.0, reach_deg=0.0)


@query("f19_duplicate_hints", """
, q AS (SELECT DISTINCT id, unnest([wikidata_qid, resolved_qid]) AS q FROM ev), g AS (SELECT id, min(id) OVER (PARTITION BY q) AS first FROM q), h AS (SELECT id, min(id) OVER (PARTITION BY title) AS first FROM ev),
u AS (SELECT first AS id, id AS other, '1 same item' AS reason FROM g WHERE id <> first UNION ALL SELECT first, id, '2 same title' FROM h WHERE id <> first)
SELECT id, other, min(reason) AS reason FROM u GROUP BY id, other""", "ev")
def duplicate_hints(spark, d):
    return D.duplicate_hints(events(spark, d))


@query("f20_pruned_hints", """
, h AS (SELECT id, min(id) OVER (PARTITION BY title) AS first FROM ev)
SELECT first AS id, id AS other FROM h WHERE id <> first AND id IN (SELECT id FROM ev WHERE sitelinks_current >= 10)""", "ev")
def pruned_hints(spark, d):
    e = events(spark, d)
    from pyspark.sql.window import Window

    hints = e.select("id", F.min("id").over(Window.partitionBy("title")).alias("first")).where("id <> first").select(F.col("first").alias("id"), F.col("id").alias("other"))
    return D.prune_hints(hints, e.where("sitelinks_current >= 10")).select("id", "other")


_SEG = """
, bx AS (SELECT name, start_year, CASE WHEN overlay = 1 THEN x0 + 4 ELSE x0 END AS w, CASE WHEN overlay = 1 THEN y0 + 3 ELSE y0 END AS s, CASE WHEN overlay = 1 THEN x0 + 9 WHEN cell % 6 = 0 THEN x0 + 7 ELSE x0 + 18 END AS e,
         CASE WHEN overlay = 1 THEN y0 + 8 ELSE y0 + 11.2 END AS n, overlay, cell, x0, y0 FROM ft)"""


@query("c19_ring_crossings", _SEG + "SELECT name, start_year FROM bx WHERE w > e", "ft")
def ring_crossings(spark, d):
    return B.crossings(features(spark, d)).select("name", "start_year")


@query("f31_reference_points", """
, p AS (SELECT k AS id, x0 + 9 AS lon, y0 + 0.02 AS lat FROM fn WHERE k % 6 <> 0)
SELECT CAST(id AS BIGINT) AS id, round(0.02 * pi() * 6371 / 180, 3) AS km FROM p""", "ft")
def reference_points(spark, d):
    cells = features(spark, d).where("start_year = 1995 AND cell % 6 <> 0")
    points = cells.select(F.col("cell").cast("long").alias("id"), (F.col("x0") + 9).alias("lon"), (F.col("y0") + 0.02).alias("lat"))
    return B.measure_points(points, features(spark, d)).select("id", F.round("km", 3).alias("km"))


@query("f33_overlaps", """
SELECT a.name AS a, b.name AS b, greatest(a.start_year, b.start_year) AS first_year, least(a.end_year, b.end_year) AS last_year, true AS intentional
FROM ft a JOIN ft b ON a.cell = b.cell AND a.name < b.name AND a.start_year <= b.end_year AND b.start_year <= a.end_year AND a.overlay + b.overlay = 1 AND a.cell % 4 = 0""", "ft")
def overlaps(spark, d):
    return B.same_year_overlaps(features(spark, d)).select("a", "b", "first_year", "last_year", "intentional")


@query("f35_class_closure", """
WITH RECURSIVE e(child, parent) AS (VALUES ('battle','conflict'),('war','conflict'),('bombing','violence'),('protest movement','civic'),('treaty','civic'),('election','civic'),('conflict','event'),('violence','event'),('civic','event')),
c AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.parent),
m AS (SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'battle' WHEN 'ECONOMY' THEN 'treaty' WHEN 'PROMO' THEN 'protest movement' WHEN 'LARGE' THEN 'war' WHEN 'SMALL' THEN 'bombing' ELSE 'election' END AS cls FROM part)
SELECT parent AS class, count(*) AS n FROM m JOIN c ON c.child = cls GROUP BY 1""")
def class_closure(spark, d):
    edges = spark.createDataFrame(list(CLASS_EDGES), "child string, parent string")
    known = front = edges
    while not front.isEmpty():
        up = edges.select(F.col("child").alias("parent"), F.col("parent").alias("up"))
        front = settle(front.join(up, "parent").select("child", F.col("up").alias("parent")).distinct().join(known, ["child", "parent"], "left_anti"))
        known = settle(known.unionByName(front))
    from ..adapters import _class_label

    parts = table(spark, d, "part").select(_class_label(F.col("p_type")).alias("child"))
    counted = parts.groupBy("child").agg(F.count("*").alias("k"))  # a row for each class: joined as it is, whatever the size of the closed table
    return counted.join(known, "child").groupBy(F.col("parent").alias("class")).agg(F.sum("k").alias("n"))


@query("f36_location_union", """
SELECT DISTINCT id, country FROM (SELECT 'o-' || o_orderkey AS id, n_name AS country FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'o-' || o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""")
def location_union(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    key = F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id")
    orders = table(spark, d, "orders")
    via_lines = orders.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    direct = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return via_lines.select(key, "country").unionByName(direct.select(key, "country")).distinct()


@query("h04_continuity", """
, b AS (SELECT replace(name, ' (phase 1)', '') AS base, name, start_year, lag(end_year) OVER (PARTITION BY replace(name, ' (phase 1)', '') ORDER BY start_year, end_year) AS prev FROM ft)
SELECT base, name, start_year, CASE WHEN prev >= start_year THEN 'overlap' ELSE 'gap' END AS problem FROM b WHERE prev >= start_year OR prev < start_year - 1""", "ft")
def continuity(spark, d):
    return B.continuity(features(spark, d), F.replace("name", F.lit(" (phase 1)"), F.lit("")))


@query("a09_decade_store", """
SELECT name, start_year, unnest(generate_series((greatest(start_year, 1990) // 10) * 10, (least(end_year, 2025) // 10) * 10, 10)) AS decade FROM ft""", "ft")
def decade_store(spark, d):
    return B.decades_of(features(spark, d), 1990, 2025).select("name", "start_year", F.col("decade").cast("long").alias("decade"))


@query("m01_split_periods", """
, c AS (SELECT cell, name, start_year, end_year, list_sort(list_distinct(list_prepend(start_year, list_filter([1996, 2000 + cell % 2], lambda y: y > start_year AND y <= end_year)))) AS s FROM ft),
u AS (SELECT *, unnest(generate_series(1, len(s))) AS i FROM c)
SELECT name, start_year, s[i] AS sub_start, coalesce(s[i + 1] - 1, end_year) AS sub_end FROM u""", "ft")
def split_periods(spark, d):
    f = features(spark, d)
    cuts = f.select("cell", F.explode(F.array(F.lit(1996), (F.lit(2000) + F.col("cell") % 2).cast("int"))).alias("year")).distinct()
    return B.split_periods(f, cuts).select("name", "start_year", "sub_start", "sub_end")


@query("m05_active_features", f"""
, hit AS (SELECT id, name, status FROM ev JOIN ft ON {INSIDE_SQL.format(x='lon', y='lat')} WHERE 1999 BETWEEN start_year AND end_year),
fo AS (SELECT *, max(CASE WHEN status IS NOT NULL AND ends_with(status, '-included') THEN 0 ELSE 1 END) OVER (PARTITION BY id) AS over_one FROM hit)
SELECT id, name FROM fo WHERE NOT (over_one = 1 AND status IS NOT NULL AND ends_with(status, '-included'))""", "ev ft")
def active_features(spark, d):
    return B.records_at(events(spark, d).select("id", "lon", "lat"), features(spark, d), 1999).select("id", "name")
