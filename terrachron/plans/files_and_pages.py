"""Queries of sources, sinks and page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import events, features, table
from ..functions import spatial as S
from ..functions import temporal as T
from ..functions import text as X
from ..operators import compare as C
from ..operators import joins as J
from ..operators import pages as P
from ..operators import report as G
from ..sources import files as A
from .registry import query

NOW = 2001


@query("a01_event_lines", """
SELECT id, title, CASE WHEN n % 2 = 0 THEN sitelinks END AS sitelinks, n % 2 = 0 AS has_sitelinks, CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END AS n_unknown, false AS corrupt FROM ev""", "ev")
def event_lines(spark, d):
    n = F.col("n")
    base = F.to_json(F.struct("id", "title", "date_start", F.col("sitelinks").cast("int").alias("sitelinks")), {"ignoreNullFields": "false"})
    short = F.to_json(F.struct("id", "title", "date_start"))
    odd = F.when(n % 9 == 0, F.concat(F.lit('{"extra":1,'), F.substring(F.when(n % 2 == 0, base).otherwise(short), F.lit(2), F.lit(100000)))).otherwise(F.when(n % 2 == 0, base).otherwise(short))
    rows = A.events_from_lines(events(spark, d).select(odd.alias("value")))
    return rows.select("id", "title", F.col("sitelinks").cast("long").alias("sitelinks"), "has_sitelinks", F.size("unknown_fields").alias("n_unknown"), "corrupt")


@query("a02_feature_lines", "SELECT name, start_year, end_year, CASE WHEN overlay = 0 AND cell % 6 = 0 THEN 2 ELSE 1 END AS n_polygons FROM ft", "ft")
def feature_lines(spark, d):
    coordinates = F.transform("polygons", lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))))
    one, many = F.to_json(F.get(coordinates, F.lit(0))), F.to_json(coordinates)
    single = F.size("polygons") == 1
    line = F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("name", "status", "note", "source", "start_year", "end_year")), F.lit(',"geometry":{"type":"'),
        F.when(single, "Polygon").otherwise("MultiPolygon"), F.lit('","coordinates":'), F.when(single, one).otherwise(many), F.lit("}}"),
    )
    rows = A.features_from_lines(features(spark, d).select(line.alias("value")))
    return rows.select("name", "start_year", "end_year", F.size("polygons").alias("n_polygons"))


@query("a03_entity_claims", """
SELECT 'Q' || (n + 1) AS qid, n % 2 = 0 AS is_war, date_start AS first_time, 11 AS first_precision, round(lat, 6) AS lat, CASE WHEN n % 15 = 0 THEN 'wikidata_novalue' END AS open_end FROM ev""", "ev")
def entity_claims(spark, d):
    n = F.col("n")
    value = lambda body: F.concat(F.lit('[{"rank":"deprecated","mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"Q0","time":"+0001-01-01","precision":9}}}},{"rank":"normal","mainsnak":{"snaktype":"value","datavalue":{"value":'), body, F.lit("}}}]"))
    kind = F.when(n % 2 == 0, '{"id":"Q198"}').otherwise('{"id":"Q131569"}')
    time = F.concat(F.lit('{"time":"+'), "date_start", F.lit('T00:00:00Z","precision":11}'))
    place = F.concat(F.lit('{"latitude":'), F.round("lat", 6).cast("string"), F.lit(',"longitude":'), F.round("lon", 6).cast("string"), F.lit("}"))
    place = F.concat(F.lit('[{"rank":"normal","mainsnak":{"snaktype":"value","datavalue":{"value":'), place, F.lit("}}}]"))
    end = F.when(n % 15 == 0, F.lit(',"P582":[{"rank":"normal","mainsnak":{"snaktype":"novalue"}}]')).otherwise("")
    claims = F.concat(F.lit('{"P31":'), value(kind), F.lit(',"P585":'), value(time), F.lit(',"P625":'), place, end, F.lit("}"))
    rows = A.entity_claims(events(spark, d).select(F.col("wikidata_qid").alias("qid"), claims.alias("claims")))
    first = F.get("times", F.lit(0))
    return rows.select("qid", F.array_contains("p31", "Q198").alias("is_war"), first["time"].alias("first_time"), first["precision"].alias("first_precision"), "lat", "open_end")


@query("a04_split_lists", "SELECT id, array_to_string(list_sort(list_distinct(countries)), ',') AS tags FROM ev", "ev")
def split_lists(spark, d):
    raw = F.concat(F.array_join(F.reverse("countries"), "| "), F.lit("||"), F.get("countries", F.lit(0)))
    return events(spark, d).select("id", raw.alias("raw")).select("id", F.array_join(A.split_list("raw"), ",").alias("tags"))


@query("a06_row_notes", """
, y AS (SELECT *, CAST(substr(date_start, 1, 4) AS INT) AS s, CAST(substr(coalesce(date_end, date_start), 1, 4) AS INT) AS e0, date_end IS NULL AND date_end_open IS NOT NULL AS open FROM ev),
z AS (SELECT *, CASE WHEN open THEN greatest(s, 2001) ELSE e0 END AS e FROM y),
k AS (SELECT *, CASE WHEN e < s THEN s BETWEEN 1997 AND 1998 OR e BETWEEN 1997 AND 1998 ELSE s <= 1998 AND e >= 1997 END AS hit FROM z)
SELECT id, array_to_string(list_filter([CASE WHEN NOT hit THEN 'Outside selected years' END, CASE WHEN s < 1997 THEN 'Ongoing since ' || s END, CASE WHEN e0 < s THEN 'End date before start' END,
  CASE WHEN open THEN 'No end date; ongoing per source' END, CASE location_quality WHEN 'none' THEN 'No map location' WHEN 'approximate' THEN 'Approximate location' END], lambda x: x IS NOT NULL), '; ') AS notes FROM k""", "ev")
def row_notes(spark, d):
    return events(spark, d).select("id", F.array_join(A.row_notes(1997, 1998, NOW), "; ").alias("notes"))


@query("a07_point_features", """
, y AS (SELECT *, CAST(substr(date_start, 1, 4) AS INT) AS s, CASE WHEN date_end IS NULL AND date_end_open IS NOT NULL THEN greatest(CAST(substr(date_start, 1, 4) AS INT), 2001) ELSE CAST(substr(coalesce(date_end, date_start), 1, 4) AS INT) END AS e FROM ev)
SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"id":"' || id || '","title":"' || title || '","y":"' || substr(date_start, 1, 4) || '","m":'
  || CASE WHEN CASE WHEN e < s THEN s BETWEEN 1997 AND 1998 OR e BETWEEN 1997 AND 1998 ELSE s <= 1998 AND e >= 1997 END THEN 1 ELSE 0 END || ',"s":0,"a":' || CASE WHEN location_quality = 'approximate' THEN 1 ELSE 0 END || '}}' AS value FROM y""", "ev")
def point_features(spark, d):
    return A.point_features(events(spark, d), T.overlaps(1997, 1998, NOW), F.lit(False))


@query("a10_lite", """
SELECT id, CASE WHEN location_quality = 'precise' AND round(abs(lon * 10 - floor(lon * 10 + 0.5)), 7) = 0 AND round(abs(lat * 10 - floor(lat * 10 + 0.5)), 7) = 0 THEN 'approximate' ELSE location_quality END AS location_quality, len(aliases) AS n_aliases FROM ev""", "ev")
def lite(spark, d):
    return A.lite(events(spark, d)).select("id", "location_quality", F.size("aliases").alias("n_aliases"))


@query("a11_content_version")
def content_version(spark, d):
    return A.content_version(table(spark, d, "documents"))


@query("a14_grid_cells", """
, b AS (SELECT name, start_year, CASE WHEN overlay = 1 THEN x0 + 4 ELSE x0 END AS w, CASE WHEN overlay = 1 THEN y0 + 3 ELSE y0 END AS s, CASE WHEN overlay = 1 THEN x0 + 9 ELSE x0 + 18 END AS e, CASE WHEN overlay = 1 THEN y0 + 8 ELSE y0 + 11.2 END AS n FROM ft),
x AS (SELECT *, unnest(generate_series(CAST(floor(w / 5) AS INT), CAST(floor(e / 5) AS INT))) AS i FROM b), y AS (SELECT *, unnest(generate_series(CAST(floor(s / 5) AS INT), CAST(floor(n / 5) AS INT))) AS j FROM x)
SELECT name, start_year, (i * 5) || '_' || (j * 5) AS grid_cell FROM y""", "ft")
def grid_cells(spark, d):
    return A.grid_cells(features(spark, d)).select("name", "start_year", "grid_cell")


@query("a17_place_periods", """
WITH s AS (SELECT s_suppkey AS place_id, CASE WHEN s_acctbal * 200 >= 1000000 THEN 3 WHEN s_acctbal * 200 >= 300000 THEN 4 WHEN s_acctbal * 200 >= 100000 THEN 5 ELSE 6 END AS min_zoom, s_name FROM supplier)
SELECT place_id, min_zoom, 'Old ' || s_name AS name, 1900 AS "from", 1949 AS "to" FROM s UNION ALL SELECT place_id, min_zoom, s_name, 1950, 9999 FROM s""")
def place_periods(spark, d):
    periods = F.array(
        F.struct(F.concat(F.lit("Old "), "s_name").alias("name"), F.lit(1900).alias("from"), F.lit(1949).alias("to")), F.struct(F.col("s_name").alias("name"), F.lit(1950).alias("from"), F.lit(9999).alias("to"))
    )
    places = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), (F.col("s_acctbal") * 200).alias("population"), periods.alias("periods"))
    return A.place_periods(places).select("place_id", "min_zoom", "name", "from", "to")


@query("a18_redirects", """
, r AS (SELECT id AS old_id, CASE WHEN n % 4 = 0 THEN 'o-none' WHEN n % 10 = 0 THEN 'gone-' || (n + 10) ELSE id END AS new_id, n FROM ev WHERE n % 30 = 0),
q AS (SELECT CASE WHEN n % 60 = 0 THEN old_id ELSE 'gone-' || n END AS old_id, new_id FROM r)
SELECT old_id, 'old id exists' AS problem FROM q WHERE old_id IN (SELECT id FROM ev) UNION ALL SELECT old_id, 'new id missing' FROM q WHERE new_id NOT IN (SELECT id FROM ev) UNION ALL SELECT old_id, 'chain' FROM q WHERE new_id IN (SELECT old_id FROM q)""", "ev")
def redirects(spark, d):
    n = F.col("n")
    e = events(spark, d).select("n", "id")
    r = e.where("n % 30 = 0").select(
        F.when(n % 60 == 0, F.col("id")).otherwise(F.concat(F.lit("gone-"), n.cast("string"))).alias("old_id"),
        F.when(n % 4 == 0, "o-none").when(n % 10 == 0, F.concat(F.lit("gone-"), (n + 10).cast("string"))).otherwise(F.col("id")).alias("new_id"),
    )
    return C.redirect_problems(r, e)


@query("d30_page_texts", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'gs') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS h FROM a)
SELECT page_id, length(trim(regexp_replace(h, '[ \t\n\r]+', ' ', 'g'))) AS n_raw FROM b""")
def page_texts(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(P.strip_tags("html")).alias("n_raw"))


@query("d30_page_leads")
def page_leads(spark, d):
    return P.lead_paragraphs(table(spark, d, "pages"), "page_id", "html").select("page_id", "n_paragraphs", F.length("lead").alias("n_lead"))


@query("d36_structured_records", """
SELECT id, title AS name, CASE date_precision WHEN 'day' THEN date_start WHEN 'month' THEN substr(date_start, 1, 7) ELSE substr(date_start, 1, 4) END AS start, location_quality = 'precise' AS placed FROM ev""", "ev")
def structured_records(spark, d):
    record = F.from_json(P.structured_record(), "name string, startDate string, location struct<geo:struct<latitude:double,longitude:double>>")
    return events(spark, d).select("id", record.alias("r")).select("id", "r.name", F.col("r.startDate").alias("start"), F.col("r.location").isNotNull().alias("placed"))


@query("g24_seed_summary", """
SELECT count(*) AS seeds, count(*) FILTER (date_end IS NULL) AS no_end, count(*) FILTER (location_quality = 'none') AS no_place, count(*) FILTER (sitelinks_current IS NULL) AS no_count FROM ev WHERE sitelinks IS NULL""", "ev")
def seed_summary(spark, d):
    return events(spark, d).where("sitelinks IS NULL").agg(F.count("*").alias("seeds"), F.count_if(F.col("date_end").isNull()).alias("no_end"), F.count_if(F.col("location_quality") == "none").alias("no_place"), F.count_if(F.col("sitelinks_current").isNull()).alias("no_count"))


@query("g22_data_as_of", "SELECT max(substr(date_start, 1, 10)) AS as_of FROM ev", "ev")
def data_as_of(spark, d):
    return events(spark, d).agg(F.max(F.substring("date_start", 1, 10)).alias("as_of"))


@query("g20_rating_pivot", """
SELECT substr(date_start, 1, 4) AS year, count(*) FILTER (location_quality = 'precise') AS precise, count(*) FILTER (location_quality = 'approximate') AS approximate, count(*) FILTER (location_quality = 'none') AS "none" FROM ev GROUP BY 1""", "ev")
def rating_pivot(spark, d):
    rows = events(spark, d).select(F.substring("date_start", 1, 4).alias("year"), "location_quality")
    return rows.groupBy("year").pivot("location_quality", ["precise", "approximate", "none"]).count().fillna(0)


@query("g25_modes", """
SELECT substr(date_start, 1, 4) AS year, arg_min(p, struct_pack(c := -c, p := p)) AS commonest FROM (SELECT date_start[1:4] || '' AS date_start, date_precision AS p, count(*) AS c FROM ev GROUP BY 1, 2) GROUP BY 1""", "ev")
def modes(spark, d):
    rows = events(spark, d).groupBy(F.substring("date_start", 1, 4).alias("year"), "date_precision").agg(F.count("*").alias("c"))
    return rows.groupBy("year").agg(F.min_by("date_precision", F.struct((-F.col("c")).alias("c"), "date_precision")).alias("commonest"))


@query("g23_flag_counts", "SELECT split_part(f, ':', 1) AS code, count(*) AS n FROM (SELECT unnest(CASE WHEN date_end < date_start THEN ['date_order_invalid: x', 'note: y'] ELSE ['note: y'] END) AS f FROM ev) GROUP BY 1", "ev")
def flag_counts(spark, d):
    flags = F.when(F.col("date_end") < F.col("date_start"), F.array(F.lit("date_order_invalid: x"), F.lit("note: y"))).otherwise(F.array(F.lit("note: y")))
    return G.flag_counts(events(spark, d).select(flags.alias("flags")), "flags")


@query("g28_side_labels", """
SELECT category, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b, round(avg(CASE WHEN list_contains(wikidata_classes, category) THEN 1.0::DOUBLE ELSE 0 END), 6) AS stored_share
FROM (SELECT wikidata_classes, CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END AS side, CASE WHEN n % 3 = 0 THEN 'war' ELSE 'treaty' END AS category FROM ev) GROUP BY category""", "ev")
def side_labels(spark, d):
    n = F.col("n")
    rows = events(spark, d).select("wikidata_classes", F.when(n % 2 == 0, "a").otherwise("b").alias("side"), F.when(n % 3 == 0, "war").otherwise("treaty").alias("category"))
    return P.labels_by_side(rows)


@query("g29_point_rollup", """
SELECT s_nationkey AS id, min(s_suppkey) AS first_key, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS regions, bool_or(s_name LIKE '%1%') AS bulk FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def point_rollup(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy(F.col("s_nationkey").alias("id")).agg(F.min("s_suppkey").alias("first_key"), F.array_join(F.array_sort(F.collect_set("r_name")), ",").alias("regions"), F.max(F.col("s_name").contains("1")).alias("bulk"))


@query("h03_merged_runs", """
, b AS (SELECT replace(name, ' (phase 1)', '') AS base, start_year, end_year, status, lag(end_year) OVER w AS pe, lag(status) OVER w AS ps FROM ft WINDOW w AS (PARTITION BY replace(name, ' (phase 1)', '') ORDER BY start_year)),
r AS (SELECT *, sum(CASE WHEN pe = start_year - 1 AND ps IS NOT DISTINCT FROM status THEN 0 ELSE 1 END) OVER (PARTITION BY base ORDER BY start_year) AS run FROM b)
SELECT base, min(start_year) AS start_year, max(end_year) AS end_year FROM r GROUP BY base, run""", "ft")
def merged_runs(spark, d):
    return P.merge_runs(features(spark, d).withColumn("base", F.replace("name", F.lit(" (phase 1)"), F.lit(""))), "base", ["status"])


@query("h06_first_wins", "SELECT title, min(id) AS id FROM ev GROUP BY title", "ev")
def first_wins(spark, d):
    return J.first_wins(events(spark, d).select("title", "id"), ["title"], [F.col("id").asc()])


@query("h08_unique_slugs", """
, s AS (SELECT id, wikidata_qid, replace(title, ' ', '-') AS slug, row_number() OVER (PARTITION BY title ORDER BY n) AS k FROM ev) SELECT id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || lower(wikidata_qid) END AS slug FROM s""", "ev")
def unique_slugs(spark, d):
    return P.unique_slugs(events(spark, d).withColumn("slug", X.slugify("title")), "slug", "wikidata_qid", F.col("n").asc()).select("id", "slug")


@query("h12_stack_items", """
SELECT id, row_number() OVER (ORDER BY n % 2, substr(date_start, 1, 4), title, id) AS place FROM ev ORDER BY place LIMIT 60""", "ev")
def stack_items(spark, d):
    from ..operators import search as Q

    rows = events(spark, d)
    return Q.numbered(rows, [(F.col("n") % 2).asc(), F.substring("date_start", 1, 4).asc(), F.col("title").asc(), F.col("id").asc()], 60).select("id", "place")


@query("i07_candidate_order", """
SELECT id, row_number() OVER (ORDER BY sitelinks_current DESC NULLS LAST, length(wikidata_qid), wikidata_qid) AS place FROM ev ORDER BY place LIMIT 200""", "ev")
def candidate_order(spark, d):
    from ..operators import search as Q

    return Q.numbered(events(spark, d), [F.col("sitelinks_current").desc_nulls_last(), F.length("wikidata_qid").asc(), F.col("wikidata_qid").asc()], 200).select("id", "place")


@query("j03_geometry_baseline", "SELECT name || '@' || start_year AS key, CASE WHEN cell % 5 = 0 THEN 'new' WHEN cell % 3 = 0 THEN 'fewer vertices' ELSE 'changed' END AS problem FROM ft WHERE cell % 5 = 0 OR cell % 3 = 0 OR cell % 7 = 0", "ft")
def geometry_baseline(spark, d):
    p, cell = F.col("polygons"), F.col("cell")
    now = features(spark, d).select("cell", F.concat_ws("@", "name", F.col("start_year").cast("string")).alias("key"), S.vertex_count(p).alias("vertices"), S.fine_count(p).alias("fine"), S.geometry_hash(p).alias("sha"))
    then = now.where("cell % 5 <> 0").select("key", F.when(cell % 3 == 0, F.col("vertices") + 1).otherwise(F.col("vertices")).alias("vertices"), "fine", F.when(cell % 7 == 0, "x").otherwise(F.col("sha")).alias("sha"))
    return C.geometry_baseline(now, then)


@query("j09_same_geometry", "SELECT true AS same")
def same_geometry(spark, d):
    f = features(spark, d).select(S.geometry_hash(F.col("polygons")).alias("h"))
    both = f.withColumn("side", F.lit(1)).unionByName(f.withColumn("side", F.lit(-1)))
    return both.groupBy("h").agg(F.sum("side").alias("s")).agg(F.coalesce(F.max(F.col("s") != 0), F.lit(False)).alias("differs")).select((~F.col("differs")).alias("same"))


@query("j10_map_set", """
, m AS (SELECT id, n % 3 = 0 AS match, date_start BETWEEN '1997-01-01' AND '1998-12-31' AS shown FROM ev) SELECT id, match FROM m WHERE shown OR match OR id = 'o-1'""", "ev")
def map_set(spark, d):
    e = events(spark, d).select("n", "id", "date_start")
    matches = e.where("n % 3 = 0").select("id")
    every = e.where("date_start BETWEEN '1997-01-01' AND '1998-12-31'").select("id").unionByName(matches).unionByName(e.where("id = 'o-1'").select("id")).dropDuplicates(["id"])
    return every.join(matches.withColumn("match", F.lit(True)), "id", "left").select("id", F.coalesce("match", F.lit(False)).alias("match"))


@query("f18_far_coordinates", """
, r AS (SELECT n_name AS country, -11.0::DOUBLE + (n_nationkey % 5) * 18 AS rx, -9.4::DOUBLE + (n_nationkey // 5) * 11.2 AS ry FROM nation), t AS (SELECT id, lon, lat, unnest(countries) AS country FROM ev),
k AS (SELECT id, min(2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(sin(radians(ry - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(ry)) * sin(radians(rx - lon) / 2) ** 2)))) AS km FROM t JOIN r USING (country) GROUP BY id)
SELECT id, CAST(floor(km + 0.5) AS BIGINT) AS km FROM k WHERE km > 1500""", "ev")
def far_coordinates(spark, d):
    k = F.col("n_nationkey")
    refs = table(spark, d, "nation").select(F.col("n_name").alias("country"), (F.lit(-11.0) + (k % 5) * 18).alias("rx"), (F.lit(-9.4) + F.floor(k / 5) * 11.2).alias("ry"))
    return P.far_from_references(events(spark, d), refs)


@query("f28_country_support", """
, t AS (SELECT id, n, unnest(countries) AS c, len(countries) AS k FROM ev), s AS (SELECT id, n, c, CAST(string_split(c, '_')[2] AS INT) % 3 = 0 AS place FROM t)
SELECT id, count(*) FILTER (place) AS inside, count(*) FILTER (NOT place) AS outside, count(*) FILTER (place) >= count(*) FILTER (NOT place) AS counts FROM s GROUP BY id""", "ev")
def country_support(spark, d):
    rows = events(spark, d).select("id", F.explode("countries").alias("country"))
    inside = F.element_at(F.split("country", "_"), 2).cast("int") % 3 == 0
    return P.place_support(rows.withColumn("inside", inside))
