"""Queries of aggregates, windows, comparisons, rules, derivations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import events, features, table
from ..functions import spatial as S
from ..functions import temporal as T
from ..operators import compare as C
from ..operators import derive as L
from ..operators import quality as K
from ..operators import report as G
from ..operators import windows as H
from .registry import query

_GROUP = """CASE WHEN list_contains({c}, 'bombing') THEN 'terrorism'
  WHEN len(list_distinct(list_filter(list_transform({c}, lambda x: CASE x WHEN 'battle' THEN 'war' WHEN 'war' THEN 'war' WHEN 'treaty' THEN 'treaty' WHEN 'election' THEN 'political' END), lambda x: x IS NOT NULL))) > 1 THEN 'mixed'
  ELSE coalesce(list_filter(list_transform({c}, lambda x: CASE x WHEN 'battle' THEN 'war' WHEN 'war' THEN 'war' WHEN 'treaty' THEN 'treaty' WHEN 'election' THEN 'political' END), lambda x: x IS NOT NULL)[1], 'unclassified') END"""

_CAND = """
cd AS (SELECT 'Q' || l_partkey AS qid, CASE p_type WHEN 'STANDARD' THEN 'battle' WHEN 'ECONOMY' THEN 'treaty' WHEN 'PROMO' THEN 'protest movement' WHEN 'LARGE' THEN 'war' WHEN 'SMALL' THEN 'bombing' ELSE 'election' END AS class,
  CASE p_type WHEN 'LARGE' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'MEDIUM' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS class_order, n_name AS country, strftime(l_shipdate, '%Y-%m-%d') AS date,
  CAST(p_size AS BIGINT) AS sitelinks, l_partkey % 3 <> 0 AS has_article
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
cr AS (SELECT qid, min(date) AS date, max(date) AS "end", max(sitelinks) AS sitelinks, list_sort(list(DISTINCT country)) AS countries, list_sort(list(DISTINCT class)) AS classes, bool_or(has_article) AS has_article FROM cd GROUP BY qid)
"""
_ORDER = {"war": 1, "battle": 2, "treaty": 3, "election": 4, "bombing": 5, "protest movement": 6}


def candidate_rows(spark, d):
    from ..adapters import _class_label

    parts = table(spark, d, "part").select("p_partkey", "p_size", _class_label(F.col("p_type")).alias("class"))
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv]), F.col("class"))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return lines.select(
        F.concat(F.lit("Q"), F.col("l_partkey").cast("string")).alias("qid"), "class", order.alias("class_order"), F.col("n_name").alias("country"), day.alias("date"), day.alias("end"),
        F.col("p_size").cast("long").alias("sitelinks"), (F.col("l_partkey") % 3 != 0).alias("has_article"),
    )


def candidates(spark, d):
    rolled = G.candidate_rollup(candidate_rows(spark, d))
    return rolled.withColumn("countries", F.split("countries", ",")).withColumn("classes", F.split("classes", ","))


@query("g01_yearly_counts", "SELECT CAST(substr(date_start, 1, 4) AS INT) AS year, count(*) AS n FROM ev GROUP BY 1", "ev")
def yearly_counts(spark, d):
    return G.yearly_counts(events(spark, d))


@query("g02_candidate_rollup", "WITH " + _CAND + """
SELECT qid, min(date) AS date, max(date) AS "end", max(sitelinks) AS sitelinks, string_agg(DISTINCT country, ',' ORDER BY country) AS countries, any_value(class) AS classes, bool_or(has_article) AS has_article FROM cd GROUP BY qid""")
def candidate_rollup(spark, d):
    return G.candidate_rollup(candidate_rows(spark, d))


@query("g03_funnel", "WITH " + _CAND + """
, k AS (SELECT count(*) AS a, count(*) FILTER (has_article) AS b, count(*) FILTER (has_article AND sitelinks >= 10) AS c FROM cr)
SELECT 1 AS step, 'raw' AS stage, a AS n, 0 AS removed FROM k UNION ALL SELECT 2, 'article', b, a - b FROM k UNION ALL SELECT 3, 'sitelinks', c, b - c FROM k""")
def funnel(spark, d):
    return G.funnel(candidates(spark, d))


@query("g04_breakdowns", "WITH " + _CAND + f"""
, l AS (SELECT has_article, sitelinks, 'country' AS dim, unnest(countries) AS key FROM cr UNION ALL SELECT has_article, sitelinks, 'class', unnest(classes) FROM cr
  UNION ALL SELECT has_article, sitelinks, 'group', {_GROUP.format(c='classes')} FROM cr UNION ALL SELECT has_article, sitelinks, 'decade', substr(date, 1, 3) || '0s' FROM cr)
SELECT dim, key, count(*) AS raw, count(*) FILTER (NOT has_article) AS no_article, count(*) FILTER (has_article AND sitelinks < 10) AS few_sitelinks, count(*) FILTER (has_article AND sitelinks >= 10) AS passed FROM l GROUP BY dim, key""")
def breakdowns(spark, d):
    return G.breakdowns(candidates(spark, d))


@query("g05_coverage", """
, t AS (SELECT len(countries) AS k, unnest(countries) AS country FROM ev), c AS (SELECT country, count(*) AS n, count(*) FILTER (k < 5) AS n_without_many FROM t GROUP BY country)
SELECT country, n, n_without_many, row_number() OVER (ORDER BY n DESC, country) AS place FROM c""", "ev")
def coverage(spark, d):
    return G.coverage(events(spark, d), 5)


@query("g07_upper_medians", """
, r AS (SELECT substr(date_start, 1, 4) AS year, sitelinks_current AS v, count(*) OVER (PARTITION BY substr(date_start, 1, 4)) AS n, row_number() OVER (PARTITION BY substr(date_start, 1, 4) ORDER BY sitelinks_current) AS i FROM ev WHERE sitelinks_current IS NOT NULL)
SELECT year, v AS median FROM r WHERE i = n // 2 + 1""", "ev")
def upper_medians(spark, d):
    return G.upper_median(events(spark, d).withColumn("year", F.substring("date_start", 1, 4)), ["year"], "sitelinks_current")


@query("g08_groups", f"SELECT id, {_GROUP.format(c='wikidata_classes')} AS grp, list_has_any(wikidata_classes, ['election']) AS not_event FROM ev", "ev")
def groups(spark, d):
    c = F.col("wikidata_classes")
    return events(spark, d).select("id", G.group_of(c).alias("grp"), G.not_events(c, ("election",)).alias("not_event"))


@query("g11_largest_stack", "SELECT max(n) AS largest, count(*) AS points FROM (SELECT lon, lat, count(*) AS n FROM ev GROUP BY lon, lat)", "ev")
def largest_stack(spark, d):
    return G.largest_stack(events(spark, d))


@query("g12_clusters", """
, m AS (SELECT (lon + 180) / 360 AS mx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS my FROM ev), z AS (SELECT unnest([2, 5]) AS zoom)
SELECT zoom, CAST(floor(mx * pow(2, zoom) * 12.8) AS BIGINT) AS cx, CAST(floor(my * pow(2, zoom) * 12.8) AS BIGINT) AS cy, count(*) AS n FROM m CROSS JOIN z GROUP BY 1, 2, 3""", "ev")
def clusters(spark, d):
    return G.grid_clusters(events(spark, d), (2, 5)).select("zoom", "cx", "cy", "n")


@query("g13_bounds", "SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, count(*) AS count FROM ev", "ev")
def bounds(spark, d):
    return G.bounds(events(spark, d))


@query("g14_distance_bands", """
, k AS (SELECT id, 2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(sin(radians(10 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(10.0::DOUBLE)) * sin(radians(20 - lon) / 2) ** 2))) AS km FROM ev)
SELECT CASE WHEN km <= 500 THEN 'up to 500' WHEN km <= 2000 THEN 'up to 2000' ELSE 'over 2000' END AS band, count(*) AS n FROM k GROUP BY 1""", "ev")
def distance_bands(spark, d):
    return G.distance_bands(events(spark, d).select(S.haversine_km("lon", "lat", 20, 10).alias("km")), limits=(500.0, 2000.0))


@query("g17_field_checks", """
SELECT 'sitelinks' AS field, count(*) AS checked, count(*) FILTER (sitelinks IS DISTINCT FROM sitelinks_current) AS mismatched FROM ev
UNION ALL SELECT 'qid', count(*), count(*) FILTER (wikidata_qid IS DISTINCT FROM resolved_qid) FROM ev""", "ev")
def field_checks(spark, d):
    rows = events(spark, d).select(F.col("sitelinks").cast("string").alias("a_sitelinks"), F.col("sitelinks_current").cast("string").alias("b_sitelinks"), F.col("wikidata_qid").alias("a_qid"), F.col("resolved_qid").alias("b_qid"))
    return G.field_checks(rows, ["sitelinks", "qid"])


@query("g18_strata", """
, s AS (SELECT substr(date_start, 1, 4) AS year, location_quality, location_quality = 'precise' AS precise, sitelinks_current::DOUBLE AS pages FROM ev),
l AS (SELECT 'year' AS dim, year AS key, precise, pages FROM s UNION ALL SELECT 'location_quality', location_quality, precise, pages FROM s UNION ALL SELECT 'all', 'ALL', precise, pages FROM s)
SELECT dim, key, count(*) AS n, round(avg(CAST(precise AS DOUBLE)), 6) AS share_precise, round(quantile_cont(pages, 0.5), 6) AS median_pages FROM l GROUP BY dim, key""", "ev")
def strata(spark, d):
    rows = events(spark, d).select(F.substring("date_start", 1, 4).alias("year"), "location_quality", (F.col("location_quality") == "precise").alias("precise"), F.col("sitelinks_current").cast("double").alias("pages"))
    return G.stratum_table(rows, ["year", "location_quality"], ["precise"], ["pages"])


@query("g19_signal_scores", """
SELECT id, (CASE WHEN coalesce(date_end < date_start, false) THEN 3 ELSE 0 END) + (CASE WHEN location_quality = 'none' THEN 2 ELSE 0 END) + (CASE WHEN coalesce(sitelinks_current < 10, false) THEN 1 ELSE 0 END) AS score FROM ev""", "ev")
def signal_scores(spark, d):
    score, _ = G.signal_score({"reversed": (F.col("date_end") < F.col("date_start"), 3), "unplaced": (F.col("location_quality") == "none", 2), "few": (F.col("sitelinks_current") < 10, 1)})
    return events(spark, d).select("id", score.alias("score"))


@query("g21_minimum_years", "SELECT min(end_year) AS year FROM ft WHERE overlay = 0 UNION ALL SELECT max(end_year) FROM ft", "ft")
def minimum_years(spark, d):
    return G.minimum_years(features(spark, d).where("status IS NULL OR status <> 'disputed'"))


@query("g26_edit_history", """
SELECT user_id AS article, sum(k) AS edits, count(*) AS editors, max(k) / sum(k)::DOUBLE AS top_share, sum(errors) AS errors, sum(ones) AS ones FROM
(SELECT user_id, event_type, count(*) AS k, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (contains(props, '1')) AS ones FROM events GROUP BY 1, 2) GROUP BY 1""")
def edit_history(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("article"), F.col("event_type").alias("editor"), F.col("event_type").alias("tag"), F.col("props").alias("comment"))
    return G.edit_history(rows)


@query("g27_reference_hosts", """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="((?:https?://|/)[^"]*)"', 1)) AS link FROM pages),
h AS (SELECT page_id, lower(regexp_extract(CASE WHEN starts_with(link, '/') THEN url ELSE link END, '^https?://([^/:?#]+)', 1)) AS host FROM l)
SELECT host, count(*) AS n, count(DISTINCT page_id) AS n_pages, ends_with(host, '.gov') OR ends_with(host, '.edu') AS official FROM h WHERE host <> '' GROUP BY host""")
def reference_hosts(spark, d):
    return G.reference_hosts(table(spark, d, "pages"))


def _revisions(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("article"), F.col("event_id").alias("revid"), "ts", "event_type", "value")


@query("h05_revision_runs", """
WITH r AS (SELECT user_id AS article, event_id AS revid, ts, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY article ORDER BY ts DESC, revid DESC ROWS UNBOUNDED PRECEDING) AS run FROM r),
g AS (SELECT article, run, min(revid) AS first_rev, max(revid) AS last_rev, count(*) AS n, count(*) FILTER (ts <= TIMESTAMP '2024-01-15') AS past FROM u GROUP BY 1, 2),
o AS (SELECT *, run - coalesce(min(CASE WHEN past > 0 THEN run END) OVER (PARTITION BY article), max(run) OVER (PARTITION BY article)) AS away FROM g)
SELECT article, first_rev, last_rev, n, row_number() OVER (PARTITION BY article ORDER BY CASE WHEN away = 0 THEN 0 WHEN away > 0 THEN away * 2 - 1 ELSE -away * 2 END) AS place FROM o""")
def revision_runs(spark, d):
    return H.revision_runs(_revisions(spark, d), "event_type", F.lit("2024-01-15").cast("timestamp"))


@query("h14_churn", """
WITH c AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events) SELECT user_id AS article, round(coalesce(sum(step), 0), 4) AS churn FROM c GROUP BY 1""")
def churn(spark, d):
    return H.churn(_revisions(spark, d), "value")


@query("h15_since_stored", """
SELECT user_id AS article, arg_max(event_id, struct_pack(t := ts, e := event_id)) FILTER (ts <= TIMESTAMP '2024-01-15') AS current_rev, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS edits_after FROM events GROUP BY 1""")
def since_stored(spark, d):
    return H.since_stored(_revisions(spark, d), F.lit("2024-01-15").cast("timestamp"))


_SEED = "sha256('1:' || id)"


@query("h09_round_robin", f"""
, t AS (SELECT id, substr(date_start, 1, 4) AS year, location_quality, row_number() OVER (PARTITION BY substr(date_start, 1, 4), location_quality ORDER BY {_SEED}, id) AS turn FROM ev),
p AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY turn, location_quality) AS place FROM t WHERE turn <= 20)
SELECT id, year, location_quality, turn, place FROM p WHERE place <= 20""", "ev")
def round_robin(spark, d):
    rows = events(spark, d).select("id", F.substring("date_start", 1, 4).alias("year"), "location_quality")
    return H.round_robin(rows, "year", "location_quality", 20)


@query("p01_seeded_sample", f"SELECT id FROM ev ORDER BY {_SEED}, id LIMIT 50", "ev")
def seeded_sample(spark, d):
    return H.seeded_sample(events(spark, d).select("id"), 50)


@query("p03_eras_and_topics", """
SELECT id, CASE WHEN substr(date_start, 1, 4) < '1997' THEN 'early' WHEN substr(date_start, 1, 4) < '2000' THEN 'middle' ELSE 'late' END AS era,
       CASE WHEN regexp_matches(title, 'ring|gear') THEN 'parts' WHEN regexp_matches(title, 'small|large') THEN 'sizes' ELSE 'other' END AS topic FROM ev""", "ev")
def eras_and_topics(spark, d):
    return events(spark, d).select("id", L.first_match(T.year_of("date_start"), ((1996, "early"), (1999, "middle")), "late").alias("era"), L.topic("title", (("parts", "ring|gear"), ("sizes", "small|large"))).alias("topic"))


@query("h13_previous_and_next", """
SELECT id, lag(id) OVER (ORDER BY date_start, id) AS prev_id, lead(id) OVER (ORDER BY date_start, id) AS next_id FROM ev""", "ev")
def previous_and_next(spark, d):
    return H.previous_and_next(events(spark, d), F.substring("date_start", 1, 7))


@query("j01_diff", """
, p AS (SELECT id, title AS sig FROM ev WHERE n % 11 <> 0), q AS (SELECT id, CASE WHEN n % 7 = 0 THEN title || '!' ELSE title END AS sig FROM ev WHERE n % 13 <> 0)
SELECT coalesce(q.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'added' WHEN q.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM p FULL JOIN q ON p.id = q.id WHERE p.id IS NULL OR q.id IS NULL OR p.sig <> q.sig""", "ev")
def diff(spark, d):
    e = events(spark, d)
    before = e.where("n % 11 <> 0").select("id", F.col("title").alias("sig"))
    after = e.where("n % 13 <> 0").select("id", F.when(F.col("n") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("sig"))
    return C.diff_by_id(before, after)


_LEDGER = """
, nw AS (SELECT CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END AS file, id, location_quality AS code FROM ev WHERE n % 20 <> 0), bs AS (SELECT CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END AS file, id, location_quality AS code FROM ev WHERE n % 30 <> 0)"""


@query("j02_baseline", _LEDGER + """
SELECT file, id, code, 'fresh' AS state FROM nw WHERE (file, id, code) NOT IN (SELECT (file, id, code) FROM bs)
UNION ALL SELECT file, id, code, 'gone' FROM bs WHERE file = 'a' AND code <> 'none' AND (file, id, code) NOT IN (SELECT (file, id, code) FROM nw)
UNION ALL SELECT file, id, code, 'kept' FROM bs WHERE (file, id, code) IN (SELECT (file, id, code) FROM nw) UNION ALL SELECT file, id, code, 'kept' FROM bs WHERE file <> 'a' AND (file, id, code) NOT IN (SELECT (file, id, code) FROM nw)""", "ev")
def baseline(spark, d):
    e = events(spark, d).select("n", F.when(F.col("n") % 2 == 0, "a").otherwise("b").alias("file"), "id", F.col("location_quality").alias("code"))
    return C.with_baseline(e.where("n % 20 <> 0"), e.where("n % 30 <> 0"), ["a"], ("none",))


@query("j04_distance_baseline", """
, a AS (SELECT id, CASE WHEN n % 9 = 0 THEN NULL ELSE lat END AS km FROM ev WHERE n % 10 <> 0), b AS (SELECT id, CASE WHEN n % 8 = 0 THEN NULL WHEN n % 5 = 0 THEN lat + 0.5 ELSE lat END AS km FROM ev WHERE n % 12 <> 0),
j AS (SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'new' WHEN b.km IS NULL AND a.km IS NOT NULL THEN 'lost' WHEN b.km > a.km + 0.25 THEN 'worse' END AS problem FROM a FULL JOIN b ON a.id = b.id)
SELECT id, problem FROM j WHERE problem IS NOT NULL""", "ev")
def distance_baseline(spark, d):
    n, lat = F.col("n"), F.col("lat")
    e = events(spark, d)
    before = e.where("n % 10 <> 0").select("id", F.when(n % 9 != 0, lat).alias("km"))
    after = e.where("n % 12 <> 0").select("id", F.when(n % 8 == 0, None).when(n % 5 == 0, lat + 0.5).otherwise(lat).alias("km"))
    return C.distance_baseline(after, before)


@query("f22_clashes", """
, b AS (SELECT id, wikidata_qid FROM ev WHERE n % 3 = 0), i AS (SELECT CASE WHEN n % 2 = 0 THEN id ELSE id || '-x' END AS id, wikidata_qid FROM ev WHERE n % 5 = 0)
SELECT i.id, CASE WHEN i.id IN (SELECT id FROM b) AND wikidata_qid IN (SELECT wikidata_qid FROM b) THEN 'id+qid' WHEN i.id IN (SELECT id FROM b) THEN 'id' ELSE 'qid' END AS "by"
FROM i WHERE i.id IN (SELECT id FROM b) OR wikidata_qid IN (SELECT wikidata_qid FROM b)""", "ev")
def clashes(spark, d):
    e = events(spark, d).select("n", "id", "wikidata_qid")
    incoming = e.where("n % 5 = 0").withColumn("id", F.when(F.col("n") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("-x"))))
    return C.clashes(e.where("n % 3 = 0"), incoming)


_EXCL = ", x AS (SELECT CASE WHEN n % 2 = 0 THEN id ELSE 'gone' || n END AS xid, wikidata_qid AS q, 'rule ' || n % 3 AS reason FROM ev WHERE n % 77 = 0)"


@query("f24_exclusions", _EXCL + """
SELECT ev.id, reason, CASE WHEN ev.id = xid THEN 'id' ELSE 'qid' END AS "by" FROM ev JOIN x ON ev.wikidata_qid = q""", "ev")
def exclusions(spark, d):
    e = events(spark, d)
    return C.match_exclusions(e, L.exclusion_ledger(e))


@query("f27_removals", """
SELECT id FROM ev WHERE n % 4 = 0 AND n % 8 <> 0 AND n % 12 <> 0 AND n % 20 <> 0""", "ev")
def removals(spark, d):
    e = events(spark, d).select("n", "id")
    return C.unaccounted_removals(e.where("n % 4 = 0"), e.where("n % 8 = 0"), e.where("n % 12 = 0").select(F.col("id").alias("old_id")), e.where("n % 20 = 0"))


@query("f21_mirrors", "SELECT a.id, b.id AS owner FROM ev a JOIN ev b ON a.resolved_qid = b.wikidata_qid WHERE a.resolved_qid <> a.wikidata_qid AND a.id <> b.id", "ev")
def mirrors(spark, d):
    return C.mirror_pairs(events(spark, d))


@query("f30_drift", """
, s AS (SELECT wikidata_qid, CASE WHEN n % 6 = 0 THEN '1990-01-01' ELSE date_start END AS src_start, CASE WHEN n % 10 = 0 THEN NULL ELSE date_end END AS src_end FROM ev),
l AS (SELECT id, n, 'date_start' AS field, date_start AS stored, src_start AS source FROM ev JOIN s USING (wikidata_qid) UNION ALL SELECT id, n, 'date_end', date_end, src_end FROM ev JOIN s USING (wikidata_qid))
SELECT id, field, stored, source, CASE WHEN n % 50 = 0 AND field = 'date_start' THEN 'explained' ELSE 'listed' END AS state FROM l WHERE stored IS DISTINCT FROM source""", "ev")
def drift(spark, d):
    e, n = events(spark, d), F.col("n")
    source = e.select("wikidata_qid", F.when(n % 6 == 0, "1990-01-01").otherwise(F.col("date_start")).alias("src_start"), F.when(n % 10 != 0, F.col("date_end")).alias("src_end"))
    known = e.where("n % 50 = 0").select("id", F.lit("date_start").alias("field"))
    return C.drift(e, source, {"date_start": "src_start", "date_end": "src_end"}, known)


@query("j06_merge", _EXCL + """
, c AS (SELECT id, wikidata_qid FROM ev WHERE n % 5 = 0)
SELECT id, CASE WHEN list_has_any(wikidata_classes, ['election']) THEN 'not an event' WHEN wikidata_qid IN (SELECT q FROM x) THEN 'excluded' WHEN id IN (SELECT id FROM c) THEN 'clash' ELSE 'merge' END AS outcome FROM ev WHERE n % 2 = 0""", "ev")
def merge(spark, d):
    e = events(spark, d)
    return C.merge_proposed(e.where("n % 5 = 0"), e.where("n % 2 = 0"), G.not_events(F.col("wikidata_classes"), ("election",)), L.exclusion_ledger(e))


@query("j07_upsert", """
, o AS (SELECT id, title, sitelinks_current AS pages FROM ev WHERE n % 2 = 0), w AS (SELECT id, title || ' new' AS title, sitelinks_current + 1 AS pages FROM ev WHERE n % 3 = 0)
SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.title ELSE w.title END AS title, CASE WHEN w.id IS NOT NULL THEN w.pages ELSE o.pages END AS pages FROM o FULL JOIN w ON o.id = w.id""", "ev")
def upsert(spark, d):
    e = events(spark, d).select("n", "id", "title", F.col("sitelinks_current").alias("pages"))
    new = e.where("n % 3 = 0").select("id", F.concat("title", F.lit(" new")).alias("title"), (F.col("pages") + 1).alias("pages"))
    return C.upsert(e.where("n % 2 = 0").drop("n"), new, "id", ["pages"])


@query("k_findings", f"""
, t AS (SELECT *, {_GROUP.format(c='wikidata_classes')} AS category FROM ev), w AS (
SELECT id, unnest([
  CASE WHEN date_end < date_start THEN 'error:date_order_invalid' END, CASE WHEN len(countries) > 4 THEN 'warning:countries_many_tags' END, CASE WHEN len(countries) >= 8 THEN 'warning:many_countries' END,
  CASE WHEN location_quality = 'none' THEN 'error:coordinates_with_none' END,
  CASE WHEN location_quality = 'precise' AND round(abs(lon * 10 - floor(lon * 10 + 0.5)), 7) = 0 AND round(abs(lat * 10 - floor(lat * 10 + 0.5)), 7) = 0 THEN 'warning:coordinate_low_precision' END,
  CASE WHEN (date_precision = 'month' AND substr(date_start, 9, 2) <> '01') OR (date_precision = 'year' AND substr(date_start, 6, 5) <> '01-01') THEN 'error:date_start_precision' END,
  CASE WHEN sitelinks < 10 THEN 'warning:sitelinks_below_threshold' END, CASE WHEN date_end IS NULL AND list_has_any(wikidata_classes, ['war', 'protest movement']) THEN 'warning:durative_class_no_end' END,
  CASE WHEN resolved_qid <> wikidata_qid THEN 'warning:article_of_other_item' END, CASE WHEN resolved_qid <> wikidata_qid AND location_quality = 'precise' THEN 'warning:borrowed_coordinates' END,
  CASE WHEN date_end_open IS NOT NULL AND date_end IS NOT NULL THEN 'error:open_end_with_end' END]) AS f FROM t)
SELECT id, split_part(f, ':', 1) AS level, split_part(f, ':', 2) AS code FROM w WHERE f IS NOT NULL""", "ev")
def findings(spark, d):
    from ..adapters import table as t

    names = [r[0] for r in t(spark, d, "nation").select("n_name").collect()]  # the tracked countries: a dimension of fixed size
    e = events(spark, d).withColumn("category", G.group_of(F.col("wikidata_classes"))).withColumn("extract", F.lit("In 1995, 1996, 1997, 1998, 1999, 2000, 2001 and 2002 it went on. " * 3))
    return K.findings(e, names, F.lit("2024-01-01"), F.lit(None).cast("string")).select("id", "level", "code")


@query("k37_lead_findings")
def lead_findings(spark, d):
    e = events(spark, d, with_text=True)
    return e.select("id", F.inline(K.flatten_findings(K.lead_rules()))).groupBy("level", "code").agg(F.count("*").alias("n"))


@query("k40_shared_articles", """
, s AS (SELECT left(sha1(extract), 12) AS sha, count(*) AS n, count(DISTINCT resolved_qid) AS n_items FROM evt WHERE extract IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT sha, n, n_items, n_items = 1 AS explained FROM s""", "evt")
def shared_articles(spark, d):
    return K.shared_articles(events(spark, d, with_text=True))


@query("k41_review_coverage", """
WITH e AS (SELECT doc_id AS id, left(sha1(text), 12) AS h FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT doc_id AS id, left(sha1(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END), 12) AS h FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN e.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'missing' WHEN e.h <> r.h THEN 'stale' ELSE 'reviewed' END AS state, count(*) AS n FROM e FULL JOIN r ON e.id = r.id GROUP BY 1""")
def review_coverage(spark, d):
    from ..functions import text as X

    docs = table(spark, d, "documents")
    reviewed = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    shape = lambda x: x.select(F.col("doc_id").alias("id"), X.text_sha1("text").alias("text_sha1"))
    return K.review_coverage(shape(docs.where("doc_id % 7 <> 0")), shape(reviewed))


@query("k42_feature_rules", "SELECT name, 'x' AS code FROM ft WHERE end_year < start_year", "ft")
def feature_rules(spark, d):
    return features(spark, d).select("name", F.inline(K.feature_rules())).select("name", "code")


_ENT = """
, en AS (SELECT id, n, date_start, date_end, CASE WHEN n % 3 = 0 THEN 8 WHEN n % 3 = 1 THEN 9 ELSE 11 END AS p585p, strftime(CAST(date_start AS DATE) - 10, '%Y-%m-%d') AS p580, CASE WHEN n % 2 = 0 THEN 11 ELSE 10 END AS p580p,
  CASE WHEN n % 4 = 0 THEN date_start WHEN n % 4 = 1 THEN strftime(CAST(date_start AS DATE) + 5, '%Y-%m-%d') END AS p582 FROM ev)"""


@query("l02_reconciled_starts", _ENT + """
, r AS (SELECT id, p580, CASE WHEN p585p < 9 THEN 'coarse' WHEN p582 = date_start AND p580 <> date_start THEN 'end' WHEN p580 < date_start AND date_start < p582 THEN 'inside' WHEN p585p = 9 AND substr(p580, 1, 4) = substr(date_start, 1, 4) THEN 'year' END AS rule FROM en)
SELECT id, rule, p580 AS date_start FROM r WHERE rule IS NOT NULL""", "ev")
def reconciled_starts(spark, d):
    n = F.col("n")
    shift = lambda k: F.date_format(F.date_add(F.to_date("date_start"), k), "yyyy-MM-dd")
    e = events(spark, d).select(
        "id", "date_start", F.col("date_start").alias("p585"), F.when(n % 3 == 0, 8).when(n % 3 == 1, 9).otherwise(11).alias("p585p"), shift(-10).alias("p580"), F.when(n % 2 == 0, 11).otherwise(10).alias("p580p"),
        F.when(n % 4 == 0, F.col("date_start")).when(n % 4 == 1, shift(5)).alias("p582"),
    )
    return e.select("id", L.reconcile_start("date_start", "p585", "p585p", "p580", "p580p", "p582").alias("r")).where("r IS NOT NULL").select("id", "r.rule", "r.date_start")


@query("l03_data_fixes", """
, f AS (SELECT wikidata_qid, CASE WHEN n % 100 = 0 THEN ['date_start', 'date_end'] ELSE ['date_start'] END AS sets FROM ev WHERE n % 50 = 0)
SELECT id, CASE WHEN f.wikidata_qid IS NOT NULL THEN '1990-06-01' ELSE date_start END AS date_start, CASE WHEN list_contains(f.sets, 'date_end') THEN NULL ELSE date_end END AS date_end,
       CASE WHEN f.wikidata_qid IS NULL THEN '' WHEN list_contains(f.sets, 'date_end') AND date_end IS NOT NULL THEN 'date_start,date_end' ELSE 'date_start' END AS changed FROM ev LEFT JOIN f USING (wikidata_qid)""", "ev")
def data_fixes(spark, d):
    e = events(spark, d)
    fixes = e.where("n % 50 = 0").select(
        "wikidata_qid", F.when(F.col("n") % 100 == 0, F.array(F.lit("date_start"), F.lit("date_end"))).otherwise(F.array(F.lit("date_start"))).alias("set_fields"), F.lit("1990-06-01").alias("date_start"), F.lit(None).cast("string").alias("date_end")
    )
    return L.apply_fixes(e, fixes, "wikidata_qid", ["date_start", "date_end"]).select("id", "date_start", "date_end", F.array_join("changed_fields", ",").alias("changed"))


@query("l09_refreshed_reasons", """
SELECT id, CASE WHEN date_end < date_start THEN 'kept: x|date_order_invalid: ' || date_end || ' before ' || date_start ELSE 'kept: x' END AS reasons FROM ev""", "ev")
def refreshed_reasons(spark, d):
    fresh = F.when(F.col("date_end") < F.col("date_start"), F.concat(F.lit("date_order_invalid: "), "date_end", F.lit(" before "), "date_start"))
    old = F.array(F.lit("kept: x"), F.lit("date_order_invalid: old text"))
    return events(spark, d).select("id", F.array_join(L.refresh_reason(old, "date_order_invalid", fresh), "|").alias("reasons"))


@query("l16_backfill", """
SELECT id, CASE WHEN sitelinks_current IS NULL THEN 'missing' WHEN sitelinks IS NULL THEN 'set' WHEN sitelinks = sitelinks_current THEN 'kept' ELSE 'differs' END AS outcome FROM ev""", "ev")
def backfill(spark, d):
    return events(spark, d).select("id", L.backfill(F.col("sitelinks"), F.col("sitelinks_current")).alias("outcome"))


@query("l19_missing_locations", """
, m AS (SELECT id, sitelinks_current FROM ev WHERE location_quality = 'none' AND n % 77 <> 0)
SELECT id, sitelinks_current, row_number() OVER (ORDER BY sitelinks_current DESC NULLS LAST, id) AS place FROM m""", "ev")
def missing_locations(spark, d):
    e = events(spark, d)
    return L.missing_locations(e, e.where("n % 77 = 0").select("id"))
