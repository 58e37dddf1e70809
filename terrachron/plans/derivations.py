"""Queries of derivations, refreshes, the border build and further orders and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import events, features, table
from ..functions import temporal as T
from ..functions import text as X
from ..operators import borders as B
from ..operators import compare as C
from ..operators import derive as L
from ..operators import search as Q
from .registry import query


@query("l04_order_flags", "SELECT id, CASE WHEN date_end < date_start THEN 'date_order_invalid: ' || date_end || ' precedes ' || date_start ELSE '' END AS flags FROM ev", "ev")
def order_flags(spark, d):
    return events(spark, d).select("id", F.array_join(L.order_flags(), "|").alias("flags"))


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


@query("l05_finalized", rf"""
, r AS (SELECT id, wikidata_classes AS c, location_quality, coalesce(date_end < date_start, false) AS rev, coalesce(extract, '') AS t FROM evt),
g AS (SELECT *, list_distinct(list_transform(list_filter(c, lambda x: x <> 'protest movement'), lambda x: CASE WHEN x IN ('battle', 'war') THEN 'war' WHEN x = 'election' THEN 'political' WHEN x = 'bombing' THEN 'terrorism' ELSE x END)) AS gs,
  list_concat(regexp_extract_all(t, '\b\d{{1,2}} (?:{_MONTHS}) \d{{4}}\b'), regexp_extract_all(t, '\b(?:{_MONTHS}) \d{{1,2}}, \d{{4}}\b')) AS days, len(list_distinct(regexp_extract_all(t, '\b(?:1[0-9]{{3}}|20[0-9]{{2}})\b'))) AS years FROM r)
SELECT id, CASE WHEN list_contains(gs, 'terrorism') THEN 'terrorism' WHEN len(gs) = 0 THEN 'unclassified' WHEN len(gs) = 1 THEN gs[1] ELSE 'mixed' END AS category, CASE WHEN rev THEN 1 ELSE 0 END AS n_flags,
  CASE WHEN len(days) > 0 THEN len(list_distinct(days[1:4])) ELSE least(6, years) END AS n_lead_dates, rev AS needs_review, location_quality = 'none' AS needs_manual_coordinates FROM g""", "evt")
def finalized(spark, d):
    return L.finalize(events(spark, d, facts={"lead_dates": X.lead_dates("extract")})).select("id", "category", F.size("date_flags").alias("n_flags"), F.size("lead_dates").alias("n_lead_dates"), "needs_review", "needs_manual_coordinates")


@query("l06_support_flags", """
SELECT id, array_to_string(list_filter(list_transform(countries, lambda c: CASE WHEN c IN ('NATION_1', 'NATION_2') THEN NULL WHEN c IN ('NATION_3', 'NATION_4', 'NATION_5') THEN 'country_via_place: ' || c ELSE 'country_not_supported: ' || c END), lambda x: x IS NOT NULL), '|') AS flags FROM ev""", "ev")
def support_flags(spark, d):
    names = lambda *k: F.array(*(F.lit(f"NATION_{i}") for i in k))
    return events(spark, d).select("id", F.array_join(L.support_flags(F.col("countries"), names(1, 2), names(3, 4, 5)), "|").alias("flags"))


@query("l07_resolved_candidates", """
SELECT wikidata_qid AS qid, CASE WHEN n % 11 = 0 THEN 'no entity' WHEN n % 7 = 0 OR n % 5 = 0 THEN 'no lead' ELSE 'kept' END AS outcome FROM ev""", "ev")
def resolved_candidates(spark, d):
    e = events(spark, d)
    leads = e.where("n % 7 <> 0").select(F.col("wikidata_qid").alias("qid"), F.when(F.col("n") % 5 == 0, " ").otherwise(F.col("title")).alias("extract"))
    entities = e.where("n % 11 <> 0").select(F.col("wikidata_qid").alias("qid"), "lat", "lon")
    return L.resolve_candidates(e.select(F.col("wikidata_qid").alias("qid")), leads, entities).select("qid", "outcome")


@query("l11_refreshed_counts", """
SELECT id, CASE WHEN n % 17 = 0 THEN sitelinks_current WHEN n % 4 = 0 THEN n % 60 ELSE sitelinks_current END AS sitelinks,
       CASE WHEN n % 17 = 0 THEN 'missing' WHEN n % 4 = 0 AND sitelinks_current IS DISTINCT FROM n % 60 THEN 'changed' ELSE 'same' END AS outcome FROM ev""", "ev")
def refreshed_counts(spark, d):
    e = events(spark, d)
    fresh = e.where("n % 17 <> 0").select("wikidata_qid", F.when(F.col("n") % 4 == 0, F.col("n") % 60).otherwise(F.col("sitelinks_current")).alias("sitelinks"))
    return L.refresh_counts(e, fresh)


@query("l12_title_changes", """
, c AS (SELECT id, title, CASE WHEN n % 6 = 0 THEN 'The ' || title WHEN n % 6 = 1 THEN title || ' two' WHEN n % 6 = 2 THEN 'small ring' ELSE title END AS new_title FROM ev)
SELECT id, new_title, CASE WHEN new_title IN (SELECT title FROM ev) THEN 'held' WHEN starts_with(new_title, 'The ') THEN 'spelling' ELSE 'renamed' END AS kind FROM c WHERE title <> new_title""", "ev")
def title_changes(spark, d):
    e = events(spark, d)
    n, t = F.col("n"), F.col("title")
    leads = e.select("id", F.when(n % 6 == 0, F.concat(F.lit("The "), t)).when(n % 6 == 1, F.concat(t, F.lit(" two"))).when(n % 6 == 2, "small ring").otherwise(t).alias("title"))
    return L.title_changes(e, leads)


@query("l13_refreshed_leads", """
SELECT id, CASE WHEN n % 9 = 0 THEN 'no lead' WHEN resolved_qid <> wikidata_qid THEN 'held' WHEN n % 2 = 0 THEN 'same' ELSE 'replaced' END AS outcome FROM ev""", "ev")
def refreshed_leads(spark, d):
    e = events(spark, d).withColumn("extract", F.col("title"))
    leads = e.where("n % 9 <> 0").select("id", F.when(F.col("n") % 2 == 0, F.concat(F.lit(" "), "title")).otherwise(F.concat("title", F.lit(" more"))).alias("extract"))
    return L.refresh_leads(e, leads)


@query("l14_synced_mirrors", """
, p AS (SELECT a.id, min(b.title) AS own FROM ev a JOIN ev b ON a.resolved_qid = b.wikidata_qid WHERE a.resolved_qid <> a.wikidata_qid AND a.id <> b.id GROUP BY a.id)
SELECT ev.id, coalesce(own, title) AS title FROM ev LEFT JOIN p ON p.id = ev.id""", "ev")
def synced_mirrors(spark, d):
    e = events(spark, d)
    return L.sync_mirrors(e, C.mirror_pairs(e), "title").select("id", "title")


@query("l15_seed_proposals", "SELECT id, 'date_end' AS field, date_start AS proposed FROM ev WHERE date_end IS NULL UNION ALL SELECT id, 'sitelinks', '7' FROM ev WHERE sitelinks IS NULL AND n % 2 = 0", "ev")
def seed_proposals(spark, d):
    e = events(spark, d)
    entities = e.select("wikidata_qid", F.col("date_start").alias("new_end"), F.when(F.col("n") % 2 == 0, 7).alias("new_links"))
    return L.seed_proposals(e, entities, {"date_end": "new_end", "sitelinks": "new_links"})


@query("l17_stale_fixes", "SELECT wikidata_qid, date_start AS was, CASE WHEN n % 40 = 0 THEN NULL ELSE date_start || '!' END AS now FROM ev WHERE n % 20 = 0", "ev")
def stale_fixes(spark, d):
    e = events(spark, d)
    fixes = e.where("n % 10 = 0").select("wikidata_qid", F.col("date_start").alias("was"))
    now = F.when(F.col("n") % 20 == 0, F.concat("date_start", F.lit("!"))).otherwise(F.col("date_start"))
    return L.stale_fixes(fixes, e.where("n % 40 <> 0").select("wikidata_qid", now.alias("now")))


@query("l20_review_findings", """
, r AS (SELECT ev.id, left(sha1(title), 12) AS h, CASE WHEN n % 10 = 0 THEN 'old' ELSE left(sha1(title), 12) END AS rh, list_filter(['ring', 'plate'], lambda p: contains(title, p)) AS p FROM ev WHERE n % 3 = 0)
SELECT id, h <> rh AS stale, CASE WHEN h <> rh THEN '' ELSE array_to_string(p, ',') END AS phrases FROM r""", "ev")
def review_findings(spark, d):
    from ..functions import text as X

    e = events(spark, d).withColumn("text", F.col("title")).withColumn("text_sha1", X.text_sha1("title"))
    reviews = e.where("n % 3 = 0").select("id", F.when(F.col("n") % 10 == 0, "old").otherwise(F.col("text_sha1")).alias("text_sha1"), F.array(F.lit("ring"), F.lit("plate")).alias("phrases"))
    return L.review_findings(reviews, e).select("id", "stale", F.array_join("phrases", ",").alias("phrases"))


@query("l01_kept_precisions", "SELECT id, 11 AS precision, 'P580' AS property FROM ev WHERE substr(date_start, 9, 2) <> '01' UNION ALL SELECT id, 11, 'P580' FROM ev WHERE substr(date_start, 9, 2) = '01'", "ev")
def kept_precisions(spark, d):
    claim = lambda t, p, q: F.struct(t.alias("time"), F.lit(p).alias("precision"), F.lit(q).alias("property"))
    month = F.concat(F.substring("date_start", 1, 7), F.lit("-00"))
    kept = L.kept_precision(F.array(claim(month, 10, "P585"), claim(F.col("date_start"), 11, "P580")), F.col("date_start"))
    return events(spark, d).select("id", kept["precision"].alias("precision"), kept["property"].alias("property"))


@query("m02_resolved_labels", """
, c AS (SELECT cell, name, start_year, end_year, list_sort(list_distinct(list_prepend(start_year, list_filter([1996, 2000 + cell % 2], lambda y: y > start_year AND y <= end_year)))) AS s FROM ft),
u AS (SELECT *, unnest(generate_series(1, len(s))) AS i FROM c)
SELECT name, start_year, s[i] AS sub_start, CASE WHEN cell % 5 = 0 AND s[i] BETWEEN 1996 AND 1997 THEN 'flag' WHEN cell % 2 = 0 AND s[i] BETWEEN 1995 AND 1999 THEN 'split' ELSE name END AS label FROM u""", "ft")
def resolved_labels(spark, d):
    f = features(spark, d)
    cuts = f.select("cell", F.explode(F.array(F.lit(1996), (F.lit(2000) + F.col("cell") % 2).cast("int"))).alias("year")).distinct()
    cells = f.select("cell").distinct()
    flags = cells.where("cell % 5 = 0").select("cell", F.lit(1996).alias("from_year"), F.lit(1997).alias("to_year"), F.lit("flag").alias("label"))
    splits = cells.where("cell % 2 = 0").select("cell", F.lit(1995).alias("from_year"), F.lit(1999).alias("to_year"), F.lit("split").alias("label"))
    return B.resolve_properties(B.split_periods(f, cuts), flags, splits).select("name", "start_year", "sub_start", "label")


@query("m04_cut_neighbours", """
, c AS (SELECT name, start_year, end_year, list_sort(list_distinct(list_prepend(start_year, CASE WHEN cell % 4 = 0 THEN list_filter([1996, 2001], lambda y: y > start_year AND y <= end_year) ELSE [] END))) AS s FROM ft WHERE overlay = 0), u AS (SELECT *, unnest(generate_series(1, len(s))) AS i FROM c)
SELECT name, start_year, s[i] AS sub_start, coalesce(s[i + 1] - 1, end_year) AS sub_end FROM u""", "ft")
def cut_neighbours(spark, d):
    return B.cut_neighbours(features(spark, d)).select("name", "start_year", "sub_start", "sub_end")


@query("m07_status_labels", "SELECT name, start_year, CASE status WHEN 'disputed' THEN 'Disputed' WHEN 'occupied-territory-included' THEN 'Includes occupied territory' ELSE '' END AS label, coalesce(status = 'disputed', false) AS dashed FROM ft", "ft")
def status_labels(spark, d):
    s = F.col("status")
    return features(spark, d).select("name", "start_year", B.status_label(s).alias("label"), B.is_dashed(s).alias("dashed"))


@query("m09_overlay_sets", "SELECT name, CASE WHEN cell % 4 = 0 THEN 'Disputed ' || replace(name, ' (phase 1)', '') ELSE '' END AS overlays FROM ft WHERE overlay = 0 AND 1999 BETWEEN start_year AND end_year", "ft")
def overlay_sets(spark, d):
    return B.overlay_sets(features(spark, d), 1999).select("name", F.array_join("overlays", ",").alias("overlays"))


@query("m10_placeholders", "SELECT cell % 5 AS grp, start_year, end_year, count(*) AS members FROM ft GROUP BY 1, 2, 3", "ft")
def placeholders(spark, d):
    return B.placeholders(features(spark, d), F.col("cell") % 5)


@query("g06_shown_now", """
SELECT count(*) AS shown, count(*) FILTER (sitelinks IS NULL) AS hand_picked, count(*) FILTER (sitelinks >= 10) AS discovered, count(*) FILTER (list_sort(countries) = countries) AS same_countries FROM ev""", "ev")
def shown_now(spark, d):
    return events(spark, d).agg(
        F.count("*").alias("shown"), F.count_if(F.col("sitelinks").isNull()).alias("hand_picked"), F.count_if(F.col("sitelinks") >= 10).alias("discovered"), F.count_if(F.array_sort("countries") == F.col("countries")).alias("same_countries")
    )


@query("g15_review_counters", """
SELECT quality, count(*) AS n, count(*) FILTER (doc_id % 10 = 0) AS stale, count(*) FILTER (text IS NULL) AS missing FROM labels LEFT JOIN documents USING (doc_id) GROUP BY quality""")
def review_counters(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "left")
    return j.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 10 == 0).alias("stale"), F.count_if(F.col("text").isNull()).alias("missing"))


@query("i01_by_date", "SELECT id, row_number() OVER (ORDER BY coalesce(CASE WHEN n % 8 <> 0 THEN date_start END, ''), id) AS place FROM ev ORDER BY place LIMIT 300", "ev")
def by_date(spark, d):
    e = events(spark, d).withColumn("date_start", F.when(F.col("n") % 8 != 0, F.col("date_start")))
    return Q.numbered(e, [F.coalesce("date_start", F.lit("")).asc(), F.col("id").asc()], 300).select("id", "place")


@query("i04_undated_last", "SELECT id, row_number() OVER (ORDER BY CASE WHEN n % 8 <> 0 THEN date_start END NULLS LAST, id) AS place FROM ev ORDER BY place LIMIT 300", "ev")
def undated_last(spark, d):
    e = events(spark, d).withColumn("date_start", F.when(F.col("n") % 8 != 0, F.col("date_start")))
    return Q.numbered(e, [F.col("date_start").asc_nulls_last(), F.col("id").asc()], 300).select("id", "place")


@query("i11_review_ranking", """
, s AS (SELECT id, n % 7 AS reverted, (CASE WHEN coalesce(date_end < date_start, false) THEN 3 ELSE 0 END) + (CASE WHEN location_quality = 'none' THEN 2 ELSE 0 END) AS score FROM ev)
SELECT id, score, row_number() OVER (ORDER BY score DESC, reverted DESC, id) AS place FROM s WHERE score >= 3 ORDER BY place LIMIT 100""", "ev")
def review_ranking(spark, d):
    from ..operators import report as G

    score, _ = G.signal_score({"reversed": (F.col("date_end") < F.col("date_start"), 3), "unplaced": (F.col("location_quality") == "none", 2)})
    rows = events(spark, d).select("id", (F.col("n") % 7).alias("reverted"), score.alias("score")).where("score >= 3")
    return Q.numbered(rows, [F.col("score").desc(), F.col("reverted").desc(), F.col("id").asc()], 100).select("id", "score", "place")


@query("e07_hits_in_index_order", """
, f AS (SELECT id, date_start, (n * 37) % 101 AS rank FROM ev WHERE n % 3 = 0) SELECT id, row_number() OVER (ORDER BY rank, date_start, id) AS place FROM f WHERE id IN (SELECT id FROM ev WHERE location_quality = 'precise') ORDER BY place LIMIT 100""", "ev")
def hits_in_index_order(spark, d):
    e = events(spark, d)
    hits = e.where("n % 3 = 0").select("id", ((F.col("n") * 37) % 101).alias("rank"))
    rows = e.where("location_quality = 'precise'").join(hits, "id")
    return Q.numbered(rows, [F.col("rank").asc(), F.col("date_start").asc(), F.col("id").asc()], 100).select("id", "place")


@query("e18_count_in_box", "SELECT count(*) AS n FROM ev WHERE lon BETWEEN 0 AND 30 AND lat BETWEEN -5 AND 20", "ev")
def count_in_box(spark, d):
    from ..functions import spatial as S

    return events(spark, d).where(S.in_box((0, -5, 30, 20))).agg(F.count("*").alias("n"))


@query("f29_predecessors", """
, p AS (SELECT id, CAST(substr(date_start, 1, 4) AS INT) AS y, unnest(countries) AS c FROM ev)
SELECT id, c AS country, CASE WHEN y <= 1997 + CAST(string_split(c, '_')[2] AS INT) % 3 THEN c || ' (phase 1)' ELSE c END AS state FROM p""", "ev")
def predecessors(spark, d):
    tags = events(spark, d).select("id", T.year_of("date_start").alias("y"), F.explode("countries").alias("country"))
    k = F.element_at(F.split("country", "_"), 2).cast("int")
    return tags.select("id", "country", F.when(F.col("y") <= 1997 + k % 3, F.concat("country", F.lit(" (phase 1)"))).otherwise(F.col("country")).alias("state"))


@query("c22_fallback_points", """
, pl AS (SELECT n_name AS country, CAST(n_nationkey % 5 AS DOUBLE) * 10 AS lon, CAST(n_nationkey // 5 AS DOUBLE) * 8 - 4 AS lat, CASE WHEN n_nationkey % 4 <> 0 THEN 'City ' || n_nationkey END AS place FROM nation WHERE n_nationkey % 6 <> 5),
t AS (SELECT id, unnest(countries) AS c, unnest(generate_series(1, len(countries))) AS nth FROM ev WHERE location_quality = 'none'),
f AS (SELECT t.id, pl.*, row_number() OVER (PARTITION BY t.id ORDER BY nth) AS k FROM t JOIN pl ON c = country)
SELECT id, country, lon, lat, 'country-fallback:' || country AS coordinate_source,
       'At the point of ' || country || coalesce(', ' || place, '') AS note
FROM f WHERE k = 1""", "ev")
def fallback_points(spark, d):
    from ..operators import relate as R

    k = F.col("n_nationkey")
    places = table(spark, d, "nation").where(k % 6 != 5).select(
        F.col("n_name").alias("country"), ((k % 5).cast("double") * 10).alias("lon"), (F.floor(k / 5).cast("double") * 8 - 4).alias("lat"), F.when(k % 4 != 0, F.concat(F.lit("City "), k.cast("string"))).alias("place")
    )
    told = F.concat(F.lit("At the point of "), "country", F.coalesce(F.concat(F.lit(", "), "place"), F.lit("")))
    return R.fallback_points(events(spark, d), places, told).select("id", "country", "lon", "lat", "coordinate_source", "note")


@query("m03_added_entries", """
SELECT name, CAST(start_year AS BIGINT) AS start_year, CAST(end_year AS BIGINT) AS end_year, status, false AS added FROM ft
UNION ALL SELECT 'Added ' || c_custkey, 1992 + c_custkey % 5, 1994 + c_custkey % 5, CASE WHEN c_custkey % 3 = 0 THEN 'disputed' END, true FROM customer""", "ft")
def added_entries(spark, d):
    year = F.col("c_custkey").cast("long") % 5
    entries = table(spark, d, "customer").select(
        F.concat(F.lit("Added "), F.col("c_custkey").cast("string")).alias("name"), (year + 1992).alias("start_year"), (year + 1994).alias("end_year"), F.when(F.col("c_custkey") % 3 == 0, "disputed").alias("status")
    )
    found = features(spark, d).select("name", F.col("start_year").cast("long").alias("start_year"), F.col("end_year").cast("long").alias("end_year"), "status")
    return B.with_additions(found, entries)


@query("k43_ring_findings", """
WITH c AS (SELECT 'Area ' || c_custkey AS name, 1990 + c_custkey % 9 AS start_year, c_custkey AS k FROM customer)
SELECT name, CAST(start_year AS BIGINT) AS start_year, CASE WHEN k % 2 = 0 THEN 'accepted crossing' ELSE 'ring crosses itself' END AS finding, 1 AS n FROM c WHERE k % 3 = 0
UNION ALL SELECT name, start_year, 'rings cross', 2 FROM c WHERE k % 3 = 1
UNION ALL SELECT name, start_year, 'accepted crossing no longer found', 1 FROM c WHERE k % 3 <> 0 AND k % 2 = 0""")
def ring_findings(spark, d):
    """Every third customer's area is a bow tie, the next one has a hole that leaves its outline; every second crossing is accepted."""
    k = F.col("c_custkey").cast("long")
    at = table(spark, d, "customer").select(
        F.concat(F.lit("Area "), k.cast("string")).alias("name"), (k % 9 + 1990).alias("start_year"), k.alias("k"), ((k % 64) * 2.0 - 64).alias("x"), ((F.floor(k / 64) % 32) * 2.0 - 32).alias("y")
    )

    def ring(*points):
        return F.array(*(F.struct((F.col("x") + px).alias("lon"), (F.col("y") + py).alias("lat")) for px, py in points))

    tie = ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))
    square = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    hole = ring((0.5, 0.25), (1.5, 0.25), (1.5, 0.75), (0.5, 0.75), (0.5, 0.25))
    shape = F.when(F.col("k") % 3 == 0, F.array(F.array(tie))).when(F.col("k") % 3 == 1, F.array(F.array(square, hole))).otherwise(F.array(F.array(square)))
    areas = at.withColumns({"polygons": shape, "end_year": F.col("start_year") + 2})
    accepted = areas.where("k % 2 = 0").select("name", "start_year", "end_year", (F.col("x") + 0.5).alias("lon"), (F.col("y") + 0.5).alias("lat"))
    return B.ring_findings(areas, accepted).select("name", "start_year", "finding", "n")
