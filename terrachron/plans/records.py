"""Queries of the derivation of records, its renewal, and title changes.

``stored_records`` makes every case from the number of an event: sources that agree, contradict, are missing or belong
to another item. The SQL twins state each field's rule on its own, in the order that the derivation must keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import events
from ..functions import temporal as T
from ..functions import text as X
from ..operators import records as R
from ..session import settle
from .registry import query

POINT = {"lon": 10.0, "lat": 10.0}


def _points() -> Column:
    """One point for each country of the test tables: a small dimension."""
    at = F.struct(F.lit(POINT["lon"]).alias("lon"), F.lit(POINT["lat"]).alias("lat"))
    return F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.concat(F.lit("NATION_"), k.cast("string"))), F.array_repeat(at, 25))


def _claims(*claims: tuple) -> Column:
    return F.array(*(F.struct(t.cast("string").alias("time"), p.cast("int").alias("precision"), F.lit(q).alias("property")) for t, p, q in claims))


def stored_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, entities, leads, ledger) of the test tables."""
    n = F.col("n")
    used = ("n", "id", "wikidata_qid", "resolved_qid", "title", "date_start", "date_end", "date_precision", "countries", "lon", "lat", "sitelinks", "wikidata_classes")
    e = settle(events(spark, d).select(*used)).withColumn("y", T.year_of("date_start"))  # read by all four
    start = F.when(n % 6 == 0, F.concat(F.col("y").cast("string"), F.lit("-01-01"))).otherwise(F.col("date_start"))
    e = e.withColumns({"claimed": F.col("date_start"), "date_start": start, "title": F.concat("title", F.lit(" "), F.col("y").cast("string"))})
    text = F.concat(F.col("title"), F.lit(" of "), F.col("y").cast("string"))
    records = e.select(
        "n", "id", "wikidata_qid", "resolved_qid", "title", "date_start", "date_end", "date_precision", "countries", "lon", "lat", "sitelinks", text.alias("extract"), F.lit(None).cast("string").alias("extract_retrieved_at"),
        F.lit("2024-05-06T00:00:00Z").alias("retrieved_at"), F.concat(F.lit("https://en.wikipedia.org/wiki/A"), n.cast("string")).alias("wikipedia_url"), F.lit("wikipedia").alias("coordinate_source"),
        F.array(F.lit("war")).alias("matched_classes"), F.when(n % 9 == 1, F.slice("countries", 1, 1)).otherwise(F.array().cast("array<string>")).alias("outside_tags"),
        F.when(n % 8 == 0, F.array(F.col("y") + 10)).when(n % 8 == 1, F.array("y")).alias("category_years"), F.when(n % 35 == 2, F.slice("countries", 1, 1)).alias("predecessor_tags"),
        F.when(n % 5 == 4, F.array(R.note(R.REVERSED, start=F.lit("x")), R.note(R.CATEGORY_YEARS, years=F.lit("1900, 1901")), R.note("kept"))).otherwise(R.no_notes()).alias("review_notes"),
        F.when(n % 5 == 3, F.array(R.note(R.ADJUSTED, rule=F.lit("old")), R.note(R.LEAD_YEAR, start=F.lit("x")))).otherwise(R.no_notes()).alias("date_notes"),
        F.lit(None).cast("array<string>").alias("wikipedia_lead_dates"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("date_end_open"), F.lit(None).cast("array<string>").alias("wikidata_classes"), F.lit(None).cast("string").alias("category"),
    )
    year = F.col("y").cast("string")
    nine, eleven = F.lit(9), F.lit(11)
    before = lambda k, tail: F.concat((F.col("y") - k).cast("string"), F.lit(tail))
    p585 = F.when(n % 6 == 0, _claims((F.concat(year, F.lit("-00-00")), nine, "P585"))).otherwise(_claims((F.col("date_start"), eleven, "P585")))
    p580 = F.when(n % 6 == 0, _claims((F.col("claimed"), eleven, "P580"))).when(n % 6 == 1, _claims((before(2, "-05-01"), eleven, "P580"))).when(n % 6 == 2, _claims((before(1, "-03-02"), eleven, "P580")))
    p582 = (
        F.when(n % 6 == 1, _claims((F.col("date_start"), eleven, "P582"), (F.col("date_end"), F.when(n % 3 == 0, 9).otherwise(11), "P582"))).when(n % 6 == 2, _claims((before(-3, "-01-01"), nine, "P582"), (F.col("date_end"), F.when(n % 3 == 0, 9).otherwise(11), "P582")))
        .otherwise(_claims((F.col("date_end"), F.when(n % 3 == 0, 9).otherwise(11), "P582")))
    )
    entities = e.where(n % 11 != 0).select(
        "wikidata_qid", F.col("wikidata_classes").alias("classes"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("end_open"), p585.alias("p585"), p580.alias("p580"), p582.alias("p582"), (n % 13 == 5).alias("redirected"),
        F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.slice("countries", 1, 1)).alias("direct_tags"), F.when(n % 7 == 1, F.array().cast("array<string>")).otherwise(F.slice("countries", 1, 2)).alias("place_tags"),
        F.array(F.lit("State")).alias("states"), (F.col("lon") + F.when(n % 4 == 1, 0.5).otherwise(0)).alias("lon"), "lat",
    )
    leads = e.where(n % 4 != 0).select(
        F.concat(F.lit("A"), n.cast("string")).alias("article"), F.concat(F.lit("A"), n.cast("string")).alias("title"), F.when(n % 4 == 2, "Q0").otherwise(F.col("wikidata_qid")).alias("item"), F.lit("2025-01-02T03:04:05Z").alias("retrieved_at"),
        F.when(n % 4 == 1, F.concat(F.lit("In "), year, F.lit(" the "), "title")).when(n % 4 == 2, F.concat(F.lit("Other "), (F.col("y") - 5).cast("string"))).otherwise(F.concat(F.lit("Near "), (F.col("y") - 3).cast("string"), F.lit(" and "), (F.col("y") - 4).cast("string"))).alias("extract"),
        (n % 20 != 7).alias("fetched"), (F.col("lon") + F.when(n % 4 == 1, 0.5).when(n % 4 == 2, 0.25).otherwise(0)).alias("lon"), "lat",
    ).withColumn("has_point", F.when(F.col("fetched"), True)).drop("fetched")
    sets = F.when(n % 10 == 3, F.array(F.lit("date_start"))).when(n % 10 == 5, F.array(F.lit("title"))).otherwise(F.array(F.lit("lon"), F.lit("lat")))
    ledger = e.where((n % 10).isin(3, 5, 7)).select(
        "wikidata_qid", F.concat(F.lit("F"), (n % 10).cast("string")).alias("ref"), sets.alias("set_fields"), F.concat(year, F.lit("-07-07")).alias("date_start"), F.lit("Set title").alias("title"),
        F.lit(None).cast("string").alias("date_end"), F.lit(None).cast("array<string>").alias("countries"), F.lit(60.0).alias("lon"), F.lit(-14.0).alias("lat"),
    )
    return records, entities, leads, ledger


#: The stored state and the sources of a record, as in ``stored_records``.
STORED = r"""
, s0 AS (SELECT n, id, resolved_qid, wikidata_qid, title || ' ' || substr(date_start, 1, 4) AS title, CAST(substr(date_start, 1, 4) AS INT) AS y, date_start AS claimed,
  CASE WHEN n % 6 = 0 THEN substr(date_start, 1, 4) || '-01-01' ELSE date_start END AS stored, date_end, date_precision, countries, lon, lat, sitelinks, wikidata_classes, n % 11 <> 0 AS there, n % 10 AS fix FROM ev)"""


@query("l05_derived_records", STORED + r"""
, s1 AS (SELECT *, n % 4 IN (1, 3) AS copied, n % 4 = 2 AS held,
  CASE n % 4 WHEN 1 THEN 'In ' || y || ' the ' || title WHEN 3 THEN 'Near ' || (y - 3) || ' and ' || (y - 4) ELSE title || ' of ' || y END AS extract,
  CASE n % 4 WHEN 3 THEN [y - 3, y - 4] ELSE [y] END AS years,
  CASE WHEN NOT there THEN NULL WHEN n % 6 = 0 THEN 'year' WHEN n % 6 = 1 THEN 'end' WHEN n % 6 = 2 AND (y + 3) || '-01-01' > stored THEN 'inside' END AS rule FROM s0),
s2 AS (SELECT *, CASE rule WHEN 'year' THEN claimed WHEN 'end' THEN (y - 2) || '-05-01' WHEN 'inside' THEN (y - 1) || '-03-02' ELSE stored END AS moved,
  there AND sitelinks IS NOT NULL AND n % 9 = 1 AS outside FROM s1),
s3 AS (SELECT *, CASE WHEN fix = 3 THEN y || '-07-07' ELSE moved END AS final, CASE WHEN outside THEN countries[2:] ELSE countries END AS tags,
  CASE WHEN fix = 5 THEN 'Set title' ELSE title END AS name, CASE WHEN fix = 7 THEN 60.0 ELSE lon END AS x,
  fix = 5 OR (fix = 3 AND moved <> y || '-07-07') OR (fix = 7 AND (lon <> 60.0 OR lat <> -14.0)) AS fixed FROM s2),
s4 AS (SELECT *, CAST(substr(final, 1, 4) AS INT) AS fy, CAST(substr(date_end, 1, 4) AS INT) AS ey,
  there AND n % 3 = 0 AND n % 6 <> 1 AS coarse, CASE WHEN n % 7 = 0 THEN [] ELSE countries[1:1] END AS direct, CASE WHEN n % 7 = 1 THEN [] ELSE countries[1:2] END AS place,
  CASE WHEN n % 35 = 2 THEN countries[1:1] ELSE [] END AS via, CASE WHEN n % 8 = 0 THEN [y + 10] WHEN n % 8 = 1 THEN [y] WHEN n % 5 = 4 THEN [1900, 1901] END AS cats FROM s3),
s5 AS (SELECT *, coalesce(date_end < final, false) AS rev, len(list_filter(years, lambda v: abs(v - fy) <= 1)) = 0 AS far_lead,
  list_distinct(list_concat(list_concat(direct, place), via)) AS known, len(cats) > 0 AND len(list_filter(cats, lambda v: v BETWEEN fy - 1 AND coalesce(ey, fy) + 1)) = 0 AS cat FROM s4),
s6 AS (SELECT *, rev AND coarse AND substr(date_end, 1, 4) || '-12-31' >= final AS coarse_end, len(list_filter(tags, lambda c: NOT list_contains(known, c))) > 0 AS unknown,
  n % 7 = 0 AND len(tags) > 0 AND len(list_filter(tags, lambda c: NOT list_contains(place, c))) = 0 AS alone FROM s5)
SELECT id, final AS date_start, CASE WHEN fix = 3 AND moved <> final THEN 'ledger' WHEN rule IS NOT NULL AND moved <> stored THEN 'start' END AS start_by,
  name AS title, CASE WHEN fix = 5 THEN 'ledger' END AS title_by, CASE WHEN copied THEN 'lead' END AS extract_by, CASE WHEN copied THEN '2025-01-02' ELSE '2024-05-06' END AS retrieved,
  array_to_string(tags, ',') AS countries, CASE WHEN outside THEN 'tags' END AS countries_by, CASE WHEN fix = 7 AND lon <> 60.0 THEN 'ledger' END AS lon_by,
  array_to_string(list_filter([CASE WHEN n % 5 = 4 THEN CASE WHEN cat THEN 'category_year_mismatch' END END, CASE WHEN n % 5 = 4 THEN 'kept' END,
    CASE WHEN held THEN 'extract_not_copied_qid_mismatch' END, CASE WHEN outside THEN 'country_from_outside_place_removed' END, CASE WHEN fix = 7 AND fixed AND len(tags) > 0 THEN 'coordinate_far_from_countries' END, CASE WHEN fixed THEN 'data_fix' END,
    CASE WHEN n % 5 <> 4 AND cat THEN 'category_year_mismatch' END,
    CASE WHEN NOT contains(regexp_replace(regexp_replace(lower(extract), '^the\s+', ''), '[^a-z0-9]+', '', 'g'), regexp_replace(regexp_replace(lower(name), '^the\s+', ''), '[^a-z0-9]+', '', 'g')) THEN 'title_differs_from_article' END,
    CASE WHEN n % 35 = 2 AND len(via) > 0 THEN 'country_via_predecessor_state' END,
    CASE WHEN NOT there THEN NULL WHEN alone THEN 'country_via_place_only' WHEN len(known) > 0 AND unknown THEN 'country_not_supported_by_wikidata' END], lambda z: z IS NOT NULL), '|') AS review_codes,
  array_to_string(list_filter([CASE WHEN rule IS NOT NULL THEN 'date_source_adjusted' END, CASE WHEN far_lead THEN 'date_start_year_not_in_lead' END,
    CASE WHEN coarse_end THEN 'date_end_precision_coarse' WHEN rev THEN 'date_order_invalid' END, CASE WHEN rev AND NOT coarse_end THEN 'wikipedia_dates_note' END], lambda z: z IS NOT NULL), '|') AS date_codes,
  CASE WHEN rev AND NOT coarse_end THEN array_to_string(list_sort(list_transform(years, lambda v: CAST(v AS VARCHAR))), ',') END AS lead_dates
FROM s6""", "ev")  # fmt: skip
def derived_records(spark, d):
    out = R.finalize(R.with_sources(*stored_records(spark, d)), _points(), "2026-01-01")
    by = F.col("set_by")
    return out.select(
        "id", "date_start", by["date_start"].alias("start_by"), "title", by["title"].alias("title_by"), by["extract"].alias("extract_by"), F.col("extract_retrieved_at").alias("retrieved"), F.array_join("countries", ",").alias("countries"), by["countries"].alias("countries_by"), by["lon"].alias("lon_by"),
        F.array_join(R.codes(F.col("review_notes")), "|").alias("review_codes"), F.array_join(R.codes(F.col("date_notes")), "|").alias("date_codes"), F.array_join("wikipedia_lead_dates", ",").alias("lead_dates"),
    )


@query("l04_order_notes", r"""
, s AS (SELECT id, date_start AS s, date_end AS e, CASE n % 5 WHEN 1 THEN 9 WHEN 2 THEN 10 WHEN 3 THEN 8 WHEN 4 THEN 11 END AS p, CASE WHEN n % 3 = 0 THEN '' WHEN n % 3 = 1 THEN 'No year here' ELSE 'From 3 May ' || (CAST(substr(date_start, 1, 4) AS INT) - 4) || ' on' END AS x FROM ev),
l AS (SELECT *, CASE p WHEN 9 THEN substr(e, 1, 4) || '-12-31' WHEN 10 THEN strftime(last_day(CAST(substr(e, 1, 7) || '-01' AS DATE)), '%Y-%m-%d') WHEN 8 THEN substr(e, 1, 3) || '9-12-31' END AS until,
  CASE p WHEN 9 THEN 'year' WHEN 10 THEN 'month' WHEN 8 THEN 'decade' END AS name, CAST(substr(s, 1, 4) AS INT) - 4 AS ly FROM s)
SELECT id, CASE WHEN until >= s THEN 'date_end_precision_coarse: end ' || e || ', end_precision ' || name || ', start ' || s || ', until ' || until
  ELSE 'date_order_invalid: end ' || e || ', end_precision ' || coalesce(name, 'unknown') || ', start ' || s
    || CASE WHEN x = '' THEN '' WHEN x = 'No year here' THEN '|wikipedia_dates_note: end ' || e || ', lacks , says no year, start ' || s
       ELSE '|wikipedia_dates_note: end ' || e || ', lacks start' || CASE WHEN abs(CAST(substr(e, 1, 4) AS INT) - ly) > 1 THEN ', end' ELSE '' END || ', says 3 May ' || ly || ', start ' || s END END AS notes
FROM l WHERE e < s""", "ev")
def order_notes(spark, d):
    n = F.col("n")
    told = F.when(n % 3 == 0, "").when(n % 3 == 1, "No year here").otherwise(F.concat(F.lit("From 3 May "), (T.year_of("date_start") - 4).cast("string"), F.lit(" on")))
    code = F.when(n % 5 == 1, 9).when(n % 5 == 2, 10).when(n % 5 == 3, 8).when(n % 5 == 4, 11)
    e = events(spark, d).withColumn("extract", told).withColumns({"years": X.years_in(told), "days": X.days_as_written(told)})
    e = e.withColumn("notes", R.order_notes(F.col("years"), F.col("days"), code))
    return e.where(F.size("notes") > 0).select("id", F.array_join(F.transform("notes", R.note_text), "|").alias("notes"))


@query("l10_rederived_starts", STORED + r"""
, c AS (SELECT *, there AND n % 13 <> 5 AND fix <> 3 AND n % 6 = 0 AND claimed <> stored AS changed, title || ' of ' || y AS extract FROM s0),
r AS (SELECT *, CASE WHEN changed THEN claimed ELSE stored END AS final, changed AND coalesce(date_end < claimed, false) AS rev, CAST(substr(date_end, 1, 4) AS INT) AS ey FROM c)
SELECT id, final AS date_start, CASE WHEN changed THEN 'day' ELSE date_precision END AS date_precision, changed,
  array_to_string(list_filter([CASE WHEN n % 5 = 3 AND NOT changed THEN 'date_source_adjusted' END, CASE WHEN n % 5 = 3 AND NOT changed THEN 'date_start_year_not_in_lead' END, CASE WHEN changed THEN 'date_source_adjusted' END,
    CASE WHEN rev AND n % 3 = 0 AND ey >= y THEN 'date_end_precision_coarse' WHEN rev THEN 'date_order_invalid' END, CASE WHEN rev AND NOT (n % 3 = 0 AND ey >= y) THEN 'wikipedia_dates_note' END], lambda z: z IS NOT NULL), '|') AS date_codes,
  array_to_string(CASE WHEN n % 5 = 4 THEN ['date_order_invalid', 'category_year_mismatch', 'kept'] ELSE [] END, '|') AS review_codes
FROM r""", "ev")
def rederived_starts(spark, d):
    out = R.rederive_starts(R.with_sources(*stored_records(spark, d)))
    return out.select("id", "date_start", "date_precision", F.col("start_change").isNotNull().alias("changed"), F.array_join(R.codes(F.col("date_notes")), "|").alias("date_codes"), F.array_join(R.codes(F.col("review_notes")), "|").alias("review_codes"))


@query("l10_rederived_pins", STORED + r"""
, p AS (SELECT *, CASE WHEN n % 4 = 0 OR n % 20 = 7 OR resolved_qid <> wikidata_qid THEN NULL WHEN n % 4 = 1 AND there THEN 'both_sources_differ' WHEN n % 4 IN (1, 2) THEN 'article_differs' END AS outcome FROM s0)
SELECT id, outcome, coalesce(outcome = 'both_sources_differ' AND fix <> 7, false) AS moved, CASE WHEN outcome = 'both_sources_differ' AND fix <> 7 THEN lon + 0.5 ELSE lon END AS lon,
  array_to_string(CASE WHEN n % 5 = 4 THEN ['date_order_invalid', 'category_year_mismatch', 'kept'] ELSE [] END, '|') || CASE WHEN coalesce(outcome = 'both_sources_differ' AND fix <> 7, false) AND
    2 * 6371 * asin(sqrt(sin(radians(10.0 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(10.0)) * sin(radians(10.0 - lon - 0.5) / 2) ** 2)) > 1500 THEN CASE WHEN n % 5 = 4 THEN '|' ELSE '' END || 'coordinate_far_from_countries' ELSE '' END
    || CASE WHEN coalesce(outcome = 'both_sources_differ' AND fix <> 7, false) AND abs((lon + 0.5) * 10 - round((lon + 0.5) * 10)) < 1e-6 AND abs(lat * 10 - round(lat * 10)) < 1e-6 THEN '~low' ELSE '' END AS review_codes
FROM p""", "ev")
def rederived_pins(spark, d):
    records, *sources = stored_records(spark, d)
    out = R.rederive_pins(R.with_sources(records.withColumn("location_quality", F.lit("precise")), *sources), _points())
    low = F.array_contains(R.codes(F.col("review_notes")), R.LOW_PRECISION)
    others = F.array_join(R.codes(R.without(F.col("review_notes"), R.LOW_PRECISION)), "|")
    return out.select("id", F.col("pin_outcome").alias("outcome"), F.col("pin_moved").alias("moved"), "lon", F.concat(others, F.when(low, "~low").otherwise("")).alias("review_codes"))


def _title_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records when they were looked at, records now, leads, where stored titles lead)."""
    n = F.col("n")
    of = lambda head, k=None: F.concat(F.lit(head), (n if k is None else k).cast("string"))
    url = lambda title: F.concat(F.lit("https://en.wikipedia.org/wiki/"), title)
    differs = F.array(R.note(R.TITLE_DIFFERS), R.note("kept"))
    e = events(spark, d).select("n", "id", "wikidata_qid", of("T").alias("title"), url(of("U")).alias("wikipedia_url"), F.when(n % 3 == 0, differs).otherwise(R.no_notes()).alias("review_notes"), R.no_notes().alias("date_notes"), (n % 3 == 0).alias("needs_review"))
    case = n % 10
    new = F.when(n % 20 == 11, of("Same", F.floor(n / 100))).when(case.isin(1, 2, 3, 4, 5), of("New")).when(case == 8, of("T", n - 7)).when(case == 9, of("T", n - 9)).otherwise(F.col("title"))
    leads = e.where(case != 6).select(
        of("U").alias("asked"), new.alias("title"), url(of("W")).alias("url"), F.when(case.isin(1, 4), of("U")).alias("redirected_from"), F.when(case == 4, "Part").alias("fragment"),
        F.when(case == 5, "Q0").otherwise(F.col("wikidata_qid")).alias("item"), n.alias("page"),
    )
    former = e.where(case.isin(2, 8, 9) | (n % 20 == 3)).select(F.col("title").alias("old_title"), F.when(case == 3, -1).otherwise(n).alias("page"), F.lit(None).cast("string").alias("fragment"))
    edited = F.when(n % 30 == 2, F.concat("title", F.lit(" edited"))).when(n % 30 == 22, of("New")).otherwise(F.col("title"))
    now = e.where("n % 30 <> 12").withColumns({"title": edited, "wikipedia_url": F.when(n % 30 == 22, url(of("W"))).otherwise(F.col("wikipedia_url"))})
    return e, now, leads, former


TITLES_SQL = r"""
, t AS (SELECT n, id, n % 10 AS c, 'T' || n AS title, CASE WHEN n % 20 = 11 THEN 'Same' || (n // 100) WHEN n % 10 IN (1, 2, 3, 4, 5) THEN 'New' || n WHEN n % 10 = 8 THEN 'T' || (n - 7) WHEN n % 10 = 9 THEN 'T' || (n - 9) ELSE 'T' || n END AS wanted FROM ev),
h AS (SELECT *, CASE c WHEN 6 THEN 'lead_missing' WHEN 4 THEN 'section_redirect' WHEN 5 THEN 'qid_mismatch' WHEN 3 THEN 'title_not_redirected_here' END AS hold,
  CASE WHEN n % 30 = 12 THEN 'unknown' WHEN n % 30 = 22 THEN 'already' WHEN n % 30 = 2 THEN 'stale' WHEN c IN (0, 7) THEN 'applied' END AS early FROM t),
o AS (SELECT 'T' || n AS title, id FROM t WHERE n % 10 NOT IN (2)),
one AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY id) AS nth FROM h WHERE c = 1),
gone AS (SELECT id, title, nth = 1 AS done FROM one),
two AS (SELECT h.*, CASE WHEN early IS NOT NULL THEN early WHEN c = 1 THEN CASE WHEN (SELECT done FROM gone WHERE gone.id = h.id) THEN 'applied' ELSE 'duplicate' END
  WHEN c IN (8, 9) THEN CASE WHEN wanted NOT IN (SELECT title FROM o) THEN 'applied' WHEN EXISTS (SELECT 1 FROM gone WHERE gone.title = wanted AND done AND gone.id < h.id) THEN 'applied' ELSE 'duplicate' END
  ELSE 'applied' END AS outcome FROM h WHERE hold IS NULL)"""


@query("l12_title_outcomes", TITLES_SQL + r"""
SELECT h.id, h.hold, CASE WHEN h.hold IS NULL OR h.c = 3 THEN CASE WHEN h.c IN (0, 7) THEN 'url_only' WHEN h.c = 1 THEN 'renamed_redirect' ELSE 'title_stale' END END AS kind, two.outcome FROM h LEFT JOIN two USING (id)""", "ev")
def title_outcomes(spark, d):
    from ..operators import titles as N

    seen, now, leads, former = _title_sources(spark, d)
    changes = N.second_look(N.detected(seen, leads), former)
    judged = N.outcomes(now, changes).select("id", "outcome")
    return changes.select("id", "hold", "kind").join(judged, "id", "left")


@query("l12_titles_applied", TITLES_SQL + r"""
SELECT h.id, CASE WHEN outcome = 'applied' THEN wanted WHEN n % 30 = 2 THEN title || ' edited' WHEN n % 30 = 22 THEN 'New' || n ELSE title END AS title,
  'https://en.wikipedia.org/wiki/' || CASE WHEN outcome = 'applied' OR n % 30 = 22 THEN 'W' ELSE 'U' END || n AS url, CASE WHEN n % 3 <> 0 THEN '' WHEN outcome = 'applied' THEN 'kept' ELSE 'title_differs_from_article|kept' END AS notes
FROM h LEFT JOIN (SELECT id, outcome FROM two) w USING (id) WHERE n % 30 <> 12""", "ev")
def titles_applied(spark, d):
    from ..operators import titles as N

    seen, now, leads, former = _title_sources(spark, d)
    out = N.applied(now, N.outcomes(now, N.second_look(N.detected(seen, leads), former)))
    return out.select("id", "title", F.col("wikipedia_url").alias("url"), F.array_join(R.codes(F.col("review_notes")), "|").alias("notes"))


@query("k01_duplicate_ids", """
, r AS (SELECT id FROM ev UNION ALL SELECT id FROM ev WHERE n % 50 = 1 UNION ALL SELECT id FROM ev WHERE n % 100 = 1), c AS (SELECT id, count(*) AS k FROM r GROUP BY id), u AS (SELECT id, k, unnest(generate_series(2, k)) AS i FROM c WHERE k > 1)
SELECT id, 'error' AS level, 'duplicate_id' AS code, 'duplicate_id: row ' || i || ' of ' || k AS msg FROM u""", "ev")
def duplicate_ids(spark, d):
    from ..operators import quality as K

    e = events(spark, d).select("n", "id")
    return K.duplicate_ids(e.unionByName(e.where("n % 50 = 1")).unionByName(e.where("n % 100 = 1")))


@query("k46_gate", """
, f AS (SELECT id, CASE WHEN n % 40 = 0 THEN 'error' ELSE 'warning' END AS level, 'c' || n % 3 AS code FROM ev WHERE n % 4 = 0)
SELECT (SELECT count(*) FROM f WHERE level = 'error') AS errors, (SELECT count(*) FROM f WHERE level = 'warning' AND NOT (CAST(replace(id, 'o-', '') AS BIGINT) % 8 = 0 AND code = 'c1')) AS fresh_warnings""", "ev")
def gate(spark, d):
    from ..operators import quality as K

    n = F.col("n")
    found = events(spark, d).where(n % 4 == 0).select("n", "id", F.when(n % 40 == 0, "error").otherwise("warning").alias("level"), F.concat(F.lit("c"), (n % 3).cast("string")).alias("code"))
    return K.gate(found, found.where(n % 8 == 0).select("id", F.lit("c1").alias("code")))


@query("k38_cross_checks", """
, s AS (SELECT id, date_start AS s, date_end AS e, CAST(substr(date_start, 1, 4) AS INT) AS a, CAST(substr(date_end, 1, 4) AS INT) AS b, n FROM ev),
t AS (SELECT *, CASE n % 4 WHEN 0 THEN [] WHEN 1 THEN [a] WHEN 2 THEN [a - 5] ELSE [a, a - 9] END AS ys, CASE n % 3 WHEN 0 THEN [] WHEN 1 THEN [a + 1] ELSE [a - 20] END AS cs FROM s)
SELECT id, array_to_string(list_filter([CASE WHEN e < s THEN 'date_order_invalid' END,
  CASE WHEN len(ys) = 0 THEN CASE WHEN n % 3 <> 1 THEN 'unverified_date' END WHEN n % 4 = 2 THEN 'date_year_mismatch' WHEN b IS NOT NULL AND len(list_filter(ys, lambda y: abs(y - b) <= 1)) = 0 THEN 'date_end_year_mismatch' END,
  CASE WHEN len(list_filter(cs, lambda y: y < least(a, coalesce(b, a)) - 1 OR y > coalesce(b, a) + 1)) > 0 AND len(list_filter(cs, lambda y: y BETWEEN a - 1 AND coalesce(b, a) + 1)) = 0 THEN 'category_year_mismatch' END], lambda z: z IS NOT NULL), '|') AS codes FROM t""", "ev")
def cross_checks(spark, d):
    n, y = F.col("n"), T.year_of("date_start")
    years = F.when(n % 4 == 0, F.array().cast("array<int>")).when(n % 4 == 1, F.array(y)).when(n % 4 == 2, F.array(y - 5)).otherwise(F.array(y, y - 9))
    categories = F.when(n % 3 == 0, F.array().cast("array<int>")).when(n % 3 == 1, F.array(y + 1)).otherwise(F.array(y - 20))
    e = events(spark, d).withColumns({"extract": F.concat(F.lit("In "), R.listed(years)), "categories": categories})
    return e.select("id", F.array_join(R.codes(R.cross_check_notes(F.col("categories"))), "|").alias("codes"))


@query("k30_lead_dates", """
, s AS (SELECT id, n, date_start AS s, date_end AS e, CAST(substr(date_start, 1, 4) AS INT) AS y FROM ev), t AS (SELECT *, coalesce(e < s, false) AS rev FROM s)
SELECT id, CASE WHEN n % 5 <> 1 AND NOT rev THEN 'lead_dates_without_flag' ELSE 'lead_dates_differ' END AS code FROM t WHERE (n % 5 <> 1 AND NOT rev) OR (n % 5 = 2 AND rev)""", "ev")
def lead_dates(spark, d):
    """Stored lead dates against those that the text gives: none, another list, or the right one."""
    from ..operators import notes as N

    n, y = F.col("n"), T.year_of("date_start")
    text = F.concat(F.lit("From 3 May "), y.cast("string"), F.lit(" to June 20, "), (y + 1).cast("string"), F.lit("; and 5–7 May 1950, of which the last day counts."))
    right = F.array(F.lit("1950-05-07"), F.concat(y.cast("string"), F.lit("-05-03")), F.concat((y + 1).cast("string"), F.lit("-06-20")))
    stored = F.when(n % 5 == 1, F.lit(None).cast("array<string>")).when(n % 5 == 2, F.array(F.lit("1950-05-07"))).otherwise(right)
    flags = F.when(F.col("date_end") < F.col("date_start"), F.array(F.lit("date_order_invalid: x"))).otherwise(F.array().cast("array<string>"))
    e = events(spark, d).withColumns({"extract": text, "wikipedia_lead_dates": stored, "date_flags": flags})
    return e.select("id", F.inline(F.array_compact(F.array(*N.lead_dates_rule(X.lead_dates("extract")))))).select("id", "code")
