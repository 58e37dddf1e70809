"""Queries of note and list rules, anti-joins against other lists, contexts and marked text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import events, features, table
from ..functions import temporal as T
from ..operators import notes as N
from .registry import query

#: Events whose every third pair of dates is reversed, for DuckDB.
_REVERSED_SQL = """
, w AS (SELECT *, CASE WHEN n % 3 = 0 AND date_end IS NOT NULL THEN date_end ELSE date_start END AS s, CASE WHEN n % 3 = 0 AND date_end IS NOT NULL THEN date_start ELSE date_end END AS e FROM ev),
x AS (SELECT *, coalesce(e < s, false) AS rev, CAST(substr(s, 1, 4) AS INT) AS y1, CAST(substr(e, 1, 4) AS INT) AS y2 FROM w)
"""

#: The findings that the made notes and fields must give: (level, code, message, condition).
_EXPECTED = (
    ("error", "date_flags_form", "date_flags_form", "n % 7 = 5"),
    ("error", "stale_date_flag", "date_order_invalid: in order", "n % 7 < 2 AND NOT rev"),
    ("error", "stale_date_flag", "date_order_invalid: other values", "n % 7 = 1 AND rev"),
    ("error", "stale_date_flag", "date_start_year_not_in_lead: in lead", "n % 7 = 2 AND n % 4 = 0"),
    ("error", "stale_date_flag", "date_source_adjusted: other values", "n % 7 = 3 AND substr(s, 9, 2) <> '01'"),
    ("error", "stale_date_flag", "date_end_precision_coarse: in order", "n % 7 = 4 AND NOT rev"),
    ("warning", "stale_review_reason", "category_year_mismatch: other values", "n % 6 = 1 AND coalesce(y2, y1) <> y1"),
    ("warning", "stale_review_reason", "category_year_mismatch: listed", "n % 6 = 1 AND coalesce(y2, y1) = y1"),
    ("warning", "stale_review_reason", "unverified_date: other values", "n % 6 = 2 AND n % 4 = 2"),
    ("warning", "stale_review_reason", "month_precision_day_in_lead: other values", "n % 6 = 3"),
    ("warning", "stale_review_reason", "date_precision_coarse: other values", "n % 6 = 4 AND n % 4 <> 2"),
    ("error", "extract_retrieved_at", "extract_retrieved_at", "n % 11 < 2"),
    ("error", "revision_id", "revision_id", "n % 4 <> 0 AND n <= 20"),
    ("error", "revision_time", "revision_time", "n % 12 = 3"),
    ("error", "revision_unpaired", "revision_unpaired", "n % 4 < 2"),
    ("error", "deprecated_category_label", "deprecated_category_label", "n % 50 = 0"),
    ("error", "source_with_none", "source_with_none", "n % 7 = 0 AND n % 2 = 1"),
    ("error", "source_of_approximate", "source_of_approximate", "n % 7 = 1 AND n % 30 >= 25"),
    ("error", "source_of_precise", "source_of_precise", "n % 7 > 1 AND n % 3 = 2"),
    ("error", "article_missing", "article_missing", "n % 9 = 0"),
    ("error", "article_form", "article_form", "n % 9 = 1"),
    ("error", "article_not_english", "article_not_english", "n % 9 = 2"),
    ("error", "needs_review_derived", "needs_review_derived", "(n % 2 = 0) <> (n % 6 <> 5 OR n % 7 <> 6)"),
    ("error", "needs_manual_coordinates_derived", "needs_manual_coordinates_derived", "(n % 5 = 0) <> (n % 7 < 2)"),
    ("error", "lead_dates_without_flag", "lead_dates_without_flag", "n % 10 < 2 AND n % 7 > 1"),
    ("error", "lead_dates_differ", "lead_dates_differ", "n % 10 = 1 AND n % 7 < 2"),
)
_EXPECTED_SQL = _REVERSED_SQL + " UNION ALL ".join(f"SELECT id, '{level}' AS level, '{code}' AS code, '{msg}' AS msg FROM x WHERE {when}" for level, code, msg, when in _EXPECTED)


def _noted(spark, d):
    """Events with reversed dates, notes, revisions, sources and articles, some of them faulty."""
    n = F.col("n")
    turn = (n % 3 == 0) & F.col("date_end").isNotNull()
    e = events(spark, d).withColumns({"date_start": F.when(turn, F.col("date_end")).otherwise(F.col("date_start")), "date_end": F.when(turn, F.col("date_start")).otherwise(F.col("date_end"))})
    s, end = F.col("date_start"), F.coalesce("date_end", F.lit("none"))
    y1 = F.substring(s, 1, 4)
    y2 = F.coalesce(F.substring("date_end", 1, 4), y1)
    words = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    flag = (
        F.when(n % 7 == 0, words("date_order_invalid: Wikidata start (", s, ") is after end (", end, ")"))
        .when(n % 7 == 1, words("date_order_invalid: date_end (1990-01-01) precedes date_start (", s, ")"))
        .when(n % 7 == 2, words("date_start_year_not_in_lead: start year ", y1, " (", s, ")"))
        .when(n % 7 == 3, words("date_source_adjusted: used P585 start time ", F.substring(s, 1, 8), "00"))
        .when(n % 7 == 4, words("date_end_precision_coarse: end time ", end, " is before the start (", s, ")"))
        .when(n % 7 == 5, "")
    )
    reason = (
        F.when(n % 6 == 0, words("category_year_mismatch: [1801, 1802] not within 1 year of ", y1, "-", y2))
        .when(n % 6 == 1, words("category_year_mismatch: [", y1, "] not within 1 year of ", y1))
        .when(n % 6 == 2, words("unverified_date: sources do not confirm ", (y1.cast("int") + F.when(n % 4 == 2, 1).otherwise(0)).cast("string")))
        .when(n % 6 == 3, words("month_precision_day_in_lead: date_start ", s, " has only month precision"))
        .when(n % 6 == 4, "date_precision_coarse: only to month precision")
    )
    return e.withColumns({
        "date_flags": F.when(flag.isNotNull(), F.array(flag)), "review_reasons": F.when(reason.isNotNull(), F.array(reason)),
        "extract": F.when(n % 4 == 0, words("It began in ", y1, ".")).otherwise("No year is named."),
        "needs_review": n % 2 == 0, "needs_manual_coordinates": n % 5 == 0, "category_label": F.when(n % 50 == 0, "x"),
        "extract_retrieved_at": F.when(n % 11 == 0, "2026-02-30").when(n % 11 > 1, "2026-10-01T00:00:00Z"),
        "wikipedia_revid": F.when(n % 4 != 0, n - 20), "wikipedia_revid_timestamp": F.when(n % 12 == 3, "2026-10-15").when(n % 4 != 1, "2026-10-15T19:38:37Z"),
        "coordinate_source": F.when(n % 7 == 0, F.when(n % 2 == 1, "wikidata")).when(n % 7 == 1, words("country-fallback:NATION_", (n % 30).cast("string"))).when(n % 3 == 0, "manual-override").when(n % 3 == 1, "wikidata"),
        "wikipedia_url": F.when(n % 9 == 1, "http://x").when(n % 9 == 2, "https://fr.wikipedia.org/wiki/A").when(n % 9 > 2, "https://en.wikipedia.org/wiki/A"),
        "wikipedia_lead_dates": F.when(n % 10 == 0, F.array(F.lit("1990-01-01"))).when(n % 10 == 1, F.array(F.lit("1991"))),
    })


@query("k07_record_findings", _EXPECTED_SQL, "ev")
def record_findings(spark, d):
    known = F.array(*(F.lit(f"NATION_{i}") for i in range(25)))
    return N.record_findings(_noted(spark, d), known, F.array(F.lit("1990-01-01")))


@query("k45_listed_findings", """
, l AS (SELECT n AS place, CASE WHEN n % 8 <> 0 THEN 'o-' || (n // 2) END AS id, CASE WHEN n % 10 = 0 THEN 'X1' WHEN n % 10 < 6 THEN 'Q' || (n // 4 + 1) END AS q, CASE WHEN n % 9 = 0 THEN ' ' ELSE 'moved' END AS reason,
  CASE WHEN n % 12 = 0 THEN '2026-02-30' ELSE '2026-10-01' END AS removed_on FROM ev)
SELECT place, 'id_missing' AS code FROM l WHERE id IS NULL UNION ALL SELECT place, 'qid_form' FROM l WHERE q = 'X1' UNION ALL SELECT place, 'reason_missing' FROM l WHERE reason = ' '
UNION ALL SELECT place, 'day_form' FROM l WHERE removed_on = '2026-02-30' UNION ALL SELECT place, 'still_there' FROM l WHERE id IN (SELECT id FROM ev WHERE n % 5 = 0)
UNION ALL SELECT place, 'id_repeated' FROM (SELECT place, min(place) OVER (PARTITION BY id) AS first FROM l WHERE id IS NOT NULL) WHERE place > first
UNION ALL SELECT place, 'qid_repeated' FROM (SELECT place, min(place) OVER (PARTITION BY q) AS first FROM l WHERE q <> 'X1') WHERE place > first""", "ev")
def listed_findings(spark, d):
    e, n = events(spark, d), F.col("n")
    number = lambda by, plus: (F.floor(n / by) + plus).cast("string")
    entries = e.select(
        n.alias("place"), F.when(n % 8 != 0, F.concat(F.lit("o-"), number(2, 0))).alias("id"),
        F.when(n % 10 == 0, "X1").when(n % 10 < 6, F.concat(F.lit("Q"), number(4, 1))).alias("wikidata_qid"),
        F.when(n % 9 == 0, " ").otherwise("moved").alias("reason"), F.when(n % 12 == 0, "2026-02-30").otherwise("2026-10-01").alias("removed_on"),
    )
    return N.listed_findings(entries, e.where("n % 5 = 0"), "removed_on")


@query("k47_outside_extent", "SELECT id, lon, lat FROM ev WHERE lon < -10 OR lon > 60 OR lat < -10 OR lat > 35", "ev")
def outside_extent(spark, d):
    return N.outside_extent(events(spark, d), (-10.0, -10.0, 60.0, 35.0)).select("id", "lon", "lat")


@query("f26_dangling_hints", """
, h AS (SELECT id, unnest(['o-' || (n + 1), 'o-' || (n + 2)]) AS hint FROM ev) SELECT id, hint FROM h WHERE hint NOT IN (SELECT id FROM ev WHERE n % 3 <> 0 OR n % 6 = 0)""", "ev")
def dangling_hints(spark, d):
    e = events(spark, d)
    other = lambda k: F.concat(F.lit("o-"), (F.col("n") + k).cast("string"))
    here = e.withColumn("possible_duplicates", F.array(other(1), other(2)))
    # The records of this list are those not divisible by 3; hints of all records are looked at against both lists.
    found = N.dangling_hints(here.where("n % 3 <> 0"), e.where("n % 6 = 0"))
    rest = N.dangling_hints(here.where("n % 3 = 0").select("id", "possible_duplicates"), e.where("n % 3 <> 0 OR n % 6 = 0"))
    return found.unionByName(rest)


@query("f23_without_curated", """
, r AS (SELECT id, CASE WHEN n % 6 <> 0 THEN resolved_qid END AS wikidata_qid FROM ev) SELECT * FROM r WHERE wikidata_qid IS NULL OR wikidata_qid NOT IN (SELECT wikidata_qid FROM ev WHERE n % 4 = 0)""", "ev")
def without_curated(spark, d):
    e = events(spark, d)
    records = e.select("id", F.when(F.col("n") % 6 != 0, F.col("resolved_qid")).alias("wikidata_qid"))
    return N.without_curated(records, e.where("n % 4 = 0"))


@query("f32_existed_in", "SELECT id, CAST(substr(date_start, 1, 4) AS INT) <= 1996 AND (date_end IS NULL OR CAST(substr(date_end, 1, 4) AS INT) > 1996) AS stood FROM ev", "ev")
def existed_in(spark, d):
    return events(spark, d).select("id", N.existed_in(T.year_of("date_start"), T.year_of("date_end"), F.lit(1996)).alias("stood"))


@query("f13_drawn_features", """
, tg AS (SELECT id, CAST(substr(date_start, 1, 4) AS INT) AS y, unnest(countries) AS c FROM ev)
SELECT DISTINCT id, name, start_year FROM tg JOIN ft ON (ft.name = c OR ft.name = c || ' (phase 1)') AND y BETWEEN start_year AND end_year""", "ev ft")
def drawn_features(spark, d):
    f = features(spark, d)
    member = F.when(F.col("name").endswith(" (phase 1)"), F.array(F.replace("name", F.lit(" (phase 1)"), F.lit(""))))
    return N.drawn_features(events(spark, d), f.withColumn("placeholder_for", member))


@query("i06_context_order", """
SELECT id, parent_qid, row_number() OVER (PARTITION BY parent_qid ORDER BY CASE WHEN n % 8 <> 0 THEN date_start END NULLS LAST, id) AS place FROM ev WHERE parent_qid IS NOT NULL""", "ev")
def context_order(spark, d):
    e = events(spark, d).withColumn("date_start", F.when(F.col("n") % 8 != 0, F.col("date_start")))
    return N.context_order(e, "parent_qid").select("id", "parent_qid", "place")


_CONTEXT_SQL = """
, p AS (SELECT id, unnest([id, 'o-' || (n + 1), 'o-' || (n + 3)]) AS entry, generate_subscripts([1, 2, 3], 1) AS place FROM ev), s AS (SELECT id AS entry, title, countries FROM ev WHERE n % 9 <> 0)
"""


def _contexts(spark, d):
    e = events(spark, d)
    other = lambda k: F.concat(F.lit("o-"), (F.col("n") + k).cast("string"))
    return N.briefings(e.select("id", F.array("id", other(1), other(3)).alias("ids")), e.where("n % 9 <> 0").select("id", "title", "countries"))


@query("f11_briefings", _CONTEXT_SQL + """
SELECT id, count(*) AS n, array_to_string(list(title ORDER BY place), '|') AS titles, array_to_string(list_sort(list_distinct(flatten(list(countries)))), '|') AS countries FROM p JOIN s USING (entry) GROUP BY id""", "ev")
def briefings(spark, d):
    return _contexts(spark, d)[0].select("id", "n", F.array_join("titles", "|").alias("titles"), F.array_join("countries", "|").alias("countries"))


@query("f11_missing_entries", _CONTEXT_SQL + "SELECT id, entry AS missing FROM p WHERE entry NOT IN (SELECT entry FROM s)", "ev")
def missing_entries(spark, d):
    return _contexts(spark, d)[1]


@query("d23_marked_pieces", """
WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, w[1] AS phrase, 'first' AS kind FROM d UNION ALL SELECT doc_id, text, w[1] || ' ' || w[2], 'pair' FROM d UNION ALL SELECT doc_id, text, w[3], 'third' FROM d),
o AS (SELECT doc_id, kind, length(phrase) AS l, unnest(string_split(text, phrase)) AS part, generate_subscripts(string_split(text, phrase), 1) AS i FROM p WHERE length(phrase) > 0),
m AS (SELECT doc_id, kind, s, s + l AS e FROM (SELECT doc_id, kind, l, sum(length(part)) OVER k + (i - 1) * l AS s, lead(i) OVER k AS after FROM o WINDOW k AS (PARTITION BY doc_id, kind ORDER BY i)) WHERE after IS NOT NULL),
b AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM m),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS run FROM b),
g AS (SELECT doc_id, min(s) AS s, max(e) AS e, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM r GROUP BY doc_id, run),
c AS (SELECT doc_id, s AS a, e AS z, true AS flagged, kinds FROM g UNION ALL SELECT doc_id, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s), false, '' FROM g
      UNION ALL SELECT doc_id, 0, min(s), false, '' FROM g GROUP BY doc_id UNION ALL SELECT doc_id, 0, NULL, false, '' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM g))
SELECT doc_id AS id, CAST(a AS BIGINT) AS at, substr(text, CAST(a + 1 AS BIGINT), CAST(coalesce(z, length(text)) - a AS BIGINT)) AS piece, flagged, kinds FROM c JOIN d USING (doc_id) WHERE coalesce(z, length(text)) > a OR doc_id NOT IN (SELECT doc_id FROM g)""")
def marked_pieces(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    w = F.split("text", " ")
    phrase = lambda p, kind: F.struct(p.alias("phrase"), F.lit(kind).alias("kind"))
    phrases = docs.select("id", F.inline(F.array(phrase(F.get(w, F.lit(0)), "first"), phrase(F.concat(F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1))), "pair"), phrase(F.get(w, F.lit(2)), "third"))))
    return N.marked_pieces(docs, phrases).withColumn("kinds", F.array_join("kinds", ","))
