"""Queries of text expressions, search, ranking and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import events, table
from ..functions import temporal as T
from ..functions import text as X
from ..operators import search as Q
from .registry import query

NOW = 2001
_TOK = "list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("d01_tokens", f"""
WITH t AS (SELECT doc_id, list_transform({_TOK}, lambda w: replace(replace(replace(w, 'ß', 'ss'), 'æ', 'ae'), 'ø', 'o')) AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS token_hash FROM t""")
def tokens(spark, d):
    w = X.tokenize("text")
    return table(spark, d, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.md5(F.array_join(w, " ").cast("binary")).alias("token_hash"))


@query("d04_openings", """
SELECT doc_id, left(text, 160) AS snippet, len(regexp_extract(split_part(text, chr(10), 1), '^(.*?[.!?])(\\s+[A-Z0-9"“(].*)?$', 1)) > 0 AS has_sentence, left(sha1(text), 12) AS sha
FROM documents""")
def openings(spark, d):
    first = X.first_sentence("text")
    return table(spark, d, "documents").select("doc_id", X.snippet("text").alias("snippet"), first.rlike(r"[.!?]$").alias("has_sentence"), X.text_sha1("text").alias("sha"))


@query("d05_text_shapes")
def text_shapes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.opening(t).alias("opening"), F.size(X.note_sentences(t)).alias("n_sentences"), F.length(X.normalize_lead(t)).alias("lead_length"), F.array_join(X.lead_dates(t), ",").alias("lead_dates"))


@query("d07_years_named", """
SELECT id, title || ' ' || substr(date_start, 1, 4) || '–' || substr(coalesce(date_end, date_start), 3, 2) AS name, CAST(substr(date_start, 1, 4) AS INT) AS y1,
       CASE WHEN date_end IS NULL OR substr(date_end, 1, 4) = substr(date_start, 1, 4) THEN substr(date_start, 1, 4)
            ELSE substr(date_start, 1, 4) || ',' || substr(date_start, 1, 2) || substr(date_end, 3, 2) END AS title_years
FROM ev WHERE substr(coalesce(date_end, date_start), 1, 4) < '2000' AND date_start < '2000'""", "ev")
def years_named(spark, d):
    rows = events(spark, d).where((F.substring(F.coalesce("date_end", "date_start"), 1, 4) < "2000") & (F.col("date_start") < "2000"))
    name = F.concat("title", F.lit(" "), F.substring("date_start", 1, 4), F.lit("–"), F.substring(F.coalesce("date_end", "date_start"), 3, 2))
    return rows.select("id", name.alias("name")).select("id", "name", F.get(X.years_in("name"), F.lit(0)).alias("y1"), F.array_join(X.title_years("name"), ",").alias("title_years"))


@query("d09_exact_days", """
SELECT id, date_start AS day_a, strftime(CAST(date_start AS DATE) + 40, '%Y-%m-%d') AS day_b FROM ev""", "ev")
def exact_days(spark, d):
    day = F.to_date("date_start")
    text = F.concat(F.lit("It began on "), F.date_format(day, "d MMMM yyyy"), F.lit(" and ended on "), F.date_format(F.date_add(day, 40), "MMMM d, yyyy"), F.lit("."))
    rows = events(spark, d).select("id", text.alias("t")).select("id", X.exact_days("t").alias("days"))
    return rows.select("id", F.get("days", F.lit(0)).alias("day_a"), F.get("days", F.lit(1)).alias("day_b"))


@query("d12_title_forms", """
SELECT id, replace(title, ' ', '-') AS slug, replace(title, ' ', '') AS norm, array_to_string(list_sort(string_split(title, ' ')), ',') AS tokens,
       'https://en.wikipedia.org/w/index.php?title=' || replace(title, ' ', '_') || '&oldid=' || n AS permalink, title AS from_url, replace(title, ' ', '-') AS anchor FROM ev""", "ev")
def title_forms(spark, d):
    url = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("title", F.lit(" "), F.lit("_")))
    return events(spark, d).select(
        "id", X.slugify("title").alias("slug"), X.norm_title("title").alias("norm"), F.array_join(F.array_sort(X.title_tokens("title")), ",").alias("tokens"),
        X.permalink("title", "n").alias("permalink"), X.title_from_url(url).alias("from_url"), X.heading_anchor("title").alias("anchor"),
    )


@query("d18_notes_and_sources", """
SELECT name, start_year, CASE WHEN overlay = 1 THEN 1 ELSE 2 END AS n_sentences, 2 AS n_items, 'survey (a; b)' AS second_item FROM ft""", "ft")
def notes_and_sources(spark, d):
    from ..adapters import features

    items = X.source_items("source")
    return features(spark, d).select("name", "start_year", F.size(X.note_sentences("note")).alias("n_sentences"), F.size(items).alias("n_items"), F.get(items, F.lit(1)).alias("second_item"))


@query("d19_text_changes", """
SELECT a.doc_id, len(list_filter(list_distinct(string_split(a.text, chr(10))), lambda x: NOT list_contains(string_split(b.text, chr(10)), x))) AS taken,
       len(list_filter(list_distinct(string_split(b.text, chr(10))), lambda x: NOT list_contains(string_split(a.text, chr(10)), x))) AS put
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def text_changes(spark, d):
    docs = table(spark, d, "documents")
    pairs = docs.select("doc_id", "text").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    taken, put = X.lines_diff("text", "next")
    return pairs.select("doc_id", F.size(taken).alias("taken"), F.size(put).alias("put"))


@query("d22_query_marks", """
SELECT id, regexp_replace(title, '\\b((?:ring|smal)[a-z]*)', '**\\1**', 'g') AS marked FROM ev""", "ev")
def query_marks(spark, d):
    return events(spark, d).select("id", X.query_marks("title", ["ring", "smal"]).alias("marked"))


@query("d34_tag_counts", """
SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<script')) AS scripts FROM pages""")
def tag_counts(spark, d):
    counts = X.tag_counts("html", {"links": "<a ", "paragraphs": "<p>", "scripts": "<script"})
    return table(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in counts.items()))


@query("d35_quote_checks", """
SELECT doc_id, CASE WHEN contains(d.text, left(b.text, 40)) THEN 'extract' ELSE 'unknown' END AS found, b.item_id FROM documents d JOIN benchmark b ON b.item_id = doc_id % 40
WHERE NOT contains(left(b.text, 40), chr(10)) AND NOT contains(left(b.text, 40), '  ')""")
def quote_checks(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("quote")).where("NOT contains(quote, '\\n') AND NOT contains(quote, '  ')")
    docs = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40)
    return docs.join(items, "item_id").select("doc_id", X.quote_check("quote", "text", F.lit("")).alias("found"), "item_id")


@query("d37_text_ratio", """
SELECT a.id, round(1 - levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title))::DOUBLE, 6) AS ratio FROM ev a JOIN ev b ON b.n = a.n + 1""", "ev")
def text_ratio(spark, d):
    e = events(spark, d)
    return e.join(e.select((F.col("n") - 1).alias("n"), F.col("title").alias("other")), "n").select("id", F.round(X.text_ratio("title", "other"), 6).alias("ratio"))


_EX = "list_filter(regexp_split_to_array(lower(strip_accents(title || ' ' || array_to_string(aliases, ' '))), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("e01_token_match", f"""
SELECT id FROM ev WHERE list_contains({_EX}, 'small') AND len(list_filter({_EX}, lambda w: starts_with(w, 'ri'))) > 0""", "ev")
def token_match(spark, d):
    rows = events(spark, d)
    return Q.apply_filters(rows, "small ri", body="date_end_open").select("id")


@query("e03_local_search", f"""
, f AS (SELECT * FROM ev WHERE len(list_filter({_EX}, lambda w: starts_with(w, 'ring'))) > 0 AND lon BETWEEN 0 AND 40 AND lat BETWEEN -10 AND 20 AND location_quality = 'precise' AND list_has_any(countries, ['NATION_1', 'NATION_2', 'NATION_3'])),
t AS (SELECT *, CASE WHEN title = 'ring' THEN 0 WHEN starts_with(title, 'ring') THEN 2 WHEN contains(title, 'ring') THEN 4 ELSE 6 END AS tier FROM f)
SELECT id, tier, row_number() OVER (ORDER BY tier, date_start, id) AS place FROM t ORDER BY place LIMIT 25""", "ev")
def local_search(spark, d):
    rows = Q.apply_filters(events(spark, d), "ring", box=(0, -10, 40, 20), countries=("NATION_1", "NATION_2", "NATION_3"), body="date_end_open").withColumn("tier", Q.tier("ring"))
    return Q.numbered(rows, [F.col("tier").asc(), F.col("date_start").asc(), F.col("id").asc()], 25).select("id", "tier", "place")


@query("e08_name_tiers", """
, a AS (SELECT id, title, list_transform(aliases, lambda x: CASE WHEN x = 'Brand#2' THEN 0 WHEN starts_with(x, 'Brand#2') THEN 1 ELSE 3 END) AS t, aliases FROM ev),
b AS (SELECT id, aliases, t, coalesce(list_min(t), 3) AS best FROM a)
SELECT id, 3 AS title_tier, least(6, best * 2 + 1) AS tier, CASE WHEN best < 3 THEN aliases[list_position(t, best)] END AS alias FROM b""", "ev")
def name_tiers(spark, d):
    q = "brand#2"
    return events(spark, d).select("id", Q.name_tier(F.col("title"), q).alias("title_tier"), Q.tier(q).alias("tier"), Q.matched_alias(q).alias("alias"))


@query("e10_word_search", """
, m AS (SELECT id, date_start FROM ev WHERE len(list_filter(string_split(title, ' '), lambda w: starts_with(w, 'widg'))) > 0)
SELECT id, row_number() OVER (ORDER BY date_start, id) AS place, (SELECT count(*) FROM m) AS total FROM m ORDER BY place LIMIT 25""", "ev")
def word_search(spark, d):
    return Q.word_search(events(spark, d), "widg").select("id", "place", "total")


@query("e11_phrases", "SELECT p_partkey FROM part WHERE contains(' ' || p_name || ' ', ' small ring ')")
def phrases(spark, d):
    return Q.phrase_matches(table(spark, d, "part").withColumnRenamed("p_name", "name"), "small ring", limit=None).select("p_partkey")


@query("e13_counts", """
, y AS (SELECT *, CAST(substr(date_start, 1, 4) AS INT) AS s, CASE WHEN date_end IS NULL AND date_end_open IS NOT NULL THEN greatest(CAST(substr(date_start, 1, 4) AS INT), 2001) ELSE CAST(substr(coalesce(date_end, date_start), 1, 4) AS INT) END AS e FROM ev),
z AS (SELECT *, CASE WHEN e < s THEN s BETWEEN 1996 AND 1998 OR e BETWEEN 1996 AND 1998 ELSE s <= 1998 AND e >= 1996 END AS hit FROM y)
SELECT count(*) AS n_all, count(*) FILTER (hit) AS n_in_range, count(*) FILTER (hit AND lon BETWEEN 0 AND 30 AND lat BETWEEN 0 AND 20) AS n_shown, count(*) AS n_placed FROM z""", "ev")
def counts(spark, d):
    return Q.count_block(events(spark, d), 1996, 1998, NOW, (0, 0, 30, 20))


@query("e15_facets", """
SELECT facet, value, count(*) AS n FROM (SELECT 'country' AS facet, unnest(countries) AS value FROM ev UNION ALL SELECT 'class', unnest(wikidata_classes) FROM ev) GROUP BY ALL""", "ev")
def facets(spark, d):
    return Q.facet_counts(events(spark, d))


@query("e04_postings")
def postings(spark, d):
    p = Q.build_postings(table(spark, d, "documents"), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("e05_full_text")
def full_text(spark, d):
    p = Q.build_postings(table(spark, d, "documents"), "doc_id", F.col("text"))
    return Q.query_postings(p, "there ing").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_ORDER = """
, y AS (SELECT *, CAST(substr(date_start, 1, 4) AS INT) AS s, CAST(substr(coalesce(date_end, date_start), 1, 4) AS INT) AS e0 FROM ev),
k AS (SELECT *, CASE WHEN date_end IS NOT NULL AND e0 < s AND NOT s BETWEEN 1997 AND 1998 AND e0 BETWEEN 1997 AND 1998 THEN date_end ELSE date_start END AS listed, s < 1997 AS early FROM y)
"""


@query("i03_browse_date", _ORDER + "SELECT id, row_number() OVER (ORDER BY early, listed, id) AS place FROM k ORDER BY place LIMIT 100", "ev")
def browse_date(spark, d):
    return Q.numbered(events(spark, d), Q.browse_order(1997, 1998, "date"), 100).select("id", "place")


@query("i03_browse_date_desc", _ORDER + "SELECT id, row_number() OVER (ORDER BY early, listed DESC, id DESC) AS place FROM k ORDER BY place LIMIT 100", "ev")
def browse_date_desc(spark, d):
    return Q.numbered(events(spark, d), Q.browse_order(1997, 1998, "date-desc"), 100).select("id", "place")


@query("i03_browse_coverage", _ORDER + "SELECT id, row_number() OVER (ORDER BY early, sitelinks_current DESC NULLS LAST, listed, id) AS place FROM k ORDER BY place LIMIT 100", "ev")
def browse_coverage(spark, d):
    return Q.numbered(events(spark, d), Q.browse_order(1997, 1998, "coverage"), 100).select("id", "place")


@query("i05_timeline", _ORDER + "SELECT id, row_number() OVER (ORDER BY early, listed, id) AS place FROM k ORDER BY place LIMIT 60", "ev")
def timeline(spark, d):
    return Q.numbered(events(spark, d), Q.timeline_order(1997, 1998), 60).select("id", "place")


@query("a05_csv_lines", """
SELECT id, id || ',' || title || ',' || date_start || ',' || coalesce(date_end, '') || ',' || CASE WHEN len(countries) > 0 THEN array_to_string(countries, '; ') ELSE '' END || ',' || coalesce(CAST(sitelinks_current AS VARCHAR), '') AS line FROM ev""", "ev")
def csv_lines(spark, d):
    cells = [X.csv_cell(F.col(c)) for c in ("id", "title", "date_start", "date_end")] + [X.csv_cell(F.array_join("countries", "; ")), X.csv_cell(F.col("sitelinks_current"), True)]
    return events(spark, d).select("id", F.concat_ws(",", *cells).alias("line"))


@query("a08_hash_buckets", """
, h AS (SELECT list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM ev)
SELECT CAST(h % 64 AS INT) AS bucket, count(*) AS n FROM h GROUP BY 1""", "ev")
def hash_buckets(spark, d):
    return events(spark, d).select(X.hash_bucket("id", 64).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("browse_window", f"""
, y AS (SELECT *, CAST(substr(date_start, 1, 4) AS INT) AS s, CASE WHEN date_end IS NULL AND date_end_open IS NOT NULL THEN greatest(CAST(substr(date_start, 1, 4) AS INT), 2001) ELSE CAST(substr(coalesce(date_end, date_start), 1, 4) AS INT) END AS e FROM ev),
f AS (SELECT *, CASE WHEN title = 'ring' THEN 0 WHEN starts_with(title, 'ring') THEN 2 WHEN contains(title, 'ring') THEN 4 ELSE 6 END AS tier FROM y
  WHERE CASE WHEN e < s THEN s BETWEEN 1996 AND 1998 OR e BETWEEN 1996 AND 1998 ELSE s <= 1998 AND e >= 1996 END
  AND len(list_filter({_EX}, lambda w: starts_with(w, 'ring'))) > 0 AND lon BETWEEN -10 AND 50 AND lat BETWEEN -12 AND 30 AND location_quality = 'precise')
SELECT row_number() OVER (ORDER BY tier, date_start, id) AS place, id, title, date_start, date_end, tier FROM f ORDER BY place LIMIT 25""", "ev")
def browse_window(spark, d):
    """Events of a span of years that match a query in a rectangle, ranked: the 25 best."""
    rows = events(spark, d).where(T.overlaps(1996, 1998, NOW))
    rows = Q.apply_filters(rows, "ring", box=(-10, -12, 50, 30), body="date_end_open").withColumn("tier", Q.tier("ring"))
    return Q.numbered(rows, [F.col("tier").asc(), F.col("date_start").asc(), F.col("id").asc()], 25).select("place", "id", "title", "date_start", "date_end", "tier")
