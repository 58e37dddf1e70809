"""Search: filters, token matching, tiers, orders, postings with BM25."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial as S
from ..functions import temporal as T
from ..functions import text as X
from ..functions.stemming import stem_word
from ..session import settle

MIN_QUERY = 2


def query_tokens(q: str | None) -> list[str]:
    """The parameter's words, folded as the texts are."""
    t = "".join(c for c in unicodedata.normalize("NFD", q or "") if not unicodedata.combining(c)).lower()
    for letter, spelt in X.EXTRA_FOLD.items():
        t = t.replace(letter, spelt)
    return [w for w in re.split(r"[\W_]+", t) if w]


def event_words(body: str = "extract") -> Column:
    return X.tokenize(F.concat_ws(" ", "title", F.array_join(F.coalesce("aliases", F.array()), " "), F.coalesce(body, F.lit(""))))


def _begins(prefix: str):
    return lambda w: F.startswith(w, F.lit(prefix))


def matches_tokens(words: Column, tokens: list[str]) -> Column:
    """Every token is a word; the last one may also begin one, from two letters on."""
    out = F.lit(True)
    for i, t in enumerate(tokens):
        hit = F.array_contains(words, t)
        if i == len(tokens) - 1 and len(t) >= MIN_QUERY:
            hit = F.exists(words, _begins(t))
        out = out & hit
    return out


def apply_filters(events: DataFrame, q: str = "", box=None, circle=None, categories=(), countries=(), body: str = "extract") -> DataFrame:
    """Rows that meet all conditions. An area leaves out records without a place or with an approximate one."""
    if box:
        events = events.where(S.in_box(box))
    if circle:
        events = events.where(S.in_circle(*circle))
    if box or circle:
        events = events.where(~F.col("location_quality").isin("approximate", "none"))
    if categories:
        events = events.where(F.col("category").isin(*categories))
    if countries:
        events = events.where(F.arrays_overlap("countries", F.array(*map(F.lit, countries))))
    if tokens := query_tokens(q):
        events = events.where(matches_tokens(event_words(body), tokens))
    return events


def name_tier(name: Column, q: str) -> Column:
    """0 the query itself, 1 begins with it, 2 has it or its words, 3 neither."""
    tokens = query_tokens(q)
    phrase, norm_q = " ".join(tokens), X.fold(F.lit(q.strip()))
    norm, words = F.trim(X.fold(name)), X.tokenize(name)
    joined = F.array_join(words, " ")
    return (
        F.when((norm == norm_q) | (joined == phrase), 0).when(F.startswith(norm, norm_q) | F.startswith(joined, F.lit(phrase)), 1)
        .when(F.contains(norm, norm_q) | matches_tokens(words, tokens), 2).otherwise(3)
    )


def alias_tiers(q: str) -> Column:
    """Aliases with their tier and place, those with none left out."""
    tiers = F.transform(F.coalesce("aliases", F.array()), lambda a, i: F.struct(name_tier(a, q).alias("tier"), i.alias("pos"), a.alias("alias")))
    return F.filter(tiers, lambda x: x["tier"] < 3)


def tier(q: str) -> Column:
    best = F.coalesce(F.array_min(alias_tiers(q))["tier"], F.lit(3))
    return F.least(name_tier(F.col("title"), q) * 2, best * 2 + 1)


def matched_alias(q: str) -> Column:
    """The best alias, where the title itself does not match."""
    return F.when(name_tier(F.col("title"), q) == 3, F.array_min(alias_tiers(q))["alias"])


def rank(events: DataFrame, q: str = "", index_rank: str | None = None) -> DataFrame:
    """By tier, then the index's rank where there is one, then start date (undated first) and id."""
    keys = [F.coalesce("date_start", F.lit("")).asc(), F.col("id").asc()]
    if index_rank:
        keys.insert(0, F.col(index_rank).asc())
    if query_tokens(q):
        events = events.withColumn("tier", tier(q))
        keys.insert(0, F.col("tier").asc())
    return events.orderBy(*keys)


def local_search(events: DataFrame, q: str = "", limit: int | None = None, **filters) -> DataFrame:
    out = rank(apply_filters(events, q, **filters), q)
    return out.limit(limit) if limit else out


def browse_order(y0: int, y1: int, sort: str = "date") -> list[Column]:
    """Sort keys: records that start in the range, then those under way; within each by date or by count of pages."""
    key, _, way = sort.partition("-")
    part = T.started_before(y0).asc()
    date, name = T.listed_date(y0, y1), F.col("id")
    if key == "coverage":
        count = F.col("sitelinks_current")
        return [part, count.asc_nulls_last() if way == "asc" else count.desc_nulls_last(), date.asc(), name.asc()]
    return [part, date.desc(), name.desc()] if way == "desc" else [part, date.asc(), name.asc()]


def timeline_order(y0: int, y1: int) -> list[Column]:
    """Records that start in the range, then those under way; undated last."""
    date = F.nullif(T.listed_date(y0, y1), F.lit(""))
    return [T.started_before(y0).asc(), date.asc_nulls_last(), F.col("id").asc()]


def numbered(df: DataFrame, keys: list[Column], limit: int | None = None, name: str = "place") -> DataFrame:
    """The first ``limit`` rows with their place from 1; a top-k, sorted once."""
    top = df.orderBy(*keys)
    if limit:
        top = top.limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long"))


def count_block(events: DataFrame, y0: int, y1: int, through: int, box) -> DataFrame:
    """All, in range, shown in the box, and placed, in one pass."""
    inside = T.overlaps(y0, y1, through)
    return events.agg(
        F.count("*").alias("n_all"), F.count_if(inside).alias("n_in_range"), F.count_if(inside & S.in_box(box)).alias("n_shown"), F.count_if(S.real_coordinates()).alias("n_placed")
    )


def facet_counts(events: DataFrame) -> DataFrame:
    """(facet, value, n): classes and countries present."""
    both = F.concat(
        F.transform("countries", lambda c: F.struct(F.lit("country").alias("facet"), c.alias("value"))),
        F.transform("wikidata_classes", lambda c: F.struct(F.lit("class").alias("facet"), c.alias("value"))),
    )
    return events.select(F.inline(both)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def word_search(events: DataFrame, q: str, limit: int = 25, body: str = "title") -> DataFrame:
    """Records whose words hold every token, or from four letters on begin with it, in date order; with the total."""
    words = X.tokenize(F.col(body))
    for t in query_tokens(q):
        hit = F.exists(words, _begins(t)) if len(t) >= 4 else F.array_contains(words, t)
        events = events.where(hit)
    total = events.agg(F.count("*").alias("total"))
    return numbered(events, [F.coalesce("date_start", F.lit("")).asc(), F.col("id").asc()], limit).crossJoin(F.broadcast(total))  # the total is one row


def phrase_matches(names: DataFrame, q: str, column: str = "name", limit: int | None = 3) -> DataFrame:
    """Entries whose words hold the query's words in a row; nothing for stop words alone."""
    tokens = query_tokens(q)
    if not tokens or all(t in X.GAP_STOP for t in tokens):
        return names.limit(0)
    words, n = X.tokenize(F.col(column)), len(tokens)
    phrase = F.array(*map(F.lit, tokens))
    found = names.where((F.size(words) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.slice(words, i, n) == phrase))
    return found.limit(limit) if limit else found


def stem(word: str) -> Column:
    """Stems of distinct words, by the rules that a query's words go through."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem_word)

    return stems.asNondeterministic()(F.col(word))  # filters on the stem stay above it: the distinct words alone are stemmed


def build_postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, tf, length): stemmed terms of each text; only the distinct vocabulary is stemmed."""
    words = docs.select(F.col(id_col).alias("id"), X.tokenize(text).alias("words")).withColumn("length", F.size("words"))
    counted = words.select("id", "length", F.explode("words").alias("word")).groupBy("id", "length", "word").agg(F.count("*").alias("tf"))
    stems = counted.select("word").distinct().withColumn("term", stem("word"))
    return counted.join(stems, "word").groupBy("term", "id", "length").agg(F.sum("tf").alias("tf"))


def query_postings(postings: DataFrame, q: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): texts with a term that begins with each stemmed query term, by BM25; an unknown term gives nothing."""
    postings = settle(postings)  # read once for the totals and once for each term
    terms = list(dict.fromkeys(stem_word(t) for t in query_tokens(q)))
    lengths = postings.select("id", "length").distinct().agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    hits = None
    for i, t in enumerate(terms):
        some = postings.where((F.col("term") >= t) & (F.col("term") < t[:-1] + chr(ord(t[-1]) + 1))).groupBy("id", "length").agg(F.sum("tf").alias("tf")).withColumn("nth", F.lit(i))
        hits = some if hits is None else hits.unionByName(some)
    frequency = hits.groupBy("nth").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(frequency), "nth").crossJoin(F.broadcast(lengths))  # a row for each term; one row of totals
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return scored.groupBy("id").agg(F.count("*").alias("n_terms"), F.sum(weight).alias("score")).where(F.col("n_terms") == len(terms)).select("id", "score")
