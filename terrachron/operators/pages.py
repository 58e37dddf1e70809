"""Page texts and the smaller roll-ups over records and places."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial as S

SKIPPED = ("script", "style", "nav", "table", "sup")


def strip_tags(html: str) -> Column:
    """Text of a page by patterns: scripts, styles, navigation, comments and tags go; white space is folded."""
    h = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " ")
    h = F.regexp_replace(F.regexp_replace(h, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(h, r"[ \t\n\r]+", " "))


class _Paragraphs(HTMLParser):
    """Texts of paragraphs, without what stands in skipped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.open = False
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "p" and not self.skip:
            self.open = True
            self.found.append("")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "article"):
            self.open = False

    def handle_data(self, data):
        if self.open and not self.skip:
            self.found[-1] += data


def paragraphs(html: str | None) -> list[str]:
    p = _Paragraphs()
    p.feed(html or "")
    return [t for t in (" ".join(x.split()) for x in p.found) if t]


def lead_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n_paragraphs, lead): the paragraphs of a page and the first of them, nested skipped parts removed."""

    @F.pandas_udf("array<string>")
    def texts(h: pd.Series) -> pd.Series:
        return h.map(paragraphs)

    return pages.select(key, texts(F.col(html)).alias("p")).select(key, F.size("p").alias("n_paragraphs"), F.coalesce(F.get("p", F.lit(0)), F.lit("")).alias("lead"))


def structured_record() -> Column:
    """A record of an event with its dates to their precision and its place where it is precise."""
    cut = F.when(F.col("date_precision") == "day", 10).when(F.col("date_precision") == "month", 7).otherwise(4)
    date = lambda c: F.substring(F.col(c), F.lit(1), cut)
    geo = F.struct(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("geo"))
    return F.to_json(F.struct(F.lit("Event").alias("type"), F.col("title").alias("name"), date("date_start").alias("startDate"), date("date_end").alias("endDate"), F.when(F.col("location_quality") == "precise", geo).alias("location")))


def labels_by_side(rows: DataFrame) -> DataFrame:
    """(category, a, b, stored_share): labels by side, and how often the stored classes have them."""
    stored = F.array_contains("wikidata_classes", F.col("category")).cast("double")
    return rows.groupBy("category").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"), F.round(F.avg(stored), 6).alias("stored_share"))


def merge_runs(features: DataFrame, base: str, same: list[str]) -> DataFrame:
    """(base, start_year, end_year): pieces that follow each other without a gap and are alike, as one."""
    w = Window.partitionBy(base).orderBy("start_year")
    joins = F.lag("end_year").over(w) == F.col("start_year") - 1
    for c in same:
        joins = joins & F.lag(c).over(w).eqNullSafe(F.col(c))
    runs = features.withColumn("_run", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(base, "_run").agg(F.min("start_year").alias("start_year"), F.max("end_year").alias("end_year")).drop("_run")


def unique_slugs(rows: DataFrame, slug: str, item: str, order: Column) -> DataFrame:
    """Slugs, the first of equal ones as it is, the others with their item."""
    nth = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn("_nth", nth).withColumn(slug, F.when(F.col("_nth") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, F.lower(item)))).drop("_nth")


def far_from_references(events: DataFrame, references: DataFrame, km: float = 1500) -> DataFrame:
    """(id, km): records farther than ``km`` from the reference point of each of their countries. ``references``: (country, rx, ry)."""
    tags = events.where(S.has_coordinates()).select("id", "lon", "lat", F.explode("countries").alias("country")).join(references, "country")
    near = tags.groupBy("id").agg(F.min(S.haversine_km("lon", "lat", "rx", "ry", S.EARTH_KM_FLAGS)).alias("d"))
    return near.where(F.col("d") > km).select("id", F.floor(F.col("d") + 0.5).alias("km"))


def place_support(rows: DataFrame) -> DataFrame:
    """(id, inside, outside, counts): a place counts only with as many states inside as outside."""
    return rows.groupBy("id").agg(F.count_if(F.col("inside")).alias("inside"), F.count_if(~F.col("inside")).alias("outside")).withColumn("counts", F.col("inside") >= F.col("outside"))
