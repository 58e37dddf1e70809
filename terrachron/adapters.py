"""Views of the test tables in the shapes that the operators take: dated and placed event records, border features, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The class label of each part type (fixed values).
CLASS_OF_TYPE = {"STANDARD": "battle", "ECONOMY": "treaty", "PROMO": "protest movement", "LARGE": "war", "SMALL": "bombing", "MEDIUM": "election"}
#: The class tree above these labels: child, parent (fixed values).
CLASS_EDGES = (("battle", "conflict"), ("war", "conflict"), ("bombing", "violence"), ("protest movement", "civic"), ("treaty", "civic"), ("election", "civic"), ("conflict", "event"), ("violence", "event"), ("civic", "event"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _class_label(column: Column) -> Column:
    pairs = [F.lit(x) for kv in CLASS_OF_TYPE.items() for x in kv]
    return F.element_at(F.create_map(*pairs), column)


def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: its number, dates and the lists gathered from its lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", _class_label(F.col("p_type")).alias("label"))
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    full = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    per_order = full.groupBy("l_orderkey").agg(
        F.min("p_name").alias("title"),
        F.max("l_shipdate").alias("ship"),
        F.array_sort(F.collect_set("p_brand")).alias("aliases"),
        F.array_sort(F.collect_set("n_name")).alias("countries"),
        F.array_sort(F.collect_set("label")).alias("wikidata_classes"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("n", F.col("o_orderkey").cast("long")).drop("l_orderkey", "o_orderkey")


def events(spark: SparkSession, sf_dir: str, with_text: bool = False, facts: dict[str, Column] | None = None) -> DataFrame:
    """Event records; ``with_text`` adds the extract, ``facts`` columns that follow from the extract alone: worked out once for each document, they are joined in its place."""
    n = F.col("n")
    q = lambda x: F.concat(F.lit("Q"), x.cast("string"))
    out = event_base(spark, sf_dir).select(
        "n",
        F.concat(F.lit("o-"), n.cast("string")).alias("id"),
        q(n + 1).alias("wikidata_qid"),
        F.when(n % 13 == 0, q(n)).otherwise(q(n + 1)).alias("resolved_qid"),
        "title",
        "aliases",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_start"),
        F.when(n % 5 != 0, F.date_format("ship", "yyyy-MM-dd")).alias("date_end"),
        F.when(n % 15 == 0, F.lit("wikidata_novalue")).alias("date_end_open"),
        F.when(n % 4 < 2, "day").when(n % 4 == 2, "month").otherwise("year").alias("date_precision"),
        (((n * 7919) % 9000).cast("double") / 100.0 - 20).alias("lon"),
        (((n * 104729) % 5600).cast("double") / 100.0 - 15).alias("lat"),
        F.when(n % 7 == 0, "none").when(n % 7 == 1, "approximate").otherwise("precise").alias("location_quality"),
        F.when(n % 9 != 0, (n * 31) % 60).alias("sitelinks_current"),
        F.when((n % 9 != 0) & (n % 8 != 0), (n * 31) % 60).alias("sitelinks"),
        F.when(n % 100 == 0, None).when(n % 10 == 0, q(F.floor(n / 100) * 100 + 1)).otherwise(q(F.floor(n / 10) * 10 + 1)).alias("parent_qid"),
        "countries",
        "wikidata_classes",
    )
    if with_text or facts:
        texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), F.col("text").alias("extract"))
        size = F.broadcast(texts.agg(F.count("*").alias("_docs")))  # one row
        if facts:
            texts = texts.select("_doc", *(["extract"] if with_text else []), *(c.alias(name) for name, c in facts.items()))
        out = out.crossJoin(size).join(texts, F.expr("_doc = n % nullif(_docs, 0)"), "left").drop("_doc", "_docs")
    return out


#: The same view for DuckDB, as common table expressions.
EVENTS_SQL = """
eb AS (
  SELECT o_orderkey AS n, o_orderdate, min(p_name) AS title, max(l_shipdate) AS ship,
         list_sort(list(DISTINCT p_brand)) AS aliases, list_sort(list(DISTINCT n_name)) AS countries,
         list_sort(list(DISTINCT CASE p_type WHEN 'STANDARD' THEN 'battle' WHEN 'ECONOMY' THEN 'treaty' WHEN 'PROMO' THEN 'protest movement'
                    WHEN 'LARGE' THEN 'war' WHEN 'SMALL' THEN 'bombing' WHEN 'MEDIUM' THEN 'election' END)) AS wikidata_classes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY o_orderkey, o_orderdate
), ev AS (
  SELECT CAST(n AS BIGINT) AS n, 'o-' || n AS id, 'Q' || (n + 1) AS wikidata_qid,
         CASE WHEN n % 13 = 0 THEN 'Q' || n ELSE 'Q' || (n + 1) END AS resolved_qid, title, aliases,
         strftime(o_orderdate, '%Y-%m-%d') AS date_start,
         CASE WHEN n % 5 <> 0 THEN strftime(ship, '%Y-%m-%d') END AS date_end,
         CASE WHEN n % 15 = 0 THEN 'wikidata_novalue' END AS date_end_open,
         CASE WHEN n % 4 < 2 THEN 'day' WHEN n % 4 = 2 THEN 'month' ELSE 'year' END AS date_precision,
         CAST((n * 7919) % 9000 AS DOUBLE) / 100.0 - 20 AS lon, CAST((n * 104729) % 5600 AS DOUBLE) / 100.0 - 15 AS lat,
         CASE WHEN n % 7 = 0 THEN 'none' WHEN n % 7 = 1 THEN 'approximate' ELSE 'precise' END AS location_quality,
         CASE WHEN n % 9 <> 0 THEN (n * 31) % 60 END AS sitelinks_current,
         CASE WHEN n % 9 <> 0 AND n % 8 <> 0 THEN (n * 31) % 60 END AS sitelinks,
         CASE WHEN n % 100 = 0 THEN NULL WHEN n % 10 = 0 THEN 'Q' || ((n // 100) * 100 + 1) ELSE 'Q' || ((n // 10) * 10 + 1) END AS parent_qid,
         countries, wikidata_classes
  FROM eb
)"""

EVENTS_TEXT_SQL = EVENTS_SQL + """, evt AS (
  SELECT ev.*, documents.text AS extract FROM ev LEFT JOIN documents ON doc_id = n % (SELECT count(*) FROM documents)
)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border features: a lattice of cells from the nations, in two phases, with holes, two-part shapes and overlays.

    (name, cell, x0, y0, start_year, end_year, status, note, source, polygons), polygons being an array of polygons, each an array of rings of points."""
    k = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select(
        "n_name", k.cast("int").alias("k"), (F.lit(-20.0) + (k % 5) * 18.0).alias("x0"), (F.lit(-15.0) + F.floor(k / 5) * 11.2).alias("y0")
    )
    k = F.col("k")
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat")).cast("struct<lon:double,lat:double>")

    def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))

    x0, y0 = F.col("x0"), F.col("y0")
    whole = rectangle(x0, y0, x0 + 18, y0 + 11.2)
    hole = rectangle(x0 + 7, y0 + 3.6, x0 + 11, y0 + 7.6)
    two = F.array(F.array(rectangle(x0, y0, x0 + 7, y0 + 11.2)), F.array(rectangle(x0 + 10, y0, x0 + 18, y0 + 11.2)))
    shape = F.when(k % 6 == 0, two).when(k % 2 == 1, F.array(F.array(whole, hole))).otherwise(F.array(F.array(whole)))
    status = F.when(k % 4 == 0, F.lit("occupied-territory-included"))
    note = F.concat(F.lit("Shape of "), "n_name", F.lit(". Est. 1995; see source."))
    source = F.concat(F.lit("Atlas "), k.cast("string"), F.lit("; survey (a; b)"))
    phases = F.array(
        F.struct(F.concat("n_name", F.lit(" (phase 1)")).alias("name"), F.lit(1995).alias("start_year"), (F.lit(1997) + k % 3).cast("int").alias("end_year")),
        F.struct(F.col("n_name").alias("name"), (F.lit(1998) + k % 3 + F.when(k % 7 == 0, 1).otherwise(0)).cast("int").alias("start_year"), F.lit(9999).alias("end_year")),
    )
    cells = nation.select("n_name", "k", "x0", "y0", status.alias("status"), note.alias("note"), source.alias("source"), shape.alias("polygons"), F.inline(phases))
    square = F.array(F.array(rectangle(x0 + 4, y0 + 3, x0 + 9, y0 + 8)))
    over = nation.where(k % 4 == 0).select(
        "n_name", "k", "x0", "y0", F.lit("disputed").alias("status"), F.lit("Claimed area.").alias("note"), source.alias("source"), square.alias("polygons"),
        F.concat(F.lit("Disputed "), "n_name").alias("name"), F.lit(1996).alias("start_year"), F.lit(2000).alias("end_year"),
    )
    out = cells.unionByName(over)
    return out.select("name", F.col("k").alias("cell"), "x0", "y0", "start_year", "end_year", "status", "note", "source", "polygons")


#: Features for DuckDB; ``parts`` gives each polygon's box, ``holes`` the boxes cut out.
FEATURES_SQL = """
fn AS (SELECT n_name, CAST(n_nationkey AS INT) AS k, -20.0::DOUBLE + (n_nationkey % 5) * 18.0::DOUBLE AS x0, -15.0::DOUBLE + (n_nationkey // 5) * 11.2::DOUBLE AS y0 FROM nation),
ft AS (
  SELECT n_name || ' (phase 1)' AS name, k AS cell, x0, y0, 1995 AS start_year, 1997 + k % 3 AS end_year, CASE WHEN k % 4 = 0 THEN 'occupied-territory-included' END AS status,
         'Shape of ' || n_name || '. Est. 1995; see source.' AS note, 'Atlas ' || k || '; survey (a; b)' AS source, 0 AS overlay FROM fn
  UNION ALL
  SELECT n_name, k, x0, y0, 1998 + k % 3 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END, 9999, CASE WHEN k % 4 = 0 THEN 'occupied-territory-included' END,
         'Shape of ' || n_name || '. Est. 1995; see source.', 'Atlas ' || k || '; survey (a; b)', 0 FROM fn
  UNION ALL
  SELECT 'Disputed ' || n_name, k, x0, y0, 1996, 2000, 'disputed', 'Claimed area.', 'Atlas ' || k || '; survey (a; b)', 1 FROM fn WHERE k % 4 = 0
)"""

#: Whether a point lies in a feature of the lattice, for DuckDB: {x} and {y} stand for the point.
INSIDE_SQL = """(CASE WHEN overlay = 1 THEN {x} >= x0 + 4 AND {x} < x0 + 9 AND {y} >= y0 + 3 AND {y} < y0 + 8
  WHEN cell % 6 = 0 THEN {y} >= y0 AND {y} < y0 + 11.2 AND (({x} >= x0 AND {x} < x0 + 7) OR ({x} >= x0 + 10 AND {x} < x0 + 18))
  WHEN cell % 2 = 1 THEN {x} >= x0 AND {x} < x0 + 18 AND {y} >= y0 AND {y} < y0 + 11.2 AND NOT ({x} >= x0 + 7 AND {x} < x0 + 11 AND {y} >= y0 + 3.6 AND {y} < y0 + 7.6)
  ELSE {x} >= x0 AND {x} < x0 + 18 AND {y} >= y0 AND {y} < y0 + 11.2 END)"""
