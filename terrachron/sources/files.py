"""Sources and sinks: event and border JSON, entity claims, tables in Markdown and TSV, CSV and GeoJSON export, partitioned stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial as S
from ..functions import temporal as T
from ..functions import text as X

EVENT_SCHEMA = (
    "id string, title string, wikidata_qid string, resolved_qid string, date_start string, date_end string, date_end_open string, date_precision string, date_end_precision string, "
    "date_flags array<string>, countries array<string>, category string, wikidata_classes array<string>, wikidata_aliases array<string>, extract string, extract_retrieved_at string, "
    "wikipedia_url string, wikipedia_revid long, wikipedia_revid_timestamp string, location_quality string, coordinates struct<lat:double,lon:double>, coordinate_source string, "
    "sitelinks int, sitelinks_current int, part_of array<struct<qid:string,label:string>>, possible_duplicates array<struct<id:string,title:string,reason:string>>, review_reasons array<string>, needs_review boolean"
)
EVENT_FIELDS = tuple(f.split()[0] for f in EVENT_SCHEMA.replace("struct<lat:double,lon:double>", "x").replace("array<struct<qid:string,label:string>>", "x").replace("array<struct<id:string,title:string,reason:string>>", "x").split(", "))
OPTIONAL = ("sitelinks", "date_precision", "date_end_precision", "wikidata_aliases")


def events_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One record for each JSON line: its fields, ``has_<field>`` for those whose absence means something, and ``unknown_fields``.

    A line that is no JSON object has ``corrupt`` true and nulls."""
    keys = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    parsed = lines.select(F.from_json(column, EVENT_SCHEMA).alias("e"), keys.alias("_keys"), F.json_object_keys(F.col(column)).isNull().alias("corrupt"))
    has = [F.array_contains("_keys", f).alias(f"has_{f}") for f in OPTIONAL]
    return parsed.select("e.*", *has, F.array_except("_keys", F.array(*map(F.lit, EVENT_FIELDS))).alias("unknown_fields"), "corrupt")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array with one record on each line, or JSON lines."""
    text = spark.read.text(path).select(F.trim("value").alias("value"))
    body = text.select(F.regexp_replace("value", r",$", "").alias("value")).where(~F.col("value").isin("", "[", "]"))
    return events_from_lines(body)


FEATURE = "properties struct<name:string,status:string,note:string,source:string,start_year:int,end_year:int>, geometry struct<type:string,coordinates:string>"


def features_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Border features of GeoJSON with one feature on each line; a polygon is lifted to a multipolygon."""
    f = F.from_json(column, FEATURE).alias("f")
    rows = lines.select(f).where("f.geometry IS NOT NULL").select("f.properties.*", F.col("f.geometry.type").alias("_type"), F.col("f.geometry.coordinates").alias("_c"))
    one = F.array(F.from_json("_c", "array<array<array<double>>>"))
    many = F.from_json("_c", "array<array<array<array<double>>>>")
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    polygons = F.when(F.col("_type") == "Polygon", one).otherwise(many)
    return rows.withColumn("polygons", F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))).drop("_type", "_c")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",$", "").alias("value"))
    return features_from_lines(lines.where(F.col("value").contains('"Feature"') & F.col("value").startswith("{") & F.col("value").endswith("}")))


CLAIM = "array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:string>>>>"


def entity_claims(entities: DataFrame, claims: str = "claims") -> DataFrame:
    """(qid, p31, p17, times, lat, lon, open_end): claims trimmed, deprecated ones dropped, in statement order."""
    c = F.from_json(claims, f"struct<P31:{CLAIM},P17:{CLAIM},P580:{CLAIM},P582:{CLAIM},P585:{CLAIM},P625:{CLAIM}>")
    rows = entities.select("qid", c.alias("c"))
    live = lambda p: F.filter(F.coalesce(F.col(f"c.{p}"), F.array().cast(CLAIM)), lambda x: F.coalesce(x["rank"], F.lit("")) != "deprecated")
    values = lambda p: F.filter(F.transform(live(p), lambda x: x["mainsnak"]["datavalue"]["value"]), lambda v: v.isNotNull())
    items = lambda p: F.transform(values(p), lambda v: F.get_json_object(v, "$.id"))
    when = lambda p: F.transform(values(p), lambda v: F.struct(F.substring(F.regexp_replace(F.get_json_object(v, "$.time"), r"^\+", ""), 1, 10).alias("time"), F.get_json_object(v, "$.precision").cast("int").alias("precision"), F.lit(p).alias("property")))
    place = F.get(values("P625"), F.lit(0))
    kinds = F.transform(live("P582"), lambda x: x["mainsnak"]["snaktype"])
    open_end = F.when(F.array_contains(kinds, "value"), None).when(F.array_contains(kinds, "novalue"), "wikidata_novalue").when(F.array_contains(kinds, "somevalue"), "wikidata_somevalue")
    return rows.select(
        "qid", items("P31").alias("p31"), items("P17").alias("p17"), F.concat(when("P585"), when("P580"), when("P582")).alias("times"),
        F.get_json_object(place, "$.latitude").cast("double").alias("lat"), F.get_json_object(place, "$.longitude").cast("double").alias("lon"), open_end.alias("open_end"),
    )


def split_list(column: str) -> Column:
    """A "a|b|c" list, sorted, once each."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")))


CSV_COLUMNS = ("id", "title", "date_start", "date_precision", "date_end", "date_end_precision", "countries", "category", "location_quality", "lat", "lon", "notes", "wikimedia_pages", "site_url", "license")


def row_notes(y0: int, y1: int, through: int) -> Column:
    """The tags of a row, as an array."""
    start = T.year_of("date_start")
    return F.array_compact(F.array(
        F.when(~T.overlaps(y0, y1, through), "Outside selected years"), F.when(T.started_before(y0), F.concat(F.lit("Ongoing since "), start.cast("string"))), F.when(T.years_reversed(), "End date before start"),
        F.when(T.ongoing_signal().isNotNull(), "No end date; ongoing per source"), F.when(F.col("location_quality") == "none", "No map location"), F.when(F.col("location_quality") == "approximate", "Approximate location"),
    ))


def csv_lines(rows: DataFrame, numbers: tuple[str, ...] = ("lat", "lon", "wikimedia_pages")) -> DataFrame:
    """One text line for each row of the fixed columns; arrays are joined with "; "."""
    kinds = dict(rows.dtypes)
    cell = lambda c: X.csv_cell(F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c), c in numbers)
    return rows.select(F.concat_ws(",", *map(cell, rows.columns)).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Part files with carriage return and line feed; the header with its byte order mark is a part of its own that sorts first."""
    spark = rows.sparkSession
    header = spark.createDataFrame([("\ufeff" + ",".join(rows.columns),)], "value string")
    header.coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/a-header")
    csv_lines(rows).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/b-rows")


def write_json_export(rows: DataFrame, path: str, query: dict[str, str], licence: str) -> None:
    """The rows, and a header row with the licence, the query and their count."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    echo = F.create_map(*[F.lit(x) for kv in query.items() for x in kv]) if query else F.create_map().cast("map<string,string>")
    rows.agg(F.count("*").alias("count")).select(F.lit(licence).alias("license"), echo.alias("query"), "count").write.mode("overwrite").json(f"{path}/header")


def point_features(rows: DataFrame, matched: Column, selected: Column) -> DataFrame:
    """One GeoJSON feature for each placed record, with flags m (match), s (selected), a (approximate)."""
    flags = F.struct("id", "title", F.substring("date_start", 1, 4).alias("y"), matched.cast("int").alias("m"), selected.cast("int").alias("s"), (F.col("location_quality") == "approximate").cast("int").alias("a"))
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), flags.alias("properties"))
    return rows.where(S.real_coordinates()).select(F.to_json(shape).alias("value"))


def write_buckets(rows: DataFrame, path: str, buckets: int, id_col: str = "id") -> None:
    """A detail store partitioned by the hash bucket of the id."""
    rows.withColumn("bucket", X.hash_bucket(id_col, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def write_decades(features: DataFrame, path: str, min_year: int, max_year: int) -> None:
    """A border store partitioned by decade; a feature is copied into each decade it touches."""
    from ..operators.borders import decades_of

    decades_of(features, min_year, max_year).repartition("decade").write.mode("overwrite").partitionBy("decade").parquet(path)


def lite(events: DataFrame) -> DataFrame:
    """The list's columns."""
    return events.select("id", "title", "date_start", "date_end", "date_end_open", "date_precision", "countries", "lon", "lat", S.shown_quality().alias("location_quality"), "sitelinks_current", "aliases")


def content_version(df: DataFrame) -> DataFrame:
    """(version): twelve hexadecimal digits of a hash over all rows, whatever their order: hashes of rows are added, then hashed."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.concat_ws(":", F.count("*").cast("string"), part(1).cast("string"), part(13).cast("string"), part(25).cast("string")).alias("s")).select(F.substring(F.sha2("s", 256), 1, 12).alias("version"))


def markdown_table(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """(row, cells): the first pipe table of a file, its cells by column; escaped bars count as text. A missing column is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    table = lines.where(F.startswith(F.trim("line"), F.lit("|"))).select("n", cells.alias("cells"), F.col("line").rlike(r"^\s*\|?\s*:?-{3,}").alias("rule"))
    header = table.orderBy("n").first()
    missing = [c for c in required if header is None or c not in header["cells"]]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    names = F.array(*map(F.lit, header["cells"]))
    bad = table.where(~F.col("rule") & (F.size("cells") != len(header["cells"]))).count()
    if bad:
        raise ValueError(f"{bad} rows have another number of cells than the header")
    body = table.where((F.col("n") > header["n"]) & ~F.col("rule"))
    return body.select(F.row_number().over(Window.orderBy("n")).alias("row"), F.when(F.size("cells") == len(header["cells"]), F.map_from_arrays(names, F.col("cells"))).alias("cells"))


def known_gaps(spark: SparkSession, path: str, event: str = "Event (QID)", reason: str = "Why the rule misses it") -> DataFrame:
    """(name, qid, reason) of a table whose first column reads "Name (Q123)"."""
    rows = markdown_table(spark, path, (event, reason))
    cell = F.regexp_replace(F.col("cells")[event], r"\[([^\]]*)\]\([^)]*\)", "$1")  # links as their texts
    item = F.regexp_extract(cell, r"\(\s*(Q\d+)\s*\)$", 1)
    name = F.when(item != "", F.rtrim(F.regexp_replace(cell, r"\([^(]*\)$", ""))).otherwise("")
    out = rows.select(name.alias("name"), item.alias("qid"), F.col("cells")[reason].alias("reason"))
    if bad := out.where("name = '' OR reason = ''").count():
        raise ValueError(f"{bad} rows without a name, an item or a reason")
    return out


def check_pins(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """(file, ok): files whose SHA-256 equals the pinned one; a pin without a file is not ok. ``pins``: (file, sha256)."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    return pins.join(found, "file", "left").select("file", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))


def grid_cells(shapes: DataFrame, size: float = 5.0) -> DataFrame:
    """Shapes with the names "<west>_<south>" of the grid cells that their boxes touch."""
    from ..operators.joins import box_cells

    b = shapes.withColumn("_b", S.polygons_box(F.col("polygons")))
    cells = b.withColumn("_c", F.explode(box_cells(F.col("_b.w"), F.col("_b.s"), F.col("_b.e"), F.col("_b.n"), size)))
    name = lambda v: (v * size).cast("int").cast("string")
    return cells.select(*shapes.columns, F.concat_ws("_", name(F.col("_c.x")), name(F.col("_c.y"))).alias("grid_cell"))


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """(item, property, value) of tab-separated lines; "#" begins a comment."""
    lines = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    part = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    return lines.select(part(0).alias("item"), part(1).alias("property"), part(2).alias("value"))


def place_periods(places: DataFrame, ladder: tuple[tuple[int, int], ...] = ((1_000_000, 3), (300_000, 4), (100_000, 5))) -> DataFrame:
    """One row for each name period of a place, with the smallest zoom for its population."""
    zoom = F.lit(6)
    for least, z in reversed(ladder):
        zoom = F.when(F.col("population") >= least, z).otherwise(zoom)
    return places.select("place_id", "lon", "lat", zoom.alias("min_zoom"), F.inline("periods"))
