"""Rules over event records: each rule is an array of findings, all of them one flat column; nothing is filtered or changed.

Row rules need no shuffle. ``findings`` gives a row for each finding; ``gate`` compares them with a baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial as S
from ..functions import temporal as T
from ..functions import text as X
from .report import group_of

MIN_EXTRACT, MIN_SITELINKS, MANY_COUNTRIES, MAX_COUNTRIES = 160, 10, 8, 4
REGION = (-20.0, -15.0, 70.0, 41.0)
QUALITIES = ("precise", "approximate", "none")
RESERVED = ("index", "new", "search")
#: Classes that describe a span of time (fixed values).
DURATIVE = (
    "war", "civil war", "world war", "proxy war", "cold war", "war of independence", "war of national liberation", "series of wars", "attrition warfare", "low-intensity conflict", "insurgency",
    "intifada", "military occupation", "ethnic conflict", "international conflict", "border conflict", "blockade", "protest movement", "social movement", "political movement", "civil resistance",
)
FINDING = "array<struct<level:string,code:string,msg:string>>"


def finding(when: Column, level: str, code: str, msg: Column | None = None) -> Column:
    """One finding where the condition holds."""
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit(code) if msg is None else msg).alias("msg")))


def error(when: Column, code: str, msg: Column | None = None) -> Column:
    return finding(when, "error", code, msg)


def warning(when: Column, code: str, msg: Column | None = None) -> Column:
    return finding(when, "warning", code, msg)


def id_rule() -> list[Column]:
    i = F.col("id")
    bad = i.isNull() | ~i.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$") | (F.length(i) > 120)
    return [error(bad, "id_form"), error(i.isin(*RESERVED), "id_reserved")]


def title_rule() -> list[Column]:
    return [error(F.coalesce(F.trim("title"), F.lit("")) == "", "title_missing")]


def qid_rule() -> list[Column]:
    q = F.col("wikidata_qid")
    return [warning(q.isNull(), "no_wikidata_qid"), error(q.isNotNull() & ~q.rlike(r"^Q[1-9]\d*$"), "qid_form")]


def start_rule(retrieved: Column) -> list[Column]:
    real = T.is_real_date("date_start")
    return [error(~real, "date_start_invalid"), warning(real & (F.col("date_start") > F.substring(retrieved, 1, 10)), "date_start_after_retrieval")]


def end_rule(end_precision: Column) -> list[Column]:
    e, s = F.col("date_end"), F.col("date_start")
    back = T.is_real_date(e, 9999) & T.is_real_date(s) & (e < s)
    reach = F.coalesce(T.last_day_of_period(e, T.precision_code(end_precision)) >= s, F.lit(False))
    return [error(e.isNotNull() & ~T.is_real_date(e), "date_end_invalid"), warning(back & reach, "date_end_coarse"), error(back & ~reach, "date_order_invalid")]


def countries_rule(known: Column) -> list[Column]:
    """``known``: an array of the countries there are."""
    c = F.coalesce("countries", F.array().cast("array<string>"))
    return [
        error(F.size(c) == 0, "countries_missing"), error((F.size(c) > 0) & ~F.arrays_overlap(c, known), "no_tracked_country"), error(F.size(F.array_except(c, known)) > 0, "unknown_country"),
        error(F.size(F.array_distinct(c)) < F.size(c), "countries_repeated"), warning(F.size(c) >= MANY_COUNTRIES, "many_countries"), warning(F.size(c) > MAX_COUNTRIES, "countries_many_tags"),
    ]


def category_rule() -> list[Column]:
    return [error(F.col("category").isNull(), "category_missing"), error(F.col("category") != group_of(F.col("wikidata_classes")), "category_rule")]


def extract_rule() -> list[Column]:
    n = F.length(F.trim(F.coalesce("extract", F.lit(""))))
    return [error(n == 0, "extract_missing"), warning((n > 0) & (n < MIN_EXTRACT), "short_extract")]


def lists_rule() -> list[Column]:
    blank = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    return [error(blank("wikidata_classes"), "classes_blank"), error(blank("aliases"), "aliases_blank"), error(F.size("aliases") == 0, "aliases_empty"), error(F.size(F.array_distinct("aliases")) < F.size("aliases"), "aliases_repeated")]


def location_rules() -> list[Column]:
    q, there = F.col("location_quality"), F.col("lon").isNotNull() & F.col("lat").isNotNull()
    placed = there & (q != "none")
    inside = S.real_coordinates()
    return [
        error(q.isNull() | ~q.isin(*QUALITIES), "location_quality"), error((q == "none") & there, "coordinates_with_none"), error((q != "none") & ~there, "coordinates_missing"),
        error(placed & ~inside, "coordinates_range"), error(placed & inside & S.looks_swapped(REGION), "coordinates_swapped"),
        warning(placed & inside & ~S.in_box(REGION) & ~S.looks_swapped(REGION), "outside_region"), warning(S.low_precision_pin(), "coordinate_low_precision"),
    ]


def precision_rules(end_precision: Column) -> list[Column]:
    p, code = F.col("date_precision"), T.precision_code("date_precision")
    return [
        error(T.precision_shape_problem("date_start", "date_precision").isNotNull(), "date_start_precision"), error(T.precision_shape_problem(F.col("date_end"), end_precision).isNotNull(), "date_end_precision"),
        warning(p.isNotNull() & code.isNull(), "date_precision_unknown"), warning(end_precision.isNotNull() & F.col("date_end").isNull(), "date_end_precision_without_end"),
        warning((code <= 8) & F.col("date_end").isNull(), "coarse_start_without_end"),
    ]


def inclusion_rule() -> list[Column]:
    s, now = F.col("sitelinks"), F.col("sitelinks_current")
    return [warning(s < MIN_SITELINKS, "sitelinks_below_threshold"), warning((s >= MIN_SITELINKS) & (now < MIN_SITELINKS), "sitelinks_current_below_threshold")]


def advisory_rules() -> list[Column]:
    start, end = T.year_of("date_start"), T.year_of("date_end")
    low, high = F.least(start, F.coalesce(end, start)), F.coalesce(F.greatest(start, end), F.lit(9999))
    high = F.when(end.isNull(), F.lit(9999)).otherwise(high)
    outside = F.filter(X.title_years("title"), lambda y: (y < low) | (y > high))
    no_end = F.coalesce("date_end", F.lit("")) == ""
    return [
        warning(F.size(outside) > 0, "title_years_outside_dates"), warning(no_end & F.col("title").rlike(T.PRESENT), "title_present_no_end"),
        warning(no_end & F.arrays_overlap("wikidata_classes", F.array(*map(F.lit, DURATIVE))), "durative_class_no_end"),
    ]


def lead_rules() -> list[Column]:
    """Start dates against the days and years that the extract names."""
    s = F.col("date_start")
    lead = X.first_sentence("extract")
    days = X.exact_days(lead)
    year, years = T.year_of("date_start"), X.years_in("extract")
    in_month = F.exists(days, lambda d: F.substring(d, 1, 7) == F.substring(s, 1, 7))
    end = F.when(F.col("date_end").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date_end"))
    same_year = F.exists(days, lambda d: (F.substring(d, 1, 4) == F.substring(s, 1, 4)) & F.coalesce(d < end, F.lit(True)))
    far = (F.size(years) > 0) & ~F.exists(years, lambda y: F.abs(y - year) <= 1)
    return [
        warning((F.col("date_precision") == "month") & in_month, "month_precision_day_in_lead"),
        warning((F.col("date_precision") == "day") & ~F.array_contains(days, s) & same_year, "lead_start_day_differs"),
        warning(far, "date_start_year_not_in_lead"), warning(F.size(years) == 0, "unverified_date"),
    ]


def other_item_rules() -> list[Column]:
    other = F.col("resolved_qid") != F.col("wikidata_qid")
    return [warning(other, "article_of_other_item"), warning(other & F.col("lon").isNotNull() & (F.col("location_quality") == "precise"), "borrowed_coordinates")]


def open_end_rule() -> list[Column]:
    return [error(F.col("date_end_open").isNotNull() & F.col("date_end").isNotNull(), "open_end_with_end"), error(F.col("date_end_open").isNotNull() & ~F.col("date_end_open").isin(*T.OPEN_ENDS), "open_end_value")]


def flatten_findings(rules: list[Column]) -> Column:
    return F.array_compact(F.array(*rules))


def duplicate_keys(events: DataFrame, key: str, code: str) -> DataFrame:
    """(id, level, code, msg) of every row of a key but the first."""
    w = Window.partitionBy(key)
    rows = events.where(F.col(key).isNotNull()).select("id", key, F.min("id").over(w).alias("_first"), F.count("*").over(w).alias("_n"))
    return rows.where("_n > 1 AND id <> _first").select("id", F.lit("error").alias("level"), F.lit(code).alias("code"), F.concat(F.lit(f"{code}: also "), "_first").alias("msg"))


def duplicate_ids(events: DataFrame) -> DataFrame:
    """(id, level, code, msg): an error for every further row of an id; rows are counted before they meet."""
    many = events.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1")
    again = many.select("id", F.explode(F.sequence(F.lit(2).cast("long"), F.col("_n"))).alias("_nth"), "_n")
    return again.select("id", F.lit("error").alias("level"), F.lit("duplicate_id").alias("code"), F.concat(F.lit("duplicate_id: row "), "_nth", F.lit(" of "), "_n").alias("msg"))


def findings(events: DataFrame, known_countries: list[str], retrieved: Column, end_precision: Column) -> DataFrame:
    """(id, level, code, msg): all row rules in a fixed order, then repeated ids and items."""
    known = F.array(*map(F.lit, known_countries))
    rules = [
        *id_rule(), *title_rule(), *qid_rule(), *start_rule(retrieved), *end_rule(end_precision), *countries_rule(known), *category_rule(), *extract_rule(), *lists_rule(), *location_rules(),
        *precision_rules(end_precision), *inclusion_rule(), *advisory_rules(), *lead_rules(), *other_item_rules(), *open_end_rule(),
    ]
    rows = events.select("id", F.inline(flatten_findings(rules)))
    return rows.unionByName(duplicate_ids(events)).unionByName(duplicate_keys(events, "wikidata_qid", "duplicate_qid"))


def gate(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(errors, fresh_warnings): both must be 0; a warning counts when the baseline does not have it."""
    fresh = found.where("level = 'warning'").join(baseline, ["id", "code"], "left_anti")
    counts = found.agg(F.count_if(F.col("level") == "error").alias("errors"))
    return counts.crossJoin(fresh.agg(F.count("*").alias("fresh_warnings")))  # one row each


def enforce(found: DataFrame, baseline: DataFrame) -> None:
    """Raise unless the gate is open: no errors, and no warning that the baseline does not have."""
    row = gate(found, baseline).first()
    if row["errors"] or row["fresh_warnings"]:
        raise ValueError(f"{row['errors']} errors and {row['fresh_warnings']} warnings that are not in the baseline")


def shared_articles(events: DataFrame, text: str = "extract") -> DataFrame:
    """(sha, n, n_items, explained): texts that several records share; explained where all their articles belong to one item."""
    rows = events.where(F.col(text).isNotNull()).select(X.text_sha1(text).alias("sha"), "resolved_qid")
    groups = rows.groupBy("sha").agg(F.count("*").alias("n"), F.count_distinct("resolved_qid").alias("n_items")).where("n > 1")
    return groups.withColumn("explained", F.col("n_items") == 1)


def review_coverage(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """(state, n): reviewed, stale (the text changed), missing and orphan reviews."""
    a, b = events.select(F.col("id").alias("ia"), F.col("text_sha1").alias("ha")), reviews.select(F.col("id").alias("ib"), F.col("text_sha1").alias("hb"))
    state = F.when(F.col("ia").isNull(), "orphan").when(F.col("ib").isNull(), "missing").when(F.col("ha") != F.col("hb"), "stale").otherwise("reviewed")
    return a.join(b, F.col("ia") == F.col("ib"), "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def feature_rules() -> Column:
    """Findings over border features: names, years, credit, known status, ring structure."""
    status = F.col("status")
    rules = [
        error(F.coalesce(F.trim("name"), F.lit("")) == "", "name_missing"), error(F.col("start_year").isNull() | F.col("end_year").isNull(), "years_missing"), error(F.col("end_year") < F.col("start_year"), "years_reversed"),
        error(F.coalesce(F.trim("source"), F.lit("")) == "", "source_missing"), warning(status.isNotNull() & ~status.rlike("^(disputed|occupied-territory-included|mandate|protectorate)$"), "status_unknown"),
        error(F.size(S.ring_problems(F.col("polygons"))) > 0, "ring_structure"),
    ]
    return flatten_findings(rules)
