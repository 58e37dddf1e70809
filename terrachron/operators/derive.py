"""Derivation and refresh of records: kept precision, reconciled dates, fixes from a ledger, refreshed reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import temporal as T
from ..session import settle


def kept_precision(claims: Column, kept: Column) -> Column:
    """The first claim (time, precision, property) whose time is the kept date: exact before filled, in the claims' order."""
    exact = F.filter(claims, lambda c: c["time"] == kept)
    filled = F.filter(claims, lambda c: T.fill_zero_parts(c["time"]) == kept)
    return F.coalesce(F.get(exact, F.lit(0)), F.get(filled, F.lit(0)))


def reconcile_start(start: str, p585: str | Column, p585_precision: str | Column, p580: str | Column, p580_precision: str | Column, p582: str | Column) -> Column:
    """Where a point in time stands for a start: the start time to use and the rule that says so; else null.

    Rules in order: only a coarse point against a start to the year; the point is the end; the point lies inside; a year against a finer start in it."""
    norm = T.fill_zero_parts
    a, b, c, pa, pb = map(T.col, (p585, p580, p582, p585_precision, p580_precision))
    rule = (
        F.when((pa < 9) & (pb >= 9), "coarse").when((a == c) & (b != a), "end").when((pb >= 9) & (norm(b) < norm(a)) & (norm(a) < norm(c)), "inside")
        .when((pa == 9) & (pb >= 10) & (F.substring(b, 1, 4) == F.substring(a, 1, 4)), "year")
    )
    applies = a.isNotNull() & b.isNotNull() & (norm(a) == norm(F.col(start))) & rule.isNotNull()
    return F.when(applies, F.struct(norm(b).alias("date_start"), rule.alias("rule"), pb.alias("precision")))


def apply_fixes(events: DataFrame, fixes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Values of a ledger for the fields it sets, with the names of the fields that changed."""
    f = fixes.select(F.col(key).alias("_key"), "set_fields", *(F.col(c).alias(f"_fix_{c}") for c in fields))
    joined = events.join(f, events[key] == F.col("_key"), "left")
    sets = lambda c: F.coalesce(F.array_contains("set_fields", c), F.lit(False))
    changed = F.array_compact(F.array(*(F.when(sets(c) & ~F.col(c).eqNullSafe(F.col(f"_fix_{c}")), F.lit(c)) for c in fields)))
    out = joined.withColumn("changed_fields", changed)
    for c in fields:
        out = out.withColumn(c, F.when(sets(c), F.col(f"_fix_{c}")).otherwise(F.col(c)))
    return out.drop("_key", "set_fields", *(f"_fix_{c}" for c in fields))


def exclusion_ledger(events: DataFrame) -> DataFrame:
    """A ledger of the test view: (id, qid, reason)."""
    n = F.col("n")
    return events.where(n % 77 == 0).select(
        F.when(n % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("gone"), n.cast("string"))).alias("id"), F.col("wikidata_qid").alias("qid"), F.concat(F.lit("rule "), (n % 3).cast("string")).alias("reason")
    )


def refresh_reason(reasons: Column, code: str, fresh: Column) -> Column:
    """Reasons with those of a code replaced by a fresh one, or taken out where it is null."""
    return F.array_compact(F.concat(F.filter(reasons, lambda r: ~F.startswith(r, F.lit(f"{code}:"))), F.array(fresh)))


def backfill(stored: Column, found: Column) -> Column:
    """What a found value does to a stored one: missing, set, kept or differs."""
    return F.when(found.isNull(), "missing").when(stored.isNull(), "set").when(stored == found, "kept").otherwise("differs")


def missing_locations(events: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id, sitelinks_current, place): records without a place, most pages first. Sorted parts are numbered on their own, behind the rows of the parts before them."""
    rows = events.where("location_quality = 'none'").join(excluded, "id", "left_anti").select("id", "sitelinks_current")
    order = [F.col("sitelinks_current").desc_nulls_last(), F.col("id")]
    parts = settle(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = parts.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(bases), "_part").select("id", "sitelinks_current", (F.col("_base") + F.col("_nth")).cast("long").alias("place"))


def first_match(value: Column, limits: tuple, otherwise: str) -> Column:
    """The name of the first limit that the value does not pass."""
    out = F.lit(otherwise)
    for limit, name in reversed(limits):
        out = F.when(value <= limit, name).otherwise(out)
    return out


def topic(column: str, patterns: tuple, otherwise: str = "other") -> Column:
    """The name of the first pattern that matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(patterns):
        out = F.when(F.col(column).rlike(pattern), name).otherwise(out)
    return out


def merged_labels(direct: Column, matched: Column) -> Column:
    """Class labels, the direct ones first, once each."""
    return F.array_distinct(F.concat(F.coalesce(direct, F.array()), F.coalesce(matched, F.array())))


def review_findings(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Reviews with a stale mark and only the phrases that occur in the text; a stale review loses its marks."""
    j = reviews.join(events.select(F.col("id"), F.col("text_sha1").alias("_sha"), "text"), "id")
    stale = F.col("text_sha1") != F.col("_sha")
    return j.select("id", stale.alias("stale"), F.when(stale, F.array().cast("array<string>")).otherwise(F.filter("phrases", lambda p: F.contains(F.col("text"), p))).alias("phrases"))


def doubtful(codes: Column, doubt: tuple[str, ...]) -> Column:
    """Whether a difference touches a field that the record shows."""
    return F.arrays_overlap(codes, F.array(*map(F.lit, doubt)))


def order_flags(start: str = "date_start", end: str = "date_end", lead: Column | None = None) -> Column:
    """The date-order flag of a reversed record, with the dates its lead names."""
    s, e = F.col(start), F.col(end)
    told = F.concat(F.lit("date_order_invalid: "), e, F.lit(" precedes "), s)
    if lead is not None:
        told = F.when(F.size(lead) > 0, F.concat(told, F.lit("; lead: "), F.array_join(lead, ", "))).otherwise(told)
    return F.when(e < s, F.array(told)).otherwise(F.array().cast("array<string>"))


def support_flags(tags: Column, direct: Column, via_place: Column) -> Column:
    """For each country tag: supported through the place only, or not supported; tags the item itself names get no flag."""
    flags = F.transform(tags, lambda c: F.when(F.array_contains(direct, c), None).when(F.array_contains(via_place, c), F.concat(F.lit("country_via_place: "), c)).otherwise(F.concat(F.lit("country_not_supported: "), c)))
    return F.array_compact(flags)


def resolve_candidates(candidates: DataFrame, leads: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, outcome, extract, lat, lon): a candidate with its landed lead and entity, or why it is left out; only its own location counts."""
    j = candidates.join(leads.select("qid", "extract"), "qid", "left").join(entities.select("qid", "lat", "lon", F.lit(True).alias("_found")), "qid", "left")
    why = F.when(F.col("_found").isNull(), "no entity").when(F.coalesce(F.trim("extract"), F.lit("")) == "", "no lead").otherwise("kept")
    return j.select("qid", why.alias("outcome"), "extract", "lat", "lon")


def finalize(events: DataFrame) -> DataFrame:
    """The ordered derivation of a record: dates, then order flags, then group, then review state.

    ``lead_dates`` may be there already, null where there is no text: texts that many records share need be read once only."""
    from ..functions import text as X
    from .report import group_of

    dates = F.coalesce("lead_dates", F.array().cast("array<string>")) if "lead_dates" in events.columns else X.lead_dates("extract")
    return (
        events.withColumn("lead_dates", dates).withColumn("date_flags", order_flags(lead=F.col("lead_dates"))).withColumn("category", group_of(F.col("wikidata_classes")))
        .withColumn("needs_review", F.size("date_flags") > 0).withColumn("needs_manual_coordinates", F.col("location_quality") == "none")
    )


def refresh_counts(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, sitelinks, outcome): counts from fresh entities; missing and unchanged ones are told apart."""
    j = events.join(entities.select("wikidata_qid", F.col("sitelinks").alias("_fresh"), F.lit(True).alias("_found")), "wikidata_qid", "left")
    told = F.when(F.col("_found").isNull(), "missing").when(F.col("_fresh").eqNullSafe(F.col("sitelinks_current")), "same").otherwise("changed")
    return j.select("id", F.when(F.col("_found"), F.col("_fresh")).otherwise(F.col("sitelinks_current")).alias("sitelinks"), told.alias("outcome"))


def title_changes(events: DataFrame, leads: DataFrame) -> DataFrame:
    """(id, new_title, kind): titles that differ from the landed article's: held where another record owns the new one, spelling only, or a rename."""
    from ..functions import text as X

    j = events.join(leads.select("id", F.col("title").alias("new_title")), "id").where("title <> new_title")
    owner = events.select(F.col("title").alias("new_title"), F.lit(True).alias("_owned")).distinct()
    j = j.join(owner, "new_title", "left")
    kind = F.when(F.col("_owned"), "held").when(X.norm_title("title") == X.norm_title("new_title"), "spelling").otherwise("renamed")
    return j.select("id", "new_title", kind.alias("kind"))


def refresh_leads(events: DataFrame, leads: DataFrame) -> DataFrame:
    """(id, outcome): a fresh lead replaces the stored one unless the article belongs to another item."""
    from ..functions import text as X

    j = events.join(leads.select("id", F.col("extract").alias("_new")), "id", "left")
    told = F.when(F.col("_new").isNull(), "no lead").when(F.col("resolved_qid") != F.col("wikidata_qid"), "held").when(X.normalize_lead("_new") == X.normalize_lead("extract"), "same").otherwise("replaced")
    return j.select("id", told.alias("outcome"))


def sync_mirrors(events: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """Mirror records take the owner's text."""
    owner = events.select(F.col("id").alias("owner"), F.col(column).alias("_own"))
    p = pairs.join(owner, "owner").groupBy("id").agg(F.min("_own").alias("_own"))
    return events.join(p, "id", "left").withColumn(column, F.coalesce("_own", column)).drop("_own")


def seed_proposals(seeds: DataFrame, entities: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(id, field, proposed): values that a seed record lacks and its entity has; nothing stored is overwritten."""
    j = seeds.join(entities, "wikidata_qid")
    rows = F.array(*(F.when(F.col(a).isNull() & F.col(b).isNotNull(), F.struct(F.lit(a).alias("field"), F.col(b).cast("string").alias("proposed"))) for a, b in fields.items()))
    return j.select("id", F.inline(F.array_compact(rows)))


def stale_fixes(fixes: DataFrame, entities: DataFrame) -> DataFrame:
    """Ledger entries whose recorded source value is no longer the source's. ``fixes``: (wikidata_qid, was)."""
    j = fixes.join(entities.select("wikidata_qid", "now"), "wikidata_qid", "left")
    return j.where(~F.col("was").eqNullSafe(F.col("now"))).select("wikidata_qid", "was", "now")
