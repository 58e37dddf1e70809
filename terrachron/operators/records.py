"""Derivation of records from their sources: ordered steps over one row, with notes kept as code and facts.

A note is struct<code, facts>, facts being a map of strings; texts are made at the edge by ``note_text``, so a rule
compares facts and never reads its own wording back. A step is a function from the columns so far to the fields that it
sets; ``derive`` runs steps in order and keeps, for each field, the name of the last step that changed it. All steps
are projections over rows that already carry their sources: ``with_sources`` joins those once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spatial as S
from ..functions import temporal as T
from ..functions import text as X
from ..session import settle
from . import joins as J
from .derive import kept_precision, merged_labels, reconcile_start
from .report import group_of

NOTE = "struct<code:string,facts:map<string,string>>"
NOTES = f"array<{NOTE}>"
FAR_KM, NEAR_YEARS = 1500, 1
#: Same point to six decimal places.
SAME_POINT = 5e-7

# Codes of notes.
HELD, ADJUSTED, LEAD_YEAR = "extract_not_copied_qid_mismatch", "date_source_adjusted", "date_start_year_not_in_lead"
REVERSED, COARSE_END, DATES_NOTE = "date_order_invalid", "date_end_precision_coarse", "wikipedia_dates_note"
OUTSIDE, FIX, FAR = "country_from_outside_place_removed", "data_fix", "coordinate_far_from_countries"
CATEGORY_YEARS, TITLE_DIFFERS, PREDECESSOR = "category_year_mismatch", "title_differs_from_article", "country_via_predecessor_state"
PLACE_ONLY, NOT_SUPPORTED = "country_via_place_only", "country_not_supported_by_wikidata"
COARSE_START, MONTH_DAY, LEAD_DAY = "date_precision_coarse", "month_precision_day_in_lead", "lead_start_day_differs"
TITLE_YEARS, LOW_PRECISION = "title_years_outside_dates", "coordinate_low_precision"
START_NOTES = (REVERSED, COARSE_END, DATES_NOTE, LEAD_YEAR)

Step = Callable[[], dict[str, Column]]


def no_notes() -> Column:
    return F.array().cast(NOTES)


def note(code: str, **facts: Column) -> Column:
    pairs = [x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(code).alias("code"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("facts")).cast(NOTE)


def when_note(condition: Column, made: Column) -> Column:
    """A list of one note, or of none."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(made)).otherwise(no_notes())


def without(notes: Column, *codes: str) -> Column:
    return F.filter(F.coalesce(notes, no_notes()), lambda n: ~n["code"].isin(*codes))


def replaced(notes: Column, code: str, fresh: Column) -> Column:
    """``notes`` with that of ``code`` replaced where it stands by ``fresh``, a list of one or none; at the end where there was none."""
    there = F.exists(notes, lambda n: n["code"] == code)
    return F.when(there, F.flatten(F.transform(notes, lambda n: F.when(n["code"] == code, fresh).otherwise(F.array(n))))).otherwise(F.concat(notes, fresh))


def codes(notes: Column) -> Column:
    return F.transform(notes, lambda n: n["code"])


def note_text(n: Column) -> Column:
    """``code: fact value, fact value`` in the order of the facts' names."""
    facts = F.transform(F.array_sort(F.map_entries(n["facts"])), lambda e: F.concat_ws(" ", e["key"], F.coalesce(e["value"], F.lit("unknown"))))
    return F.when(F.size(facts) > 0, F.concat(n["code"], F.lit(": "), F.array_join(facts, ", "))).otherwise(n["code"])


def listed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ", ")


def lead_year_note(years: Column, start: str = "date_start") -> Column:
    """The text names ``years``, and none is within a year of the start."""
    year = T.year_of(start)
    missing = (F.size(years) > 0) & year.isNotNull() & ~F.exists(years, lambda y: F.abs(y - year) <= NEAR_YEARS)
    return when_note(missing, note(LEAD_YEAR, start=F.col(start), years=listed(F.slice(years, 1, 8))))


def dates_note(start: Column, end: Column, extract: Column, years: Column, days: Column) -> Column:
    """What a text says of dates, beside the stored ones: up to four days as written, else six years, and which stored year it lacks."""
    lacks = lambda year: (F.size(years) > 0) & year.isNotNull() & ~F.exists(years, lambda y: F.abs(y - year) <= NEAR_YEARS)
    told = F.when(F.size(days) > 0, F.array_join(F.slice(days, 1, 4), "; ")).when(F.size(years) > 0, listed(F.slice(years, 1, 6))).otherwise("no year")
    missing = F.array_join(F.array_compact(F.array(F.when(lacks(T.year_of(start)), "start"), F.when(lacks(T.year_of(end)), "end"))), ", ")
    return when_note(F.coalesce(extract, F.lit("")) != "", note(DATES_NOTE, says=told, start=start, end=end, lacks=missing))


def order_notes(years: Column, days: Column, end_code: Column, start: str = "date_start", end: str = "date_end", extract: str = "extract") -> Column:
    """Notes on an end before its start. An end coarser than a day stands for its whole period: where that reaches the start, it is only coarse."""
    s, e, code = F.col(start), F.col(end), end_code
    coarse = code < 11
    last = F.when(coarse, T.last_day_of_period(e, code))
    fits = F.coalesce(last >= s, F.lit(False))
    name = F.when(coarse, T.precision_name(code))
    wrong = F.concat(F.array(note(REVERSED, start=s, end=e, end_precision=name)), dates_note(s, e, F.col(extract), years, days))
    return F.when(e < s, F.when(fits, F.array(note(COARSE_END, start=s, end=e, end_precision=name, until=last))).otherwise(wrong)).otherwise(no_notes())


def category_years_note(years: Column, start: str = "date_start", end: str = "date_end") -> Column:
    """Year categories of the article, all of them more than a year away from the dates."""
    low = T.year_of(start)
    high = F.coalesce(T.year_of(end), low)
    near = F.exists(years, lambda y: y.between(low - NEAR_YEARS, high + NEAR_YEARS))
    return when_note((F.size(years) > 0) & low.isNotNull() & ~near, note(CATEGORY_YEARS, years=listed(years), first=low, last=high))


def years_of_note(notes: Column) -> Column:
    """The years that a note on category years lists; null without one."""
    found = F.get(F.filter(notes, lambda n: n["code"] == CATEGORY_YEARS), F.lit(0))["facts"]
    return F.transform(F.split(F.try_element_at(found, F.lit("years")), ", "), lambda y: y.try_cast("int"))


UNVERIFIED, START_YEAR, END_YEAR = "unverified_date", "date_year_mismatch", "date_end_year_mismatch"


def cross_check_notes(category_years: Column, start: str = "date_start", end: str = "date_end", extract: str = "extract") -> Column:
    """Dates against the years that the text and the article's year categories name: a reversed pair, then one of the text's notes, then the categories'.

    Without a year in the text a date is unverified, unless a category has it; else the start, or then the end, may be a year the text lacks."""
    years, first, last = X.years_in(extract), T.year_of(start), T.year_of(end)
    near = lambda found, year: F.exists(found, lambda y: F.abs(y - year) <= NEAR_YEARS)
    reversed_ = when_note(F.col(end) < F.col(start), note(REVERSED, start=F.col(start), end=F.col(end)))
    confirmed = first.isNotNull() & (F.size(category_years) > 0) & near(category_years, first)
    unverified = when_note((F.size(years) == 0) & ~F.coalesce(confirmed, F.lit(False)), note(UNVERIFIED, start_year=first, categories=F.coalesce(listed(category_years), F.lit(""))))
    lacks_start = (F.size(years) > 0) & first.isNotNull() & ~near(years, first)
    lacks_end = (F.size(years) > 0) & last.isNotNull() & ~near(years, last)
    text = F.when(F.coalesce(lacks_start, F.lit(False)), F.array(note(START_YEAR, start_year=first, years=listed(years)))).when(F.coalesce(lacks_end, F.lit(False)), F.array(note(END_YEAR, end_year=last, years=listed(years)))).otherwise(unverified)
    return F.concat(reversed_, text, category_years_note(category_years, start, end))


def far_note(points: Column, lon: str = "lon", lat: str = "lat", countries: str = "countries", limit: float = FAR_KM) -> Column:
    """A place further than ``limit`` from every one of its countries' points; ``points``: a map from country to struct<lon, lat>."""
    known = F.array_compact(F.transform(countries, lambda c: F.try_element_at(points, c)))
    km = F.array_min(F.transform(known, lambda p: S.haversine_km(F.col(lon), F.col(lat), p["lon"], p["lat"], S.EARTH_KM_FLAGS)))
    return when_note(F.col(lon).isNotNull() & F.col(lat).isNotNull() & (km > limit), note(FAR, km=F.floor(km + 0.5), countries=F.array_join(countries, ", ")))


def with_sources(records: DataFrame, entities: DataFrame, leads: DataFrame, ledger: DataFrame) -> DataFrame:
    """``records`` with columns ``entity``, ``lead`` and ``fix``, structs or null, each of one row at most by its key.

    ``entities`` and ``ledger`` are keyed by wikidata_qid, ``leads`` by article."""

    def packed(table: DataFrame, key: str, name: str) -> DataFrame:
        return J.shuffled(table.groupBy(key).agg(F.first(F.struct(*(c for c in table.columns if c != key))).alias(name)))

    article = records.withColumn("article", F.coalesce(X.title_from_url("wikipedia_url"), F.col("title")))
    by_item = article.join(packed(entities, "wikidata_qid", "entity"), "wikidata_qid", "left").join(packed(ledger, "wikidata_qid", "fix"), "wikidata_qid", "left")  # one shuffle of the records for both
    return settle(by_item).join(packed(leads, "article", "lead"), "article", "left")


def derive(records: DataFrame, steps: list[tuple[str, Step]], watched: tuple[str, ...]) -> DataFrame:
    """The steps in order. ``set_by`` tells for each of the ``watched`` fields which step changed it last; null where it is as stored."""
    out = records.withColumn("set_by", F.struct(*(F.lit(None).cast("string").alias(c) for c in watched)))
    for name, step in steps:
        fields = step()
        by = F.struct(*(F.when(~F.col(c).eqNullSafe(fields[c]), F.lit(name)).otherwise(F.col("set_by")[c]).alias(c) if c in fields else F.col("set_by")[c].alias(c) for c in watched))
        out = out.withColumns(fields | {"set_by": by})
    return out


def lead_step(as_of: str) -> Step:
    """The text of the article, unless that is the article of another item: then the stored one stays, with a note."""

    def step() -> dict[str, Column]:
        lead, extract = F.col("lead"), F.col("extract")
        fresh, own = lead["extract"], F.col("wikidata_qid")
        held = F.coalesce(fresh.isNotNull() & ~fresh.eqNullSafe(extract) & (lead["item"] != own), F.lit(False))
        copied = fresh.isNotNull() & ~held
        stamp = F.when(extract.isNotNull(), F.substring(F.coalesce("retrieved_at", F.lit(as_of)), 1, 10))
        return {
            "extract": F.when(copied, fresh).otherwise(extract),
            "extract_retrieved_at": F.when(copied, F.substring(lead["retrieved_at"], 1, 10)).otherwise(F.coalesce("extract_retrieved_at", stamp)),
            "review_notes": F.concat(without(F.col("review_notes"), HELD), when_note(held, note(HELD, article=lead["title"], item=lead["item"], own=own))),
        }

    return step


def class_step() -> dict[str, Column]:
    """Classes of the item, then those it was found under; the group; aliases and an open end as the item has them."""
    entity = F.col("entity")
    classes = merged_labels(entity["classes"], F.col("matched_classes"))
    return {"wikidata_classes": classes, "category": group_of(classes), "aliases": F.when(F.size(entity["aliases"]) > 0, entity["aliases"]), "date_end_open": entity["end_open"]}


def _first(claims: str) -> Column:
    return F.get(F.col("entity")[claims], F.lit(0))


def adjusted_start(rules: tuple[str, ...] | None = None) -> Column:
    """``reconcile_start`` over the first claims of the item, for some of its rules."""
    names = [F.lit(r) for r in rules or ("coarse", "end", "inside", "year")]
    found = reconcile_start("date_start", _first("p585")["time"], _first("p585")["precision"], _first("p580")["time"], _first("p580")["precision"], _first("p582")["time"])
    return F.when(found["rule"].isin(*names), found)


def _adjusted_note(found: Column) -> Column:
    return note(ADJUSTED, rule=found["rule"], point=_first("p585")["time"], start=_first("p580")["time"])


def start_step() -> dict[str, Column]:
    """The item's start time where its point in time stands for something else."""
    found = adjusted_start()
    return {"date_start": F.coalesce(found["date_start"], "date_start"), "date_notes": F.concat(without(F.col("date_notes"), ADJUSTED), when_note(found.isNotNull(), _adjusted_note(found)))}


def tag_step() -> dict[str, Column]:
    """Country tags that only places mostly outside give are taken out of discovered records."""
    outside = F.when(F.col("entity").isNotNull() & F.col("sitelinks").isNotNull(), F.array_intersect("countries", "outside_tags"))
    some = F.coalesce(F.size(outside) > 0, F.lit(False))
    return {"countries": F.when(some, F.array_except("countries", outside)).otherwise(F.col("countries")), "review_notes": F.concat("review_notes", when_note(some, note(OUTSIDE, countries=F.array_join(outside, ", "))))}


def ledger_step(fields: tuple[str, ...], points: Column) -> Step:
    """Values that the ledger sets, with a note of those that changed; a place that changed is measured again."""

    def step() -> dict[str, Column]:
        fix = F.col("fix")
        sets = lambda c: F.coalesce(F.array_contains(fix["set_fields"], c), F.lit(False))
        new = {c: F.when(sets(c), fix[c]).otherwise(F.col(c)) for c in fields}
        changed = F.array_compact(F.array(*(F.when(sets(c) & ~F.col(c).eqNullSafe(fix[c]), F.lit(c)) for c in fields)))
        notes = F.filter(F.col("review_notes"), lambda n: ~((n["code"] == FIX) & F.try_element_at(n["facts"], F.lit("ref")).eqNullSafe(fix["ref"])))
        notes = F.when(F.size(changed) > 0, F.concat(notes, F.array(note(FIX, ref=fix["ref"], fields=F.array_join(changed, ", "))))).otherwise(F.col("review_notes"))
        return new | {"review_notes": notes, "moved": F.arrays_overlap(changed, F.array(F.lit("lon"), F.lit("lat")))}

    return step


def moved_step(points: Column) -> Step:
    """The distance note of a place that the ledger moved, before the note of the fix."""

    def step() -> dict[str, Column]:
        kept, far = without(F.col("review_notes"), FAR), far_note(points)
        fixes = F.filter(kept, lambda n: n["code"] == FIX)
        return {"review_notes": F.when(F.col("moved"), F.concat(without(kept, FIX), far, fixes)).otherwise(F.col("review_notes"))}

    return step


def told_step() -> dict[str, Column]:
    """What the text says of dates, and the precision of the stored end, for the notes after."""
    return {"told_years": X.years_in("extract"), "told_days": X.days_as_written("extract"), "told_dates": X.lead_dates("extract"), "end_code": kept_precision(F.col("entity")["p582"], F.col("date_end"))["precision"]}


TOLD = ("told_years", "told_days", "told_dates", "end_code")


def lead_days() -> Column:
    """The days that the text names, for a record whose dates are reversed; else null."""
    return F.when(F.exists("date_notes", lambda n: n["code"] == REVERSED) & (F.size("told_dates") > 0), F.col("told_dates"))


def date_note_step() -> dict[str, Column]:
    """Notes on the dates that the record keeps."""
    return {"date_notes": F.concat(without(F.col("date_notes"), *START_NOTES), lead_year_note(F.col("told_years")), order_notes(F.col("told_years"), F.col("told_days"), F.col("end_code")))}


def category_step() -> dict[str, Column]:
    """The note on category years over the dates that are kept; a note lists the years where the record has none."""
    notes = without(F.col("review_notes"), REVERSED, "date_year_mismatch", "date_end_year_mismatch", TITLE_DIFFERS, NOT_SUPPORTED, PLACE_ONLY, PREDECESSOR)
    years = F.coalesce("category_years", years_of_note(F.col("review_notes")))
    return {"review_notes": F.when(years.isNotNull(), replaced(notes, CATEGORY_YEARS, category_years_note(years))).otherwise(notes), "wikipedia_lead_dates": lead_days()}


def support_step() -> dict[str, Column]:
    """Notes on the title and the country tags, over what the former steps left."""
    differs = X.title_mismatch("title", "article", "extract") & (F.coalesce("extract", F.lit("")) != "")
    title = when_note(differs, note(TITLE_DIFFERS, title=F.col("title"), article=F.col("article")))
    via = F.coalesce("predecessor_tags", F.array().cast("array<string>"))
    before = when_note(F.size(via) > 0, note(PREDECESSOR, countries=F.array_join(via, ", ")))
    direct, place, tags = F.col("entity")["direct_tags"], F.col("entity")["place_tags"], F.col("countries")
    known = F.array_union(F.array_union(direct, place), via)
    alone = (F.size(direct) == 0) & (F.size(F.col("entity")["states"]) > 0) & (F.size(tags) > 0) & (F.size(F.array_except(tags, place)) == 0)
    unknown = F.array_except(tags, known)
    support = F.when(F.col("entity").isNull(), no_notes()).when(alone, F.array(note(PLACE_ONLY, states=F.array_join(F.col("entity")["states"], ", "))))
    support = support.when((F.size(known) > 0) & (F.size(unknown) > 0), F.array(note(NOT_SUPPORTED, countries=F.array_join(unknown, ", "), known=F.array_join(known, ", ")))).otherwise(no_notes())
    return {"review_notes": F.concat("review_notes", title, before, support)}


def review_step() -> dict[str, Column]:
    return {"needs_review": (F.size("review_notes") > 0) | (F.size("date_notes") > 0)}


WATCHED = ("title", "extract", "category", "date_start", "date_end", "countries", "lon", "lat")
LEDGER_FIELDS = ("title", "date_start", "date_end", "countries", "lon", "lat")


def finalize(records: DataFrame, points: Column, as_of: str, reconcile: bool = True) -> DataFrame:
    """The whole derivation of records that carry their sources: text, classes, start, tags, ledger, notes, review, in this order.

    ``points``: a map from country to its point. With ``reconcile`` off, the stored start and its note stay."""
    steps: list[tuple[str, Step]] = [("lead", lead_step(as_of)), ("classes", class_step)]
    steps += [("start", start_step)] if reconcile else []
    steps += [("tags", tag_step), ("ledger", ledger_step(LEDGER_FIELDS, points)), ("moved", moved_step(points)), ("told", told_step), ("date notes", date_note_step), ("category", category_step), ("support", support_step), ("review", review_step)]
    return derive(records, steps, WATCHED).drop("moved", *TOLD)


def _ledger_sets(*fields: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.col("fix")["set_fields"], F.array(*map(F.lit, fields))), F.lit(False))


def rederive_starts(records: DataFrame, rules: tuple[str, ...] = ("year",)) -> DataFrame:
    """Stored records whose start the rule of the year gives anew, with the notes that hang on it; a column ``start_change`` tells of those.

    Nothing changes where the item is not there or redirects, where the ledger sets the start, or where it is the same already."""
    entity = F.col("entity")
    found = adjusted_start(rules)
    applies = entity.isNotNull() & ~F.coalesce(entity["redirected"], F.lit(False)) & ~_ledger_sets("date_start") & (found["date_start"] != F.col("date_start"))
    change = F.struct(F.col("date_start").alias("from"), F.col("date_precision").alias("from_precision"), found["date_start"].alias("to"), T.precision_name(found["precision"]).alias("to_precision"), found["rule"].alias("rule"))
    out = records.withColumn("start_change", F.when(applies, change))
    changed = F.col("start_change").isNotNull()
    # the note is made before the start is replaced: it names the point that was set aside
    out = out.withColumns({
        "date_notes": F.when(changed, F.concat(without(F.col("date_notes"), ADJUSTED), F.array(_adjusted_note(found)))).otherwise(F.col("date_notes")),
        "date_start": F.coalesce(F.col("start_change")["to"], "date_start"),
        "date_precision": F.coalesce(F.col("start_change")["to_precision"], "date_precision"),
    })
    out = out.withColumns(told_step())
    out = out.withColumn("date_notes", F.when(changed, date_note_step()["date_notes"]).otherwise(F.col("date_notes")))
    out = out.withColumn("wikipedia_lead_dates", F.when(changed, lead_days()).otherwise(F.col("wikipedia_lead_dates")))
    years = years_of_note(F.col("review_notes"))
    start, end = F.col("date_start"), F.when(F.col("date_end").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date_end"))
    out = out.withColumn("first_days", F.array_sort(X.exact_days(X.first_sentence("extract"))))
    in_month = F.filter("first_days", lambda d: F.substring(d, 1, 7) == F.substring(start, 1, 7))
    in_year = F.filter("first_days", lambda d: (F.substring(d, 1, 4) == F.substring(start, 1, 4)) & F.coalesce(d < end, F.lit(True)))
    first, last = T.year_of("date_start"), T.year_of("date_end")
    outside = F.filter(X.title_years("title"), lambda y: (y < F.least(first, F.coalesce(last, first))) | (y > F.greatest(first, last)) & last.isNotNull())
    fresh = (
        (CATEGORY_YEARS, F.when(years.isNotNull(), category_years_note(years)).otherwise(no_notes())),
        (COARSE_START, when_note(T.precision_code("date_precision") < 9, note(COARSE_START, precision=F.col("date_precision")))),
        (MONTH_DAY, when_note((F.col("date_precision") == "month") & (F.size(in_month) > 0), note(MONTH_DAY, start=start, days=listed(in_month)))),
        (LEAD_DAY, when_note((F.col("date_precision") == "day") & ~F.array_contains("first_days", start) & (F.size(in_year) > 0), note(LEAD_DAY, start=start, days=listed(in_year)))),
        (TITLE_YEARS, when_note(F.size(outside) > 0, note(TITLE_YEARS, years=listed(outside)))),
    )
    for code, made in fresh:
        out = out.withColumn("review_notes", F.when(changed, replaced(F.col("review_notes"), code, made)).otherwise(F.col("review_notes")))
    return out.withColumns(review_step()).drop("first_days", *TOLD)


def same_point(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.coalesce((F.abs(lon1 - lon2) <= SAME_POINT) & (F.abs(lat1 - lat2) <= SAME_POINT), F.lit(False))


def pin_outcome() -> Column:
    """A pin of the article against the article's point now (``lead.lon``, ``lead.lat``; ``lead.has_point`` null where not fetched) and the item's.

    'both_sources_differ' where the two agree with each other and not with the pin, 'article_differs' where only the article differs, else null."""
    lead, entity = F.col("lead"), F.col("entity")
    own = (F.col("coordinate_source") == "wikipedia") & F.col("lon").isNotNull() & lead["has_point"].isNotNull() & F.coalesce(F.col("resolved_qid") == F.col("wikidata_qid"), F.lit(True))
    stays = same_point(F.col("lon"), F.col("lat"), lead["lon"], lead["lat"])
    agree = same_point(lead["lon"], lead["lat"], entity["lon"], entity["lat"])
    return F.when(own & ~stays, F.when(agree, "both_sources_differ").otherwise("article_differs"))


def rederive_pins(records: DataFrame, points: Column) -> DataFrame:
    """Pins moved to where article and item agree, unless the ledger sets them; ``pin_outcome`` tells of each, ``pin_moved`` of those that moved."""
    out = records.withColumn("pin_outcome", pin_outcome())
    moved = (F.col("pin_outcome") == "both_sources_differ") & ~_ledger_sets("lon", "lat")
    out = out.withColumn("pin_moved", F.coalesce(moved, F.lit(False)))
    out = out.withColumns({c: F.when(F.col("pin_moved"), F.col("lead")[c]).otherwise(F.col(c)) for c in ("lon", "lat")})
    low = when_note(S.low_precision_pin(), note(LOW_PRECISION, lon=F.col("lon"), lat=F.col("lat")))
    for code, made in ((FAR, far_note(points)), (LOW_PRECISION, low)):
        out = out.withColumn("review_notes", F.when(F.col("pin_moved"), replaced(F.col("review_notes"), code, made)).otherwise(F.col("review_notes")))
    return out.withColumns(review_step())
