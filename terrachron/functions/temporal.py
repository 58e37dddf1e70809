"""Date and year expressions over event records; every function returns a Column and needs no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PRESENT = r"(?i)[–—-]\s*present\b"
OPEN_ENDS = ("wikidata_novalue", "wikidata_somevalue")
#: Names of the date precisions by code (fixed values).
PRECISIONS = {14: "second", 13: "minute", 12: "hour", 11: "day", 10: "month", 9: "year", 8: "decade", 7: "century", 6: "millennium"}
MIN_YEAR, DECADE = 1900, 10


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def year_of(date: str | Column) -> Column:
    return F.try_to_number(F.substring(col(date), 1, 4), F.lit("9999")).cast("int")


def raw_years(start="date_start", end="date_end") -> tuple[Column, Column]:
    """Start year, and end year (the start's where there is none)."""
    s = year_of(start)
    return s, F.coalesce(year_of(end), s)


def ongoing_signal(start="date_start", end="date_end", title="title", open_end="date_end_open") -> Column:
    """"title" or the open-end value where a dated record without an end says it goes on; else null."""
    dated = (F.coalesce(col(start), F.lit("")) != "") & (F.coalesce(col(end), F.lit("")) == "")
    return F.when(dated & col(title).rlike(PRESENT), F.lit("title")).when(dated & col(open_end).isin(*OPEN_ENDS), col(open_end))


def span_years(through: int, **names) -> tuple[Column, Column]:
    """Start and end year; an ongoing record runs to ``through`` at least."""
    s, e = raw_years(names.get("start", "date_start"), names.get("end", "date_end"))
    return s, F.when(ongoing_signal(**names).isNotNull() & s.isNotNull(), F.greatest(s, F.lit(through))).otherwise(e)


def years_reversed(start="date_start", end="date_end") -> Column:
    s, e = raw_years(start, end)
    return e < s


def ordered_years(through: int) -> tuple[Column, Column]:
    s, e = span_years(through)
    return F.least(s, e), F.greatest(s, e)


def overlaps(y0: int, y1: int, through: int) -> Column:
    """Whether a record touches the years: by its interval, a reversed one by either year it names."""
    s, e = span_years(through)
    return F.coalesce(F.when(e < s, s.between(y0, y1) | e.between(y0, y1)).otherwise((s <= y1) & (e >= y0)), F.lit(False))


def started_before(y0: int) -> Column:
    return F.coalesce(year_of("date_start") < y0, F.lit(False))


def listed_at_end(y0: int, y1: int) -> Column:
    """A reversed record of whose years only the end lies in the range."""
    s, e = raw_years()
    return F.coalesce((F.col("date_end") != "") & (e < s) & ~s.between(y0, y1) & e.between(y0, y1), F.lit(False))


def listed_year(y0: int, y1: int) -> Column:
    s, e = raw_years()
    return F.when(listed_at_end(y0, y1), e).otherwise(s)


def listed_date(y0: int, y1: int) -> Column:
    return F.coalesce(F.when(listed_at_end(y0, y1), F.col("date_end")).otherwise(F.col("date_start")), F.lit(""))


def decade_floor(year: str | Column) -> Column:
    return (F.floor(col(year) / DECADE) * DECADE).cast("int")


def decade_label(decade: str | Column) -> Column:
    return F.coalesce(F.concat(col(decade).cast("string"), F.lit("s")), F.lit("No date"))


def _ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def coarse_period_label(date: str | Column, precision: str | Column) -> Column:
    y = F.when(col(date).rlike(r"^\d{4}-"), year_of(date))
    named = lambda size, word: F.concat(_ordinal(F.ceil(y / size).cast("int")), F.lit(f" {word}"))
    return F.when(y >= 1, F.when(col(precision) == "century", named(100, "century")).when(col(precision) == "millennium", named(1000, "millennium")))


def format_start(date: str | Column, precision: str | Column) -> Column:
    """A date written to its precision."""
    d, p = col(date), col(precision)
    month = F.try_to_number(F.substring(d, 6, 2), F.lit("99")).cast("int")
    day = F.try_to_number(F.substring(d, 9, 2), F.lit("99")).cast("int")
    name = F.when(month.between(1, 12), F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.lit(1), F.least(F.lit(12), month))))
    year = F.substring(d, 1, 4)
    full = F.concat(day.cast("string"), F.lit(" "), name, F.lit(" "), year)
    return F.when((p == "day") & name.isNotNull() & (day > 0), full).when(p.isin("day", "month") & name.isNotNull(), F.concat(name, F.lit(" "), year)).otherwise(F.coalesce(coarse_period_label(d, p), year))


def format_event_date(start="date_start", end="date_end", precision="date_precision", end_precision="date_end_precision", ongoing: Column | None = None) -> Column:
    """One text for both dates: years where a part is unknown or reversed, a shared year or month written once."""
    s, e = col(start), F.when(col(end) != "", col(end))
    sy = F.substring(s, 1, 4)
    st = F.when(F.coalesce(e < s, F.lit(False)), sy).otherwise(format_start(s, precision))
    on = F.coalesce(ongoing, F.lit(False)) if ongoing is not None else F.lit(False)
    parts = F.struct(s.alias("s"), e.alias("e"), sy.alias("sy"), F.when(e != s, F.substring(e, 1, 4)).alias("ey"), st.alias("st"), format_start(e, end_precision).alias("et"), on.alias("on"))

    def joined(x: Column) -> Column:
        part = F.substring(x["st"], F.lit(1), F.greatest(F.length(x["st"]) - 5, F.lit(0)))
        month, words = F.get(F.split(part, " "), F.lit(1)), F.split(x["et"], " ")
        return (
            F.when(F.coalesce(x["s"], F.lit("")) == "", "")
            .when(x["e"].isNull() & x["on"], F.when(x["st"] == x["sy"], F.concat(x["sy"], F.lit("–ongoing (per source)"))).otherwise(F.concat(x["st"], F.lit(" – ongoing (per source)"))))
            .when(x["ey"].isNull(), x["st"])
            .when(x["st"] == x["sy"], F.when(x["ey"] == x["sy"], x["sy"]).otherwise(F.concat(x["sy"], F.lit("–"), x["ey"])))
            .when(x["et"] == x["ey"], F.when(x["ey"] == x["sy"], F.concat(x["st"], F.lit(" (ended "), x["ey"], F.lit(")"))).otherwise(F.concat(x["st"], F.lit(" – "), x["ey"])))
            .when(x["et"] == x["st"], x["st"])
            .when(x["ey"] != x["sy"], F.concat(x["st"], F.lit(" – "), x["et"]))
            .when(month.isNotNull() & (F.size(words) == 3) & (F.get(words, F.lit(1)) == month), F.concat(F.get(F.split(part, " "), F.lit(0)), F.lit("–"), x["et"]))
            .otherwise(F.concat(part, F.lit(" – "), x["et"]))
        )

    return F.get(F.transform(F.array(parts), joined), F.lit(0))  # the parts are worked out once


def years_text(ongoing: Column) -> Column:
    s, e = raw_years()
    return F.when(s.isNull(), "").when(ongoing.isNotNull(), F.concat(s.cast("string"), F.lit("–ongoing"))).when(e != s, F.concat_ws("–", s.cast("string"), e.cast("string"))).otherwise(s.cast("string"))


def precision_code(name: str | Column) -> Column:
    pairs = [F.lit(x) for code, word in PRECISIONS.items() for x in (word, code)]
    return F.try_element_at(F.create_map(*pairs), col(name))


def precision_name(code: str | Column) -> Column:
    pairs = [F.lit(x) for kv in PRECISIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(code))


def last_day_of_period(date: str | Column, code: str | Column) -> Column:
    """The last day of the period that a stored date stands for at a precision; null past a millennium or for no date."""
    d, c = col(date), col(code)
    y = year_of(d)
    year_end = lambda n: F.concat(F.lpad(n.cast("string"), 4, "0"), F.lit("-12-31"))
    month_end = F.date_format(F.last_day(F.try_to_date(F.concat(F.substring(d, 1, 7), F.lit("-01")))), "yyyy-MM-dd")
    out = (
        F.when(c.isNull() | (c >= 11), d).when(c == 10, month_end).when(c == 9, year_end(y)).when(c == 8, year_end(decade_floor(y) + 9))
        .when(c == 7, year_end((F.ceil(y / 100) * 100).cast("int"))).when(c == 6, year_end((F.ceil(y / 1000) * 1000).cast("int")))
    )
    return F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), out)


def precision_shape_problem(date: str | Column, name: str | Column) -> Column:
    """Why a date does not fit its precision: a month's first day, else 1 January; null where it fits."""
    d, c = col(date), precision_code(name)
    month_bad = (c == 10) & (F.substring(d, 9, 2) != "01")
    year_bad = (c < 10) & ((F.substring(d, 6, 2) != "01") | (F.substring(d, 9, 2) != "01"))
    return F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(month_bad, "not the first day of the month").when(year_bad, F.concat(F.lit("not 1 January, for precision "), col(name))))


def day_number(date: str | Column) -> Column:
    """Days since 1970 of YYYY, YYYY-MM or YYYY-MM-DD."""
    d = col(date)
    month = F.coalesce(F.nullif(F.regexp_extract(d, r"^\d{4}-(\d{2})", 1), F.lit("")), F.lit("01"))
    day = F.coalesce(F.nullif(F.regexp_extract(d, r"^\d{4}-\d{2}-(\d{2})", 1), F.lit("")), F.lit("01"))
    return F.when(d.rlike(r"^\d{4}"), F.unix_date(F.try_to_date(F.concat(F.substring(d, 1, 4), F.lit("-"), month, F.lit("-"), day))))


def exact_day(flags: Column | None = None) -> Column:
    """A record whose start is known to the day and not flagged."""
    clean = F.lit(True) if flags is None else F.coalesce(F.size(flags) == 0, F.lit(True))
    return (F.col("date_precision") == "day") & clean & F.coalesce(F.col("date_start").rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))


def is_real_date(date: str | Column, max_year: int = 9999) -> Column:
    d = col(date)
    return F.coalesce(d.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(d).isNotNull() & year_of(d).between(1, max_year), F.lit(False))


def julian_to_gregorian(year: Column, month: Column, day: Column) -> Column:
    """The Gregorian date of a Julian calendar day, by its Julian day number; null for no such day."""
    lengths = F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))
    leap = F.when((month == 2) & (year % 4 == 0), 1).otherwise(0)
    there = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= F.try_element_at(lengths, month) + leap)
    a = F.floor((F.lit(14) - month) / 12)
    y, m = year + 4800 - a, month + a * 12 - 3
    number = day + F.floor((m * 153 + 2) / 5) + y * 365 + F.floor(y / 4) - 32083
    return F.when(there, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (number - 2440588).cast("int")), "yyyy-MM-dd"))


def source_date(time: Column, precision: Column, julian: Column) -> Column:
    """A "+YYYY-MM-DDT..." value as a date; Julian days become Gregorian, coarser Julian values stay."""
    d = F.substring(F.regexp_replace(time, r"^\+", ""), 1, 10)
    part = lambda a, n: F.substring(d, a, n).cast("int")
    plain = d.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(F.coalesce(julian & (precision >= 11) & plain, F.lit(False)), F.coalesce(F.when(plain, julian_to_gregorian(part(1, 4), part(6, 2), part(9, 2))), d)).otherwise(d)


def fill_zero_parts(time: str | Column) -> Column:
    return F.regexp_replace(col(time), r"-00(?=-|$)", "-01")


def active_years(start_day: Column, end_day: Column) -> tuple[Column, Column]:
    """The years a record in force from one day to another owns: those whose 1 July it covers."""
    first = F.year(start_day) + F.when(F.date_format(start_day, "MM-dd") > "07-01", 1).otherwise(0)
    last = F.year(end_day) - F.when(F.date_format(end_day, "MM-dd") < "07-01", 1).otherwise(0)
    return first, last


def last_year(clock: int, build: int) -> int:
    """The last year shown: the clock's, within the decade of the data's year."""
    return min(max(clock, build), build // DECADE * DECADE + DECADE - 1)


def period_label(start: Column, end: Column, max_year: int) -> Column:
    s, e = start.cast("string"), end.cast("string")
    return F.when(end >= max_year, F.when(start >= max_year, s).otherwise(F.concat(s, F.lit("–present")))).when(start == end, s).otherwise(F.concat(s, F.lit("–"), e))


def _percent(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 100


def bar(a0: int, a1: int, through: int) -> Column:
    """A record's bar on an axis of years: left and width in percent, whether it goes on before or after, reversed, a point; null off the axis."""
    s, e = span_years(through)
    cells = float(a1 - a0 + 1)
    back = e < s
    year = F.when(s.between(a0, a1), s).when(e.between(a0, a1), e)
    from_, to = F.greatest(s, F.lit(a0)), F.least(e, F.lit(a1))

    def fields(left: Column, width: Column, before: Column, after: Column, point: Column) -> Column:
        return F.struct(_percent(left).alias("left"), _percent(width).alias("width"), before.alias("before"), after.alias("after"), back.alias("reversed"), point.alias("point"))

    no, yes = F.lit(False), F.lit(True)
    turned = F.when(year.isNotNull(), fields((year - a0) / cells, F.lit(1 / cells), no, no, yes))
    plain = F.when((e >= a0) & (s <= a1), fields((from_ - a0) / cells, (to - from_ + 1) / cells, s < a0, e > a1, s == e))
    return F.when(s > 0, F.when(back, turned).otherwise(plain))


def axis_bounds(through: int, min_year: int, max_year: int) -> tuple[Column, Column]:
    """Aggregates: first and last year of the records, a reversed one at its start, within limits."""
    s, e = span_years(through)
    dated = s > 0
    return F.greatest(F.min(F.when(dated, s)), F.lit(min_year)), F.least(F.max(F.when(dated, F.greatest(s, e))), F.lit(max_year))
