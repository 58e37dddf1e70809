"""Queries of temporal and spatial expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import INSIDE_SQL, events, features
from ..functions import spatial as S
from ..functions import temporal as T
from ..operators import borders as B
from .registry import query

NOW = 2001

_YEARS = """
, y AS (SELECT *, CAST(substr(date_start, 1, 4) AS INT) AS s, CAST(substr(coalesce(date_end, date_start), 1, 4) AS INT) AS e0,
        date_end IS NULL AND date_end_open IS NOT NULL AS open FROM ev),
z AS (SELECT *, CASE WHEN open THEN greatest(s, 2001) ELSE e0 END AS e FROM y)
"""


@query("b01_year_spans", _YEARS + """
SELECT id, s AS start_year, e0 AS end_year, e AS span_end, e0 < s AS reversed, least(s, e) AS lo, greatest(s, e) AS hi,
       CASE WHEN open THEN date_end_open END AS ongoing FROM z""", "ev")
def year_spans(spark, d):
    s, e0 = T.raw_years()
    _, e = T.span_years(NOW)
    lo, hi = T.ordered_years(NOW)
    return events(spark, d).select("id", s.alias("start_year"), e0.alias("end_year"), e.alias("span_end"), T.years_reversed().alias("reversed"), lo.alias("lo"), hi.alias("hi"), T.ongoing_signal().alias("ongoing"))


@query("b06_overlap_and_listing", _YEARS + """
, k AS (SELECT *, date_end IS NOT NULL AND e0 < s AND NOT (s BETWEEN 1997 AND 1998) AND e0 BETWEEN 1997 AND 1998 AS at_end FROM z)
SELECT id, s < 1997 AS started_before, at_end AS listed_at_end, CASE WHEN at_end THEN e0 ELSE s END AS listed_year, CASE WHEN at_end THEN date_end ELSE date_start END AS listed_date
FROM k WHERE CASE WHEN e < s THEN s BETWEEN 1997 AND 1998 OR e BETWEEN 1997 AND 1998 ELSE s <= 1998 AND e >= 1997 END""", "ev")
def overlap_and_listing(spark, d):
    rows = events(spark, d).where(T.overlaps(1997, 1998, NOW))
    return rows.select("id", T.started_before(1997).alias("started_before"), T.listed_at_end(1997, 1998).alias("listed_at_end"), T.listed_year(1997, 1998).alias("listed_year"), T.listed_date(1997, 1998).alias("listed_date"))


@query("b09_decades_and_texts", _YEARS + """
SELECT id, (s // 10) * 10 AS decade, ((s // 10) * 10) || 's' AS label,
       CASE WHEN open THEN s || '–ongoing' WHEN e0 <> s THEN s || '–' || e0 ELSE CAST(s AS VARCHAR) END AS years_text,
       ((s + 99) // 100) || CASE WHEN ((s + 99) // 100) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN ((s + 99) // 100) % 10 = 1 THEN 'st' WHEN ((s + 99) // 100) % 10 = 2 THEN 'nd'
         WHEN ((s + 99) // 100) % 10 = 3 THEN 'rd' ELSE 'th' END || ' century' AS century
FROM z""", "ev")
def decades_and_texts(spark, d):
    decade = T.decade_floor(T.year_of("date_start"))
    return events(spark, d).select("id", decade.alias("decade"), T.decade_label(decade).alias("label"), T.years_text(T.ongoing_signal()).alias("years_text"), T.coarse_period_label("date_start", F.lit("century")).alias("century"))


@query("b11_event_dates", """
, t AS (SELECT id, date_precision AS p, CAST(date_start AS DATE) AS s, CAST(date_end AS DATE) AS e, date_end_open IS NOT NULL AS open FROM ev),
f AS (SELECT *, CASE p WHEN 'day' THEN strftime(s, '%-d %B %Y') WHEN 'month' THEN strftime(s, '%B %Y') ELSE strftime(s, '%Y') END AS a, CASE p WHEN 'day' THEN strftime(e, '%-d %B %Y') WHEN 'month' THEN strftime(e, '%B %Y') ELSE strftime(e, '%Y') END AS b FROM t)
SELECT id, CASE WHEN e IS NULL THEN a || CASE WHEN NOT open THEN '' WHEN p = 'year' THEN '–ongoing (per source)' ELSE ' – ongoing (per source)' END
  WHEN e = s THEN a
  WHEN e < s OR p = 'year' THEN CASE WHEN year(e) = year(s) THEN '' || year(s) ELSE year(s) || '–' || year(e) END
  WHEN a = b THEN a
  WHEN year(e) <> year(s) THEN a || ' – ' || b
  WHEN p = 'day' AND month(e) = month(s) THEN day(s) || '–' || b
  ELSE left(a, length(a) - 5) || ' – ' || b END AS date_text FROM f""", "ev")
def event_dates(spark, d):
    rows = events(spark, d).withColumn("date_end_precision", F.col("date_precision"))
    return rows.select("id", T.format_event_date(ongoing=T.ongoing_signal().isNotNull()).alias("date_text"))


@query("b13_period_ends", """
SELECT id, CASE date_precision WHEN 'day' THEN date_start WHEN 'month' THEN strftime(last_day(CAST(date_start AS DATE)), '%Y-%m-%d') ELSE substr(date_start, 1, 4) || '-12-31' END AS last_day,
       CASE date_precision WHEN 'day' THEN 11 WHEN 'month' THEN 10 ELSE 9 END AS code,
       lpad(CAST((CAST(substr(date_start, 1, 4) AS INT) // 10) * 10 + 9 AS VARCHAR), 4, '0') || '-12-31' AS decade_end,
       CASE WHEN date_precision = 'month' AND substr(date_start, 9, 2) <> '01' THEN 'not the first day of the month'
            WHEN date_precision = 'year' AND substr(date_start, 6, 5) <> '01-01' THEN 'not 1 January, for precision year' END AS problem
FROM ev""", "ev")
def period_ends(spark, d):
    code = T.precision_code("date_precision")
    return events(spark, d).select("id", T.last_day_of_period("date_start", code).alias("last_day"), code.alias("code"), T.last_day_of_period("date_start", F.lit(8)).alias("decade_end"), T.precision_shape_problem("date_start", "date_precision").alias("problem"))


@query("b15_day_numbers", """
SELECT id, CAST(date_start AS DATE) - DATE '1970-01-01' AS day_number, CAST(substr(date_start, 1, 7) || '-01' AS DATE) - DATE '1970-01-01' AS month_number,
       CAST(substr(date_start, 1, 4) || '-01-01' AS DATE) - DATE '1970-01-01' AS year_number, date_precision = 'day' AS exact, true AS real
FROM ev""", "ev")
def day_numbers(spark, d):
    return events(spark, d).select(
        "id", T.day_number("date_start").alias("day_number"), T.day_number(F.substring("date_start", 1, 7)).alias("month_number"), T.day_number(F.substring("date_start", 1, 4)).alias("year_number"),
        T.exact_day().alias("exact"), T.is_real_date("date_start").alias("real"),
    )


@query("b17_julian_days", """
SELECT id, strftime(CAST(date_start AS DATE) + 13, '%Y-%m-%d') AS gregorian, strftime(CAST(date_start AS DATE) + 13, '%Y-%m-%d') AS day_value,
       substr(date_start, 1, 7) || '-00' AS month_value, substr(date_start, 1, 7) || '-01' AS filled
FROM ev""", "ev")
def julian_days(spark, d):
    part = lambda a, n: F.substring("date_start", a, n).cast("int")
    coarse = F.concat(F.substring("date_start", 1, 7), F.lit("-00"))
    stamp = lambda x: F.concat(F.lit("+"), x, F.lit("T00:00:00Z"))
    return events(spark, d).select(
        "id", T.julian_to_gregorian(part(1, 4), part(6, 2), part(9, 2)).alias("gregorian"), T.source_date(stamp(F.col("date_start")), F.lit(11), F.lit(True)).alias("day_value"),
        T.source_date(stamp(coarse), F.lit(10), F.lit(True)).alias("month_value"), T.fill_zero_parts(coarse).alias("filled"),
    )


@query("b20_active_years", """
SELECT id, year(CAST(date_start AS DATE)) + CASE WHEN strftime(CAST(date_start AS DATE), '%m-%d') > '07-01' THEN 1 ELSE 0 END AS first_year,
       year(CAST(date_end AS DATE)) - CASE WHEN strftime(CAST(date_end AS DATE), '%m-%d') < '07-01' THEN 1 ELSE 0 END AS last_year
FROM ev WHERE date_end >= date_start""", "ev")
def active_years(spark, d):
    first, last = T.active_years(F.to_date("date_start"), F.to_date("date_end"))
    return events(spark, d).where("date_end >= date_start").select("id", first.alias("first_year"), last.alias("last_year"))


@query("b22_period_labels", """
SELECT name, start_year, CASE WHEN end_year >= 2001 THEN CASE WHEN start_year >= 2001 THEN CAST(start_year AS VARCHAR) ELSE start_year || '–present' END
       WHEN start_year = end_year THEN CAST(start_year AS VARCHAR) ELSE start_year || '–' || end_year END AS label FROM ft""", "ft")
def period_labels(spark, d):
    return features(spark, d).select("name", "start_year", T.period_label(F.col("start_year"), F.col("end_year"), NOW).alias("label"))


@query("b23_bars", _YEARS + """
, b AS (SELECT *, CASE WHEN s BETWEEN 1996 AND 1999 THEN s WHEN e BETWEEN 1996 AND 1999 THEN e END AS spot FROM z)
SELECT id, e < s AS reversed,
  CASE WHEN e < s THEN floor((spot - 1996) / 4.0::DOUBLE * 10000 + 0.5) / 100 ELSE floor((greatest(s, 1996) - 1996) / 4.0::DOUBLE * 10000 + 0.5) / 100 END AS "left",
  CASE WHEN e < s THEN 25.0::DOUBLE ELSE floor((least(e, 1999) - greatest(s, 1996) + 1) / 4.0::DOUBLE * 10000 + 0.5) / 100 END AS width,
  e >= s AND s < 1996 AS before, e >= s AND e > 1999 AS after, e < s OR s = e AS point
FROM b WHERE CASE WHEN e < s THEN spot IS NOT NULL ELSE e >= 1996 AND s <= 1999 END""", "ev")
def bars(spark, d):
    return events(spark, d).select("id", T.bar(1996, 1999, NOW).alias("bar")).where("bar IS NOT NULL").select("id", "bar.*")


@query("b24_axis", _YEARS + "SELECT greatest(min(s), 1996) AS first_year, least(max(greatest(s, e)), 2005) AS last_year FROM z", "ev")
def axis(spark, d):
    lo, hi = T.axis_bounds(NOW, 1996, 2005)
    return events(spark, d).agg(lo.alias("first_year"), hi.alias("last_year"))


@query("c01_coordinates", """
, c AS (SELECT *, round(abs(lon * 10 - floor(lon * 10 + 0.5)), 7) = 0 AND round(abs(lat * 10 - floor(lat * 10 + 0.5)), 7) = 0 AND location_quality = 'precise' AS low FROM ev)
SELECT id, true AS placed, low AS low_precision, CASE WHEN low THEN 'approximate' ELSE location_quality END AS shown,
       NOT (lon BETWEEN -20 AND 20 AND lat BETWEEN -15 AND 41) AND lat BETWEEN -20 AND 20 AND lon BETWEEN -15 AND 41 AS swapped FROM c""", "ev")
def coordinates(spark, d):
    return events(spark, d).select("id", S.real_coordinates().alias("placed"), S.low_precision_pin().alias("low_precision"), S.shown_quality().alias("shown"), S.looks_swapped((-20, -15, 20, 41)).alias("swapped"))


_HAV = "2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(sin(radians(10 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(10.0::DOUBLE)) * sin(radians(20 - lon) / 2) ** 2)))"


@query("c02_distances", f"""
, b AS (SELECT id, {_HAV} AS km, (degrees(atan2(sin(radians(20 - lon)) * cos(radians(10.0::DOUBLE)), cos(radians(lat)) * sin(radians(10.0::DOUBLE)) - sin(radians(lat)) * cos(radians(10.0::DOUBLE)) * cos(radians(20 - lon)))) + 720) % 360 AS bearing FROM ev)
SELECT id, round(km, 4) AS km, round(bearing, 4) AS bearing, CASE WHEN km < 1 THEN 'under 1 km' ELSE CAST(floor(km + 0.5) AS BIGINT) || ' km' END AS label,
       (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(bearing / 45 + 0.5) AS INT) % 8 + 1] AS compass FROM b""", "ev")
def distances(spark, d):
    km, b = S.haversine_km("lon", "lat", 20, 10), S.bearing_deg("lon", "lat", 20, 10)
    return events(spark, d).select("id", F.round(km, 4).alias("km"), F.round(b, 4).alias("bearing"), S.format_km(km).alias("label"), S.compass_point(b).alias("compass"))


@query("c04_destinations", """
SELECT id, round(degrees(asin(sin(radians(lat)) * cos(100 / 6371.0088::DOUBLE) + cos(radians(lat)) * sin(100 / 6371.0088::DOUBLE) * cos(radians(30.0::DOUBLE)))), 6) AS lat2, 73 AS ring_points,
       round((lon + 180) / 360, 8) AS mx, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2, 8) AS my FROM ev""", "ev")
def destinations(spark, d):
    _, lat2 = S.destination("lon", "lat", 30, 100)
    mx, my = S.mercator()
    return events(spark, d).select("id", F.round(lat2, 6).alias("lat2"), F.size(S.circle_ring("lon", "lat", 100)).alias("ring_points"), F.round(mx, 8).alias("mx"), F.round(my, 8).alias("my"))


@query("c07_circle_filter", f"SELECT id FROM ev WHERE {_HAV} <= 800", "ev")
def circle_filter(spark, d):
    return events(spark, d).where(S.in_circle(20, 10, 800)).select("id")


@query("c12_feature_geometry", """
SELECT name, start_year, CASE WHEN overlay = 1 THEN x0 + 4 ELSE x0 END AS w, CASE WHEN overlay = 1 THEN y0 + 3 ELSE y0 END AS s,
       CASE WHEN overlay = 1 THEN x0 + 9 ELSE x0 + 18 END AS e, round(CASE WHEN overlay = 1 THEN y0 + 8 ELSE y0 + 11.2 END, 6) AS n,
       CASE WHEN overlay = 1 THEN 5 WHEN cell % 6 = 0 THEN 10 WHEN cell % 2 = 1 THEN 10 ELSE 5 END AS vertices, 0 AS fine, 0 AS problems,
       round(CASE WHEN overlay = 1 THEN 25.0::DOUBLE WHEN cell % 6 = 0 THEN 8 * 11.2::DOUBLE ELSE 18 * 11.2::DOUBLE END, 6) AS largest_area
FROM ft""", "ft")
def feature_geometry(spark, d):
    p = F.col("polygons")
    box = S.polygons_box(p)
    return features(spark, d).select(
        "name", "start_year", box["w"].alias("w"), box["s"].alias("s"), box["e"].alias("e"), F.round(box["n"], 6).alias("n"), S.vertex_count(p).alias("vertices"), S.fine_count(p).alias("fine"),
        F.size(S.ring_problems(p)).alias("problems"), F.round(F.abs(S.ring_area(F.get(S.largest_part(p), F.lit(0)))), 6).alias("largest_area"),
    )


@query("m08_label_anchors", """
SELECT name, start_year, round(CASE WHEN overlay = 1 THEN x0 + 6.5 WHEN cell % 6 = 0 THEN x0 + 14 ELSE x0 + 9 END, 6) AS lon,
       round(CASE WHEN overlay = 1 THEN y0 + 5.5 ELSE y0 + 5.6 END, 6) AS lat FROM ft WHERE overlay = 1 OR cell % 2 = 0""", "ft")
def label_anchors(spark, d):
    at = S.label_anchor(F.col("polygons"))
    return features(spark, d).select("name", "start_year", at.alias("at")).where("at IS NOT NULL").select("name", "start_year", F.round("at.lon", 6).alias("lon"), F.round("at.lat", 6).alias("lat"))


@query("f14_features_at", f"SELECT id, name, start_year FROM ev JOIN ft ON {INSIDE_SQL.format(x='lon', y='lat')}", "ev ft")
def features_at(spark, d):
    return B.features_at(events(spark, d).select("id", "lon", "lat"), features(spark, d)).select("id", "name", "start_year")
