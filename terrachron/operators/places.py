"""Country tags by place: which places may lend theirs, tags that only others gave, tags from predecessor states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import borders as B

DEPTH = 8


def resolved_places(claims: DataFrame, within: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(place, source): each place and the places whose claims count for it: its own, else those of the nearest places that it lies in.

    ``claims`` (place, ...) has a row for each country of a place, ``within`` (place, parent) the places around it. The walk
    goes up a step at a time from the places still without claims, at most ``depth`` steps; a place seen before on the way is not taken again, so circles end."""
    having = claims.select("place").distinct()
    up = settle(within.where("place IS NOT NULL AND parent IS NOT NULL AND place <> parent").distinct())
    every = having.unionByName(up.select("place")).unionByName(up.select(F.col("parent").alias("place"))).distinct()
    out = having.select("place", F.col("place").alias("source"))
    front = settle(every.join(having, "place", "left_anti").select("place", F.col("place").alias("at")))
    seen = front
    for _ in range(depth):
        if front.isEmpty():
            break
        steps = settle(front.join(up.select(F.col("place").alias("at"), "parent"), "at").select("place", F.col("parent").alias("at")).distinct().join(seen, ["place", "at"], "left_anti"))
        met = settle(steps.join(having.select(F.col("place").alias("at")), "at", "left_semi"))
        out = out.unionByName(met.select("place", F.col("at").alias("source")))
        front = settle(steps.join(met.select("place").distinct(), "place", "left_anti"))  # the nearest claims are enough
        seen = seen.unionByName(front)
    return out


def place_tags(claims: DataFrame, within: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(place, inside, outside, lends, tags): tracked and other present-day states of a place; it lends its tags where as many are inside as outside.

    ``claims``: (place, country, tracked, sovereign). A former state counts on neither side."""
    rows = resolved_places(claims, within, depth).join(claims.withColumnRenamed("place", "source"), "source").select("place", "country", "tracked", "sovereign").distinct()
    counted = rows.groupBy("place").agg(
        F.count_if("tracked").alias("inside"), F.count_if(~F.col("tracked") & F.col("sovereign")).alias("outside"), F.array_sort(F.collect_set(F.when(F.col("tracked"), F.col("country")))).alias("tags")
    )  # a row for each country at most
    return counted.withColumn("lends", F.col("outside") <= F.col("inside")).select("place", "inside", "outside", "lends", "tags")


def outside_tags(records: DataFrame, at: DataFrame, tagged: DataFrame) -> DataFrame:
    """(id, countries, removed): tags of a record that only places which do not lend give.

    ``records``: (id, countries, direct), ``direct`` the tags of the item itself; ``at``: (id, place); ``tagged`` as ``place_tags`` gives it."""
    given = at.select("id", "place").distinct().join(tagged, "place").select("id", "lends", F.explode("tags").alias("tag")).distinct()
    sides = given.groupBy("id").agg(F.collect_set(F.when(F.col("lends"), F.col("tag"))).alias("lent"), F.collect_set(F.when(~F.col("lends"), F.col("tag"))).alias("kept_back"))
    none = F.array().cast("array<string>")
    j = records.join(sides, "id", "left")
    supported = F.array_union(F.coalesce("direct", none), F.coalesce("lent", none))
    removed = F.array_except(F.array_intersect("countries", F.coalesce("kept_back", none)), supported)
    return j.withColumn("removed", removed).select("id", F.array_except("countries", "removed").alias("countries"), "removed")


def predecessor_tags(records: DataFrame, predecessors: DataFrame, at: DataFrame, claims: DataFrame, features: DataFrame, names_of: DataFrame, year: int) -> DataFrame:
    """(id, predecessors, via, countries): records of a former state, with the evidence for today's countries.

    ``records``: (id, lon, lat, states); ``predecessors``: (state); ``at``: (id, place); ``claims``: (place, country, tracked);
    ``names_of``: (country, shape). Evidence is of two kinds: the countries whose shapes of ``year`` hold the record's own point,
    and the tracked countries of each of its places, former states left out. Records of no former state give no row."""
    states = records.select("id", F.explode("states").alias("state")).join(predecessors.select("state").distinct(), "state", "left_semi")
    former = states.groupBy("id").agg(F.array_sort(F.collect_set("state")).alias("predecessors"))
    now = features.where(F.lit(year).between(F.col("start_year"), F.col("end_year"))).join(names_of.withColumnRenamed("shape", "name"), "name").select("country", "polygons")
    points = records.where("lon IS NOT NULL AND lat IS NOT NULL").join(former.select("id"), "id", "left_semi").select("id", "lon", "lat")
    own = B.features_at(points, now).groupBy("id", "lon", "lat").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    own = own.select("id", F.struct(F.lit("point").alias("kind"), F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("value"), "countries").alias("via"))
    today = claims.where("tracked").join(predecessors.select(F.col("state").alias("country")).distinct(), "country", "left_anti").select("place", "country").distinct()
    placed = at.select("id", "place").distinct().join(former.select("id"), "id", "left_semi").join(today, "place")
    placed = placed.groupBy("id", "place").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    placed = placed.select("id", F.struct(F.lit("place").alias("kind"), F.col("place").cast("string").alias("value"), "countries").alias("via"))
    via = own.unionByName(placed).groupBy("id").agg(F.sort_array(F.collect_list("via")).alias("via"))
    out = former.join(via, "id", "left").withColumn("via", F.coalesce("via", F.array().cast("array<struct<kind:string,value:string,countries:array<string>>>")))
    return out.withColumn("countries", F.array_sort(F.array_distinct(F.flatten(F.transform("via", lambda v: v["countries"])))))
