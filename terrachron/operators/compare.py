"""Snapshots and ledgers: differences, baselines, merges, removals, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_by_id(before: DataFrame, after: DataFrame, key: str = "id", signature: str = "sig") -> DataFrame:
    """(id, change): added, removed or changed rows, by a full outer join."""
    a = before.select(F.col(key).alias("a_id"), F.col(signature).alias("a_sig"))
    b = after.select(F.col(key).alias("b_id"), F.col(signature).alias("b_sig"))
    change = F.when(F.col("a_id").isNull(), "added").when(F.col("b_id").isNull(), "removed").when(~F.col("a_sig").eqNullSafe(F.col("b_sig")), "changed")
    return a.join(b, F.col("a_id") == F.col("b_id"), "full").select(F.coalesce("b_id", "a_id").alias("id"), change.alias("change")).where("change IS NOT NULL")


def full_replace(before: DataFrame, after: DataFrame, changes: DataFrame, ratio: float = 0.5) -> bool:
    """Whether so much changed that replacing all is better: counts only."""
    n = changes.groupBy().agg(F.count_if(F.col("change") != "removed").alias("put"), F.count_if(F.col("change") != "added").alias("taken")).first()
    return max(n["put"], n["taken"]) > ratio * max(before.count(), after.count())


def with_baseline(current: DataFrame, baseline: DataFrame, files: list[str], skipped: tuple[str, ...] = ()) -> DataFrame:
    """(file, id, code, state): findings that are fresh, kept, or gone from a baseline; files that did not run keep theirs."""
    keys = ["file", "id", "code"]
    now, base = current.select(keys).distinct(), baseline.select(keys).distinct()
    ran = F.col("file").isin(*files)
    fresh = now.join(base, keys, "left_anti").withColumn("state", F.lit("fresh"))
    gone = base.where(ran & ~F.col("code").isin(*skipped)).join(now, keys, "left_anti").withColumn("state", F.lit("gone"))
    kept = base.join(now, keys, "left_semi").unionByName(base.where(~ran).join(now, keys, "left_anti")).withColumn("state", F.lit("kept"))
    return fresh.unionByName(gone).unionByName(kept)


def geometry_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, problem): fewer vertices, coarser decimals, another hash, new, gone; the first that holds."""
    a = baseline.select(F.col("key").alias("ka"), F.col("vertices").alias("va"), F.col("fine").alias("fa"), F.col("sha").alias("ha"))
    b = current.select(F.col("key").alias("kb"), F.col("vertices").alias("vb"), F.col("fine").alias("fb"), F.col("sha").alias("hb"))
    told = (
        F.when(F.col("ka").isNull(), "new").when(F.col("kb").isNull(), "gone").when(F.col("vb") < F.col("va"), "fewer vertices")
        .when(F.col("fb") < F.col("fa"), "coarser").when(F.col("hb") != F.col("ha"), "changed")
    )
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("kb", "ka").alias("key"), told.alias("problem")).where("problem IS NOT NULL")


def distance_baseline(current: DataFrame, baseline: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(id, problem): distances that grew by more than the tolerance, were lost, or have no counterpart."""
    a, b = baseline.select(F.col("id").alias("ia"), F.col("km").alias("ka")), current.select(F.col("id").alias("ib"), F.col("km").alias("kb"))
    told = (
        F.when(F.col("ib").isNull(), "missing").when(F.col("ia").isNull(), "new").when(F.col("kb").isNull() & F.col("ka").isNotNull(), "lost").when(F.col("kb") > F.col("ka") + tolerance, "worse")
    )
    return a.join(b, F.col("ia") == F.col("ib"), "full").select(F.coalesce("ib", "ia").alias("id"), told.alias("problem")).where("problem IS NOT NULL")


def size_guard(fresh: DataFrame, committed: DataFrame, share: float = 0.9) -> None:
    """Fail where a fresh table has less than ``share`` of the committed rows."""
    now, then = fresh.count(), committed.count()
    if now < share * then:
        raise ValueError(f"{now} rows where {then} are committed")


def clashes(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, by): incoming rows whose id or item the base has; two semi-joins, never an OR."""
    same_id = incoming.join(base.select("id"), "id", "left_semi").select("id", F.lit("id").alias("by"))
    same_item = incoming.join(base.select("wikidata_qid"), "wikidata_qid", "left_semi").select("id", F.lit("qid").alias("by"))
    both = same_id.unionByName(same_item)
    return both.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("by")), "+").alias("by"))


def match_exclusions(events: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(id, reason, by): rows a ledger excludes by id, else by item."""
    x = exclusions.select(F.col("id").alias("x_id"), F.col("qid").alias("x_qid"), "reason")
    by_id = events.join(x, F.col("id") == F.col("x_id")).select("id", "reason", F.lit("id").alias("by"))
    by_item = events.join(x, F.col("wikidata_qid") == F.col("x_qid")).select("id", "reason", F.lit("qid").alias("by"))
    return by_id.unionByName(by_item.join(by_id.select("id"), "id", "left_anti"))


def unaccounted_removals(base: DataFrame, head: DataFrame, redirects: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids of the base that are neither in the head nor redirected nor listed as removed."""
    out = base.select("id")
    for other in (head.select("id"), redirects.select(F.col("old_id").alias("id")), removed.select("id")):
        out = out.join(other, "id", "left_anti")
    return out


def redirect_problems(redirects: DataFrame, ids: DataFrame) -> DataFrame:
    """(old_id, problem): a redirect whose old id still exists, whose new id does not, or that leads to another redirect."""
    live = ids.select(F.col("id").alias("live_id"))
    old_lives = redirects.join(live, F.col("old_id") == F.col("live_id"), "left_semi").select("old_id", F.lit("old id exists").alias("problem"))
    new_gone = redirects.join(live, F.col("new_id") == F.col("live_id"), "left_anti").select("old_id", F.lit("new id missing").alias("problem"))
    chain = redirects.join(redirects.select(F.col("old_id").alias("next")), F.col("new_id") == F.col("next"), "left_semi").select("old_id", F.lit("chain").alias("problem"))
    return old_lives.unionByName(new_gone).unionByName(chain)


def merge_proposed(curated: DataFrame, proposed: DataFrame, not_event: Column, exclusions: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """(id, outcome): why a proposed row is not merged, or "merge": no event, excluded, a clash, not reviewed. Nothing is written."""
    rows = proposed.withColumn("_not", not_event)
    excluded = match_exclusions(proposed, exclusions).select("id", F.lit(True).alias("_out"))
    clash = clashes(curated, proposed).select("id", F.lit(True).alias("_clash"))
    rows = rows.join(excluded, "id", "left").join(clash, "id", "left")
    gate = F.lit(True)
    if reviewed is not None:
        rows = rows.join(reviewed.select("id", F.lit(True).alias("_seen")), "id", "left")
        gate = F.coalesce("_seen", F.lit(False))
    told = F.when(F.col("_not"), "not an event").when(F.col("_out"), "excluded").when(F.col("_clash"), "clash").when(~gate, "not reviewed").otherwise("merge")
    return rows.select("id", told.alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, key: str, refreshed: list[str]) -> DataFrame:
    """Old rows stay but for the ``refreshed`` columns, which the new table gives where it has the row; new rows are added."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    there = F.col(f"a.{key}").isNotNull()
    cols = []
    for c in old.columns:
        if c in refreshed:
            cols.append(F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            cols.append(F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return joined.select(*cols)


def mirror_pairs(events: DataFrame) -> DataFrame:
    """(id, owner): events whose article belongs to another event's item."""
    o = events.select(F.col("wikidata_qid").alias("q"), F.col("id").alias("owner"))
    return events.where("resolved_qid <> wikidata_qid").join(o, F.col("resolved_qid") == F.col("q")).where("id <> owner").select("id", "owner")


def drift(events: DataFrame, entities: DataFrame, fields: dict[str, str], explained: DataFrame | None = None) -> DataFrame:
    """(id, field, stored, source, state): stored values that differ from the source's, explained by the ledger or listed."""
    j = events.join(entities, "wikidata_qid")
    rows = F.array(*(F.struct(F.lit(a).alias("field"), F.col(a).cast("string").alias("stored"), F.col(b).cast("string").alias("source")) for a, b in fields.items()))
    long = j.select("id", F.inline(rows)).where(~F.col("stored").eqNullSafe(F.col("source")))
    if explained is None:
        return long.withColumn("state", F.lit("listed"))
    known = explained.select("id", "field", F.lit("explained").alias("_known"))
    return long.join(known, ["id", "field"], "left").withColumn("state", F.coalesce("_known", F.lit("listed"))).drop("_known")


def same_geometries(left: DataFrame, right: DataFrame) -> DataFrame:
    """(same, only_left, only_right): whether two sets of shapes are equal, each as often; one row."""
    from ..functions import spatial as S

    both = left.select(S.geometry_hash(F.col("polygons")).alias("h"), F.lit(1).alias("side")).unionByName(right.select(S.geometry_hash(F.col("polygons")).alias("h"), F.lit(-1).alias("side")))
    sums = both.groupBy("h").agg(F.sum("side").alias("s"))
    counts = sums.agg(F.coalesce(F.sum(F.greatest("s", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("s"), F.lit(0))), F.lit(0)).alias("only_right"))
    return counts.select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("same"), "only_left", "only_right")
