"""Titles of records against the articles that they link to: what changed, what a second look holds back, what may be set.

A change is set only where the record still has the values that it was made from, and only one record at a time may
have a title. Changes count in the order of their records' ids: a title that an earlier change gives up is free for a
later one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import settle

ROUNDS = 60


def detected(records: DataFrame, leads: DataFrame) -> DataFrame:
    """(id, old_title, old_url, new_title, new_url, article_page, kind, hold) of records whose title or address is not the article's.

    ``leads`` (asked, title, url, redirected_from, fragment, item, page) is keyed by ``asked``, the title in a stored address.
    Held: no article, a redirect to a section, an article of another item. Kinds: renamed_redirect, title_stale, url_only."""
    asked = records.select("id", "wikidata_qid", F.col("title").alias("old_title"), F.col("wikipedia_url").alias("old_url"), X.title_from_url("wikipedia_url").alias("asked"))
    j = asked.join(leads.withColumn("found", F.lit(True)), "asked", "left")
    there = F.coalesce("found", F.lit(False))
    retitled, moved = F.col("title") != F.col("old_title"), ~F.col("title").eqNullSafe(F.col("asked"))
    hold = F.when(~there, "lead_missing").when(F.col("fragment").isNotNull(), "section_redirect").when(F.col("item") != F.col("wikidata_qid"), "qid_mismatch")
    kind = F.when(there & hold.isNull(), F.when(F.col("redirected_from").isNotNull() & retitled, "renamed_redirect").when(retitled, "title_stale").otherwise("url_only"))
    rows = j.where(~there | retitled | moved)
    return rows.select("id", "old_title", "old_url", F.col("title").alias("new_title"), F.when(moved, F.col("url")).otherwise(F.col("old_url")).alias("new_url"), F.col("page").alias("article_page"), kind.alias("kind"), hold.alias("hold"))


def second_look(changes: DataFrame, former: DataFrame) -> DataFrame:
    """Stale titles that do not lead to the very article are held: they may name something narrower. ``former`` (old_title, page, fragment): where stored titles lead."""
    f = former.select("old_title", F.col("page").alias("_page"), F.col("fragment").alias("_fragment"))
    j = changes.join(f, "old_title", "left")
    here = F.coalesce((F.col("_page") == F.col("article_page")) & F.col("_fragment").isNull(), F.lit(False))
    held = (F.col("kind") == "title_stale") & F.col("hold").isNull() & ~here
    return j.withColumn("hold", F.when(held, "title_not_redirected_here").otherwise(F.col("hold"))).select(changes.columns)


def outcomes(records: DataFrame, changes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Changes that are not held, with ``outcome``: applied, already, stale, duplicate or unknown.

    Whether a title is free depends on changes of smaller ids alone, so repeating the rule settles it; rows of a title
    are counted before they meet, and a round writes its answer to the shared folder."""
    now = records.select("id", F.col("title").alias("_title"), F.col("wikipedia_url").alias("_url"), F.lit(True).alias("_there"))
    j = changes.where("hold IS NULL").join(now, "id", "left")
    told = (
        F.when(F.col("_there").isNull(), "unknown").when((F.col("_title") == F.col("new_title")) & F.col("_url").eqNullSafe(F.col("new_url")), "already")
        .when((F.col("_title") != F.col("old_title")) | ~F.col("_url").eqNullSafe(F.col("old_url")), "stale").when(F.col("new_title") == F.col("_title"), "applied")
    )
    judged = settle(j.withColumn("outcome", told).drop("_title", "_url", "_there"))
    open_ = judged.where("outcome IS NULL").select("id", "new_title")
    holders = settle(now.select("id", F.col("_title").alias("new_title")).join(open_.select("new_title").distinct(), "new_title", "left_semi"))
    won = None
    for _ in range(rounds):
        gone = holders.withColumn("gone", F.lit(None).cast("string")) if won is None else holders.join(won.select("id", F.col("id").alias("gone")), "id", "left")
        free = gone.groupBy("new_title").agg(F.count_if(F.col("gone").isNull()).alias("left"), F.max("gone").alias("free_at"))
        able = open_.join(free, "new_title", "left").where(F.coalesce("left", F.lit(0)) == 0).where(F.col("free_at").isNull() | (F.col("id") > F.col("free_at")))
        fresh = settle(able.groupBy("new_title").agg(F.min("id").alias("id")))
        if won is not None and fresh.join(won, ["id", "new_title"], "left_anti").isEmpty() and won.join(fresh, ["id", "new_title"], "left_anti").isEmpty():
            break
        won = fresh
    else:
        raise RuntimeError(f"titles did not settle in {rounds} rounds")
    first = won.select("id", F.lit("applied").alias("_won"))
    return judged.join(first, "id", "left").withColumn("outcome", F.coalesce("outcome", "_won", F.lit("duplicate"))).drop("_won")


def applied(records: DataFrame, judged: DataFrame) -> DataFrame:
    """``records`` with the titles and addresses that were applied; a note that the title differs from the article goes with them."""
    from .records import TITLE_DIFFERS, review_step, without

    done = judged.where("outcome = 'applied'").select("id", F.col("new_title").alias("_title"), F.col("new_url").alias("_url"))
    j = records.join(done, "id", "left")
    changed = F.col("_title").isNotNull()
    out = j.withColumns({"title": F.coalesce("_title", "title"), "wikipedia_url": F.coalesce("_url", "wikipedia_url"), "review_notes": F.when(changed, without(F.col("review_notes"), TITLE_DIFFERS)).otherwise(F.col("review_notes"))})
    return out.withColumn("needs_review", F.when(changed, review_step()["needs_review"]).otherwise(F.col("needs_review"))).select(records.columns)
