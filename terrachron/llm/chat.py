"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

Logs that save a conversation after every turn hold it once for each prefix. Every turn's prefix
gets a rolling hash (two 64-bit exclusive-or sums of position-salted turn hashes). A conversation
whose complete hash is a proper prefix's hash elsewhere, or equals a conversation with a smaller
id, is dropped by anti-joins; the maximal ones are rendered.

Turns are numbered and hashed in stretches of turn numbers, and stretches are added up per
conversation, so a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

STRETCH_TURNS = 512
PART_TURNS = 1024


def _same(left: DataFrame, right: DataFrame, *names: str):
    on = left[names[0]].eqNullSafe(right[names[0]])
    for name in names[1:]:
        on = on & left[name].eqNullSafe(right[name])
    return on


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, role, text, pa, pb): each turn with its position from 1, its conversation's length and the hash of the turns up to it."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / STRETCH_TURNS).alias("stretch")
    )
    stretch = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sizes = turns.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    sizes = sizes.select("conv_id", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("n_turns"))
    ranked = turns.withColumn("nth", F.row_number().over(stretch))
    placed = ranked.join(sizes, _same(ranked, sizes, "conv_id", "stretch")).select(ranked["*"], "n_turns", (F.col("base") + F.col("nth")).alias("pos"))
    hashed = placed.select(
        "conv_id", "stretch", "pos", "n_turns", "role", "text", F.xxhash64(F.lit(1), "pos", "role", F.length("role"), "text").alias("ha"), F.xxhash64(F.lit(2), "text", "pos", F.length("role"), "role").alias("hb")
    )
    hashed = materialise(hashed)
    sums = hashed.groupBy("conv_id", "stretch").agg(F.bit_xor("ha").alias("sa"), F.bit_xor("hb").alias("sb"))
    sums = sums.select("conv_id", "stretch", F.coalesce(F.bit_xor("sa").over(before), F.lit(0)).alias("ba"), F.coalesce(F.bit_xor("sb").over(before), F.lit(0)).alias("bb"))
    running = Window.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumn("ra", F.bit_xor("ha").over(running)).withColumn("rb", F.bit_xor("hb").over(running))
    joined = rolled.join(sums, _same(rolled, sums, "conv_id", "stretch"))
    return joined.select(rolled["conv_id"], "pos", "n_turns", "role", "text", F.col("ra").bitwiseXOR(F.col("ba")).alias("pa"), F.col("rb").bitwiseXOR(F.col("bb")).alias("pb"))


def maximal_turns(conversations: DataFrame) -> DataFrame:
    """The turns of the conversations that are no prefix of another one; of equal ones the smallest conv_id stays."""
    turns = materialise(prefix_hashes(conversations))
    ends = turns.where("pos = n_turns").select("conv_id", "pos", "pa", "pb")
    prefixes = turns.where("pos < n_turns").select("pos", "pa", "pb").distinct()
    longest = ends.join(prefixes, ["pos", "pa", "pb"], "left_anti")
    kept = longest.groupBy("pos", "pa", "pb").agg(F.min("conv_id").alias("conv_id"))
    return turns.join(kept.select("conv_id"), turns["conv_id"].eqNullSafe(kept["conv_id"]), "left_semi")


def format_conversations(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations rendered turn by turn, in parts of at most ``part_turns`` turns.

    Turns go by turn number (null first), then role and text. A null role reads "unknown", a null
    text is empty. Rows with a null conv_id are one conversation. Repeated rows are turns of their
    own. Other columns are ignored; no rows give no rows."""
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    turns = maximal_turns(conversations).select("conv_id", "pos", F.floor((F.col("pos") - 1) / part_turns).alias("part"), line.alias("line"))
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, turn FROM conversations
), r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t
), p AS (
  SELECT conv_id, pos, n_turns, role, text,
         string_agg(role || chr(1) || text || chr(2), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM r
), ends AS (
  SELECT min(conv_id) AS conv_id FROM p
  WHERE pos = n_turns AND prefix NOT IN (SELECT prefix FROM p WHERE pos < n_turns)
  GROUP BY prefix
)
SELECT conv_id, (pos - 1) // 1024 AS part, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM p WHERE conv_id IN (SELECT conv_id FROM ends)
GROUP BY ALL
"""
