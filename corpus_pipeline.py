"""A training-data pipeline over documents: five stages of the operators in ``terrachron.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.llm.common import materialise, table
from terrachron.llm.decontam import drop_contaminated
from terrachron.llm.line_dedup import dedup_lines
from terrachron.llm.packing import pack_documents
from terrachron.llm.quality import accepted, train
from terrachron.llm.simhash import keep_one
from terrachron.session import ship_package


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with their columns.

    A null text is judged as an empty one. Null ids and repeated rows are judged like any other;
    columns of any name may come with the documents; without labels every score is one half and all
    documents stay; no rows give no rows."""
    ship_package(spark)
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated lines; n_chars, where there is one, counts the text that stays.

    Null and empty texts stay as they are, and a document may be left with an empty text. A null id
    comes before all others, so its lines stay; rows that repeat an id and its text lose the same
    lines. Columns of any name may come with the documents; no rows give no rows."""
    ship_package(spark)
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, then text hash, and one of repeated rows.

    Null and empty texts are one group; documents without an id all stay. Columns of any name may
    come with the documents; no rows give no rows."""
    ship_package(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, with their columns.

    Null and empty texts hold none and stay. An id goes with all its rows when one of its texts is
    contaminated; a null id is an id like any other. Columns of any name may come with the
    documents; no rows, or an empty benchmark, change nothing."""
    ship_package(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of at most 2048 tokens.

    A null text is empty and packs as its end id alone; null and repeated ids and repeated rows are
    packed each; other columns are ignored; no rows give no rows."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: Fingerprints, boosted models and tokenizers are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
