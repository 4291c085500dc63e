"""From raw documents to packed training sequences, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns the columns of
documents; the last returns packed pieces. What each does with nulls, empty and very long texts, ties, repeated rows, empty tables and
further columns is said where its operator is defined; a stage of an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import jaccard, langid, linededup, mixing, queries
from nearfield.llm.common import spill, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told."""
    return langid.accepted(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes recurring lines but in one document, and documents of which nothing is left."""
    # one document keeps a recurring line, as the next stage keeps one of each group of near copies
    return linededup.filtered(docs, linededup.Settings(keep_first=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share of words; a document comes once for each pass that takes of it."""
    return mixing.sample(docs, *mixing.mix(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs tokens, each source at its share, into sequences of 2048."""
    return queries.packed(docs)


STAGES = [("language id", language), ("line dedup", lines), ("n-gram jaccard join", near_copies), ("mixing", mixture), ("packing", sequences)]

#: Learned models, hashes and a tokenizer decide here, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = spill(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
