"""From raw documents to packed training sequences, one Parquet table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import jaccard, lines, mixing, packing, quality
from tidebook.llm.common import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rule ensemble, fitted on the labelled documents, accepts."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of recurring templates out of the texts."""
    return lines.drop_recurring(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return jaccard.first_of_groups(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents in the order of the mix of sources."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every id of every document in a sequence of at most 2048, in the order of the mix."""
    return packing.pack_in_order(docs)


STAGES = [("quality classifier", classify), ("line dedup", line_dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mix), ("packing", pack)]

# The classifier is a fitted model and packing needs a tokenizer: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
