"""A corpus pipeline: language ID, exact dedup, near-dedup and packing, each stage on what the one before kept.

``STAGES`` lists (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it again as the next stage's input, so a lost executor costs no
earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import exact_dedup, language_id, near_dedup, packing
from rasterloom.llm._shared import cut, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language cannot be told, go."""
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents at a similarity of 0.8 or more (5-word shingles) the one with the smallest id stays."""
    return near_dedup.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 4096 tokens."""
    return packing.op7_pack(docs)


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("packing", pack)]

#: SQL cannot express the language model, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
