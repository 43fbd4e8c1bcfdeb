"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._shared import table

#: query: (module, function, table)
_QUERIES = {
    "op1_naive_bayes_language": ("language_id", "documents"),
    "op2_content_sort": ("exact_dedup", "documents"),
    "op3_license_scan": ("license_scan", "documents"),
    "op4_chat_format": ("chat_format", "conversations"),
    "op5_simhash": ("simhash", "documents"),
    "op6_shard_ring": ("sharding", "documents"),
    "op7_pack": ("packing", "documents"),
    "op8_nra_topk": ("topk", "embeddings"),
    "op9_stupid_backoff": ("lm_score", "documents"),
    "op10_bpe_transducer": ("bpe", "documents"),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    module, of = _QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(table(spark, sf_dir, of))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (module, _) in _QUERIES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), f"{name.partition('_')[0].upper()}_SQL", None)
        if sql:
            out[name] = sql
    return out
