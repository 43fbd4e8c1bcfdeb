"""The session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "rasterloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI stays on, so expressions use the ``try_`` forms where that matters.

    ``shuffle_partitions`` should be about the shuffled bytes over 128 MB; adaptive execution merges what is too small.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
