"""File pipelines: read a file, transform it by SQL over a view called ``input``, append it to a table without duplicates.

A run is one plan. Target tables are Parquet folders under a warehouse folder. A failed or cancelled run leaves the target as
it was, as the append is one commit.
"""

from __future__ import annotations

import os
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import GraphError
from ..sources.tables import read_file

TIMEOUT = 300
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass
class PipelineSpec:
    format: str
    path: str
    destination_table: str
    sql_transform: str | None = None
    dedupe_column: str | None = None
    batch_size: int = 1024
    header: bool = True
    delimiter: str = ","
    data_root: str | None = None

    def validate(self) -> None:
        if self.format.lower() not in ("csv", "parquet", "json"):
            raise GraphError(f"no source format {self.format!r}")
        for name in filter(None, (self.destination_table, self.dedupe_column)):
            check_identifier(name)
        self.batch_size = self.batch_size or 1024
        self.delimiter = self.delimiter or ","
        if self.data_root and not os.path.realpath(self.path).startswith(os.path.realpath(self.data_root).rstrip("/") + "/"):
            raise GraphError("the path leaves the data folder")


@dataclass
class JobStatus:
    id: str
    state: str = "pending"
    rows_read: int = 0
    rows_written: int = 0
    started_at: float | None = None
    finished_at: float | None = None
    error: str | None = None
    spec: dict = field(default_factory=dict)


def check_identifier(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise GraphError(f"not an identifier: {name!r}")
    return name


def sql_type(kind: str) -> str:
    """INTEGER, REAL or TEXT for a Spark type name."""
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint"):
        return "INTEGER"
    return "REAL" if kind in ("float", "double") else "TEXT"


def transform(spark: SparkSession, source: DataFrame, sql: str | None) -> DataFrame:
    """One statement over a relation named ``input``: a common table expression before its own, over a view of this run's."""
    if not sql:
        return source
    source.createOrReplaceTempView(name := f"input_{uuid.uuid4().hex}")
    text = sql.strip().rstrip(";")
    own = re.match(r"with\s+", text, re.IGNORECASE)
    return spark.sql(f"with input as (select * from {name}), {text[own.end() :]}" if own else f"with input as (select * from {name}) {text}")


def first_rows(rows: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """The first row of each key; rows without a key all stay. ``order`` defaults to the rows' place in the file."""
    taken = {c.lower() for c in rows.columns}
    seq, rank = (next(n for k in range(len(taken) + 1) if (n := f"_{word}{k or ''}") not in taken) for word in ("seq", "rank"))
    keyed = rows.withColumn(seq, F.monotonically_increasing_id()) if order is None else rows
    w = Window.partitionBy(key).orderBy(*(order or [seq]))
    # rows without a key never conflict: they skip the window, so they cannot make one huge group
    ranked = keyed.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)
    return ranked.unionByName(keyed.where(F.col(key).isNull())).select(*rows.columns)


class Engine:
    """Runs pipelines in the background and keeps their status."""

    def __init__(self, spark: SparkSession, warehouse: str) -> None:
        self.spark, self.warehouse = spark, warehouse.rstrip("/")
        self.jobs: dict[str, JobStatus] = {}
        self.cancelled: set[str] = set()
        self.locks: dict[str, threading.Lock] = {}

    def table(self, name: str) -> DataFrame | None:
        path = f"{self.warehouse}/{check_identifier(name)}"
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        return self.spark.read.parquet(path) if where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where) else None

    def run(self, spec: PipelineSpec, on_event: Callable[[JobStatus], None] = lambda _: None, job: str | None = None) -> JobStatus:
        """In this thread, to the end."""
        spec.validate()
        status = self.jobs.setdefault(job or uuid.uuid4().hex, JobStatus(job or ""))
        status.id = status.id or next(k for k, v in self.jobs.items() if v is status)
        status.spec, status.state, status.started_at = asdict(spec), "running", time.time()
        on_event(status)
        sc = self.spark.sparkContext
        sc.setJobGroup(status.id, f"pipeline {spec.destination_table}", interruptOnCancel=True)
        timer = threading.Timer(TIMEOUT, lambda: sc.cancelJobGroup(status.id))
        timer.start()
        try:
            with self.locks.setdefault(spec.destination_table, threading.Lock()):
                self._load(spec, status)
            status.state = "completed"
        except Exception as x:
            status.state = "cancelled" if status.id in self.cancelled else "failed"
            status.error = str(x).splitlines()[0] if str(x) else type(x).__name__
        finally:
            timer.cancel()
            status.finished_at = time.time()
            on_event(status)
        return status

    def _load(self, spec: PipelineSpec, status: JobStatus) -> None:
        source = read_file(self.spark, spec.format, spec.path, spec.header, spec.delimiter)
        rows = transform(self.spark, source, spec.sql_transform)
        for c in rows.columns:
            check_identifier(c)
        rows = rows.persist()
        try:
            status.rows_read = rows.count()  # after the transform
            if status.id in self.cancelled:
                raise GraphError("cancelled")
            fresh, there = rows, self.table(spec.destination_table)
            if spec.dedupe_column:
                fresh = first_rows(rows, spec.dedupe_column)
                if there is not None:
                    fresh = fresh.join(there.select(spec.dedupe_column).where(F.col(spec.dedupe_column).isNotNull()), spec.dedupe_column, "left_anti").select(*rows.columns)
            path = f"{self.warehouse}/{spec.destination_table}"
            before = there.count() if there is not None else 0
            fresh.write.mode("append").parquet(path)
            status.rows_written = self.spark.read.parquet(path).count() - before
        finally:
            rows.unpersist()

    def start(self, spec: PipelineSpec, on_event: Callable[[JobStatus], None] = lambda _: None) -> str:
        from pyspark import InheritableThread

        spec.validate()
        job = uuid.uuid4().hex
        self.jobs[job] = JobStatus(job)
        InheritableThread(target=self.run, args=(spec, on_event, job), daemon=True).start()
        return job

    def status(self, job: str) -> JobStatus:
        return self.jobs[job]

    def list(self, limit: int = 50) -> list[JobStatus]:
        """Newest first."""
        return sorted(self.jobs.values(), key=lambda s: -(s.started_at or time.time()))[: limit or 50]

    def cancel(self, job: str) -> bool:
        if job not in self.jobs or self.jobs[job].state not in ("pending", "running"):
            return False
        self.cancelled.add(job)
        self.spark.sparkContext.cancelJobGroup(job)
        return True
