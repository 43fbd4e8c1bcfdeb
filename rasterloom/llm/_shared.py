"""What the operators share: table access, shipping the package to executors, and cutting lineage."""

from __future__ import annotations

import io
import itertools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that they import it wherever they run.

    Arrow batches of the session are held to 8 MB, unless it sets a bound of its own: rows here are whole texts.
    """
    if spark.conf.get(BATCH, None) in (None, "67108864b"):  # Spark's default
        spark.conf.set(BATCH, "8m")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    place = os.path.join(tempfile.mkdtemp(), "rasterloom.zip")
    with open(place, "wb") as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(place)  # the driver's file server hands it to every executor
    _SHIPPED.add(app)


def spare(columns: list[str], *wanted: str) -> list[str]:
    """Names like those ``wanted`` that none of ``columns`` has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        own = next(n for k in itertools.count() if (n := f"_{name}{k or ''}").lower() not in taken)
        taken.add(own.lower())
        out.append(own)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a local master gets a temporary folder; on a cluster that would be a folder of one machine, so it is an error.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        held = _LOCAL[app] = _LOCAL.get(app) or tempfile.mkdtemp(prefix="rasterloom-")
    return held


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the file.

    A lost executor then costs a file read, and two consumers of a nondeterministic plan see the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._cut_path = path  # type: ignore[attr-defined]
    return held


def discard(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote and that no plan reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


_RESIDENT: dict = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """A large object that this Python worker keeps for its next task; only one, so that operators in turn do not add up."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def release() -> None:
    """Let go of what an earlier operator kept in this Python worker."""
    _RESIDENT.clear()
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose ``column`` holds about ``limit`` bytes each (a longer single row is a part alone)."""
    start = held = 0
    lengths = batch.column(column)
    lengths = pa.compute.binary_length(lengths).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)
