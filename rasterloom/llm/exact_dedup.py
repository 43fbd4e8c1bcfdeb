"""Exact dedup by content sort.

Sampled splitters range-partition the rows by (first bytes of the text, 64-bit hash of it, id): the order is by content as far as
the first ``PREFIX`` bytes go, then by hash. An external sort inside each partition, by these and then by the whole text, puts
equal texts next to each other, and each row is compared in full with its neighbour.
Splitters hold ``PREFIX`` bytes and two integers, not whole texts, so sampling stays small however long texts are; the
hash parts texts that share their beginning, and the id parts one text that holds a third of all rows.

A run of equal texts may thus cross partition borders. Only runs under a partition's first or last (bytes, hash)
key can; a partition hands on each such run once, with its text, and those rows, a few per partition, are matched by
full text and joined back. Nothing grows with the size of a group but the integers of its ids within a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, release, ship, spare

PREFIX = 16
SMALL = 1 << 20  # runs at partition borders that are broadcast at most

_RUNS = "id long, pid int, run long, keep_id long, group_size long, leads boolean, edge boolean, edge_text string, text_sha256 string"
_NAMES = [x.split()[0] for x in _RUNS.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring full comparisons over one sorted partition; a row's run is told once its key is over."""
    release()
    context = TaskContext.get()
    pid, run = context.partitionId() if context else 0, -1
    key, text, first_key = None, None, True
    ids: list = []
    held: list[tuple[int, str, str, list]] = []  # the runs under the current key
    out: list[tuple] = []

    def close(edge: bool) -> None:
        for number, own, digest, members in held:
            for k, i in enumerate(members):
                out.append((i, pid, number, members[0], len(members), k == 0, edge, own if edge and k == 0 else None, digest))
        held.clear()

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
        out.clear()
        return made

    for b in batches:
        for i, t, p, h in zip(*(b.column(n).to_pylist() for n in ("id", "text", "prefix", "hash")), strict=True):
            if (p, h) != key:
                if key is not None:
                    close(first_key)
                    first_key = False
                key, text = (p, h), None
            if t != text:  # the full comparison with the row before
                run += 1
                ids = []
                text = t
                held.append((run, t, hashlib.sha256(t.encode()).hexdigest(), ids))
            ids.append(i)
            if len(out) >= 8192:
                yield batch()
    close(True)
    if out:
        yield batch()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the ``smallest`` or ``largest`` id of equal texts stays. Null texts count as empty. Null
    ids come last; of rows that repeat an id exactly one is kept; a group of null ids only has a null keep_id. An
    empty table gives no rows; other columns are not read. Ids must be integers.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("prefix", F.substring(F.col("text").cast("binary"), 1, PREFIX)).withColumn("hash", F.xxhash64("text"))
    by_id = F.desc_nulls_last("id") if keep == "largest" else F.asc_nulls_last("id")
    runs = cut(rows.repartitionByRange("prefix", "hash", by_id).sortWithinPartitions("prefix", "hash", "text", by_id).mapInArrow(_scan, _RUNS))
    edges = runs.where("edge and leads").select("pid", "run", "edge_text", "keep_id", "group_size")
    best = F.max if keep == "largest" else F.min
    whole = edges.groupBy("edge_text").agg(best("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"), F.min(F.struct("pid", "run")).alias("lead"))
    # two keys a partition (more only where 64-bit hashes collide), and no texts; counted before it is broadcast
    told = edges.join(whole, "edge_text").select("pid", "run", "all_keep", "all_size", (F.struct("pid", "run") == F.col("lead")).alias("leading"))
    told = F.broadcast(told) if edges.count() <= SMALL else told
    return runs.join(told, ["pid", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("edge"), F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("edge"), F.col("all_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("leads") & F.coalesce(F.col("leading"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns as they were; of rows that repeat an id and a
    text one stays. Null texts count as empty; an empty table stays empty; other columns may have any name.
    """
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept")
    own, stays = spare(docs.columns, "key", "kept")
    kept = kept.select(F.struct(F.col(id_col).cast("long").alias("id"), F.col("text_sha256").alias("sha")).alias(stays))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    held = docs.withColumn(own, F.struct(F.col(id_col).cast("long").alias("id"), sha.alias("sha")))  # struct equality takes null as a value
    return held.join(kept, F.col(own) == F.col(stays), "left_semi").dropDuplicates([own]).drop(own)


def op2_content_sort(docs: DataFrame) -> DataFrame:
    """The contract's columns: texts equal as they are, the largest doc_id stays."""
    return exact_dedup(docs, keep="largest")


OP2_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
