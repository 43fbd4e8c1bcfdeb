"""Exact top-k inner products by no-random-access aggregation.

Vectors are packed into blocks of bounded size. A cell holds some blocks of candidates, each sorted into lists once; the blocks
of queries are dealt to every cell, and nothing is broadcast. In a block of candidates each component has a list sorted by
value, read from the top for a positive query component and from the bottom for a negative one, all lists in step.

What has been read bounds every candidate's score. The components that are not read yet give at most what stands at the front of
their lists, and no more than the product of what is left of the two vectors' lengths; at least their lists' last
entries, and the negative of that product. Reading stops as soon as the candidates that can still reach the k-th lower bound are
fewer than half of a list's unread entries; the scores of those are then resolved. The k-th score so far is carried to the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ship

CANDIDATES = 2048  # in a block
GROUP = 32768  # candidates in a cell at most, about
QUERIES = 256  # in a block
STEPS = 8  # of reading a block's lists
EXACT = 1 << 62

_BLOCK = "width int, kind int, ids binary, data binary"


def _packer(scale: int, rows_in_block: int, kind: int):
    """Rows (id, v) to blocks of integer vectors of equal width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def emit(width: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(width), strict=True)
            columns = [[width], [kind], [np.array(ids, np.int64).tobytes()], [np.array(vectors, np.int64).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["width", "kind", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v"), strict=True):
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.abs(x).max(initial=0) >= EXACT:
                    raise OverflowError(f"a component of vector {i} does not fit a long")
                own = held.setdefault(len(x), [])
                own.append((i, x.astype(np.int64)))
                if len(own) >= rows_in_block:
                    yield emit(len(x))
        for width in list(held):
            yield emit(width)

    return run


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products; those that do not fit a long are an error."""
    if not x.size or int(np.abs(x).max()) * int(np.abs(q).max(initial=0)) * len(q) < EXACT:
        return x @ q
    out = x.astype(object) @ q.astype(object)
    if any(abs(s) >= 1 << 63 for s in out):
        raise OverflowError("a score does not fit a long")
    return out.astype(np.int64)


class Lists:
    """The sorted lists of one block of candidates; a block of queries reads them in step."""

    def __init__(self, ids: np.ndarray, data: np.ndarray) -> None:
        self.ids, self.x = ids, data
        self.columns = data.astype(np.float64).T
        order = np.argsort(-self.columns, axis=1, kind="stable")  # width x n: candidates, best first
        self.values = np.take_along_axis(self.columns, order, axis=1)
        self.place = np.empty_like(order)  # where each candidate stands in each list
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(len(ids)), order.shape), axis=1)
        self.read = self.resolved = self.held = 0  # entries of the lists, candidates whose score was resolved, candidates

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and scores of the block's k best with a score of its floor or more, ties to smaller ids."""
        n, out = len(self.ids), [None] * len(queries)
        q = queries.astype(np.float64)
        both = np.concatenate((np.maximum(q, 0), np.minimum(q, 0)), axis=1)  # lists read from the top, from the bottom
        ends = np.concatenate((self.values[:, -1], self.values[:, 0]))
        slack = 1e-9 * (np.abs(both) @ np.abs(np.concatenate((self.values[:, 0], self.values[:, -1]))) + np.abs(both) @ np.abs(ends)) + 1e-6
        square = self.columns**2
        active = np.arange(len(queries))
        for step in range(1, STEPS + 1):
            depth = -(-step * n // STEPS)
            read = np.concatenate((self.place < depth, self.place >= n - depth))
            unread = (~read).astype(np.float64)
            front = np.concatenate((self.values[:, depth - 1], self.values[:, n - depth]))
            own = both[active]
            got = own @ np.where(read, np.concatenate((self.columns, self.columns)), 0.0)
            left, highest, lowest = np.split(np.concatenate((own**2, own * front, own * ends)) @ unread, 3)
            length = np.sqrt(np.maximum(left, 0) * np.maximum((own != 0) @ (np.concatenate((square, square)) * unread), 0))
            same = query_ids[active, None] == self.ids
            low = np.where(same, -np.inf, got + np.maximum(lowest, -length))
            bar = np.maximum(floors[active], np.partition(low, n - k, axis=1)[:, n - k]) if n > k else floors[active]
            among = (got + np.minimum(highest, length) >= (bar - slack[active])[:, None]) & ~same
            done = (2 * among.sum(axis=1) <= n - depth) | (depth == n)
            for i, mask in zip(active[done].tolist(), among[done], strict=True):
                out[i] = self._resolve(queries[i], np.flatnonzero(mask), k, floors[i])
            self.read += int(done.sum()) * depth * len(self.values)
            active = active[~done]
            if not len(active):
                break
        self.held += n * len(queries)
        return out

    def _resolve(self, q: np.ndarray, among: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        self.resolved += len(among)
        scores = _scores(self.x[among], q)
        reach = scores >= floor
        among, scores = among[reach], scores[reach]
        top = np.lexsort((self.ids[among], -scores))[:k]
        return self.ids[among[top]], scores[top]


def _meet(k: int):
    """Blocks sorted by (width, cell, kind): the candidate blocks of a cell, then the query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists = None, []
        for b in batches:
            for row in b.to_pylist():
                if (row["width"], row["cell"]) != at:
                    at, lists = (row["width"], row["cell"]), []
                ids = np.frombuffer(row["ids"], np.int64)
                data = np.frombuffer(row["data"], np.int64).reshape(len(ids), row["width"])
                if row["kind"] == 0:
                    lists.append(Lists(ids, data))
                    continue
                best: list[list[tuple[int, int]]] = [[] for _ in ids]
                for own in lists:
                    floors = np.array([-found[k - 1][0] if len(found) >= k else -np.inf for found in best])
                    for n, more in enumerate(own.best(ids, data, k, floors)):
                        best[n] = sorted(best[n] + [(-s, v) for v, s in zip(*(x.tolist() for x in more), strict=True)])[:k]
                names = [xxhash.xxh64_intdigest(q.tobytes()) - (1 << 63) for q in data]
                out = [(i, name, v, -s) for i, name, found in zip(ids.tolist(), names, best, strict=True) for s, v in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "query", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``is_query`` holds, the k best others, all if fewer.

    Components become floor(scale * x); scores are exact longs, and a component or score that does not fit one is an error. Ties
    go to the smaller id. Null vectors, vectors with null, NaN or infinite components and rows without an id take no part;
    vectors of different width do not meet. Every row of another id counts, repeated ones too; a query that repeats an id and
    vector is asked once, and each different vector of an id has a list of its own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
    wanted = rows.where(is_query).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct()
    n_queries, n_rows = wanted.count(), rows.count()
    spread = 4 * spark.sparkContext.defaultParallelism
    n_cells = max(1, -(-n_rows // max(CANDIDATES, min(GROUP, -(-n_rows // spread)))))
    asked = wanted.repartition(max(1, -(-n_queries // QUERIES))).mapInArrow(_packer(scale, QUERIES, 1), _BLOCK)
    plain = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    held = plain.repartition(n_cells).mapInArrow(_packer(scale, CANDIDATES, 0), _BLOCK)
    numbered = held.withColumn("cell", F.spark_partition_id().cast("long"))
    # the stated queries against all rows, in blocks: the query blocks, a hundredth of the rows, go to every cell
    dealt = asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cells - 1).cast("long"))))
    both = numbered.unionByName(dealt).repartition(n_cells, "width", "cell").sortWithinPartitions("width", "cell", "kind")
    local = both.mapInArrow(_meet(k), "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nra_topk(vectors: DataFrame) -> DataFrame:
    """The contract's columns: queries are the rows whose vec_id is divisible by 100."""
    return exact_topk(vectors, F.col("vec_id") % 100 == 0)


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score, q.e as q
  from (select distinct * from v where vec_id % 100 = 0) q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (
  select *, cast(row_number() over (partition by query_id, q order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
