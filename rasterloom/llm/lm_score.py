"""LM scoring: stupid-backoff scores from n-gram count tables that are partitioned by hash.

Documents are taken in chunks of bounded text. A chunk's n-grams are exploded, hashed to 64 bits and counted, so that
frequent ones are one entry of a chunk (pre-aggregation), and dealt to partitions by hash range. Each partition adds
up its part of the count table and joins it back to the entries: it answers every chunk with the corpus counts of the
n-grams that the chunk asked for, in the order asked. The chunk then scores each n-gram of each document and sums by
document. Only packed arrays are shuffled, about 8 bytes for a different n-gram of a chunk, and nothing is broadcast but
one number, the corpus's length. Plain rows of (n-gram, document) would be the same join, but write more to disk than
twice the input for the counts alone. The numbers of parts and of chunk partitions follow the texts' bytes, so what a task
holds does not grow with the input.

A document must not vouch for itself: its own occurrences are taken off every count. The score of a word is
c(context, word) / c(context) at the highest order where the n-gram occurs elsewhere, times ``backoff`` for each order given
up; a word that occurs nowhere else counts once beyond the corpus. The document's score is the mean of the natural logs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, ship, slices

BYTES = 8 << 20  # text in a chunk
PART = 16 << 20  # text for each part of the count table: a part holds about as many bytes of hashes
ORDER = 2
BACKOFF = 0.4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, document of each); ASCII letters are lower-cased, words stand between ASCII white space."""
    h, made, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        own = t.encode().lower().split() if t else ()
        made.append(np.fromiter(map(h, own), np.uint64, len(own)))
        sizes.append(len(own))
    return np.concatenate(made) if made else np.zeros(0, np.uint64), np.repeat(np.arange(len(texts)), sizes)


def _grams(words: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the last word) of every n-gram of ``order`` words inside a document."""
    hashed, at = words, np.arange(len(words))
    for k in range(1, order):
        mixed = (hashed[:-1] ^ (hashed[:-1] >> np.uint64(29))) * _MIX + words[k:]
        hashed = (mixed ^ (mixed >> np.uint64(32))) * _MIX2
    at = at[order - 1 :]
    whole = owner[at] == owner[: len(at)]
    return hashed[whole], at[whole]


def _borders(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)


def _planes(hashes: np.ndarray) -> bytes:
    """Sorted hashes with their bytes apart, so that the shuffle's compression finds the high ones alike."""
    return hashes.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk number, rows): the same for every run over the same partition, whose number is in ``pid``."""
    number = 0
    for b in batches:
        for part in slices(b, "text", limit):
            yield part.column("pid")[0].as_py() << 32 | number, part
            number += 1


def _explode(order: int, parts: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _chunks(batches, limit):
            words, owner = _words(b.column("text").to_pylist())
            for n in range(1, order + 1):
                hashes, counts = np.unique(_grams(words, owner, n)[0], return_counts=True)
                ends = [0, *np.searchsorted(hashes, _borders(parts)).tolist(), len(hashes)]
                keep = [(p, i, j) for p, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i]
                if keep:
                    counts = counts.astype("<u4")
                    columns = [[p for p, _, _ in keep], [chunk] * len(keep), [n] * len(keep), [_planes(hashes[i:j]) for _, i, j in keep], [counts[i:j].tobytes() for _, i, j in keep]]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "chunk", "n", "hashes", "counts"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, n): add up the counts of each hash and answer each row."""
    at, held = None, []

    def answer() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        hashes = [_unplanes(r["hashes"]) for r in held]
        counts = [np.frombuffer(r["counts"], "<u4") for r in held]
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)[place]
        ends = np.cumsum([len(h) for h in hashes])
        answers = np.split(total.astype("<i8" if total.max() > 0xFFFFFFFF else "<u4"), ends[:-1])
        columns = [[r["chunk"] for r in held], [at[1]] * len(held), [at[0]] * len(held), [int(c.sum()) for c in counts], [a.itemsize for a in answers], [a.tobytes() for a in answers]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "n", "part", "words", "width", "totals"])

    for b in batches:
        for r in b.to_pylist():
            if (r["part"], r["n"]) != at:
                yield from answer()
                at, held = (r["part"], r["n"]), []
            held.append(r)
    yield from answer()


def _payload(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _chunks(batches, limit):
            ids, texts = (pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("id", "text"))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), ids, texts], ["chunk", "ids", "texts"])

    return run


def _own(place: np.ndarray, owner: np.ndarray, different: int) -> np.ndarray:
    """For each n-gram, how often its document has it."""
    _, at, n = np.unique(owner * different + place, return_inverse=True, return_counts=True)
    return n[at]


def score_chunk(texts: list[str | None], totals: dict[int, np.ndarray], corpus: int, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: words, words whose highest-order n-gram occurs elsewhere, mean log score (NaN without words)."""
    words, owner = _words(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    rest = np.maximum(corpus - n_words, 0)[owner]  # the corpus without the document
    value, found = np.zeros(len(words)), np.zeros(len(words), bool)
    elsewhere = []  # by order: occurrences outside the document of the n-gram ending at each word, 0 where there is none
    for n in range(1, order + 1):
        hashes, at = _grams(words, owner, n)
        different, place = np.unique(hashes, return_inverse=True)
        if len(different) != len(totals.get(n, ())):
            raise RuntimeError("the chunks of two runs over the documents differ; read them from files")
        count = np.zeros(len(words), np.int64)
        if len(at):
            count[at] = totals[n][place] - _own(place, owner[at], len(different))
        elsewhere.append(count)
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(words) else np.zeros(0, bool)
    since = np.arange(len(words)) - np.maximum.accumulate(np.where(first, np.arange(len(words)), 0)) if len(words) else np.zeros(0, np.int64)
    given_up = np.zeros(len(words), np.int64)
    top = np.zeros(len(words), bool)
    for n in range(order, 0, -1):
        can = ~found & (since >= n - 1)
        here = can & (elsewhere[n - 1] > 0)
        below = rest if n == 1 else np.concatenate(([1], elsewhere[n - 2][:-1]))  # the context's occurrences elsewhere
        value[here] = np.log(elsewhere[n - 1][here] / below[here]) + given_up[here] * np.log(backoff)
        top |= here & (np.minimum(since, order - 1) == n - 1)
        found |= here
        given_up[can & ~here] += 1
    value[~found] = given_up[~found] * np.log(backoff) - np.log(rest[~found] + 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return n_words, np.bincount(owner[top], minlength=len(texts)), np.bincount(owner, value, len(texts)) / n_words


def _score(corpus: int, order: int, backoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for b in batches:
            kind_of_id = b.schema.field("ids").type.value_type
            chunks = b.column("chunk").to_pylist()
            for k, (chunk, texts, n, width, data) in enumerate(zip(chunks, *(b.column(c) for c in ("texts", "n", "width", "totals")), strict=True)):
                if chunk != at:
                    at, held = chunk, {}
                if not texts.is_valid:  # the answers come first, in the order of their parts
                    held.setdefault(n.as_py(), []).append(np.frombuffer(data.as_py(), "<u4" if width.as_py() == 4 else "<i8").astype(np.int64))
                    continue
                totals = {n: np.concatenate(x) for n, x in held.items()}
                words, seen, mean = score_chunk(texts.as_py(), totals, corpus, order, backoff)
                ids = b.column("ids")[k].values
                yield pa.RecordBatch.from_arrays([ids.cast(kind_of_id), pa.array(words, pa.int64()), pa.array(seen, pa.int64()), pa.array(mean, pa.float64(), from_pandas=True)], ["id", "n_words", "n_seen", "score"])

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = BYTES) -> DataFrame:
    """id, n_words, n_seen, score: one row per input row.

    n_seen counts words whose longest n-gram (of ``order`` words, fewer at the start) occurs in another row. A null text, or
    one without words, has no words and a null score. Repeated rows count as documents of their own, so they vouch for each
    other. An empty table gives no rows; other columns are not read. ``docs`` must be a scan or another plan that
    gives the same partitions when it runs again (it runs twice); a difference is found and raised.
    """
    if order < 1 or not 0 < backoff <= 1:
        raise ValueError("order must be positive, backoff in (0, 1]")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("pid"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts or -(-n_bytes // PART) or 1
    exploded = rows.mapInArrow(_explode(order, parts, chunk_bytes), "part int, chunk long, n int, hashes binary, counts binary")
    counted = exploded.repartitionById(parts, "part").sortWithinPartitions("part", "n")
    totals = cut(counted.mapInArrow(_count, "chunk long, n int, part int, words long, width int, totals binary"))
    corpus = totals.where("n = 1").agg(F.sum("words")).first()[0] or 0
    kind = rows.schema["id"].dataType
    payload = rows.mapInArrow(_payload(chunk_bytes), T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("texts", T.ArrayType(T.StringType()))]))
    both = totals.drop("words").unionByName(payload, allowMissingColumns=True)
    dealt = both.repartition(max(1, -(-2 * n_bytes // chunk_bytes)), "chunk").sortWithinPartitions("chunk", F.col("texts").isNotNull(), "n", "part")
    out = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_seen", T.LongType()), T.StructField("score", T.DoubleType())])
    return dealt.mapInArrow(_score(int(corpus), order, backoff), out).withColumnRenamed("id", id_col)


def op9_stupid_backoff(docs: DataFrame) -> DataFrame:
    """Every document scored against all others: bigrams, backoff 0.4; scores to 6 decimals."""
    return backoff_scores(docs).withColumn("score", F.round("score", 6))


OP9_SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') as w
  from documents
), p as (
  select doc_id, unnest(w) as b, unnest(range(len(w))) as i, unnest(list_concat([null], w[:-2])) as a from d where len(w) > 0
), n as (select count(*) as n from p
), d1 as (select doc_id, b, count(*) as c from p group by all
), c1 as (select b, sum(c) as c from d1 group by all
), d2 as (select doc_id, a, b, count(*) as c from p where i > 0 group by all
), c2 as (select a, b, sum(c) as c from d2 group by all
), len as (select doc_id, len(w) as n_words from d
), s as (
  select p.doc_id, p.i, len.n_words, n.n - len.n_words as rest,
         c1.c - d1.c as uni, case when p.i > 0 then c2.c - d2.c else 0 end as bi, c1a.c - d1a.c as ctx
  from p join len using (doc_id) cross join n
  join c1 on c1.b = p.b join d1 on d1.doc_id = p.doc_id and d1.b = p.b
  left join c1 c1a on c1a.b = p.a left join d1 d1a on d1a.doc_id = p.doc_id and d1a.b = p.a
  left join c2 on c2.a = p.a and c2.b = p.b left join d2 on d2.doc_id = p.doc_id and d2.a = p.a and d2.b = p.b
), t as (
  select doc_id, sum(case when bi > 0 or i = 0 and uni > 0 then 1 else 0 end) as n_seen,
         avg(case when bi > 0 then ln(bi / ctx)
                  when uni > 0 then ln(uni / rest) + case when i > 0 then ln(0.4) else 0 end
                  else ln(0.4) * case when i > 0 then 2 else 1 end - ln(rest + 1.0) end) as score
  from s group by doc_id
)
select len.doc_id, cast(n_words as bigint) as n_words, cast(coalesce(n_seen, 0) as bigint) as n_seen, round(score, 6) as score
from len left join t using (doc_id)
"""
