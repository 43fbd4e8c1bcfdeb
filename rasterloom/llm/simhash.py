"""SimHash near-dedup with bit-sliced comparison.

Each document gets a 64-bit fingerprint of its word shingles. Fingerprints at most ``radius`` bits apart agree exactly on
all but ``radius`` of ``radius + 2`` blocks of bits, so distinct fingerprints meet in the buckets of every pair of
blocks: no pair is lost, and equal fingerprints are one node from the start. A bucket over ``CELL`` rows is split into
parts, and each two parts meet in a task of their own, so a hot bucket spreads out and still loses no pair.

Inside a bucket the members' bits are stored vertically, 64 members to a word. A member is compared with 64 others at once:
the bit planes' differences run through carry-save counters, and words of which all lanes exceed the radius are dropped as
soon as they do. Each bucket hands on a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, release, ship
from .components import connected_components

CELL = 2048
SHINGLES = 1 << 15  # hashed at a time
TASKS = 1 << 16  # words compared at a time, an eighth of them where fingerprints are wide
ROWS = 1 << 17  # bucket rows held at a time, if the buckets are small
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint; ASCII letters are lower-cased, words stand between ASCII white space."""
    own = text.encode().lower().split() if text else []
    if not own:
        return 0
    size = min(words, len(own))
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(own) - size + 1], ends[size - 1 :]
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES):
        hashed = np.array([h(joined[s:e], seed) for s, e in zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            made = np.array([fingerprint(t.as_py(), words, seed) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, schema)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest index of each set, flat) after joining the sets of a[i] and b[i]."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label = flat


def linked(fps: np.ndarray, buckets: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its set: rows of a bucket link at ``radius`` or fewer differing bits."""
    label = np.arange(len(fps))
    for a, b in matches(fps, buckets, radius):
        label = _unite(label, a, b)
    return label


def matches(fps: np.ndarray, buckets: np.ndarray, radius: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a before b) of a bucket at ``radius`` or fewer differing bits, in blocks; ``buckets`` is sorted.

    ``fps`` has one word of 64 bits for each row, or a row of words. Pairs of one ``label`` need not be found: words that hold
    nothing but a row's own label are passed over, so rows are best sorted by label inside a bucket.
    """
    fps = fps.reshape(len(fps), -1).T
    bits, rows = 64 * len(fps), fps.shape[1]
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    size = np.diff(np.append(first, rows))
    rank = np.arange(rows) - np.repeat(first, size)
    words = -(-size // 64)
    base = np.cumsum(words) - words
    row_word = np.repeat(base, size) + rank // 64
    lane = (rank % 64).astype(np.uint64)
    word_first = np.flatnonzero(np.concatenate(([True], row_word[1:] != row_word[:-1])))
    word_size = np.diff(np.append(word_first, rows))
    valid = np.where(word_size == 64, ALL, (np.uint64(1) << word_size.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    # a task compares one row with a word of its bucket that holds later rows
    tasks = np.repeat(base + words, size) - row_word
    tasks[np.repeat(size, size) < 2] = 0
    ends = np.cumsum(tasks)
    planes = [np.bitwise_or.reduceat(((fps[p // 64] >> np.uint64(p % 64)) & np.uint64(1)) << lane, word_first) for p in range(bits)] if ends[-1] else []
    if label is not None:
        least, most = np.minimum.reduceat(label, word_first), np.maximum.reduceat(label, word_first)
    order = [k % 4 * (bits // 4) + k // 4 for k in range(bits)]  # the blocks in turn: some of them may be equal in any bucket
    step = 1 if bits == 64 else 8
    at = 0
    while at < rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TASKS // step, side="right")))
        n = tasks[at:upto]
        row = np.repeat(np.arange(at, upto), n)
        at = upto
        if not len(row):
            continue
        word = row_word[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        if label is not None:
            apart = (least[word] != most[word]) | (least[word] != label[row])
            row, word = row[apart], word[apart]
        own = word == row_word[row]
        counters = [np.zeros(len(row), np.uint64) for _ in range(max((radius + 1).bit_length(), step.bit_length() - 1))]
        over = ~valid[word]
        over[own] |= ALL >> (np.uint64(63) - lane[row[own]])  # itself and the rows before it
        for k in range(0, bits, step):
            carry = [planes[p][word] ^ (np.uint64(0) - ((fps[p // 64][row] >> np.uint64(p % 64)) & np.uint64(1))) for p in order[k : k + step]]
            first = 0
            while len(carry) > 1:  # eight bits at once: full adders of a counter and two bits hand on half as many
                carry = [_add(counters, first, *carry[n : n + 2]) for n in range(0, len(carry), 2)]
                first += 1
            (carry,) = carry
            for c in range(first, len(counters)):  # carry-save: add one bit to 64 counters at once
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over = over | carry
            if (bits == 64 and k % 4 == 3) or (step > 1 and k > radius and k % 32 == 24):
                out = over | _beyond(counters, radius)
                keep = out != ALL
                if not keep.all():  # abandon the words of which every lane exceeds the radius
                    row, word, over, counters = row[keep], word[keep], over[keep], [c[keep] for c in counters]
                if not len(row):
                    break
        hits = ~(over | _beyond(counters, radius))
        while len(row):
            some = hits != 0
            row, word, hits = row[some], word[some], hits[some]
            low = hits & (np.uint64(0) - hits)
            if len(row):
                yield row, word_first[word] + np.log2(low.astype(np.float64)).astype(np.int64)
            hits = hits ^ low


def _add(counters: list[np.ndarray], at: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Add two bits to 64 counters' plane ``at`` at once; what is carried to the next plane."""
    both = one ^ two
    carry = (one & two) | (both & counters[at])
    counters[at] = counters[at] ^ both
    return carry


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, lowest plane first, is over the radius. A counter that overflowed is marked where that happens."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            more, same = more | (same & counters[k]), same & ~counters[k]
    return more


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            fps = rows.column("fp").to_numpy().view(np.uint64)
            cells = np.stack([rows.column(c).to_numpy() for c in ("key", "low", "high")])
            number = np.concatenate(([0], np.cumsum((cells[:, 1:] != cells[:, :-1]).any(axis=0))))
            label = linked(fps, number, radius)
            child = np.flatnonzero(label != np.arange(len(fps)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(fps[child].view(np.int64)), pa.array(fps[label[child]].view(np.int64))], ["u", "v"])

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                rows = pa.Table.from_batches(held)
                last = [rows.column(c)[-1].as_py() for c in ("key", "low", "high")]
                same = np.all([rows.column(c).to_numpy() == x for c, x in zip(("key", "low", "high"), last, strict=True)], axis=0)
                begin = n - int(same.sum())  # the last cell may go on
                if begin:
                    yield from links(rows.slice(0, begin))
                    held, n = rows.slice(begin).to_batches(), n - begin
        if n:
            yield from links(pa.Table.from_batches(held))

    return run


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): a spanning forest, bucket by bucket, of all pairs of distinct ``fp`` at ``radius`` or fewer differing bits."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    bits = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in range(4)]
    keys = [F.lit(n << 32).cast("long") + bits[a] * F.lit(1 << 16).cast("long") + bits[b] for n, (a, b) in enumerate(combinations(range(4), 2))]
    rows = fps.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / CELL).cast("long").alias("parts"))
    # few keys are hot or none; adaptive execution broadcasts them if their measured size allows it, else sorts and merges
    parts = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    cells = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_link(radius), "u long, v long")


def near_components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id reachable over links, the row's own included.

    A null or empty text, or one of white space, has fingerprint zero and links like any other; a text of fewer words than a
    shingle is one shingle. Null ids are in a component but never name it, so a component of null ids only has a null
    name. Repeated rows give a row each; an empty table none.
    """
    own = cut(fingerprints(docs, words, seed, id_col, text_col))
    nodes = own.groupBy("fp").agg(F.min("id").alias("least"))
    found = cut(connected_components(near_links(own, radius)))
    # written, so that the join of one very large component can be split
    named = cut(found.join(nodes.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("name")))
    names = found.join(named, "root").select(F.col("node").alias("fp"), "name")
    told = cut(nodes.join(names, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")))
    return own.join(told, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: 3-word shingles, XXH64 with seed 42, links at 2 or fewer bits."""
    return near_components(docs)
