"""SimHash near-dedup at a similarity of whole shingle sets: fingerprint buckets, bit-sliced comparison, then an exact check.

A bit of a fingerprint is 1 if set in over half of the hashes of a document's different shingles; on a tie the smallest hash
decides, so no value is likelier. Two sets at a Jaccard similarity of 0.8 agree in a bit with probability ``AGREE`` or more (0.80 in
sets of under 25 shingles). Agreement on most of 64 bits would share no bucket that is short of the whole corpus, so a
document has ``tables`` keys of ``bits`` fingerprint bits each, all different bits: the bits follow from the number of documents (a
bucket holds about ``BUCKET``), and the tables from the bits, so that a pair at 0.8 shares no bucket with a probability
of ``MISS`` (in sets of under 25 shingles less than 1e-7, up to 8 bits).

1. In each bucket ``WIDE`` more words of the fingerprints are compared bit-sliced. Documents within ``RADIUS`` (a pair at 0.8 is beyond
   it with less than 2e-9) are joined, and each names the middle of what it was joined with, and the smallest node of it. A bucket
   of more than ``PART`` cells is split in parts, each two of which meet. What is connected over all buckets is a block. A large group
   has another smallest node in each bucket, but the smallest over all buckets is the same for nearly all of it: to that one a node
   is linked, and so are the others that it named. These are about as many links as nodes, not as nodes times tables.
2. Each document of a block is checked against the middle that it named most often. Most groups of copies are one component then.
3. Blocks whose documents are still apart are compared in full: again bit-sliced, and pairs of different components that pass
   are checked. Of a block of more than ``CELL`` documents, the largest component is not compared with itself.

Steps 2 and 3 are decided by the whole shingle sets, no partner is capped, and only spanning forests of the links are handed on.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, discard, release, ship, spare
from .components import connected_components
from .simhash import _unite, matches

CELL = 2048  # documents of a block or part that are compared in one task
SALT = 2048  # documents that are checked against a centre in one task
BUCKET = 1024  # documents that share a key on average, about
PART = 4  # cells of documents whose fingerprints are compared in one task
ROWS = 1 << 16  # bucket rows held at a time, if the buckets are small
AGREE, MISS = 0.83, 1e-9
WIDE = 4  # words of a fingerprint that are compared
RADIUS = 88  # of 256 bits
STARS = 4  # rounds that join a bucket's rows to one of them before all are compared
_FPS = [f"fp{k}" for k in range(WIDE)]
SMALL = 2_000_000  # ids that are broadcast at most (16 bytes each); beyond, the join is shuffled

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2, _MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


@functools.cache
def _seeds(words: int) -> np.ndarray:
    """One seed for each word of a fingerprint, the same in every process."""
    return _spread(np.arange(1, words + 1, dtype=np.uint64) * _MIX)


def layout(count: int) -> tuple[int, int]:
    """(bits of a key, tables) for so many documents."""
    bits = max(0, math.ceil(math.log2(max(count, 1) / BUCKET)))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(AGREE**bits))) if bits else 1


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted different hashes of the word shingles (one of all words if there are fewer); ASCII letters are lower-cased."""
    own = text.encode().lower().split() if text else []
    size, h = min(words, len(own)), xxhash.xxh64_intdigest
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(own) - size + 1
    return np.unique(np.fromiter((h(joined[s:e]) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n))


def wide_fingerprint(own: np.ndarray, bits: int = 64 * WIDE) -> np.ndarray:
    """The first ``bits`` bits, 0 or 1, of a sorted set: 1 if set in over half of the hashes, on a tie as in the first one."""
    seeds = _seeds(-(-bits // 64))
    ones = np.zeros(64 * len(seeds), np.int64)
    for at in range(0, len(own), 255):  # a byte holds the sums of a turn
        hashed = np.unpackbits(_spread(own[at : at + 255, None] ^ seeds).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(hashed, axis=0, dtype=np.uint8)
        first = hashed[0] if not at else first
    return (2 * ones + first > len(own)).view(np.uint8)[:bits]


def alike(one: np.ndarray, other: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    one, other = (one, other) if len(one) >= len(other) else (other, one)
    if len(other) < least * len(one) - 1e-9:
        return False
    both = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
    return both >= least * (len(one) + len(other) - both) - 1e-9


def _fingerprints(words: int, bits: int, tables: int):
    """For each document with words its fingerprint's first words and its keys, which are made of the bits after these."""
    place, weight = np.arange(tables, dtype=np.int64) << 32, 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            node, fps, keys = [], [], []
            for n, text in zip(b.column("node").to_pylist(), b.column("text"), strict=True):
                own = shingles(text.as_py(), words)
                if len(own):
                    made = wide_fingerprint(own, 64 * WIDE + bits * tables)
                    node.append(n)
                    fps.append(np.packbits(made[: 64 * WIDE], bitorder="little").view(np.int64))
                    keys.append(place + made[64 * WIDE :].reshape(tables, bits) @ weight)
            if node:
                ends = pa.array(np.arange(len(node) + 1, dtype=np.int32) * tables)
                columns = [pa.array(node, pa.int64()), *(pa.array(c) for c in np.stack(fps, axis=1)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))]
                yield pa.RecordBatch.from_arrays(columns, ["node", *_FPS, "keys"])

    return run


def gathered(fps: np.ndarray, cells: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its set: rows of a cell link at ``radius`` or fewer differing bits; ``cells`` is sorted."""
    label, rows = np.arange(len(fps)), np.arange(len(fps))
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    cell = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(fps))))
    turn = np.random.default_rng(0).permutation(len(fps))
    for _ in range(STARS):  # most rows of a large group are joined here, and need not be compared with each other
        centre = turn == np.maximum.reduceat(turn, first)[cell]
        middle = rows[centre & (turn >= 0)]
        to = np.full(len(first), -1)
        to[cell[middle]] = middle
        to = to[cell]
        near = (to >= 0) & (np.bitwise_count(fps ^ fps[to]).sum(axis=1) <= radius)
        label = _unite(label, rows[near], to[near])
        turn = np.where(near, -1, turn)
    order = np.lexsort((label, cells))
    for a, b in matches(fps[order], cells[order], radius, label[order]):
        label = _unite(label, order[a], order[b])
    return label


def middles(fps: np.ndarray, label: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, middle, least) of the rows that are not alone: of their set the row nearest to the majority of each bit, and the smallest node."""
    row = np.argsort(label, kind="stable")
    label, many = label[row], np.bincount(label, minlength=len(label))
    row, label = row[many[label] > 1], label[many[label] > 1]
    if not len(row):
        return row, row, node[row]
    first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    size = np.diff(np.append(first, len(row)))
    bits = np.unpackbits(np.ascontiguousarray(fps[row]).view(np.uint8), axis=1)
    most = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > size[:, None]
    order = np.lexsort((node[row], (bits != np.repeat(most, size, axis=0)).sum(axis=1), label))
    return row, np.repeat(row[order[first]], size), np.repeat(np.minimum.reduceat(node[row], first), size)


def _near(radius: int):
    """Rows sorted by (key, low, high), which are a cell: (node, least, centre) of the rows that are near another of their cell."""

    def changes(rows: pa.Table) -> np.ndarray:
        at = np.stack([rows.column(c).to_numpy() for c in ("key", "low", "high")])
        return (at[:, 1:] != at[:, :-1]).any(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            fps = np.stack([rows.column(c).to_numpy() for c in _FPS], axis=1).view(np.uint64)
            node = rows.column("node").to_numpy()
            row, middle, least = middles(fps, gathered(fps, np.cumsum(np.append(0, changes(rows))), radius), node)
            apart = (node[row] != node[middle]) | (node[row] != least)
            yield pa.RecordBatch.from_arrays([pa.array(x[apart]) for x in (node[row], least, node[middle])], ["node", "least", "centre"])

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                rows = pa.Table.from_batches(held)
                begin = int(np.append(-1, np.flatnonzero(changes(rows)))[-1]) + 1  # the last cell may go on
                if begin:
                    yield from found(rows.slice(0, begin))
                    held, n = rows.slice(begin).to_batches(), n - begin
        if n:
            yield from found(pa.Table.from_batches(held))

    return run


def _links(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["u", "v"])


def _star(words: int, least: float):
    """Rows sorted by (centre, salt, member): a centre, then those that are checked against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at = middle = None
        for b in batches:
            found = []
            for centre, salt, member, node, text in zip(*(b.column(c).to_pylist() for c in ("centre", "salt", "member", "node")), b.column("text"), strict=True):
                own = shingles(text.as_py(), words)
                if not member:
                    at, middle = (centre, salt), own
                elif at == (centre, salt) and alike(middle, own, least):
                    found.append((node, centre))
            yield from _links(found)

    return run


def forest(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, across: bool, least: float, radius: int) -> list[tuple[int, int]]:
    """Links that join the labels as all pairs of sets at ``least`` or more do; if ``across``, of those of different sides."""
    order = np.argsort(label, kind="stable")
    fps = np.stack([np.packbits(wide_fingerprint(sets[k]), bitorder="little").view(np.uint64) for k in order])
    label, side, out = np.unique(label[order], return_inverse=True)[1], side[order], []
    for a, b in matches(fps, np.zeros(len(sets), np.int64), radius, label.copy()):
        keep = label[a] != label[b]
        if across:
            keep &= side[a] != side[b]
        for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
            if label[i] != label[j] and alike(sets[order[i]], sets[order[j]], least):
                out.append((order[i], order[j]))
                label[label == label[j]] = label[i]
    return out


def _forest(words: int, least: float, radius: int):
    """Rows sorted by (cell, low, high): the links of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cell, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                nodes, labels, own, sets = zip(*held, strict=True)
                links = forest(list(sets), np.array(labels), np.array(own), cell[1] != cell[2], least, radius)
                yield from _links([(nodes[i], nodes[j]) for i, j in links])

        for b in batches:
            for *at, own, node, label, text in zip(*(b.column(c).to_pylist() for c in ("cell", "low", "high", "own", "node", "label")), b.column("text"), strict=True):
                if at != cell:
                    yield from found()
                    cell, held = at, []
                held.append((node, label, own, shingles(text.as_py(), words)))
        yield from found()

    return run


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` (ids only) if it was counted to be small; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


def block_links(near: DataFrame) -> DataFrame:
    """Different (u, v) that connect what ``near`` (node, least) does: a node goes to the smallest that it named, and so do the others it named.

    A node names one in each bucket or part that it is in, so its different rows fit one task; no join, and nothing is left out.
    """
    to = F.min("least").over(Window.partitionBy("node"))
    links = near.where("node <> least").select("node", "least").distinct().select("node", "least", to.alias("v"))
    return links.select(F.when(F.col("least") == F.col("v"), F.col("node")).otherwise(F.col("least")).alias("u"), "v").distinct()


def near_components(rows: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) of the documents of ``rows`` (node long, text) that are near-duplicates, transitively, of another."""
    bits, tables = layout(rows.count())
    schema = ", ".join(["node long", *(f"{c} long" for c in _FPS), "keys array<long>"])
    fps = cut(rows.mapInArrow(_fingerprints(words, bits, tables), schema))
    met = fps.select(F.explode("keys").alias("key"), "node", *_FPS)
    hot = met.groupBy("key").count().where(F.col("count") > PART * CELL)
    hot = cut(hot.select("key", F.ceil(F.col("count") / (PART * CELL)).cast("long").alias("parts")))
    # few keys are hot or none; adaptive execution broadcasts them if their measured size allows it, else sorts and merges
    dealt = met.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1).cast("long"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", *_FPS)
    order = ["key", "low", "high"]
    near = cut(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_near(RADIUS), "node long, least long, centre long"))
    blocks = cut(connected_components(block_links(near)))
    named = near.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("times"))
    partner = cut(named.groupBy("node").agg(F.max(F.struct("times", "centre")).alias("c")).select("node", F.col("c.centre").alias("centre")))
    salts = cut(partner.groupBy("centre").agg(F.ceil(F.count("*") / SALT).cast("long").alias("salts")))
    members = partner.join(salts, "centre").select("centre", F.pmod(F.xxhash64("node"), "salts").alias("salt"), F.lit(1).alias("member"), "node")
    centres = salts.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("centre").alias("node"))
    asked = cut(members.union(centres))
    order = ["centre", "salt", "member", "node"]
    star = rows.join(_sized(asked), "node").select(*order, "text").repartition("centre", "salt").sortWithinPartitions(*order)
    stars = cut(star.mapInArrow(_star(words, least), "u long, v long"))

    joined = cut(connected_components(stars).withColumnRenamed("root", "label"))
    labelled = cut(blocks.join(joined, "node", "left").select("root", "node", F.coalesce("label", "node").alias("label")))
    sizes = cut(labelled.groupBy("root", "label").agg(F.count("*").alias("many")))
    open_blocks = sizes.groupBy("root").agg(F.sum("many").alias("size"), F.max(F.struct("many", "label")).alias("main")).where("main.many < size")
    # a block that is not small is its largest component, in parts from -1 down, and the rest, in parts from 0 up
    apart = F.when(F.col("size") > CELL, F.col("main.many")).otherwise(F.lit(0).cast("long"))
    open_blocks = cut(open_blocks.select("root", F.when(F.col("size") > CELL, F.col("main.label")).alias("main"), F.ceil(apart / CELL).cast("long").alias("mains"), F.ceil((F.col("size") - apart) / CELL).cast("long").alias("rests")))
    left = labelled.join(open_blocks, "root").withColumn("is_main", F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
    spot = F.xxhash64("node")
    left = left.withColumn("own", F.when(F.col("is_main"), -1 - F.pmod(spot, "mains")).otherwise(F.pmod(spot, "rests")))
    left = left.withColumn("other", F.explode(F.sequence(F.when(F.col("is_main"), F.lit(0).cast("long")).otherwise(-F.col("mains")), F.col("rests") - 1)))
    cells = cut(left.select(F.col("root").alias("cell"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "label"))
    order = ["cell", "low", "high"]
    whole = rows.join(_sized(cells), "node").select(*order, "own", "node", "label", "text").repartition(*order).sortWithinPartitions(*order)
    links = cut(stars.union(whole.mapInArrow(_forest(words, least, RADIUS), "u long, v long")))
    for done in (fps, hot, near, blocks, partner, salts, asked, stars, joined, labelled, sizes, open_blocks, cells):
        discard(done)
    return connected_components(links)


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are near-duplicates, transitively, of one with a smaller id.

    Texts without words, null ones included, are near-duplicates of nothing; rows without an id stay. A node is an id with a text:
    different texts of one id are documents of their own (of those that are near-duplicates one stays), equal rows stand or
    fall together. An empty table stays empty. Other columns, whatever their names, stay as they are.
    """
    ship(docs.sparkSession)
    node = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    named = docs.where(F.col(id_col).isNotNull()).select(node.alias("node"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut(near_components(named.where("text is not null").select("node", "text"), words, least))
    known = cut(named.select("node", "id").join(_sized(found), "node").distinct())
    stays = known.groupBy("root").agg(F.min(F.struct("id", "node")).alias("stays"))
    (gone_node,) = spare(docs.columns, "gone")
    gone = cut(known.join(cut(stays), "root").where(F.col("node") != F.col("stays.node")).select(F.col("node").alias(gone_node)))
    return docs.join(_sized(gone), node == F.col(gone_node), "left_anti")
