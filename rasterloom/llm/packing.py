"""Packing: shortest-pack-first over the length histogram.

Documents become token ids once, are cut into pieces of at most ``capacity`` ids, and only the histogram of piece lengths
(at most ``capacity`` counts, and one more for each ``LANE`` rows) reaches the driver. There lengths are placed longest first into the packs with
the most room, whole counts at a time, so the work depends on the number of lengths, not of documents. A pattern is a
list of (length, times); pieces join their place by rank: the k-th piece of a length takes the k-th place of that length.

Each step of the placement ends a length's count or fills all packs of a pattern, so there are at most two patterns
for each length, and each has fewer than 91 different lengths (their sum is at most 4096): the plan that is broadcast is
bounded whatever the input's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, resident, ship, slices, spare
from .word_bpe import WordBPE

LANE = 1 << 20  # rows of one length that are ranked in one task, about
BYTES = 8 << 20  # of text that is tokenized at a time


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: id, start, length, doc_tokens, ids (little-endian uint32 in a binary).

    Every document ends with ``end_id``, so an empty or null text is one piece of one id. Repeated rows give their pieces
    each. The tokenizer's file is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType
    schema = T.StructType().add(id_col, kind).add("start", "long").add("length", "integer").add("doc_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = resident(("words", hash(held.value)), lambda: WordBPE(held.value))
        for whole in batches:
            for b in slices(whole, "text", BYTES):
                ids, total = known.encode(b.column("text"), end_id)
                many = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), many)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                size = np.minimum(capacity, total[row] - start)
                ends = pa.py_buffer(np.append(0, 4 * np.cumsum(size)))
                bytes_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, ends, pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(start), pa.array(size.astype(np.int32)), pa.array(total[row]), bytes_], schema.names)

    return docs.mapInArrow(run, schema)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many packs, their (length, times) entries), so that each length is placed as often as the histogram has it."""
    packs: dict[int, list] = {}  # by room: [count, entries]; entries are linked lists, shared by patterns that were split
    rooms: list[int] = []  # a heap of the rooms, most first
    done = []

    def put(room: int, count: int, entries) -> None:
        if not room:
            done.append((count, entries))
            return
        if room not in packs:
            packs[room] = []
            heapq.heappush(rooms, -room)
        packs[room].append((count, entries))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left:
            while rooms and not packs.get(-rooms[0]):
                packs.pop(-heapq.heappop(rooms), None)
            if not rooms or -rooms[0] < length:
                put(capacity - length, left, (length, 1, None))
                break
            room = -rooms[0]
            count, entries = packs[room].pop()
            # as often into these packs as they stay the emptiest
            below = heapq.nsmallest(2, rooms)
            other = room if packs[room] else -below[1] if len(below) > 1 else 0
            times = max(1, min(room // length, (room - max(other, length)) // length, left // count))
            if left < count:
                put(room, count - left, entries)
                count = left
            put(room - times * length, count, (length, times, entries))
            left -= count * times
    out = []
    for count, entries in done + [x for room in sorted(packs) for x in packs[room]]:
        own = []
        while entries:
            own.append(entries[:2])
            entries = entries[2]
        out.append((count, own[::-1]))
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Runs of places, sorted by (length, first rank): keys, first sequence, offset, times."""
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    runs, sequence = [], 0
    for count, entries in patterns(histogram, capacity):
        offset = 0
        for length, times in entries:
            runs.append((length << 48 | used[length], sequence, offset, times))
            used[length] += count * times
            offset += length * times
        sequence += count
    return tuple(np.array(x, np.int64) for x in zip(*sorted(runs), strict=True)) if runs else (np.zeros(0, np.int64),) * 4


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset (replaced if there): pieces of a sequence lie gapless from 0 to at most ``capacity``.

    Lengths must be from 1 to ``capacity``. An empty table gives no rows; repeated rows get places of their own. The pieces
    are written once to the shared folder, so what they are made of runs once and ranks hold if executors are lost.
    """
    spark = pieces.sparkSession
    ship(spark)
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    seen, lanes, lane, rank = spare(names, "seen", "lanes", "lane", "rank")
    rows = cut(pieces.withColumn(seen, F.monotonically_increasing_id()))
    histogram = {r[0]: r[1] for r in rows.groupBy(length_col).count().collect()}  # capacity rows at most
    dealt = spark.createDataFrame([(length, -(-n // LANE)) for length, n in histogram.items()], f"{lanes}_of int, {lanes} int")
    laned = rows.join(F.broadcast(dealt), F.col(length_col) == F.col(f"{lanes}_of")).withColumn(lane, F.pmod(F.xxhash64(seen), F.col(lanes)).cast("int")).drop(f"{lanes}_of", lanes)
    counts = {(r[0], r[1]): r[2] for r in laned.groupBy(length_col, lane).count().collect()}  # a row for each LANE rows and length
    first_lane, starts, before = np.zeros(capacity + 1, np.int64), [], 0
    for length, n in sorted(histogram.items()):
        first_lane[length], before = len(starts), 0
        for k in range(-(-n // LANE)):
            starts.append(before)  # ranks of the lanes before
            before += counts.get((length, k), 0)
    held = spark.sparkContext.broadcast((first_lane, np.array(starts, np.int64), *plan(histogram, capacity)))
    ranked = laned.withColumn(rank, F.row_number().over(Window.partitionBy(length_col, lane).orderBy(seen)) - F.lit(1).cast("long"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_lane, starts, keys, first, offset, times = held.value
        for b in batches:
            length = b.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            key = (length << 48) + b.column(rank).to_numpy(zero_copy_only=False) + starts[first_lane[length] + b.column(lane).to_numpy(zero_copy_only=False)]
            at = np.searchsorted(keys, key, side="right") - 1
            beyond = key - keys[at]
            columns = [*(b.column(c) for c in names), pa.array(first[at] + beyond // times[at]), pa.array(offset[at] + beyond % times[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return ranked.mapInArrow(run, schema)


def padding(length: int, capacity: int = 4096) -> int:
    """How many pad ids a sequence of ``length`` gets: none at a power of two, else up to ``capacity``."""
    return 0 if length & (length - 1) == 0 else capacity - length


def op7_pack(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per piece."""
    import public_tokenizers

    pieces = tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(digests)
