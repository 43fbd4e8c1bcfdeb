"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns ``vnodes`` points on a ring of 64-bit hashes, put there by a hash of (shard, replica), so adding a shard takes
stretches from the others but moves none among them. A row stands at ``xxhash64(key)``; its first choice is the owner of the next
point clockwise. Loads are bounded by exact capacities (total rows divided by shards, at most one apart): rows that find a
shard full go on clockwise to the next shard with room, so a row sits past its first choice only if that one is full.

Rows that agree in id, size and checksum are one group with a count, so a key that holds a third of all rows is counted before
it is shuffled. Groups of the arc before a point are dealt to lanes by their hash, and only counts by (arc, lane) reach the driver:
one for each point and each ``LANE`` groups. They give each arc's quota by shard; groups get their place by a running sum
of counts. All of this depends on the rows alone, not on how they are partitioned.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, discard

LANE = 1 << 16  # groups of an arc that are ranked in one task, about
CHUNK = 1 << 20  # rows of a group that one task writes
SMALL = 1 << 20  # rows of a plan or a ring that are broadcast at most (about 50 bytes each); beyond, the join is shuffled


def ring_points(shards: int, vnodes: int = 64) -> list[tuple[int, int]]:
    """Sorted (position, shard): positions are signed 64-bit hashes."""
    return sorted((xxhash.xxh64_intdigest(f"{shard}/{replica}") - (1 << 63), shard) for shard in range(shards) for replica in range(vnodes))


def quotas(counts: list[int], owners: list[int], shards: int) -> list[list[tuple[int, int]]]:
    """For each arc, (shard, rows) in walking order; shard totals are at most one apart.

    In turn, each arc in ring order offers what is left of it to the next shard clockwise that it did not meet yet, which takes
    what it has room for.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    walking = [(arc, n, arc, set()) for arc, n in enumerate(counts) if n]
    while walking:
        still = []
        for arc, n, at, met in walking:
            while owners[at % len(owners)] in met:
                at += 1
            shard = owners[at % len(owners)]
            met.add(shard)
            if taken := min(n, room[shard]):
                out[arc].append((shard, taken))
                room[shard] -= taken
            if n > taken:
                still.append((arc, n - taken, at + 1, met))
        walking = still
    return out


def _held(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def _arcs(groups: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """``groups`` with arc, the number of the next point clockwise of ``position``."""
    bits = max(1, (2 * len(points)).bit_length())  # segments of which most have a point or none
    own: dict[int, list[int]] = {}
    for position, _ in points:
        own.setdefault(position >> (64 - bits), []).append(position)
    rows, before = [], 0
    for segment in range(-(1 << bits - 1), 1 << bits - 1):
        inside = own.get(segment, [])
        rows.append((segment, before, inside))
        before += len(inside)
    table = groups.sparkSession.createDataFrame(rows, "segment long, before int, inside array<long>")
    placed = groups.withColumn("segment", F.shiftright("position", 64 - bits)).join(_held(table, len(rows)), "segment")
    passed = F.size(F.filter("inside", lambda p: p < F.col("position")))
    return placed.withColumn("arc", F.pmod(F.col("before") + passed, F.lit(len(points)))).drop("segment", "before", "inside")


def assign_shards(docs: DataFrame, shards: int = 8, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot, first_choice.

    Slots run gapless from 0 in each shard. Null texts have size 1 and the checksum of the empty text; null ids and
    repeated rows are rows like any other; an empty table gives no rows. Columns besides id and text are not read.
    """
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and vnodes must be positive")
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    groups = cut(rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("position", F.xxhash64("id")))
    points = ring_points(shards, vnodes)
    owners, arced = [shard for _, shard in points], cut(_arcs(groups, points))
    totals, lanes = [0] * len(points), []
    for arc, n_groups, n in arced.groupBy("arc").agg(F.count("*"), F.sum("n")).collect():  # a row for each point at most
        totals[arc] = n
        lanes.append((arc, -(-n_groups // LANE)))
    dealt = _held(spark.createDataFrame(lanes, "arc int, lanes int"), len(lanes))
    laned = cut(arced.join(dealt, "arc").withColumn("lane", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.col("lanes")).cast("int")).drop("lanes"))
    counts = {(r[0], r[1]): r[2] for r in laned.groupBy("arc", "lane").agg(F.sum("n")).collect()}  # a row for each LANE groups, and for each arc
    filled, runs = [0] * shards, []
    for arc, quota in enumerate(quotas(totals, owners, shards)):
        # cut the arc's rows, lane after lane, into the runs that go to one shard
        lane, used = 0, 0
        for shard, n in quota:
            while n:
                while used == counts.get((arc, lane), 0):
                    lane, used = lane + 1, 0
                part = min(n, counts[arc, lane] - used)
                runs.append((arc, lane, used, used + part, shard, filled[shard], owners[arc]))
                filled[shard] += part
                used += part
                n -= part
    plan = spark.createDataFrame(runs, "arc int, lane int, begins long, ends long, shard int, base long, first_choice int")
    window = Window.partitionBy("arc", "lane").orderBy("position", "id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = laned.withColumn("upto", F.sum("n").over(window)).withColumn("start", F.col("upto") - F.col("n"))
    met = ranked.join(_held(plan, len(runs)), ["arc", "lane"]).where((F.col("start") < F.col("ends")) & (F.col("upto") > F.col("begins")))
    spans = met.withColumn("start", F.greatest("start", "begins")).withColumn("upto", F.least("upto", "ends"))
    spans = spans.select("id", "size", "text_crc32", "shard", "first_choice", (F.col("base") + F.col("start") - F.col("begins")).alias("slot"), (F.col("upto") - F.col("start")).alias("n"))
    # a large group's rows are written by several tasks
    large = spans.where(F.col("n") > CHUNK).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).withColumn("slot", F.col("slot") + F.col("at"))
    large = large.withColumn("n", F.least(F.col("n") - F.col("at"), F.lit(CHUNK).cast("long"))).drop("at").repartition("shard", "slot")
    every = spans.where(F.col("n") <= CHUNK).unionByName(large).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    discard(groups)
    discard(arced)
    return every.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot") + F.col("at")).alias("slot"), "first_choice")


def op6_shard_ring(docs: DataFrame) -> DataFrame:
    """The contract's columns: law ``rows`` (counts at most one apart), 8 shards, no grown shard."""
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "first_choice"
    )
