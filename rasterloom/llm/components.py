"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long): the root is the smallest node reachable.

    Every step is written to the shared folder, so lineage stays short and a lost executor costs a file read. Minima are
    aggregated map-side. The joins have a written table on either side: then adaptive execution can split the rows of a node
    with very many edges over tasks. Self-loops make their node known; null ends are left out.
    """
    now = cut(edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops, now_state = now.where("u = v").select(F.col("u").alias("node")), None
    first, now_state = now, _state(now.where("u <> v"))
    now = now.where("u <> v")
    while now_state[0]:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours go to the smallest of these
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = _state(after)
        for done in (nearest, large, least, *([now] if now is not first else [])):
            discard(done)
        now, same = after, state == now_state
        now_state = state
        if same:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node")).union(loops).distinct()
    roots = roots.join(now.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return pairs.union(roots.select("node", F.col("node").alias("root")))
