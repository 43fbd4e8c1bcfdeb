"""User workers over blocks, for what Columns cannot say: Arrow batches, one block at a time, with an optional halo.

A block is ``block`` x ``block`` pixels, so a group has a bounded size whatever the raster's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Cube
from .merge import joined


def blocks(frame: DataFrame, block: int, halo: int = 0) -> DataFrame:
    """Rows with block_row and block_col; with a halo, border pixels go to the neighbours' blocks as well (``core`` False)."""
    own_row, own_col = F.floor(F.col("y") / block).cast("int"), F.floor(F.col("x") / block).cast("int")
    if not halo:
        return frame.withColumns({"block_row": own_row, "block_col": own_col, "core": F.lit(True)})
    rows = F.sequence(F.floor((F.col("y") - halo) / block).cast("int"), F.floor((F.col("y") + halo) / block).cast("int"))
    cols = F.sequence(F.floor((F.col("x") - halo) / block).cast("int"), F.floor((F.col("x") + halo) / block).cast("int"))
    out = frame.withColumn("block_row", F.explode(rows)).withColumn("block_col", F.explode(cols))
    return out.where("block_row >= 0 and block_col >= 0").withColumn("core", (F.col("block_row") == own_row) & (F.col("block_col") == own_col))


def _masked(cube: Cube, mask: Cube | None) -> DataFrame:
    """The cube's rows, with a mask's bands as ``mask_<band>`` where there is one."""
    if mask is None:
        return cube.frame()
    base, ours, theirs = joined(cube, mask, "left")
    return base.frame().select(*base.keys, *(c.alias(b) for b, c in ours.items()), *(c.alias(f"mask_{b}") for b, c in theirs.items()))


def apply_blocks(cube: Cube, worker: Callable[[pd.DataFrame], pd.DataFrame], schema: str, block: int = 256, halo: int = 0, by_scene: bool = True, mask: Cube | None = None) -> DataFrame:
    """``worker`` on the rows of each block (and scene): a map, or with ``by_scene`` False a reduction over time.

    With a mask its bands come along, named ``mask_<band>``. Rows of the halo are marked by ``core``; what the worker returns
    for them is its own business.
    """
    keys = ["block_row", "block_col"] + (["scene"] if by_scene and not cube.base.timeless else [])
    return blocks(_masked(cube, mask), block, halo).groupBy(*keys).applyInPandas(worker, schema)


def apply_rows(cube: Cube, worker: Callable[[pd.DataFrame], pd.DataFrame], schema: str, width: int | None = None, mask: Cube | None = None) -> DataFrame:
    """``worker`` on each pixel row of all scenes; with ``width`` on runs of that many of its columns.

    A group holds a row's columns times its scenes, so a wide raster needs ``width``. A mask's bands come along as in ``apply_blocks``.
    """
    frame = _masked(cube, mask)
    run = [F.floor(F.col("x") / width).cast("int").alias("run")] if width else []
    return frame.groupBy("y", *run).applyInPandas(worker, schema)
