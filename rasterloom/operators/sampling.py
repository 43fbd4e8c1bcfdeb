"""From world to pixels, blocks and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Cube
from .vector import sample


def geo_to_pixel(transform: tuple[float, ...], wx: Column, wy: Column) -> tuple[Column, Column]:
    """(row, column)."""
    x0, dx, _, y0, _, dy = transform
    return F.floor((F.lit(y0) - wy) / abs(dy)).cast("int"), F.floor((wx - x0) / dx).cast("int")


def block_place(y: Column, x: Column, cols: int, block: int) -> tuple[Column, Column, Column]:
    """(block number, row in it, column in it); blocks are numbered row by row."""
    across = -(-cols // block)
    return (F.floor(y / block) * across + F.floor(x / block)).cast("int"), (y % block).cast("int"), (x % block).cast("int")


def sample_points(cube: Cube, points: DataFrame, wx: str = "wx", wy: str = "wy") -> DataFrame:
    """point, value for a table (point, wx, wy): the primary band's first scene, NULL outside."""
    row, col = geo_to_pixel(cube.transform, F.col(wx), F.col(wy))
    return sample(cube, points.select("point", row.alias("y"), col.alias("x")))


def extract(cube: Cube, at: DataFrame, bands: list[str]) -> DataFrame:
    """The bands at a table of (seq, y, x), for every scene; ``seq`` keeps the input's order."""
    frame = cube.base.frame()
    keys = [k for k in cube.base.keys if k not in ("y", "x")]
    pixels = frame.select(*keys, "y", "x", *(cube.band(b).alias(b) for b in bands))
    return at.join(pixels, ["y", "x"], "left")
