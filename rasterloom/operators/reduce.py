"""Reductions over time or bands, histograms, overviews."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..model import Base, Cube, Grouped
from ..plans.callback import compile_array, compile_temporal
from .merge import joined

TIME, BANDS = ("t", "time", "temporal"), ("bands", "band")


def _grouped(cube: Cube, by: tuple[str, ...]) -> Grouped:
    """The one aggregation of this kind over the cube's base; sibling reductions share it."""
    if by not in cube.base.groups:
        cube.base.groups[by] = Grouped(cube.base, by)
    return cube.base.groups[by]


def reduce_dimension(cube: Cube, reducer: object, dimension: str, all_bands: bool = False) -> Cube:
    """Time: the primary band (``all_bands``: every data band) over the scenes of a pixel, in scene order.
    Bands: all data bands of a row into the band ``result``, without a shuffle."""
    if dimension in TIME:
        if cube.base.timeless:
            raise GraphError("the cube has no time")
        base = _grouped(cube, ("y", "x"))
        names = cube.data_bands if all_bands else [cube.primary]
        bands = {b: compile_temporal(reducer, cube.base.hold(cube.band(b)), base.add, base.hold) for b in names}
        return replace(cube, base=base, bands=bands, scenes=((0, None),), scales={b: s for b, s in cube.scales.items() if b in bands})
    if dimension in BANDS:
        values = [cube.band(b) for b in cube.data_bands]
        return replace(cube, bands={"result": compile_array(reducer, values, cube.base.hold)}, scales={})
    raise GraphError(f"no dimension {dimension!r}; t and bands can be reduced")


def sum_dimension(cube: Cube, dimension: str) -> DataFrame:
    """A plain sum: a missing value makes the sum missing."""
    if dimension in BANDS:
        total = sum((cube.band(b).cast("double") for b in cube.names), F.lit(0.0))
        return cube.base.frame().select(*cube.base.keys, total.alias("sum"))
    frame = cube.frame()
    return frame.groupBy("y", "x").agg(*(F.when(F.count(b) == F.count(F.lit(1)), F.sum(F.col(b).cast("double"))).alias(b) for b in cube.names))


def argmax(data: Column) -> Column:
    """The first place of an array's largest element, from 0."""
    return (F.array_position(data, F.array_max(data)) - 1).cast("int")


def zonal_histogram(cube: Cube, masking: Cube) -> DataFrame:
    """value, n: how often each value of the primary band stands where the mask is not 0."""
    if len(masking.bands) != 1:
        raise GraphError("a mask has exactly one band")
    base, ours, theirs = joined(cube, masking, "inner")
    hit = theirs[masking.names[0]] != 0
    rows = base.frame().where(hit).select(ours[cube.primary].alias("value"))
    return rows.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def overview(cube: Cube, level: int) -> Cube:
    """Averages of level x level pixels."""
    if level < 2:
        raise GraphError("an overview level is 2 or more")
    keys = [k for k in cube.base.keys if k not in ("y", "x")]
    frame = cube.frame().withColumns({"y": F.floor(F.col("y") / level).cast("int"), "x": F.floor(F.col("x") / level).cast("int")})
    out = frame.groupBy(*keys, "y", "x").agg(*(F.avg(F.col(b).cast("double")).alias(b) for b in cube.names))
    x0, dx, rx, y0, ry, dy = cube.transform
    shape = cube.shape and (-(-cube.shape[0] // level), -(-cube.shape[1] // level))
    return replace(cube, base=Base(out, cube.base.timeless), bands={b: F.col(b) for b in cube.names}, transform=(x0, dx * level, rx, y0, ry, dy * level), shape=shape)
