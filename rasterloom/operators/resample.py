"""Reprojection by nearest neighbour: target pixels look their source pixel up in an equi-join."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.projection import project, project_columns
from ..model import Base, Cube
from ..sources.extent import parse_crs


def target_grid(cube: Cube, crs: object) -> tuple[tuple[float, ...], tuple[int, int]]:
    """Transform and shape in ``crs``: the bounds of the cube's edges at about its own number of pixels."""
    if not cube.shape:
        raise GraphError("the cube has no shape")
    rows, cols = cube.shape
    x0, dx, _, y0, _, dy = cube.transform
    edge = [(c, r) for c in (0, cols / 2, cols) for r in (0, rows / 2, rows)]
    points = [project(x0 + c * dx, y0 + r * dy, cube.crs, crs) for c, r in edge]
    xs, ys = zip(*points, strict=True)
    return (min(xs), (max(xs) - min(xs)) / cols, 0.0, max(ys), 0.0, (min(ys) - max(ys)) / rows), (rows, cols)


def resample_spatial(cube: Cube, projection: object, resolution: float = 0) -> Cube:
    """The cube on a grid of another CRS; pixels that fall outside the source are absent."""
    if resolution:
        raise GraphError("only the source's own resolution is supported")
    epsg = parse_crs(projection)
    if epsg == parse_crs(cube.crs):
        return cube
    grid, (rows, cols) = target_grid(cube, epsg)
    frame = cube.frame()
    target = frame.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("ty"), (F.col("id") % cols).cast("int").alias("tx"))
    wx, wy = project_columns((F.col("tx") + 0.5) * grid[1] + grid[0], (F.col("ty") + 0.5) * grid[5] + grid[3], epsg, cube.crs)
    x0, dx, _, y0, _, dy = cube.transform
    target = target.withColumns({"x": F.floor((wx - x0) / dx).cast("int"), "y": F.floor((wy - y0) / dy).cast("int")})
    found = frame.join(target, ["y", "x"]).drop("y", "x").withColumnsRenamed({"ty": "y", "tx": "x"})
    base = Base(found.select(*cube.base.keys, *cube.names), cube.base.timeless)
    return replace(cube, base=base, bands={b: F.col(b) for b in cube.names}, transform=grid, shape=(rows, cols), crs=f"EPSG:{epsg}", bbox=None)
