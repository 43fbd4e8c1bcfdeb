"""Filters, labels and dimensions of a cube. Row filters are plain predicates on keys, so they reach the scan."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import BackendError, GraphError
from ..functions.projection import project_bbox
from ..model import Base, Cube, check_name
from ..sources.extent import parse_bbox, parse_interval


def filter_temporal(cube: Cube, extent: list[str | None]) -> Cube:
    """Both ends included; None is open. Scenes are numbered anew, densely, in their order."""
    start, end = parse_interval(extent)
    if any(t is None for _, t in cube.scenes):
        raise GraphError("filter_temporal needs a cube with times")
    kept = [(s, t) for s, t in cube.scenes if (start is None or t >= start) and (end is None or t <= end)]
    if not kept:
        raise BackendError("no scene is in the interval")
    renumber = F.create_map(*[F.lit(x) for new, (old, _) in enumerate(kept) for x in (old, new)])
    frame = cube.frame().where(F.col("scene").isin([s for s, _ in kept])).withColumn("scene", renumber[F.col("scene")])
    scenes = tuple((new, t) for new, (_, t) in enumerate(kept))
    return _rebased(cube, frame, scenes=scenes)


def _rebased(cube: Cube, frame, **more) -> Cube:
    return replace(cube, base=Base(frame, cube.base.timeless), bands={b: F.col(b) for b in cube.names}, **more)


def window(cube: Cube, bbox: dict) -> tuple[int, int, int, int]:
    """(row, column, rows, columns) of a bbox on the cube's grid; it may reach outside, but not lie outside."""
    w, s, e, n = project_bbox(bbox, cube.crs)
    x0, dx, _, y0, _, dy = cube.transform
    col, row = math.floor((w - x0) / dx + 0.001), math.floor((n - y0) / dy + 0.001)
    cols, rows = math.ceil((e - w) / abs(dx) - 0.001), math.ceil((n - s) / abs(dy) - 0.001)
    if cols <= 0 or rows <= 0:
        raise GraphError("the extent is smaller than a pixel")
    if cube.shape and (row >= cube.shape[0] or col >= cube.shape[1] or row + rows <= 0 or col + cols <= 0):
        raise GraphError("the extent lies outside the cube")
    return row, col, rows, cols


def filter_bbox(cube: Cube, extent: dict) -> Cube:
    """Pixels of the window; row and column count from the window's corner. Pixels outside the source stay absent (NULL)."""
    bbox = parse_bbox(extent)
    row, col, rows, cols = window(cube, bbox)
    return sub_rectangle(cube, row, col, rows, cols, bbox=bbox)


def sub_rectangle(cube: Cube, row: int, col: int, rows: int, cols: int, **more) -> Cube:
    y, x = F.col("y"), F.col("x")
    frame = cube.frame().where((y >= row) & (y < row + rows) & (x >= col) & (x < col + cols)).withColumns({"y": y - row, "x": x - col})
    x0, dx, rx, y0, ry, dy = cube.transform
    moved = (x0 + col * dx + row * rx, dx, rx, y0 + col * ry + row * dy, ry, dy)
    return _rebased(cube, frame, transform=moved, shape=(rows, cols), **more)


def filter_spatial(cube: Cube, geometries: object) -> Cube:
    """The envelope of all coordinates; not a clip to the polygons."""
    points = list(_coordinates(geometries))
    if not points:
        raise GraphError("the geometries have no coordinates")
    xs, ys = zip(*points, strict=True)
    if min(xs) >= max(xs) or min(ys) >= max(ys):
        raise GraphError("the geometries' envelope is degenerate")
    return filter_bbox(cube, {"west": min(xs), "south": min(ys), "east": max(xs), "north": max(ys)})


def _coordinates(value: object):
    if isinstance(value, dict):
        for key in ("coordinates", "geometry", "geometries", "features"):
            if key in value:
                yield from _coordinates(value[key])
    elif isinstance(value, list):
        if len(value) >= 2 and all(isinstance(v, int | float) for v in value[:2]):
            yield value[0], value[1]
        else:
            for v in value:
                yield from _coordinates(v)


def filter_bands(cube: Cube, bands: list[str]) -> Cube:
    if not bands:
        raise GraphError("filter_bands needs bands")
    return cube.with_bands({b: cube.band(b) for b in bands})


def rename_labels(cube: Cube, dimension: str, target: list[str], source: list[str] | None = None) -> Cube:
    """Bands only. Without ``source`` the targets name the bands in order; a renamed band wins over one of its new name."""
    if dimension not in ("bands", "band"):
        raise GraphError("only band labels can be renamed")
    if source is None:
        source = cube.names[: len(target)]
        if len(target) > len(cube.names):
            raise GraphError("more labels than bands")
    if len(source) != len(target):
        raise GraphError("source and target differ in length")
    renames = dict(zip(source, map(check_name, target), strict=True))
    columns = {b: cube.band(b) for b in source}
    out = {b: c for b, c in cube.bands.items() if b not in renames}
    out |= {renames[b]: c for b, c in columns.items()}
    scales = {renames.get(b, b): s for b, s in cube.scales.items()}
    return replace(cube, bands=out, scales=scales)


def add_dimension(cube: Cube, name: str, label: str) -> Cube:
    if name in cube.extra_dims or name in ("t", "x", "y", "bands"):
        raise GraphError(f"the dimension {name!r} exists")
    return replace(cube, extra_dims={**cube.extra_dims, check_name(name): str(label)})


def drop_dimension(cube: Cube, name: str) -> Cube:
    if name not in cube.extra_dims:
        raise GraphError(f"the dimension {name!r} was not added, so it cannot be dropped")
    return replace(cube, extra_dims={k: v for k, v in cube.extra_dims.items() if k != name})


def select_layer(cube: Cube, index: int) -> Cube:
    """One band by its place in name order; the others are not read."""
    return filter_bands(cube, [cube.names[index]])


def trim_border(cube: Cube, n: int) -> Cube:
    if not cube.shape:
        raise GraphError("the cube has no shape")
    rows, cols = cube.shape
    if 2 * n >= min(rows, cols):
        raise GraphError("nothing is left")
    return sub_rectangle(cube, n, n, rows - 2 * n, cols - 2 * n)


def fill_missing(cube: Cube, value: float) -> Cube:
    return cube.with_bands({b: F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(float(value))) for b, c in cube.bands.items()})
