"""Polygons and points over a cube."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.projection import project
from ..model import Cube
from ..plans.callback import REDUCERS, aggregate_reducer, nodes_of

RING = "id int, ring array<struct<x:double,y:double>>"
MAX_CELLS = 100_000  # in the list of cells that rings touch
MAX_VERTICES = 1_000_000  # that are broadcast; beyond, the joins are left to the planner


def rings(geometry: object) -> list[list[tuple[float, float]]]:
    """Exterior rings of GeoJSON polygons, however nested; holes are ignored. Bare rings are taken as they are."""
    if isinstance(geometry, dict):
        kind = geometry.get("type")
        if kind == "Polygon":
            return [_ring(geometry["coordinates"][0])]
        if kind == "MultiPolygon":
            return [_ring(p[0]) for p in geometry["coordinates"]]
        if kind == "Feature":
            return rings(geometry.get("geometry"))
        if kind in ("FeatureCollection", "GeometryCollection"):
            return [r for g in geometry.get("features", geometry.get("geometries", [])) for r in rings(g)]
        raise GraphError(f"no polygon: {kind!r}")
    if isinstance(geometry, list) and geometry:
        first = geometry[0]
        if isinstance(first, list | tuple) and first and isinstance(first[0], int | float):
            return [_ring(geometry)]
        return [r for g in geometry for r in rings(g)]
    raise GraphError("no polygon")


def _ring(points: list) -> list[tuple[float, float]]:
    own = [(float(p[0]), float(p[1])) for p in points]
    if len(own) > 1 and own[0] == own[-1]:
        own.pop()
    if len(own) < 3:
        raise GraphError("a ring needs three vertices")
    return own


def ring_table(spark: SparkSession, own: list[list[tuple[float, float]]]) -> DataFrame:
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(own)], RING)


def inside(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd rule with half-open edges: an edge counts where it spans [lower y, upper y)."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = ((a["y"] <= py) & (py < b["y"])) | ((b["y"] <= py) & (py < a["y"]))
        at = a["x"] + F.try_divide((py - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when(spans & (px < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1


def in_rings(pixels: DataFrame, own: list[list[tuple[float, float]]]) -> DataFrame:
    """Each pixel with the number (``id``) of each ring, in pixel space, that holds its centre.

    Rings are listed by the coarse cells that their bounds touch, so pixels find them by an equi-join on the cell; the cells
    are as large as it takes to keep that list short. Rings come with the request, so both tables are bounded by it.
    """
    spark = pixels.sparkSession
    bounds = [(min(x for x, _ in r), max(x for x, _ in r), min(y for _, y in r), max(y for _, y in r)) for r in own]
    side = 64
    while sum((math.floor(x1 / side) - math.floor(x0 / side) + 1) * (math.floor(y1 / side) - math.floor(y0 / side) + 1) for x0, x1, y0, y1 in bounds) > MAX_CELLS:
        side *= 2
    cells = [
        (i, cy, cx, *(float(v) for v in box))
        for i, box in enumerate(bounds)
        for cy in range(math.floor(box[2] / side), math.floor(box[3] / side) + 1)
        for cx in range(math.floor(box[0] / side), math.floor(box[1] / side) + 1)
    ]
    listed = spark.createDataFrame(cells, "id int, _cy int, _cx int, x0 double, x1 double, y0 double, y1 double")
    rings_by_id = ring_table(spark, own)
    if sum(map(len, own)) <= MAX_VERTICES:
        listed, rings_by_id = F.broadcast(listed), F.broadcast(rings_by_id)
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    near = (cx >= F.col("x0")) & (cx <= F.col("x1")) & (cy >= F.col("y0")) & (cy <= F.col("y1"))
    placed = pixels.withColumns({"_cy": F.floor(cy / side).cast("int"), "_cx": F.floor(cx / side).cast("int")})
    found = placed.join(listed, ["_cy", "_cx"]).where(near).join(rings_by_id, "id").where(inside(F.col("ring"), cx, cy))
    return found.drop("ring", "x0", "x1", "y0", "y1", "_cy", "_cx")


def to_pixels(own: list[list[tuple[float, float]]], cube: Cube, crs: object = 4326) -> list[list[tuple[float, float]]]:
    """Rings from world to pixel coordinates of the cube."""
    x0, dx, _, y0, _, dy = cube.transform
    moved = [[project(x, y, crs, cube.crs) for x, y in r] for r in own]
    return [[((x - x0) / dx, (y - y0) / dy) for x, y in r] for r in moved]


def _over(cube: Cube, own: list[list[tuple[float, float]]], value: Column) -> tuple[DataFrame, DataFrame]:
    frame = cube.base.frame()
    spark = frame.sparkSession
    table = ring_table(spark, own)
    scene = F.lit(0).alias("scene") if cube.base.timeless else F.col("scene")
    pixels = frame.select(scene, "y", "x", value.alias("v"))
    return in_rings(pixels, own), table.select(F.col("id").alias("geometry"))


def aggregate_spatial(cube: Cube, geometries: object, reducer: object, crs: object = 4326) -> DataFrame:
    """geometry, scene, value: one built-in reducer over the primary band's pixels inside; NULL where none is valid."""
    nodes = nodes_of(reducer)
    if len(nodes) != 1 or (name := next(iter(nodes.values())).get("process_id")) not in REDUCERS:
        raise GraphError("aggregate_spatial takes one built-in reducer")
    found, table = _over(cube, to_pixels(rings(geometries), cube, crs), cube.band(cube.primary))
    # pixels of a scene have no order but their place
    ordered = found.withColumnsRenamed({"scene": "_s"}).withColumn("scene", F.col("y") * (1 << 31) + F.col("x"))
    out = ordered.groupBy("id", "_s").agg(aggregate_reducer(name, F.col("v")).alias("value"))
    scenes = F.array(*(F.lit(s) for s, _ in cube.scenes))
    grid = table.select("geometry", F.explode(scenes).alias("scene"))
    return grid.join(out.select(F.col("id").alias("geometry"), F.col("_s").alias("scene"), "value"), ["geometry", "scene"], "left")


def aggregate_spatial_polygon(cube: Cube, geometries: object) -> DataFrame:
    """geometry, mean: rings in pixel space, the primary band's first scene; a missing pixel makes the mean NULL."""
    first = cube if cube.base.timeless else cube.where(F.col("scene") == 0)
    found, table = _over(first, rings(geometries), first.band(first.primary))
    mean = F.when(F.count("v") == F.count(F.lit(1)), F.avg(F.col("v").cast("double")))
    return table.join(found.groupBy(F.col("id").alias("geometry")).agg(mean.alias("mean")), "geometry", "left")


def aggregate_spatial_point(cube: Cube, points: list[tuple[float, float]]) -> DataFrame:
    """point, value: the primary band's first scene at world points; NULL outside."""
    frame = cube.base.frame()
    x0, dx, _, y0, _, dy = cube.transform
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    table = frame.sparkSession.createDataFrame(rows, "point int, wx double, wy double")
    at = table.select("point", F.floor((F.col("wy") - y0) / dy).cast("int").alias("y"), F.floor((F.col("wx") - x0) / dx).cast("int").alias("x"))
    return sample(cube, at)


def sample(cube: Cube, at: DataFrame) -> DataFrame:
    """point, value for a table of (point, y, x); any size, as the pixels are found by an equi-join."""
    frame = cube.base.frame() if cube.base.timeless else cube.base.frame().where("scene = 0")
    pixels = frame.select("y", "x", cube.band(cube.primary).alias("value"))
    return at.join(pixels, ["y", "x"], "left").select("point", "value")


def rasterize(spark: SparkSession, own: list[list[tuple[float, float]]], rows: int, cols: int, burn: list[float] | None = None) -> DataFrame:
    """y, x, v over a grid: the value of the last ring (in pixel space) that holds the pixel's centre, else 0."""
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("y"), (F.col("id") % cols).cast("int").alias("x"))
    found = in_rings(grid, own).groupBy("y", "x").agg(F.max("id").alias("id"))
    values = F.array(*(F.lit(float(v)) for v in (burn or [1.0] * len(own))))
    return grid.join(found, ["y", "x"], "left").select("y", "x", F.coalesce(F.get(values, F.col("id")), F.lit(0.0)).alias("v"))


def extent(cubes: list[Cube]) -> dict:
    """The union of the cubes' world extents (they need shapes and one CRS)."""
    boxes = []
    for c in cubes:
        x0, dx, _, y0, _, dy = c.transform
        boxes.append((min(x0, x0 + dx * c.shape[1]), min(y0, y0 + dy * c.shape[0]), max(x0, x0 + dx * c.shape[1]), max(y0, y0 + dy * c.shape[0])))
    w, s, e, n = zip(*boxes, strict=True)
    return {"west": min(w), "south": min(s), "east": max(e), "north": max(n)}
