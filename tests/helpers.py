"""Small cubes for tests."""

from __future__ import annotations

from rasterloom.model import Cube, from_frame


def raster(spark, values, band="v", **more) -> Cube:
    """One scene from a list of rows; None is missing."""
    rows = [(0, y, x, None if v is None else float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    df = spark.createDataFrame(rows, f"scene int, y int, x int, {band} double")
    more.setdefault("transform", (0.0, 1.0, 0.0, float(len(values)), 0.0, -1.0))
    return from_frame(df, [band], shape=(len(values), len(values[0])), **more)


def series(spark, values, band="v", times=None) -> Cube:
    """One pixel over scenes."""
    rows = [(k, 0, 0, None if v is None else float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"scene int, y int, x int, {band} double")
    scenes = [(k, times[k] if times else None) for k in range(len(values))]
    return from_frame(df, [band], scenes, shape=(1, 1))


def call(process, **arguments):
    return {"process_graph": {"f": {"process_id": process, "arguments": arguments, "result": True}}}


X, DATA = {"from_parameter": "x"}, {"from_parameter": "data"}
RANGE = {
    "process_graph": {
        "a": {"process_id": "max", "arguments": {"data": DATA}},
        "b": {"process_id": "min", "arguments": {"data": DATA}},
        "c": {"process_id": "subtract", "arguments": {"x": {"from_node": "a"}, "y": {"from_node": "b"}}, "result": True},
    }
}
