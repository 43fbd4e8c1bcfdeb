"""Process graphs compiled to lazy cubes and frames. Only what the result needs is built; every node is checked."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import BackendError, GraphError, UnknownProcess
from ..functions import values as V
from ..model import Cube
from ..operators import apply as A
from ..operators import filters as FL
from ..operators import mask as M
from ..operators import merge as MG
from ..operators import ml
from ..operators import reduce as R
from ..operators import resample as RS
from ..operators import vector as VC
from ..sinks.result import Result
from .catalogue import PROCESSES
from .graph import Graph, ancestors, parse, suggest

Handler = Callable[["Run", dict], Any]
_HANDLERS: dict[str, Handler] = {}


def process(name: str) -> Callable[[Handler], Handler]:
    """Register a process; the last one of a name wins."""

    def keep(f: Handler) -> Handler:
        _HANDLERS[name] = f
        return f

    return keep


def process_ids() -> list[str]:
    return sorted(_HANDLERS)


@dataclass
class Run:
    spark: SparkSession
    #: (id, spatial_extent, temporal_extent, bands, properties, limit) -> Cube
    loader: Callable[..., Cube]
    all_bands: bool = False

    def need(self, args: dict, *names: str) -> Any:
        for n in names:
            if n in args:
                return args[n]
        raise GraphError(f"missing argument {names[0]!r}")

    def cube(self, args: dict, *names: str) -> Cube:
        value = self.need(args, *names)
        if not isinstance(value, Cube):
            raise GraphError(f"{names[0]!r} is not a cube")
        return value


def validate(document: dict) -> list[dict]:
    """Errors (code, message) of a graph: its structure, then process names that are not known."""
    try:
        graph = parse(document)
    except GraphError as x:
        return [{"code": x.code, "message": str(x)}]
    return [{"code": UnknownProcess.code, "message": _unknown(n.process)} for n in graph.nodes.values() if n.process not in _HANDLERS]


def _unknown(name: str) -> str:
    return f"unknown process {name!r}{suggest(name, _HANDLERS)}"


def execute(spark: SparkSession, document: dict, loader: Callable[..., Cube], all_bands: bool = False) -> Any:
    """The result node's value: a Cube, a DataFrame, a Result to be written, or a plain value. Nothing has run yet."""
    graph: Graph = parse(document)
    for n in graph.nodes.values():
        if n.process not in _HANDLERS:
            raise UnknownProcess(_unknown(n.process))
    run, made = Run(spark, loader, all_bands), {}
    wanted = ancestors(graph, graph.result)
    for name in graph.order:
        if name in wanted:
            node = graph.nodes[name]
            made[name] = _HANDLERS[node.process](run, {k: _resolve(v, made) for k, v in node.arguments.items()})
    return made[graph.result]


def _resolve(value: Any, made: dict) -> Any:
    if isinstance(value, dict):
        if "from_node" in value:
            return made[value["from_node"]]
        if "process_graph" in value:
            return value
        return {k: _resolve(v, made) for k, v in value.items()}
    if isinstance(value, list):
        return [_resolve(v, made) for v in value]
    return value


@process("load_collection")
def _load(run: Run, args: dict) -> Cube:
    return run.loader(run.need(args, "id"), args.get("spatial_extent"), args.get("temporal_extent"), args.get("bands"), args.get("properties"), args.get("limit"))


@process("save_result")
def _save(run: Run, args: dict) -> Result:
    return Result.of(run.need(args, "data"), args.get("format"), args.get("options") or {})


@process("apply")
def _apply(run: Run, args: dict) -> Cube:
    return A.apply(run.cube(args, "data"), args.get("process"))


@process("ndvi")
def _ndvi(run: Run, args: dict) -> Cube:
    return A.ndvi(run.cube(args, "data"), args.get("nir") or "B08", args.get("red") or "B04", args.get("target_band") or "ndvi")


@process("reduce_dimension")
def _reduce(run: Run, args: dict) -> Cube:
    return R.reduce_dimension(run.cube(args, "data"), run.need(args, "reducer"), run.need(args, "dimension"), run.all_bands)


@process("mask")
def _mask(run: Run, args: dict) -> Cube:
    return M.mask(run.cube(args, "data"), run.cube(args, "mask"), args.get("replacement"))


@process("mask_scl_dilation")
def _mask_scl(run: Run, args: dict) -> Cube:
    return M.mask_scl(run.cube(args, "data"), args.get("scl_band_name") or "SCL", args.get("mask2_values"))


@process("mask_from_values")
def _mask_values(run: Run, args: dict) -> Cube:
    return M.mask_from_values(run.cube(args, "data"), args.get("band") or "SCL", args.get("values"), args.get("target_band") or "mask")


@process("merge_cubes")
def _merge(run: Run, args: dict) -> Cube:
    return MG.merge_cubes(run.cube(args, "cube1", "data1"), run.cube(args, "cube2", "data2"), args.get("overlap_resolver"))


@process("filter_temporal")
def _filter_temporal(run: Run, args: dict) -> Cube:
    return FL.filter_temporal(run.cube(args, "data"), run.need(args, "extent"))


@process("filter_bbox")
def _filter_bbox(run: Run, args: dict) -> Cube:
    return FL.filter_bbox(run.cube(args, "data"), run.need(args, "extent"))


@process("filter_spatial")
def _filter_spatial(run: Run, args: dict) -> Cube:
    return FL.filter_spatial(run.cube(args, "data"), run.need(args, "geometries"))


@process("filter_bands")
def _filter_bands(run: Run, args: dict) -> Cube:
    return FL.filter_bands(run.cube(args, "data"), run.need(args, "bands"))


@process("rename_labels")
def _rename(run: Run, args: dict) -> Cube:
    return FL.rename_labels(run.cube(args, "data"), run.need(args, "dimension"), run.need(args, "target"), args.get("source"))


@process("add_dimension")
def _add_dimension(run: Run, args: dict) -> Cube:
    return FL.add_dimension(run.cube(args, "data"), run.need(args, "name"), run.need(args, "label"))


@process("drop_dimension")
def _drop_dimension(run: Run, args: dict) -> Cube:
    return FL.drop_dimension(run.cube(args, "data"), run.need(args, "name"))


@process("resample_spatial")
def _resample(run: Run, args: dict) -> Cube:
    return RS.resample_spatial(run.cube(args, "data"), run.need(args, "projection"), args.get("resolution") or 0)


@process("aggregate_spatial")
def _aggregate_spatial(run: Run, args: dict) -> DataFrame:
    return VC.aggregate_spatial(run.cube(args, "data"), run.need(args, "geometries"), run.need(args, "reducer"))


@process("aggregate_spatial_polygon")
def _aggregate_polygon(run: Run, args: dict) -> DataFrame:
    return VC.aggregate_spatial_polygon(run.cube(args, "data"), run.need(args, "geometries"))


@process("aggregate_spatial_point")
def _aggregate_point(run: Run, args: dict) -> DataFrame:
    return VC.aggregate_spatial_point(run.cube(args, "data"), run.need(args, "points"))


@process("zonal_histogram")
def _zonal_histogram(run: Run, args: dict) -> DataFrame:
    return R.zonal_histogram(run.cube(args, "data"), run.cube(args, "mask"))


@process("fit_classifier")
def _fit(run: Run, args: dict) -> dict:
    return {"model": ml.fit_rows(run.need(args, "x"), run.need(args, "y"), int(args.get("iterations") or 200), float(args.get("lr") or 0.05))}


@process("predict_classifier")
def _predict(run: Run, args: dict) -> list[int]:
    return ml.predict_rows(run.need(args, "model"), run.need(args, "x"))


def _plain(name: str, f: Callable[..., Any]) -> None:
    parameters = next(p["parameters"] for p in PROCESSES if p["id"] == name)
    allowed = [p.lstrip("*") for p in parameters]

    def handle(run: Run, args: dict) -> Any:
        for p in parameters:
            if not p.startswith("*"):
                run.need(args, p)
        given = {k: v for k, v in args.items() if k in allowed}
        try:
            value = f(**given)
        except (TypeError, ValueError, OverflowError, IndexError) as x:
            raise BackendError(f"{name}: {x}") from x
        return None if isinstance(value, float) and not math.isfinite(value) else value

    _HANDLERS[name] = handle


for _name, _f in V.PLAIN.items():
    _plain(_name, _f)
