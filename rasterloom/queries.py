"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .etl.pipeline import first_rows
from .functions import arrays as AR
from .functions import qa
from .model import Base, Cube
from .operators import filters as FL
from .operators import mask as M
from .operators import merge as MG
from .operators import ml
from .operators import reduce as R
from .operators import resample as RS
from .operators import sampling as SM
from .operators import vector as VC
from .operators.apply import apply, ndvi
from .plans.callback import REDUCERS, compile_apply
from .plans.executor import execute
from .sinks.result import stretched
from .sources import scenes as SC
from .sources.tables import lineitem_cube, lineitem_loader

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GRID = 32

#: the fixture cube in SQL: c(scene, yr, y, x, b03, b04, b08, scl), m with cloud classes masked, n with the index
CUBE = """
c0 as (
  select year(l_shipdate) as yr, cast(l_orderkey % 32 as int) as y, cast(l_partkey % 32 as int) as x,
         cast(sum(l_linenumber) as int) * 100 as b03, cast(floor(max(l_quantity)) as int) * 100 as b04,
         cast(floor(max(l_extendedprice)) as int) % 10000 as b08, cast(min(l_orderkey) % 12 as int) as scl
  from lineitem group by 1, 2, 3
), c as (select *, cast(dense_rank() over (order by yr) - 1 as int) as scene from c0),
m as (select scene, y, x, scl, case when scl in (3,8,9,10,11) then null else b03 end as b03,
             case when scl in (3,8,9,10,11) then null else b04 end as b04, case when scl in (3,8,9,10,11) then null else b08 end as b08 from c),
n as (select scene, y, x, b03, scl, case when b08 > 0 and b04 > 0 and abs(b08 + b04) >= 1 then cast(b08 - b04 as double) / (b08 + b04) end as ndvi from m)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql if sql.startswith("with ") else f"with {CUBE}{sql}" if sql.startswith(",") else f"with {CUBE} {sql}"
        return f

    return keep


def _cube(spark: SparkSession, sf_dir: str) -> Cube:
    return lineitem_cube(spark, sf_dir, GRID)


def _rows(cube: Cube) -> DataFrame:
    return cube.frame().drop("t")


def _call(process: str, **arguments: object) -> dict:
    return {"process_graph": {"f": {"process_id": process, "arguments": arguments, "result": True}}}


X, DATA = {"from_parameter": "x"}, {"from_parameter": "data"}


# ---- filters ----


@query("load_filter_bbox", 'select scene, y - 4 as y, x - 4 as x, b03 as "B03", b04 as "B04", b08 as "B08", scl as "SCL" from c where y between 4 and 23 and x between 4 and 19')
def _(spark, d):
    return _rows(FL.filter_bbox(_cube(spark, d), {"west": 4, "south": 8, "east": 20, "north": 28}))


@query("filter_spatial", 'select scene, y - 2 as y, x - 3 as x, b04 as "B04" from c where y between 2 and 21 and x between 3 and 29')
def _(spark, d):
    shape = {"type": "Polygon", "coordinates": [[[3, 10], [30, 10], [16, 30], [3, 10]]]}
    return _rows(FL.filter_bands(FL.filter_spatial(_cube(spark, d), shape), ["B04"]))


@query("filter_temporal", 'select cast(dense_rank() over (order by scene) - 1 as int) as scene, y, x, b04 as "B04" from c where yr between 1997 and 1999')
def _(spark, d):
    return _rows(FL.filter_bands(FL.filter_temporal(_cube(spark, d), ["1996-06-01", "1999-12-31"]), ["B04"]))


@query("filter_bands", 'select scene, y, x, b04 as "B04", scl as "SCL" from c')
def _(spark, d):
    return _rows(FL.filter_bands(_cube(spark, d), ["B04", "SCL"]))


@query("rename_labels", 'select scene, y, x, b03 as "B03", b04 as red, b08 as nir, scl as "SCL" from c')
def _(spark, d):
    return _rows(FL.rename_labels(_cube(spark, d), "bands", ["red", "nir"], ["B04", "B08"]))


@query("dimension_round_trip", 'select scene, y, x, b08 as "B08" from c')
def _(spark, d):
    return _rows(FL.filter_bands(FL.drop_dimension(FL.add_dimension(_cube(spark, d), "level", "L2A"), "level"), ["B08"]))


@query("select_layer", 'select scene, y, x, b04 as "B04" from c')
def _(spark, d):
    return _rows(FL.select_layer(_cube(spark, d), 1))


@query("trim_border", 'select scene, y - 3 as y, x - 3 as x, b04 as "B04" from c where y between 3 and 28 and x between 3 and 28')
def _(spark, d):
    return _rows(FL.filter_bands(FL.trim_border(_cube(spark, d), 3), ["B04"]))


@query("fill_missing", "select scene, y, x, coalesce(ndvi, -1.0) as ndvi from n")
def _(spark, d):
    return _rows(FL.fill_missing(FL.filter_bands(ndvi(M.mask_scl(_cube(spark, d))), ["ndvi"]), -1))


# ---- masks and maps ----


@query("mask_scl", 'select scene, y, x, b03 as "B03", b04 as "B04", b08 as "B08", scl as "SCL" from m')
def _(spark, d):
    return _rows(M.mask_scl(_cube(spark, d)))


@query("mask_from_values", "select scene, y, x, case when scl in (4, 5) then 1 else 0 end as mask from c")
def _(spark, d):
    return _rows(M.mask_from_values(_cube(spark, d), "SCL", [4, 5]))


@query("mask_replacement", "select scene, y, x, cast(case when scl in (3,8,9,10,11) then -1 else b04 end as double) as \"B04\", cast(case when scl in (3,8,9,10,11) then -1 else b08 end as double) as \"B08\" from c")
def _(spark, d):
    cube = _cube(spark, d)
    return _rows(M.mask(FL.filter_bands(cube, ["B04", "B08"]), M.mask_from_values(cube), -1))


@query("mask_join", 'select c.scene, c.y, c.x, case when k.scene is not null and k.scl not in (3,8,9,10,11) then cast(c.b04 as double) end as "B04" from c left join c k on k.scene = c.scene and k.y = c.y and k.x = c.x and k.b04 > 2000')
def _(spark, d):
    # a mask of another base: pixels that it lacks are masked
    other = _cube(spark, d).where(F.col("B04") > 2000)
    return _rows(M.mask(FL.filter_bands(_cube(spark, d), ["B04"]), M.mask_from_values(other)))


@query("ndvi", 'select scene, y, x, b03 as "B03", scl as "SCL", ndvi from n')
def _(spark, d):
    return _rows(ndvi(M.mask_scl(_cube(spark, d))))


@query("apply_clip", "select scene, y, x, case when ndvi is not null then least(greatest(ndvi, 0.0), 0.5) end as ndvi from n")
def _(spark, d):
    cube = FL.filter_bands(ndvi(M.mask_scl(_cube(spark, d))), ["ndvi"])
    return _rows(apply(cube, _call("clip", x=X, min=0, max=0.5)))


@query("apply_linear_scale", "select scene, y, x, round((ndvi - -1.0) / 2.0 * 255.0, 6) as ndvi from n")
def _(spark, d):
    cube = FL.filter_bands(ndvi(M.mask_scl(_cube(spark, d))), ["ndvi"])
    return _rows(apply(cube, _call("linear_scale_range", x=X, inputMin=-1, inputMax=1, outputMin=0, outputMax=255))).withColumn("ndvi", F.round("ndvi", 6))


@query("apply_scale_offset", 'select scene, y, x, round((b04 * 0.0001 - 0.1) * 2, 9) as "B04" from c')
def _(spark, d):
    cube = replace(FL.filter_bands(_cube(spark, d), ["B04"]), scales={"B04": (0.0001, -0.1)})
    return _rows(apply(cube, _call("multiply", x=X, y=2))).withColumn("B04", F.round("B04", 9))


_V = "case when v is not null then {} end"
_MATH = {
    "absolute": (_call("absolute", x=X), "abs(v)"),
    "sqrt": (_call("sqrt", x=X), "case when v >= 0 then sqrt(v) end"),
    "exp": (_call("exp", p=X), "exp(v)"),
    "ln": (_call("ln", x=X), "case when v > 0 then ln(v) end"),
    "log": (_call("log", x=X, base=10), "case when v > 0 then ln(v) / ln(10) end"),
    "sgn": (_call("sgn", x=X), "cast(sign(v) as double)"),
    "floor": (_call("floor", x=X), "floor(v)"),
    "ceil": (_call("ceil", x=X), "ceil(v)"),
    "int": (_call("int", x=X), "trunc(v)"),
    "round": (_call("round", x=X, p=1), "round_even(v * 10, 0) / 10"),
    "power": (_call("power", base=X, p=3), "v * v * v"),
    "mod": (_call("mod", x=X, y=-3), "v + 3 * floor(v / -3.0)"),
    "add": (_call("add", x=X, y=1), "v + 1"),
    "subtract": (_call("subtract", x=1, y=X), "1 - v"),
    "multiply": (_call("multiply", x=X, y=X), "v * v"),
    "divide": (_call("divide", x=1, y=X), "case when v <> 0 then 1 / v end"),
    "normalized_difference": (_call("normalized_difference", x=X, y=1), "case when v + 1 <> 0 then (v - 1) / (v + 1) end"),
    "sin": (_call("sin", x=X), "sin(v)"),
    "cos": (_call("cos", x=X), "cos(v)"),
    "tan": (_call("tan", x=X), "tan(v)"),
    "arcsin": (_call("arcsin", x=X), "case when abs(v) <= 1 then asin(v) end"),
    "arccos": (_call("arccos", x=X), "case when abs(v) <= 1 then acos(v) end"),
    "arctan": (_call("arctan", x=X), "atan(v)"),
    "arctan2": (_call("arctan2", y=X, x=2), "atan2(v, 2)"),
    "min": (_call("min", x=X, y=0), "least(v, 0)"),
    "max": (_call("max", data=[X, 0]), "greatest(v, 0)"),
}
_LOGIC = {
    "eq": (_call("eq", x=X, y=0.5, delta=0.1), "abs(v - 0.5) <= 0.1"),
    "neq": (_call("neq", x=X, y=0), "v <> 0"),
    "gt": (_call("gt", x=X, y=0.25), "v > 0.25"),
    "gte": (_call("gte", x=X, y=0), "v >= 0"),
    "lt": (_call("lt", x=X, y=0), "v < 0"),
    "lte": (_call("lte", x=X, y=0.25), "v <= 0.25"),
    "between": (_call("between", x=X, min=0, max=0.5), "v between 0 and 0.5"),
    "and": (_call("and", x=X, y=1), "v <> 0"),
    "or": (_call("or", x=X, y=0), "v <> 0"),
    "not": (_call("not", x=X), "v = 0"),
    "xor": (_call("xor", x=X, y=1), "v = 0"),
}


def _scaled(spark, d) -> DataFrame:
    """The index times 3, so that values reach beyond 1 and -1."""
    cube = FL.filter_bands(ndvi(M.mask_scl(_cube(spark, d))), ["ndvi"])
    return _rows(cube).withColumn("v", F.col("ndvi") * 3).select("scene", "y", "x", "v")


def _columns(table: dict, places: int) -> str:
    return ", ".join(f"round(cast({_V.format(sql)} as double), {places}) as r_{name}" for name, (_, sql) in table.items())


@query("apply_math_all", f"select scene, y, x, {_columns(_MATH, 6)} from (select scene, y, x, ndvi * 3 as v from n)")
def _(spark, d):
    v = F.col("v")
    return _scaled(spark, d).select("scene", "y", "x", *(F.round(compile_apply(callback, v), 6).alias(f"r_{name}") for name, (callback, _) in _MATH.items()))


@query("apply_logic", f"select scene, y, x, {_columns(_LOGIC, 0)} from (select scene, y, x, ndvi * 3 as v from n)")
def _(spark, d):
    v = F.col("v")
    return _scaled(spark, d).select("scene", "y", "x", *(compile_apply(callback, v).alias(f"r_{name}") for name, (callback, _) in _LOGIC.items()))


# ---- reductions ----

_REDUCE_SQL = {
    "mean": "avg(ndvi)",
    "min": "min(ndvi)",
    "max": "max(ndvi)",
    "sum": "sum(ndvi)",
    "count": "cast(nullif(count(ndvi), 0) as double)",
    "first": "min_by(ndvi, case when ndvi is not null then scene end)",
    "last": "max_by(ndvi, case when ndvi is not null then scene end)",
    "median": "median(ndvi)",
    "variance": "case when count(ndvi) = 1 then 0 else var_samp(ndvi) end",
    "sd": "case when count(ndvi) = 1 then 0 else stddev_samp(ndvi) end",
}


def _reduced(name: str) -> Query:
    def run(spark, d):
        cube = R.reduce_dimension(ndvi(M.mask_scl(_cube(spark, d))), _call(name, data=DATA), "t")
        return _rows(cube).withColumn("ndvi", F.round("ndvi", 6))

    return run


for _name in REDUCERS:
    query(f"reduce_t_{_name}", f"select y, x, round({_REDUCE_SQL[_name]}, 6) as ndvi from n group by y, x")(_reduced(_name))

RANGE = {
    "process_graph": {
        "mx": {"process_id": "max", "arguments": {"data": DATA}},
        "mn": {"process_id": "min", "arguments": {"data": DATA}},
        "d": {"process_id": "subtract", "arguments": {"x": {"from_node": "mx"}, "y": {"from_node": "mn"}}, "result": True},
    }
}


@query("reduce_t_range_callback", "select y, x, round(max(ndvi) - min(ndvi), 9) as ndvi from n group by y, x")
def _(spark, d):
    return _rows(R.reduce_dimension(ndvi(M.mask_scl(_cube(spark, d))), RANGE, "t")).withColumn("ndvi", F.round("ndvi", 9))


@query("reduce_t_all_bands", 'select y, x, max(b03) as "B03", max(b04) as "B04", max(b08) as "B08" from m group by y, x')
def _(spark, d):
    cube = R.reduce_dimension(M.mask_scl(_cube(spark, d)), _call("max", data=DATA), "t", all_bands=True)
    return cube.frame().select("y", "x", *(F.col(b).cast("int").alias(b) for b in cube.names))


_BANDS_SQL = {
    "mean": "(b03 + b04 + b08) / 3.0",
    "min": "least(b03, b04, b08)",
    "max": "greatest(b03, b04, b08)",
    "sum": "b03 + b04 + b08",
    "count": "case when b03 is not null then 3 end",
    "first": "b03",
    "last": "b08",
    "median": "b03 + b04 + b08 - least(b03, b04, b08) - greatest(b03, b04, b08)",
    "variance": "((b03 - q) * (b03 - q) + (b04 - q) * (b04 - q) + (b08 - q) * (b08 - q)) / 2",
    "sd": "sqrt(((b03 - q) * (b03 - q) + (b04 - q) * (b04 - q) + (b08 - q) * (b08 - q)) / 2)",
}


def _reduced_bands(name: str) -> Query:
    def run(spark, d):
        return _rows(R.reduce_dimension(M.mask_scl(_cube(spark, d)), _call(name, data=DATA), "bands")).withColumn("result", F.round("result", 4))

    return run


for _name in REDUCERS:
    query(f"reduce_bands_{_name}", f"select scene, y, x, round(cast({_BANDS_SQL[_name]} as double), 4) as result from (select *, (b03 + b04 + b08) / 3.0 as q from m)")(_reduced_bands(_name))


@query("sum_dimension_t", 'select y, x, case when count(b04) = count(*) then sum(cast(b04 as double)) end as "B04" from m group by y, x')
def _(spark, d):
    return R.sum_dimension(FL.filter_bands(M.mask_scl(_cube(spark, d)), ["B04"]), "t")


@query("argmax_band", "select scene, y, x, case when b03 >= b04 and b03 >= b08 then 0 when b04 >= b08 then 1 else 2 end as best from c")
def _(spark, d):
    return _cube(spark, d).frame().select("scene", "y", "x", R.argmax(F.array("B03", "B04", "B08")).alias("best"))


@query("overview_avg", 'select scene, cast(floor(y / 4) as int) as y, cast(floor(x / 4) as int) as x, round(avg(b04), 6) as "B04" from m group by 1, 2, 3')
def _(spark, d):
    return _rows(R.overview(FL.filter_bands(M.mask_scl(_cube(spark, d)), ["B04"]), 4)).withColumn("B04", F.round("B04", 6))


@query("png_stretch", "select y, x, cast(coalesce(round_even((b08 - lo) / greatest(hi - lo, 1.1920928955078125e-07) * 255, 0), 0) as int) as gray from (select y, x, cast(b08 as double) as b08, min(b08) over () as lo, max(b08) over () as hi from m where scene = 0)")
def _(spark, d):
    return stretched(FL.filter_bands(M.mask_scl(_cube(spark, d)), ["B08"]))


# ---- combinations ----


@query("merge_band_join", 'select coalesce(a.scene, b.scene) as scene, coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x, a.b04 as "B04", b.b08 as "B08" from (select * from c where b04 > 2500) a full join (select * from c where b08 > 5000) b on a.scene = b.scene and a.y = b.y and a.x = b.x')
def _(spark, d):
    one = FL.filter_bands(_cube(spark, d).where(F.col("B04") > 2500), ["B04"])
    two = FL.filter_bands(_cube(spark, d).where(F.col("B08") > 5000), ["B08"])
    return _rows(MG.merge_cubes(one, two))


def _overlap(name: str) -> Query:
    def run(spark, d):
        one = FL.filter_bands(_cube(spark, d).where(F.col("B04") > 2500), ["B04"])
        two = FL.rename_labels(FL.filter_bands(_cube(spark, d).where(F.col("B08") > 5000), ["B08"]), "bands", ["B04"], ["B08"])
        return _rows(MG.merge_cubes(one, two, _call(name, data=DATA)))

    return run


for _name, _sql in (("sum", "coalesce(a.b04, 0) + coalesce(b.b08, 0)"), ("mean", "(coalesce(a.b04, b.b08) + coalesce(b.b08, a.b04)) / 2.0"), ("first", "coalesce(a.b04, b.b08)")):
    query(f"merge_overlap_{_name}", f'select coalesce(a.scene, b.scene) as scene, coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x, cast({_sql} as double) as "B04" from (select * from c where b04 > 2500) a full join (select * from c where b08 > 5000) b on a.scene = b.scene and a.y = b.y and a.x = b.x')(_overlap(_name))


@query("merge_mosaic", 'select coalesce(a.scene, b.scene) as scene, coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x, coalesce(b.b08, a.b04) as "B04" from (select * from c where b04 > 2500) a full join (select * from c where b08 > 5000) b on a.scene = b.scene and a.y = b.y and a.x = b.x')
def _(spark, d):
    one = FL.filter_bands(_cube(spark, d).where(F.col("B04") > 2500), ["B04"])
    two = FL.rename_labels(FL.filter_bands(_cube(spark, d).where(F.col("B08") > 5000), ["B08"]), "bands", ["B04"], ["B08"])
    return _rows(MG.merge_cubes(one, two))


@query("extend_time", 'select scene, y, x, b04 as "B04" from c union all select scene + (select count(distinct scene) from c), y, x, b04 from c')
def _(spark, d):
    one = FL.filter_bands(_cube(spark, d), ["B04"])
    return _rows(MG.extend(one, one)).select(F.col("scene").cast("bigint").alias("scene"), "y", "x", "B04")


@query("stack_layers", 'select scene, y, x, b04 as "B04", b04 as "B04_1", b08 as "B08" from c')
def _(spark, d):
    return _rows(MG.stack(FL.filter_bands(_cube(spark, d), ["B04", "B08"]), FL.filter_bands(_cube(spark, d), ["B04"])))


@query("scl_nearest", 'select f.scene, f.y, f.x, f.b04 as "B04", k.scl as "SCL" from c f left join (select * from c where y < 16 and x < 16) k on k.scene = f.scene and k.y = cast(floor(f.y * 0.5) as int) and k.x = cast(floor(f.x * 0.5) as int)')
def _(spark, d):
    fine = _cube(spark, d).frame().select("scene", "y", "x", "B04")
    coarse = _cube(spark, d).frame().where("y < 16 and x < 16")
    return M.nearest_class(fine, coarse, 0.5, 0.5)


# ---- vectors and samples ----

RINGS = [[(2.0, 3.0), (20.0, 3.0), (20.0, 17.0), (2.0, 17.0)], [(1.0, 1.0), (30.0, 9.0), (12.0, 29.0)], [(100.0, 100.0), (110.0, 100.0), (110.0, 120.0)]]


def _inside_sql(ring: list[tuple[float, float]]) -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay != by:
            spans = f"(({ay} <= y + 0.5 and y + 0.5 < {by}) or ({by} <= y + 0.5 and y + 0.5 < {ay}))"
            parts.append(f"case when {spans} and x + 0.5 < {ax} + (y + 0.5 - {ay}) * ({bx} - {ax}) / ({by} - {ay}) then 1 else 0 end")
    return f"({' + '.join(parts)}) % 2 = 1"


_RINGS_SQL = " union all ".join(f"select {i} as geometry, scene, y, x, b04, ndvi from (select n.*, c.b04 from n join c using (scene, y, x)) where {_inside_sql(r)}" for i, r in enumerate(RINGS))
_GEOMETRIES = "(select unnest([0, 1, 2]) as geometry)"


@query("aggregate_polygon_mean", f"select g.geometry, round(case when count(p.b04) > 0 and count(p.b04) = count(*) then avg(p.b04) end, 6) as mean from {_GEOMETRIES} g left join ({_RINGS_SQL}) p on p.geometry = g.geometry and p.scene = 0 group by g.geometry")
def _(spark, d):
    out = VC.aggregate_spatial_polygon(FL.filter_bands(_cube(spark, d), ["B04"]), [[*r] for r in RINGS])
    return out.select("geometry", F.round("mean", 6).alias("mean"))


def _spatial(name: str) -> Query:
    def run(spark, d):
        world = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[x, GRID - y] for x, y in r]]}} for r in RINGS]}
        out = VC.aggregate_spatial(ndvi(M.mask_scl(_cube(spark, d))), world, _call(name, data=DATA))
        return out.select("geometry", "scene", F.round("value", 6).alias("value"))

    return run


for _name in ("mean", "max", "count", "median"):
    query(f"aggregate_spatial_{_name}", f"select g.geometry, s.scene, round(p.value, 6) as value from {_GEOMETRIES} g cross join (select distinct scene from c) s left join (select geometry, scene, {_REDUCE_SQL[_name]} as value from ({_RINGS_SQL}) group by 1, 2) p on p.geometry = g.geometry and p.scene = s.scene")(_spatial(_name))


@query("aggregate_points", 'select p.point, c.b04 as value from (select unnest([0, 1, 2, 3]) as point, unnest([4, 9, 31, 40]) as x, unnest([3, 12, 31, 2]) as y) p left join c on c.scene = 0 and c.y = p.y and c.x = p.x')
def _(spark, d):
    points = [(4.5, 28.5), (9.0, 20.0), (31.9, 0.1), (40.0, 29.5)]
    return VC.aggregate_spatial_point(FL.filter_bands(_cube(spark, d), ["B04"]), points)


@query("sample_customers", 'select cast(c_custkey as bigint) as point, k.b04 as value from customer left join c k on k.scene = 0 and k.y = c_custkey % 40 and k.x = c_nationkey')
def _(spark, d):
    points = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("point"), (F.col("c_nationkey") + 0.25).alias("wx"), (GRID - 0.25 - F.col("c_custkey") % 40).alias("wy"))
    return SM.sample_points(FL.filter_bands(_cube(spark, d), ["B04"]), points)


@query("block_place", "select scene, y, x, cast(floor(y / 10) * 4 + floor(x / 10) as int) as block, y % 10 as row, x % 10 as col from c")
def _(spark, d):
    block, row, col = SM.block_place(F.col("y"), F.col("x"), GRID, 10)
    return _cube(spark, d).frame().select("scene", "y", "x", block.alias("block"), row.alias("row"), col.alias("col"))


@query("extract_pixels", 'select cast(p.seq as bigint) as seq, c.scene, p.y, p.x, c.b04 as "B04", c.b08 as "B08" from (select unnest(range(10)) as seq, cast(unnest(range(10)) * 3 as int) as y, cast(31 - unnest(range(10)) as int) as x) p left join c on c.y = p.y and c.x = p.x')
def _(spark, d):
    at = spark.range(10).select(F.col("id").alias("seq"), (F.col("id") * 3).cast("int").alias("y"), (31 - F.col("id")).cast("int").alias("x"))
    return SM.extract(_cube(spark, d), at, ["B04", "B08"]).drop("t").select("seq", "scene", "y", "x", "B04", "B08")


_TRIANGLE = [(2.0, 1.0), (29.0, 6.0), (9.0, 30.0)]


@query("rasterize_polygons", f"with grid as (select cast(a.v as int) as y, cast(b.v as int) as x from (select unnest(range(32)) as v) a, (select unnest(range(32)) as v) b) select y, x, cast(case when {_inside_sql(_TRIANGLE)} then 2 when {_inside_sql(RINGS[0])} then 1 else 0 end as double) as v from grid")
def _(spark, d):
    return VC.rasterize(spark, [RINGS[0], _TRIANGLE], GRID, GRID, [1, 2])


@query("zonal_histogram", "select cast(b04 as int) as value, count(*) as n from c where scl in (4, 5, 6) group by b04")
def _(spark, d):
    cube = _cube(spark, d)
    return R.zonal_histogram(FL.filter_bands(cube, ["B04"]), M.mask_from_values(cube, "SCL", [4, 5, 6]))


def _resample_sql() -> str:
    """Target pixels with the source pixel that their centre falls in; the grid comes from the same rule as the operator's."""
    shape = Cube(Base(None), {}, transform=(0.0, 1.0, 0.0, float(GRID), 0.0, -1.0), shape=(GRID, GRID))
    (x0, dx, _, y0, _, dy), (rows, cols) = RS.target_grid(shape, 3857)
    lon, lat = f"(((tx + 0.5) * {dx!r}::double + {x0!r}::double) * 180 / pi() / 6378137.0)", f"(atan(sinh(((ty + 0.5) * {dy!r}::double + {y0!r}::double) / 6378137.0)) * 180 / pi())"
    grid = f"select cast(a.v as int) as ty, cast(b.v as int) as tx from (select unnest(range({rows})) as v) a, (select unnest(range({cols})) as v) b"
    target = f"select ty, tx, cast(floor({lon}) as int) as x, cast(floor({GRID} - {lat}) as int) as y from ({grid})"
    return f'select c.scene, k.ty as y, k.tx as x, c.b04 as "B04" from c join ({target}) k on k.x = c.x and k.y = c.y'


@query("resample_spatial", _resample_sql())
def _(spark, d):
    return _rows(RS.resample_spatial(FL.filter_bands(_cube(spark, d), ["B04"]), "EPSG:3857"))


# ---- arrays ----


def _arrays(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    value = F.when(F.col("l_quantity") > 5, F.floor("l_quantity").cast("double"))
    # an order has a handful of lines, so its array is bounded
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", value.alias("v"))))
    return rows.groupBy("l_orderkey").agg(F.transform(listed, lambda s: s["v"]).alias("a"))


def _text(c):
    return F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("bigint").cast("string"), F.lit("-"))), ",")


_ARRAYS = "a as (select l_orderkey, list(case when l_quantity > 5 then cast(floor(l_quantity) as bigint) end order by l_linenumber, l_partkey, case when l_quantity > 5 then floor(l_quantity) end nulls first) as a from lineitem group by l_orderkey)"


def _list_sql(expression: str) -> str:
    return f"list_aggregate(list_transform({expression}, lambda v: coalesce(cast(v as varchar), '-')), 'string_agg', ',')"


_FULL = "list_filter(a, lambda v: v is not null)"
_POSITIONS = "list_filter(range(len(a)), lambda i: a[i + 1] is not null)"
_ARRAY_QUERIES = {
    "element": (lambda a: AR.array_element(a, 1, True).cast("bigint"), "a[2]"),
    "find": (lambda a: AR.array_find(a, F.lit(20.0)).cast("bigint"), "list_position(a, 20) - 1"),
    "contains": (lambda a: AR.array_contains(a, F.lit(20.0)), "coalesce(list_contains(a, 20), false)"),
    "contains_null": (lambda a: AR.array_contains(a, F.lit(None).cast("double")), "len(list_filter(a, lambda v: v is null)) > 0"),
    "concat": (lambda a: _text(AR.array_concat(a, a)), _list_sql("list_concat(a, a)")),
    "append": (lambda a: _text(AR.array_append(a, F.lit(7.0))), _list_sql("list_append(a, 7)")),
    "create": (lambda a: _text(AR.array_create(a, 2)), _list_sql("list_concat(a, a)")),
    "count": (lambda a: AR.count(a).cast("bigint"), f"cast(len({_FULL}) as bigint)"),
    "sort": (lambda a: _text(AR.sort(a)), f"coalesce({_list_sql(f'list_sort({_FULL})')}, '')"),
    "sort_desc_nodata": (lambda a: _text(AR.sort(a, False, True)), _list_sql(f"list_concat(list_reverse_sort({_FULL}), list_filter(a, lambda v: v is null))")),
    "order": (lambda a: _text(AR.order(a)), f"coalesce({_list_sql(f'list_transform(list_sort(list_transform({_POSITIONS}, lambda i: a[i + 1] * 1000 + i)), lambda k: k % 1000)')}, '')"),
    "order_desc": (lambda a: _text(AR.order(a, False)), f"coalesce({_list_sql(f'list_transform(list_sort(list_transform({_POSITIONS}, lambda i: (1000 - a[i + 1]) * 1000 + i)), lambda k: k % 1000)')}, '')"),
}


def _array_query(f) -> Query:
    return lambda spark, d: _arrays(spark, d).select("l_orderkey", f(F.col("a")).alias("r"))


for _name, (_f, _sql) in _ARRAY_QUERIES.items():
    query(f"array_{_name}")(_array_query(_f))
    SQL[f"array_{_name}"] = f"with {_ARRAYS} select l_orderkey, {_sql} as r from a"


# ---- quality, classes, learning ----


@query("qa_landsat_decode")
def _(spark, d):
    v = (F.col("l_partkey") * 37 % 65536).cast("int")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", v.alias("v"))
    v = F.col("v")
    return rows.select("l_orderkey", "l_linenumber", "v", qa.qa_to_mask(v).alias("code"), qa.qa_is_clear(v).alias("is_clear"), qa.qa_flag(v, "water").alias("water"), qa.qa_confidence(v, "cloud_confidence").alias("cloud_confidence"))


SQL["qa_landsat_decode"] = """
with r as (select l_orderkey, l_linenumber, cast(l_partkey * 37 % 65536 as int) as v from lineitem)
select l_orderkey, l_linenumber, v,
  case when v & 1 <> 0 then 0 when v & 8 <> 0 or v & 2 <> 0 then 2 when v & 16 <> 0 then 3 when v & 4 <> 0 then 2
       when v & 32 <> 0 then 4 when v & 128 <> 0 then 5 else 1 end as code,
  (v & 64) <> 0 and (v & 60) = 0 as is_clear, (v & 128) <> 0 as water, (v >> 8) & 3 as cloud_confidence
from r
"""


@query("scl_to_maskvalue", "select scene, y, x, case scl when 0 then 0 when 1 then 6 when 3 then 3 when 6 then 5 when 8 then 2 when 9 then 2 when 10 then 2 when 11 then 4 else 1 end as code, scl in (4,5,6,7,11) as is_clear from c")
def _(spark, d):
    s = F.col("SCL")
    return _cube(spark, d).frame().select("scene", "y", "x", qa.scl_to_mask(s).alias("code"), qa.scl_is_clear(s).alias("is_clear"))


@query("cloud_brightness", "select scene, y, x, case when b03 >= 2000 and b08 >= 2000 and b04 >= 1500 then 1 else 0 end as cloud from c")
def _(spark, d):
    return _cube(spark, d).frame().select("scene", "y", "x", qa.bright_cloud(F.col("B03"), F.col("B08"), F.col("B04")).alias("cloud"))


@query("get_class", "select scene, y, x, case when ndvi is null then null when ndvi < -0.5 then 0 when ndvi < 0.0 then 1 when ndvi < 0.5 then 2 else 3 end as class from n")
def _(spark, d):
    frame = ndvi(M.mask_scl(_cube(spark, d))).frame()
    return frame.select("scene", "y", "x", qa.get_class(F.col("ndvi"), [-0.5, 0.0, 0.5]).alias("class"))


# weights by a rule, for the 64 components of an embedding
_MODEL = {"weights": [(1 + k % 7) * (-1) ** k / 4 for k in range(64)], "bias": 0.01}
_SCORE_SQL = " + ".join([*(f"{w} * cast(embedding[{k}] as double)" for k, w in enumerate(_MODEL["weights"], 1)), str(_MODEL["bias"])])


@query("predict_classifier", f"select vec_id, case when 1 / (1 + exp(-({_SCORE_SQL}))) >= 0.5 then 1 else 0 end as p from embeddings")
def _(spark, d):
    x = F.col("embedding").cast("array<double>")
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", ml.predict({"model": _MODEL}, x).alias("p"))


@query("classifier_accuracy", f"select round(avg(case when (case when {_SCORE_SQL} >= 0 then 1 else 0 end) = label % 2 then 1.0 else 0.0 end), 6) as accuracy from embeddings")
def _(spark, d):
    x = F.col("embedding").cast("array<double>")
    return spark.read.parquet(f"{d}/embeddings.parquet").agg(F.round(ml.accuracy(ml.predict(_MODEL, x), F.col("label") % 2), 6).alias("accuracy"))


def _fit_sql(iterations: int, lr: float = 0.05) -> str:
    """One common table for each step of the descent."""
    parts = ["with r as (select cast(embedding[1] as double) as a, cast(embedding[2] as double) as b, cast(embedding[3] as double) as c, label % 2 as y from embeddings)", "s0 as (select 0.0::double as wa, 0.0::double as wb, 0.0::double as wc, 0.0::double as bias)"]
    for k in range(iterations):
        miss = "(1 / (1 + exp(-(wa * a + wb * b + wc * c + bias))) - y)"
        steps = ", ".join(f"any_value(w{v}) - {lr} * avg({miss} * {v}) as w{v}" for v in "abc")
        parts.append(f"s{k + 1} as (select {steps}, any_value(bias) - {lr} * avg({miss}) as bias from r, s{k})")
    values = " union all ".join(f"select {i} as place, round({n}, 9) as value from s{iterations}" for i, n in enumerate(("wa", "wb", "wc", "bias")))
    return ", ".join(parts) + " " + values


@query("fit_classifier", _fit_sql(5))
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.slice("embedding", 1, 3).alias("x"), (F.col("label") % 2).alias("y"))
    model = ml.fit_frame(rows, iterations=5)
    return spark.createDataFrame([(i, round(w, 9)) for i, w in enumerate([*model["weights"], model["bias"]])], "place int, value double")


# ---- catalogue, ETL, graphs ----


def _scene_table(spark, d) -> DataFrame:
    cube = _cube(spark, d).frame()
    cloud = F.avg(F.col("SCL").isin(*qa.SCL_MASKED).cast("double")) * 100
    own = cube.groupBy("scene").agg(F.round(cloud, 6).alias("cloud"), F.year(F.max("t")).alias("yr"))
    west = (F.col("scene") * 10).cast("double")
    return own.select(F.concat(F.lit("S2_"), "yr").alias("id"), F.lit("sentinel-2-l2a").alias("collection"), F.concat("yr", F.lit("-01-01T00:00:00Z")).alias("t"), "cloud", west.alias("west"), F.lit(0.0).alias("south"), (west + 10).alias("east"), F.lit(10.0).alias("north"), F.create_map(F.lit("red"), F.concat(F.lit("s3://bucket/"), "yr")).alias("bands"))


@query("catalog_search", "select 'S2_' || yr as id, round(100 * avg(case when scl in (3,8,9,10,11) then 1.0 else 0.0 end), 6) as cloud from c group by yr, scene having scene * 10 <= 45 and yr >= 1996 order by 2, 1 limit 3")
def _(spark, d):
    found = SC.search(_scene_table(spark, d), ["sentinel-2-l2a"], {"west": 0, "south": 0, "east": 45, "north": 5}, ["1996-01-01", None], limit=3)
    return found.select("id", "cloud")


@query("etl_sql_dedupe", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders where o_orderstatus <> 'P') where r = 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_totalprice")
    return first_rows(rows, "o_custkey", [F.col("o_orderkey")])


def _graph(**nodes: tuple) -> dict:
    last = list(nodes)[-1]
    return {"process": {"process_graph": {k: {"process_id": p, "arguments": a, **({"result": True} if k == last else {})} for k, (p, a) in nodes.items()}}}


def _node(name: str) -> dict:
    return {"from_node": name}


_LOAD = ("load_collection", {"id": "lineitem", "spatial_extent": None, "temporal_extent": None, "bands": ["B03", "B04", "B08", "SCL"]})
MINIMUM = _graph(
    load=_LOAD,
    masked=("mask_scl_dilation", {"data": _node("load")}),
    index=("ndvi", {"data": _node("masked")}),
    spread=("reduce_dimension", {"data": _node("index"), "dimension": "t", "reducer": RANGE}),
)
ENVIRONMENT = _graph(
    load=_LOAD,
    masked=("mask_scl_dilation", {"data": _node("load")}),
    green=("ndvi", {"data": _node("masked"), "nir": "B08", "red": "B04", "target_band": "ndvi"}),
    water=("ndvi", {"data": _node("masked"), "nir": "B03", "red": "B08", "target_band": "ndwi"}),
    green_mean=("reduce_dimension", {"data": _node("green"), "dimension": "t", "reducer": _call("mean", data=DATA)}),
    green_max=("reduce_dimension", {"data": _node("green"), "dimension": "t", "reducer": _call("max", data=DATA)}),
    best=("merge_cubes", {"cube1": _node("green_mean"), "cube2": _node("green_max"), "overlap_resolver": _call("mean", data=DATA)}),
    water_mean=("reduce_dimension", {"data": _node("water"), "dimension": "t", "reducer": _call("mean", data=DATA)}),
    both=("merge_cubes", {"cube1": _node("best"), "cube2": _node("water_mean")}),
    vigor=("reduce_dimension", {"data": _node("both"), "dimension": "bands", "reducer": _call("mean", data=DATA)}),
    clipped=("apply", {"data": _node("vigor"), "process": _call("clip", x=X, min=0, max=1)}),
    spread=("reduce_dimension", {"data": _node("green"), "dimension": "t", "reducer": RANGE}),
    unstable=("rename_labels", {"data": _node("spread"), "dimension": "bands", "source": ["ndvi"], "target": ["result"]}),
    stress=("merge_cubes", {"cube1": _node("clipped"), "cube2": _node("unstable"), "overlap_resolver": RANGE}),
    saved=("save_result", {"data": _node("stress"), "format": "JSON"}),
)


def environment(spark: SparkSession, sf_dir: str, grid: int = GRID) -> Cube:
    return execute(spark, ENVIRONMENT, lineitem_loader(spark, sf_dir, grid)).data


@query("graph_minimum", "select y, x, round(max(ndvi) - min(ndvi), 9) as ndvi from n group by y, x")
def _(spark, d):
    return _rows(execute(spark, MINIMUM, lineitem_loader(spark, d, GRID))).withColumn("ndvi", F.round("ndvi", 9))


@query(
    "env_15node",
    """, e as (select y, x, case when b08 > 0 and b04 > 0 and abs(b08 + b04) >= 1 then cast(b08 - b04 as double) / (b08 + b04) end as ndvi,
                    case when b03 > 0 and b08 > 0 and abs(b03 + b08) >= 1 then cast(b03 - b08 as double) / (b03 + b08) end as ndwi from m),
    p as (select y, x, avg(ndvi) as nm, max(ndvi) as nx, max(ndvi) - min(ndvi) as rng, avg(ndwi) as wm from e group by y, x),
    g as (select y, x, rng, wm, (nm + nx) / 2 as bg from p),
    v as (select y, x, rng, case when bg is null then wm when wm is null then bg else (bg + wm) / 2 end as vg from g),
    k as (select y, x, rng, case when vg is not null then least(greatest(vg, 0.0), 1.0) end as gc from v)
    select y, x, round(case when gc is null and rng is null then null else greatest(gc, rng) - least(gc, rng) end, 6) as result from k""",
)
def _(spark, d):
    return _rows(environment(spark, d)).withColumn("result", F.round("result", 6))


def queries() -> dict[str, Query]:
    from . import source_queries  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
