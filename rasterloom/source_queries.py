"""Queries for catalogues, image queries, blocks, tiles and file pipelines, each with the SQL that gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .etl.pipeline import first_rows, sql_type, transform
from .functions import qa
from .operators import filters as FL
from .operators import kernels as K
from .operators import mask as M
from .operators import merge as MG
from .operators import vector as VC
from .queries import _cube, _rows, _scene_table, query
from .sinks import tiles as TL
from .sources import builder as B
from .sources import products as P
from .sources import scenes as SC
from .sources.extent import parse_cloud_limit
from .sources.query import Cmp, ImageQuery, Intersects
from .sources.tables import read_file

#: the scenes of the fixture cube as a catalogue
SCENES = """, s as (
  select scene, yr, 'S2_' || yr as id, yr || '-01-01T00:00:00Z' as t, round(100 * avg(case when scl in (3,8,9,10,11) then 1.0 else 0.0 end), 6) as cloud from c group by yr, scene
)"""
LOW_CLOUD = {"eo:cloud_cover": {"process_graph": {"c": {"process_id": "lt", "arguments": {"x": {"from_parameter": "value"}, "y": 45}, "result": True}}}}


def _catalogue(spark, d):
    """The scene table with every band's address."""
    href = F.concat(F.lit("s3://bucket/"), "id", F.lit("/"))
    return _scene_table(spark, d).withColumn("bands", F.create_map(*(x for b in ("B04", "B08") for x in (F.lit(b), F.concat(href, F.lit(b))))))


def _pixels(spark, d):
    frame = _cube(spark, d).frame()
    return frame.select(F.concat(F.lit("S2_"), F.year("t")).alias("scene_id"), "y", "x", F.col("B04").alias("red"), F.col("B08").alias("nir"))


# ---- catalogues ----


@query("load_collection", SCENES + ', k as (select scene as own, cast(row_number() over (order by cloud, t, id) - 1 as int) as scene from s where cloud < 45 and scene * 10 <= 45 qualify row_number() over (order by cloud, t, id) <= 2) select k.scene, y, x, b04 as "B04", b08 as "B08" from c join k on c.scene = k.own')
def _(spark, d):
    scenes = _scene_table(spark, d).withColumn("bands", F.create_map(F.lit("red"), F.lit("a"), F.lit("nir"), F.lit("b")))
    load = SC.loader(scenes, _pixels(spark, d))
    return _rows(load("sentinel-2-l2a", {"west": 0, "south": 0, "east": 45, "north": 5}, None, ["B04", "B08"], LOW_CLOUD, 2))


@query("load_collection_in_time", SCENES + ', k as (select scene as own, cast(row_number() over (order by t, id) - 1 as int) as scene from (select * from s where yr between 1993 and 1996 order by cloud, t, id limit 3)) select k.scene, y, x, b04 as "B04" from c join k on c.scene = k.own')
def _(spark, d):
    scenes = _scene_table(spark, d).withColumn("bands", F.create_map(F.lit("red"), F.lit("a")))
    return _rows(SC.loader(scenes, _pixels(spark, d), "time")("sentinel-2-l2a", None, ["1993-01-01", "1996-12-31"], ["B04"]))


@query("cloud_predicate", SCENES + " select id, cloud from s where cloud < 45")
def _(spark, d):
    return SC.search(_scene_table(spark, d), max_cloud=parse_cloud_limit(LOW_CLOUD)).select("id", "cloud")


@query("image_query", SCENES + """ select id, b as band, 's3://bucket/' || id || '/' || b as href, '/vsis3/bucket/' || id || '/' || b as path
from (select * from s where cloud <= 45 and scene * 10 <= 35 and yr >= 1993 order by cloud, t, id limit 4), (select unnest(['B04', 'B08']) as b)""")
def _(spark, d):
    asked = ImageQuery("earth_search", "sentinel2", Intersects(bbox={"west": 0, "south": 0, "east": 35, "north": 5}), ("1993-01-01", None), ("red", "nir"), Cmp("<=", 45), 4)
    return asked.hrefs(_catalogue(spark, d))


@query("image_query_geometry", SCENES + " select id from s where scene * 10 <= 21 and scene * 10 + 10 >= 12 order by cloud, t, id limit 100")
def _(spark, d):
    shape = {"type": "Polygon", "coordinates": [[[12, 1], [21, 1], [16, 7], [12, 1]]]}
    return ImageQuery("earth_search", "sentinel2", Intersects(geometry=shape)).items(_catalogue(spark, d)).select("id")


@query("image_query_ids", SCENES + " select id, t from s where id in ('S2_1994', 'S2_1996')")
def _(spark, d):
    return ImageQuery("earth_search", "sentinel2", Intersects(ids=("S2_1994", "S2_1996"))).items(_catalogue(spark, d)).select("id", "t")


@query("scene_sources", SCENES + " select id, 's3://bucket/' || id || '/B08' as href from s")
def _(spark, d):
    return SC.sources_for(_catalogue(spark, d), "B08")


@query("scene_dates", SCENES + " select distinct t[1:10] as date from s where yr between 1993 and 1997")
def _(spark, d):
    return SC.dates_in(_catalogue(spark, d), "1993-01-01", "1997-06-30")


@query("scenes_on_a_day", SCENES + " select id from s where yr = 1995")
def _(spark, d):
    return SC.items_on(_catalogue(spark, d), "1995-01-01").select("id")


@query("scene_band_names", "select unnest(['B04', 'B08']) as name")
def _(spark, d):
    return SC.asset_names(_catalogue(spark, d))


@query("scene_numbers", SCENES + " select id, cast(row_number() over (order by cloud, t, id) - 1 as int) as number from s")
def _(spark, d):
    return SC.numbered(_scene_table(spark, d)).select("id", F.col("scene").alias("number"))


@query("band_aliases", "select * from (values ('B04', 'red'), ('B08', 'nir'), ('SCL', 'scl'), ('B99', null)) as v(wanted, found)")
def _(spark, d):
    rows = [(b, P.resolve_band(b, ["red", "nir", "scl", "green"])) for b in ("B04", "B08", "SCL", "B99")]
    return spark.createDataFrame(rows, "wanted string, found string")


@query("collection_names", "select * from (values ('earth_search', 'sentinel2', 'sentinel-2-l2a', 'B08'), ('planetary_computer', 'landsat8', 'landsat-c2-l2', 'nir08'), ('usgs', 'landsat8', 'landsat-c2l2-sr', 'nir08'), ('dea', 'sentinel2', 'ga_s2am_ard_3', 'B08')) as v(provider, name, collection, nir)")
def _(spark, d):
    rows = [(p, c, P.collection_id(c, p), P.canonical_band("nir", c)) for p, c in (("earth_search", "sentinel2"), ("planetary_computer", "landsat8"), ("usgs", "landsat8"), ("dea", "sentinel2"))]
    return spark.createDataFrame(rows, "provider string, name string, collection string, nir string")


# ---- grids, masks, blocks and tiles ----


@query("sub_rectangle", 'select scene, y - 3 as y, x - 5 as x, b04 as "B04" from c where y between 3 and 12 and x between 5 and 16')
def _(spark, d):
    return _rows(FL.filter_bands(FL.sub_rectangle(_cube(spark, d), 3, 5, 10, 12), ["B04"]))


@query("union_extent", "select 2.0 :: double as west, 0.0 :: double as south, 32.0 :: double as east, 30.0 :: double as north")
def _(spark, d):
    parts = [FL.sub_rectangle(_cube(spark, d), *p) for p in ((2, 4, 10, 28), (20, 2, 12, 3))]
    box = VC.extent(parts)
    return spark.createDataFrame([tuple(float(box[k]) for k in ("west", "south", "east", "north"))], "west double, south double, east double, north double")


@query("check_alignment", "select * from (values ('B04', 1, null), ('B04', 2, 'bilinear'), ('SCL', 2, 'nearest')) as v(band, step, how)")
def _(spark, d):
    from dataclasses import replace

    cube = _cube(spark, d)
    grids = {1: replace(cube, transform=(7.0, 1.0, 0.0, 32.0, 0.0, -1.0)), 2: replace(cube, transform=(0.0, 2.0, 0.0, 32.0, 0.0, -2.0))}
    return spark.createDataFrame([(b, k, MG.check_alignment(cube, grids[k], b)) for b, k in (("B04", 1), ("B04", 2), ("SCL", 2))], "band string, step int, how string")


@query("scl_clear_sky", "select scene, y, x, scl not in (0, 1, 3, 8, 9, 10) as clear from c")
def _(spark, d):
    return _cube(spark, d).frame().select("scene", "y", "x", qa.scl_clear_sky(F.col("SCL")).alias("clear"))


@query("apply_clear", "select scene, y, x, case when scl in (4,5,6,7,11) then b04 end as red from c")
def _(spark, d):
    return _cube(spark, d).frame().select("scene", "y", "x", M.apply_clear(F.col("B04"), qa.scl_is_clear(F.col("SCL"))).alias("red"))


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.groupby(["scene", "block_row", "block_col"], as_index=False).agg(n=("B04", "size"), total=("B04", "sum"))


def _core(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.groupby(["scene", "block_row", "block_col"], as_index=False).agg(n=("core", "size"), own=("core", "sum"))


def _unmasked(pdf: pd.DataFrame) -> pd.DataFrame:
    kept = pdf.assign(red=pdf.B04.where(pdf.mask_cloud == 0))
    return kept[["scene", "y", "x", "red"]].astype({"red": "float64"})


def _highest(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.groupby(["y", "x"], as_index=False).agg(top=("B08", "max"))


def _row_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"y": [pdf.y.iloc[0]], "n": [len(pdf)], "total": [pdf.B04.sum()]})


_BLOCK = "cast(floor(y / 10) as int) as block_row, cast(floor(x / 10) as int) as block_col"


@query("apply_blocks", f"select scene, {_BLOCK}, count(*) as n, cast(sum(b04) as bigint) as total from c group by all")
def _(spark, d):
    return K.apply_blocks(_cube(spark, d), _total, "scene int, block_row int, block_col int, n long, total long", 10)


@query("apply_blocks_halo", "select scene, r as block_row, q as block_col, count(*) as n, cast(sum(case when floor(y / 10) = r and floor(x / 10) = q then 1 else 0 end) as bigint) as own from c, (select unnest(range(5)) :: int as r), (select unnest(range(5)) :: int as q) where y between r * 10 - 2 and r * 10 + 11 and x between q * 10 - 2 and q * 10 + 11 group by all")
def _(spark, d):
    return K.apply_blocks(_cube(spark, d), _core, "scene int, block_row int, block_col int, n long, own long", 10, 2)


@query("apply_blocks_with_mask", "select scene, y, x, case when scl not in (3, 8, 9, 10, 11) then cast(b04 as double) end as red from c")
def _(spark, d):
    cube = _cube(spark, d)
    out = K.apply_blocks(cube, _unmasked, "scene int, y int, x int, red double", 16, mask=M.mask_from_values(cube, target_band="cloud"))
    return out.withColumn("red", F.nanvl("red", F.lit(None)))


@query("apply_blocks_over_time", "select y, x, cast(max(b08) as bigint) as top from c group by y, x")
def _(spark, d):
    return K.apply_blocks(_cube(spark, d), _highest, "y int, x int, top long", 8, by_scene=False)


@query("apply_rows", "select y, count(*) as n, cast(sum(b04) as bigint) as total from c group by y")
def _(spark, d):
    return K.apply_rows(_cube(spark, d), _row_sum, "y int, n long, total long")


@query("tiles", "select scene, band, block_row, block_col, least(10, 32 - block_row * 10) :: int as rows, least(10, 32 - block_col * 10) :: int as cols, (8 * rows * cols) :: int as bytes "
       f"from (select distinct scene, {_BLOCK}, unnest(['B04', 'B08']) as band from c)")
def _(spark, d):
    tiles = TL.to_tiles(FL.filter_bands(_cube(spark, d), ["B04", "B08"]), 10)
    return tiles.select("scene", "band", "block_row", "block_col", "rows", "cols", F.octet_length("data").alias("bytes"))


@query("tiles_round_trip", 'select scene, y, x, b04 :: double as "B04", b08 :: double as "B08" from c')
def _(spark, d):
    tiles = TL.to_tiles(FL.filter_bands(_cube(spark, d), ["B04", "B08"]), 10)
    return _rows(TL.from_tiles(tiles, ["B04", "B08"], 10))


@query("block_plan", "select cast(a.v as int) as block_row, cast(b.v as int) as block_col, least(12, 40 - a.v * 12) :: int as rows, least(12, 30 - b.v * 12) :: int as cols, greatest(0, a.v * 12 - 2) :: int as read_y, greatest(0, b.v * 12 - 2) :: int as read_x from (select unnest(range(4)) as v) a, (select unnest(range(3)) as v) b")
def _(spark, d):
    return spark.createDataFrame([(b.row, b.col, b.rows, b.cols, b.read[0], b.read[1]) for b in B.blocks((40, 30), 12, 2)], "block_row int, block_col int, rows int, cols int, read_y int, read_x int")


@query("chunk_side", "select * from (values (24 * 4096 * 4096, 1, 4096), (24 * 1000 * 1000, 1, 512), (24 * 400 * 400, 1, 400), (24, 1, 64)) as v(budget, workers, side)")
def _(spark, d):
    cases = [(24 * 4096 * 4096, 1), (24 * 1000 * 1000, 1), (24 * 400 * 400, 1), (24, 1)]
    return spark.createDataFrame([(b, w, B.plan_chunk(b, w)) for b, w in cases], "budget int, workers int, side int")


# ---- file pipelines ----


@query("etl_read_transform", "with o as (select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as total, 'the input' as note from orders where o_orderstatus <> 'P' group by 1) select * from o where orders > 1")
def _(spark, d):
    sql = "with o as (select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as total, 'the input' as note from input where o_orderstatus <> 'P' group by 1) select * from o where orders > 1;"
    return transform(spark, read_file(spark, "parquet", f"{d}/orders.parquet"), sql)


@query("etl_append_dedupe", "with o as (select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderkey % 2 = 0 group by 1), p as (select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderkey % 2 = 1 group by 1) select * from o union all select * from p where o_custkey not in (select o_custkey from o)")
def _(spark, d):
    orders = read_file(spark, "parquet", f"{d}/orders.parquet")
    halves = [first_rows(transform(spark, orders, f"select o_custkey, o_orderkey from input where o_orderkey % 2 = {k}"), "o_custkey", [F.col("o_orderkey")]) for k in (0, 1)]
    return halves[0].unionByName(halves[1].join(halves[0].select("o_custkey"), "o_custkey", "left_anti"))


@query("etl_types", "select * from (values ('c_custkey', 'INTEGER'), ('c_name', 'TEXT'), ('c_acctbal', 'REAL')) as v(name, kind)")
def _(spark, d):
    rows = read_file(spark, "parquet", f"{d}/customer.parquet").select(F.col("c_custkey"), "c_name", F.col("c_acctbal").cast("double"))
    return spark.createDataFrame([(n, sql_type(k)) for n, k in rows.dtypes], "name string, kind string")
