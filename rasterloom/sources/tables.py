"""File sources, and a cube over an ordinary fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..model import Base, Cube


def read_file(spark: SparkSession, kind: str, path: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """csv (schema inferred), parquet or json (an array or one object a line)."""
    kind = kind.lower()
    if kind == "csv":
        return spark.read.csv(path, header=header, sep=(delimiter or ",")[0], inferSchema=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.json(path, multiLine=True)
    raise GraphError(f"no source format {kind!r}")


def lineitem_cube(spark: SparkSession, sf_dir: str, grid: int = 32) -> Cube:
    """The fixture cube: a pixel for (order key, part key) modulo ``grid``, a scene for each ship year."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    year = F.year("l_shipdate")
    cells = rows.groupBy(year.alias("yr"), (F.col("l_orderkey") % grid).cast("int").alias("y"), (F.col("l_partkey") % grid).cast("int").alias("x")).agg(
        (F.sum("l_linenumber").cast("int") * 100).alias("B03"),
        (F.floor(F.max("l_quantity")).cast("int") * 100).alias("B04"),
        (F.floor(F.max("l_extendedprice")).cast("int") % 10000).alias("B08"),
        (F.min("l_orderkey") % 12).cast("int").alias("SCL"),
    )
    years = [r[0] for r in rows.select(year.alias("yr")).distinct().orderBy("yr").collect()]  # one row for each scene
    number = F.create_map(*[F.lit(x) for k, v in enumerate(years) for x in (v, k)]) if years else F.create_map().cast("map<int,int>")
    frame = cells.select(number[F.col("yr")].alias("scene"), F.make_timestamp("yr", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("t"), "y", "x", "B03", "B04", "B08", "SCL")
    scenes = tuple((k, f"{v}-01-01T00:00:00Z") for k, v in enumerate(years))
    return Cube(Base(frame), {b: F.col(b) for b in ("B03", "B04", "B08", "SCL")}, scenes, transform=(0.0, 1.0, 0.0, float(grid), 0.0, -1.0), shape=(grid, grid))


def lineitem_loader(spark: SparkSession, sf_dir: str, grid: int = 32):
    """``load_collection`` over the fixture cube, with extents and bands as filters."""
    from ..operators.filters import filter_bands, filter_bbox, filter_temporal

    def load(name, spatial_extent=None, temporal_extent=None, bands=None, properties=None, limit=None) -> Cube:
        cube = lineitem_cube(spark, sf_dir, grid)
        if temporal_extent:
            cube = filter_temporal(cube, temporal_extent)
        if spatial_extent:
            cube = filter_bbox(cube, spatial_extent)
        return filter_bands(cube, bands) if bands else cube

    return load
