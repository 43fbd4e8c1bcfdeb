import pytest
from tests.helpers import DATA, call, raster

from rasterloom.errors import GraphError
from rasterloom.functions import projection as P
from rasterloom.operators import sampling as SM
from rasterloom.operators import vector as V
from rasterloom.operators.resample import resample_spatial

HILLS = [[7, -2, 30, 11], [5, 18, 0, 44], [9, 9, 21, 3], [60, 1, 13, 8]]


def test_polygon_mean(spark):
    band = [[1, 0], [4, 0], [4, 2], [1, 2], [1, 0]]
    far = [[50, 50], [51, 50], [51, 51]]
    out = V.aggregate_spatial_polygon(raster(spark, HILLS), [band, far]).orderBy("geometry").collect()
    assert [r["mean"] for r in out] == [pytest.approx(101 / 6), None]


def test_world_polygons(spark):
    shape = {"type": "Polygon", "coordinates": [[[1, 4], [4, 4], [4, 2], [1, 2], [1, 4]]]}
    out = V.aggregate_spatial(raster(spark, HILLS), shape, call("mean", data=DATA)).collect()
    assert [(r["geometry"], r["scene"], r["value"]) for r in out] == [(0, 0, pytest.approx(101 / 6))]
    with pytest.raises(GraphError):
        V.aggregate_spatial(raster(spark, HILLS), shape, call("clip", x=1))


def test_points(spark):
    cube = raster(spark, [[10 + r] * 4 for r in range(4)])
    out = V.aggregate_spatial_point(cube, [(0.5, 3.5), (1.5, 1.5), (9, 9)]).orderBy("point").collect()
    assert [r["value"] for r in out] == [10, 12, None]


def test_rings():
    multi = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[2, 2], [3, 2], [3, 3]]]]}}]}
    assert len(V.rings(multi)) == 2
    for bad in ({"type": "Point", "coordinates": [0, 0]}, [[0, 0], [1, 1]], None):
        with pytest.raises(GraphError):
            V.rings(bad)


def test_neighbours_share_no_pixel(spark):
    left, right = [(0, 0), (2, 0), (2, 4), (0, 4)], [(2, 0), (4, 0), (4, 4), (2, 4)]
    out = V.in_rings(raster(spark, HILLS).frame(), [left, right])
    assert out.count() == 16 and out.groupBy("id").count().count() == 2


@pytest.mark.parametrize("crs", [3857, 32633, 32733])
def test_projection_round_trip(spark, crs):
    lat = -33.0 if crs == 32733 else 48.2
    x, y = P.from_geographic(16.35, lat, crs)
    assert P.to_geographic(x, y, crs) == pytest.approx((16.35, lat), abs=1e-8)
    if crs == 32633:
        assert (x, y) == pytest.approx((600321.8, 5339340.2), abs=400)
    from pyspark.sql import functions as F

    row = spark.range(1).select(*(c.alias(n) for n, c in zip("xy", P.project_columns(F.lit(16.35), F.lit(lat), 4326, crs), strict=True))).first()
    assert (row["x"], row["y"]) == pytest.approx((x, y), abs=1e-6)


def test_resample_keeps_the_picture(spark):
    cube = raster(spark, HILLS)
    out = resample_spatial(cube, 3857)
    got = {(r["y"], r["x"]): r["v"] for r in out.frame().collect()}
    assert out.crs == "EPSG:3857" and got[0, 0] == 7 and got[3, 3] == 8
    with pytest.raises(GraphError):
        resample_spatial(cube, 3857, 10)


def test_sampling(spark):
    cube = raster(spark, HILLS)
    points = spark.createDataFrame([(0, 0.5, 3.5), (1, 3.9, 0.1), (2, -1.0, 0.0)], "point int, wx double, wy double")
    assert [r["value"] for r in SM.sample_points(cube, points).orderBy("point").collect()] == [7, 8, None]
