import pytest
from tests.helpers import DATA, X, call, raster, series

from rasterloom.errors import BackendError, CrsMismatch, GraphError, MissingBand
from rasterloom.model import from_frame
from rasterloom.operators import apply as A
from rasterloom.operators import filters as FL
from rasterloom.operators import mask as M
from rasterloom.operators import merge as MG


def values(cube, band="v"):
    return {(r["y"], r["x"]): r[band] for r in cube.frame().collect()}


def test_filter_temporal(spark):
    cube = series(spark, [1, 2, 3], times=["2024-06-05T00:00:00Z", "2024-06-15T00:00:00Z", "2024-06-25T00:00:00Z"])
    one = FL.filter_temporal(cube, ["2024-06-10", "2024-06-20"])
    assert one.scenes == ((0, "2024-06-15T00:00:00Z"),) and [r["scene"] for r in one.frame().collect()] == [0]
    assert len(FL.filter_temporal(cube, [None, "2024-06-20"]).scenes) == 2
    with pytest.raises(BackendError):
        FL.filter_temporal(cube, ["2025-01-01", None])
    with pytest.raises(GraphError):
        FL.filter_temporal(series(spark, [1]), [None, None])


def test_bbox_window_is_pushed_down(spark, tmp_path):
    raster(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]]).frame().write.parquet(f"{tmp_path}/p")
    cube = from_frame(spark.read.parquet(f"{tmp_path}/p"), ["v"], shape=(3, 3), transform=(0.0, 1.0, 0.0, 3.0, 0.0, -1.0))
    cut = FL.filter_bbox(cube, {"west": 1, "south": 1, "east": 3, "north": 3})
    assert values(cut) == {(0, 0): 2, (0, 1): 3, (1, 0): 5, (1, 1): 6}
    assert "GreaterThanOrEqual(x,1)" in cut.frame()._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(GraphError):
        FL.filter_bbox(cube, {"west": 10, "south": 1, "east": 11, "north": 3})
    with pytest.raises(GraphError):
        FL.filter_bbox(cube, {"west": 3, "south": 1, "east": 1, "north": 3})


def test_bands_labels_and_dimensions(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0, 2.0, 4)], "scene int, y int, x int, B04 double, B08 double, SCL int")
    cube = from_frame(df, ["B04", "B08", "SCL"])
    assert FL.rename_labels(cube, "bands", ["red"], ["B04"]).names == ["B08", "SCL", "red"]
    assert FL.rename_labels(cube, "bands", ["a", "b", "c"]).names == ["a", "b", "c"]
    for bad in (lambda: FL.filter_bands(cube, []), lambda: FL.rename_labels(cube, "bands", ["a"], ["x", "y"]), lambda: FL.rename_labels(cube, "bands", ["../x"], ["B04"]), lambda: FL.drop_dimension(cube, "t")):
        with pytest.raises(GraphError):
            bad()
    with pytest.raises(MissingBand):
        FL.filter_bands(cube, ["B99"])
    assert FL.add_dimension(cube, "level", "1").extra_dims == {"level": "1"}


def test_merge(spark):
    ten, thirty = raster(spark, [[10] * 4] * 4, "ndvi"), raster(spark, [[32] * 4] * 4, "ndvi")
    assert set(values(MG.merge_cubes(ten, thirty, call("sum", data=DATA)), "ndvi").values()) == {42}
    assert set(values(MG.merge_cubes(ten, thirty), "ndvi").values()) == {32}  # a mosaic: the last one wins
    ordered = MG.merge_cubes(raster(spark, [[10, None]]), raster(spark, [[None, 3]]), call("sum", data=DATA))
    assert values(ordered) == {(0, 0): 10, (0, 1): 3}
    assert MG.merge_cubes(raster(spark, [[1]], "a"), raster(spark, [[2]], "b")).names == ["a", "b"]
    with pytest.raises(GraphError):
        MG.merge_cubes(series(spark, [1, 2]), series(spark, [1]), call("sum", data=DATA))


def test_extend_and_stack(spark):
    a = series(spark, [1, 2])
    assert sorted((r["scene"], r["v"]) for r in MG.extend(a, a).frame().collect()) == [(0, 1), (1, 2), (2, 1), (3, 2)]
    assert MG.stack(a, a).names == ["v", "v_1"]


def test_alignment(spark):
    a = raster(spark, [[1]])
    b = raster(spark, [[1]], transform=(0.0, 2.0, 0.0, 1.0, 0.0, -2.0))
    assert MG.check_alignment(a, a) is None
    assert MG.check_alignment(a, b, "SCL") == "nearest" and MG.check_alignment(a, b, "B04") == "bilinear"
    with pytest.raises(CrsMismatch):
        MG.check_alignment(a, raster(spark, [[1]], crs="EPSG:3857"))


def test_masks(spark):
    df = spark.createDataFrame([(0, 0, k, 100.0, s) for k, s in enumerate([0, 3, 4, 8, 11, None])], "scene int, y int, x int, B04 double, SCL int")
    cube = from_frame(df, ["B04", "SCL"])
    once = M.mask_scl(cube)
    assert [r["B04"] for r in once.frame().orderBy("x").collect()] == [100, None, 100, None, None, 100]
    twice = M.mask_scl(once)
    assert values(twice, "B04") == values(once, "B04")
    replaced = M.mask(cube, M.mask_from_values(cube, "SCL", [4]), 1e9)
    assert values(replaced, "B04")[0, 2] == 32767 and values(replaced, "SCL")[0, 2] == 4
    with pytest.raises(GraphError):
        M.mask(cube, cube)
    with pytest.raises(GraphError):
        M.mask_from_values(cube, "SCL", [])


def test_coarse_classes(spark):
    fine = raster(spark, [[1234] * 10] * 10, "B04").frame()
    coarse = raster(spark, [[9 if (y, x) == (0, 0) else 4 for x in range(5)] for y in range(5)], "SCL").frame()
    rows = M.nearest_class(fine, coarse, 0.5, 0.5).collect()
    assert {(r["y"], r["x"]) for r in rows if r["SCL"] == 9} == {(0, 0), (0, 1), (1, 0), (1, 1)} and len(rows) == 100


@pytest.mark.parametrize(
    ("callback", "value", "expected"),
    [
        (call("clip", x=X, min=0, max=10), 15, 10), (call("mod", x=X, y=-3), 7, -2), (call("round", x=X), 2.5, 2), (call("divide", x=1, y=X), 0, None), (call("sqrt", x=X), -1, None),
        (call("ln", x=X), 0, None), (call("int", x=X), -2.7, -2), (call("linear_scale_range", x=X, inputMin=0, inputMax=10), 20, 2), (call("max", data=[X, 3]), 1, 3), (call("gt", x=X, y=1), 2, 1),
        (call("add", x=X, y=1), None, None), (call("exp", p=X), 1000, None),
    ],
)
def test_apply(spark, callback, value, expected):
    got = A.apply(raster(spark, [[value]]), callback).frame().first()["v"]
    assert got == (expected if expected is None else pytest.approx(expected))


def test_long_callbacks_stay_small(spark):
    nodes = {"n0": {"process_id": "add", "arguments": {"x": X, "y": 1}}}
    for k in range(1, 25):
        nodes[f"n{k}"] = {"process_id": "multiply", "arguments": {"x": {"from_node": f"n{k - 1}"}, "y": 1}, **({"result": True} if k == 24 else {})}
    assert A.apply(raster(spark, [[41]]), {"process_graph": nodes}).frame().first()["v"] == 42


def test_apply_rejects_bad_callbacks(spark):
    cube = raster(spark, [[1]])
    for bad in (call("clip", x=X, min=2, max=1), {"process_graph": {}}, {"process_graph": {"a": {"process_id": "add", "arguments": {"x": {"from_node": "a"}, "y": 1}, "result": True}}}):
        with pytest.raises(GraphError):
            A.apply(cube, bad)


def test_ndvi(spark):
    df = spark.createDataFrame([(0, 0, 0, 100.0, 300.0), (0, 0, 1, 0.0, 300.0), (0, 0, 2, 0.2, 0.3)], "scene int, y int, x int, B04 double, B08 double")
    out = values(A.ndvi(from_frame(df, ["B04", "B08"])), "ndvi")
    assert out == {(0, 0): 0.5, (0, 1): None, (0, 2): None}
