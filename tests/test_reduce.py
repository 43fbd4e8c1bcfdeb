import pytest
from tests.helpers import DATA, RANGE, call, raster, series

from rasterloom.errors import GraphError, UnknownProcess
from rasterloom.operators import reduce as R
from rasterloom.operators.mask import mask_from_values

CASES = [
    ("mean", [1, 2, 3], 2), ("median", [3, 1, 2], 2), ("median", [1, 2, 3, 4], 2.5), ("min", [4, 1, 3, 2], 1), ("max", [4, 1, 3, 2], 4), ("sum", [4, 1, 3, 2], 10),
    ("count", [4, 1, 3, 2], 4), ("first", [4, 1, 3, 2], 4), ("last", [4, 1, 3, 2], 2), ("variance", [2, 4, 4, 4, 5, 5, 7, 9], 32 / 7), ("sd", [5], 0), ("variance", [7], 0),
    ("first", [None, 5, 3, None], 5), ("last", [None, 5, 3, None], 3), ("count", [None, None], None), ("mean", [None, None], None), ("mean", [float("nan"), 4], 4),
]


@pytest.mark.parametrize(("name", "values", "expected"), CASES)
def test_reducers_over_time(spark, name, values, expected):
    row = R.reduce_dimension(series(spark, values), call(name, data=DATA), "t").frame().first()
    assert row["v"] == (expected if expected is None else pytest.approx(expected))


def test_range_callback(spark):
    assert R.reduce_dimension(series(spark, [1, 5, 3]), RANGE, "t").frame().first()["v"] == 4


def test_siblings_share_one_aggregation(spark):
    cube = series(spark, [1, 5, 3])
    a, b = (R.reduce_dimension(cube, call(n, data=DATA), "t") for n in ("min", "max"))
    assert a.base is b.base
    from rasterloom.operators.merge import merge_cubes

    both = merge_cubes(a, b, RANGE)
    plan = both.frame()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and both.frame().first()["v"] == 4


def test_errors(spark):
    cube = series(spark, [1])
    with pytest.raises(GraphError):
        R.reduce_dimension(cube, call("mean", data=DATA), "z")
    with pytest.raises(UnknownProcess, match="did you mean mean"):
        R.reduce_dimension(cube, call("meen", data=DATA), "t")
    with pytest.raises(GraphError):
        R.reduce_dimension(cube, call("mean", data=[1, 2]), "t")


def test_zonal_histogram(spark):
    cube = raster(spark, [[7] * 8 for _ in range(8)])
    zones = mask_from_values(raster(spark, [[1] * 4 + [2] * 4 for _ in range(8)], "SCL"), "SCL", [1, 2])
    rows = R.zonal_histogram(cube, zones).collect()
    assert [(r["value"], r["n"]) for r in rows] == [(7, 64)]


def test_overview(spark):
    out = R.overview(raster(spark, [[1, 3], [None, 5]]), 2)
    assert out.frame().first()["v"] == 3 and out.shape == (1, 1)
