import pytest
from pyspark.sql import functions as F
from tests.helpers import call

from rasterloom.errors import BackendError, GraphError, MissingBand
from rasterloom.functions import arrays as AR
from rasterloom.functions import qa
from rasterloom.operators import ml
from rasterloom.sources import extent as E
from rasterloom.sources import products as PR
from rasterloom.sources import query as Q
from rasterloom.sources import scenes as S


@pytest.fixture
def scenes(spark):
    rows = [("a", "s2", "2024-06-05T00:00:00Z", 50.0, {"red": "s3://b/a"}), ("b", "s2", "2024-06-15T00:00:00Z", None, {"B04": "s3://b/b"}), ("c", "s2", "2024-06-25T00:00:00Z", 10.0, {"red": "https://h/c", "SCL": "x"})]
    df = spark.createDataFrame(rows, "id string, collection string, t string, cloud double, bands map<string,string>")
    return df.withColumns({"west": F.lit(0.0), "south": F.lit(0.0), "east": F.lit(1.0), "north": F.lit(1.0)})


def test_search(scenes):
    ids = lambda **k: [r["id"] for r in S.search(scenes, **k).collect()]
    assert ids(collections=["s2"]) == ["c", "a", "b"] and ids(collections=["x"]) == []
    assert ids(max_cloud=40) == ["c"] and ids(interval=["2024-06-10", None]) == ["c", "b"]
    assert ids(bbox={"west": 2, "south": 2, "east": 3, "north": 3}) == [] and ids(ids=["b"]) == ["b"] and ids(limit=1) == ["c"]
    assert [r["name"] for r in S.asset_names(scenes).collect()] == ["B04", "SCL", "red"]
    assert S.parse_query_interval("2024-01-01/..") == ("2024-01-01T00:00:00Z", None)


def test_loader(spark, scenes):
    pixels = spark.createDataFrame([("a", 0, 0, 1.0, None), ("b", 0, 0, None, 2.0), ("c", 0, 0, 3.0, None)], "scene_id string, y int, x int, red double, B04 double")
    load = S.loader(scenes, pixels)
    cube = load("s2", None, None, ["B04", "SCL"])
    assert cube.names == ["B04"] and [t for _, t in cube.scenes][0].startswith("2024-06-25")  # SCL is not on every scene
    assert [(r["scene"], r["B04"]) for r in cube.frame().orderBy("scene").collect()] == [(0, 3), (1, 1), (2, 2)]
    clear = {"eo:cloud_cover": call("lte", x={"from_parameter": "value"}, y=20)}
    assert len(load("s2", None, None, ["B04"], clear).scenes) == 1
    with pytest.raises(BackendError):
        load("other")
    with pytest.raises(GraphError):
        load("s2", None, None, ["B99"])


def test_query_builder(scenes):
    box = Q.Intersects(bbox={"west": 0, "south": 0, "east": 1, "north": 1})
    query = Q.ImageQuery("earth_search", "sentinel2", box, bands=("red",), cloudcover=Q.Cmp("<", 40))
    with pytest.raises(GraphError):
        Q.ImageQuery(collection="sentinel2").items(scenes)
    with pytest.raises(GraphError):
        Q.Intersects()
    held = scenes.withColumn("collection", F.lit("sentinel-2-l2a"))
    assert [r["id"] for r in query.items(held).collect()] == ["c"]
    assert Q.Cmp("!=", 3).to_query() == {"neq": 3}
    row = scenes.sparkSession.createDataFrame([("s3://a/b", "https://h/x", "/local")], "a string, b string, c string").select(*(Q.vsi(F.col(c)) for c in "abc")).first()
    assert tuple(row) == ("/vsis3/a/b", "/vsicurl/https://h/x", "/local")


@pytest.mark.parametrize("url", ["http://localhost/x", "http://10.0.0.1/", "http://169.254.169.254/", "file:///etc/passwd", "ftp://a/b", "http://[::1]/"])
def test_url_policy(url):
    with pytest.raises(GraphError):
        Q.check_url(url)
    assert Q.check_url("https://example.com/a")


def test_names():
    assert PR.resolve_band("B04", ["red", "Red"]) == "red" and PR.resolve_band("B04", ["B04", "red"]) == "B04" and PR.resolve_band("B04", []) is None
    assert PR.collection_id("landsat8", "usgs") == "landsat-c2l2-sr" and PR.collection_id("x", "usgs") == ""
    assert PR.canonical_band("nir", "landsat5") == "nir08" and len(PR.PRODUCTS) == 4
    with pytest.raises(MissingBand):
        PR.canonical_band("swir1", "landsat5")
    assert E.parse_crs("EPSG:32633") == 32633 and E.parse_interval(["2024-01-01", None]) == ("2024-01-01T00:00:00Z", None)


def test_quality(spark):
    rows = spark.createDataFrame([(64,), (0,), (68,), (1,), (8,), (16,), (4,), (32,), (128,)], "v int")
    v = F.col("v")
    got = rows.select(qa.qa_is_clear(v).alias("c"), qa.qa_to_mask(v).alias("m")).collect()
    assert [r["c"] for r in got][:3] == [True, False, False] and [r["m"] for r in got] == [1, 1, 2, 0, 2, 3, 2, 4, 5]
    t = spark.createDataFrame([(-0.1,), (0.3,), (0.7,), (0.9,)], "v double").select(qa.get_class(v, [0.2, 0.5, 0.8]).alias("c"))
    assert [r["c"] for r in t.collect()] == [0, 1, 2, 3]


def test_array_columns(spark):
    a = spark.createDataFrame([([3.0, 1.0, None, 2.0, 1.0],)], "a array<double>")
    c = F.col("a")
    row = a.select(AR.order(c).alias("o"), AR.order(c, False).alias("d"), AR.sort(c, True, False).alias("s"), AR.array_find(c, F.lit(2.0)).alias("f"), AR.count(c).alias("n")).first()
    assert (row["o"], row["d"], row["s"], row["f"], row["n"]) == ([1, 4, 3, 0], [0, 3, 1, 4], [None, 1, 1, 2, 3], 3, 4)
    with pytest.raises(ValueError):
        AR.array_element(c, -1)


def test_classifier(spark):
    x = [[float(i), float(i % 3)] for i in range(10)]
    y = [int(i >= 5) for i in range(10)]
    model = ml.fit_rows(x, y, 500, 0.1)
    rows = spark.createDataFrame(list(zip(x, y, strict=True)), "x array<double>, y int")
    other = ml.fit_frame(rows, iterations=20, lr=0.1)
    same = ml.fit_rows(x, y, 20, 0.1)
    assert other["weights"] == pytest.approx(same["weights"]) and other["bias"] == pytest.approx(same["bias"])
    assert rows.agg(ml.accuracy(ml.predict(model, F.col("x")), F.col("y"))).first()[0] >= 0.9
    assert ml.predict_rows({"model": {"weights": [1, 1], "bias": -10}}, [[1, 1], [9, 9]]) == [0, 1]
