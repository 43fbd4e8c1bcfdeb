import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    good = [(i, tuple(int(x) for x in np.floor(1024 * np.float32(v).astype(float)))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in dict.fromkeys(good):
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 8).tolist(), 0) for i in range(700)]
    rows += [(1000 + i, rows[i % 3][1], 0) for i in range(30)]  # ties
    rows += [(900, None, 0), (800, [None] + [0.1] * 7, 0), (801, [float("nan")] * 8, 0), (802, [float("inf")] * 8, 0), (None, [0.1] * 8, 0), (1200, [0.5, 0.5], 0), (1300, [0.0] * 8, 0), (705, rows[5][1], 1), (705, rows[5][1], 1)]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "rank": F.lit(1), "key": F.lit(2)})
    assert sorted(tuple(r) for r in K.op8_nra_topk(vectors).collect()) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 4).tolist(), 0) for i in range(1500)]
    monkeypatch.setattr(K, "CANDIDATES", 50)
    monkeypatch.setattr(K, "GROUP", 200)
    monkeypatch.setattr(K, "QUERIES", 3)
    assert sorted(tuple(r) for r in K.op8_nra_topk(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_early_stop_is_exact():
    rng = np.random.default_rng(3)
    data = rng.integers(-400, 400, (2000, 6))
    lists = K.Lists(np.arange(2000), data)
    for q in (data[7], np.array([900, 0, 0, 0, 0, 0]), np.zeros(6, np.int64)):
        ids, scores = lists.best(np.array([7]), q[None], 10, np.array([-np.inf]))[0]
        want = sorted((-int(s), i) for i, s in enumerate(data @ q) if i != 7)[:10]
        assert [(-s, i) for i, s in zip(ids, scores, strict=True)] == want


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], SCHEMA)
    assert [tuple(r) for r in K.op8_nra_topk(two).collect()] == [(0, 1, 1, 524288)]
    assert K.op8_nra_topk(two.where("false")).count() == 0


def test_the_bounds_prune_dense_vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    data = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    lists = K.Lists(np.arange(2000), data)
    asked = np.arange(0, 2000, 100)
    for i, best in zip(asked, lists.best(asked, data[asked], 10, np.full(20, -np.inf)), strict=True):
        want = sorted((-int(s), v) for v, s in enumerate(data @ data[i]) if v != i)[:10]
        assert [(-s, v) for v, s in zip(*best, strict=True)] == want
    assert lists.resolved < 0.2 * lists.held and lists.read < 0.9 * lists.held * 64


def test_large_components_repeated_rows_and_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [5000.0, -3000.0], 0), (0, [5000.0, -3000.0], 0), (0, [1.0, 1.0], 0), (1, [2.5, 1e9], 0), (2, [1e9, 7.25], 0), (2, [1e9, 7.25], 0), (3, [4000.5, 4000.5], 0)]
    rows += [(100 + i, rng.normal(0, 1, 600).tolist(), 0) for i in range(30)]
    assert sorted(tuple(r) for r in K.op8_nra_topk(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(brute(rows))
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["vec_id", "e", "label"]))
    con.execute("create view embeddings as select vec_id, e::float[] as embedding from t")
    assert sorted(con.execute(K.OP8_SQL).fetchall()) == sorted(brute(rows))


def test_what_does_not_fit_a_long_is_an_error():
    with pytest.raises(OverflowError):
        K._scores(np.full((1, 2), 1 << 40), np.full(2, 1 << 40))
    assert K._scores(np.array([[1 << 40, 1]]), np.array([1 << 22, 1])).tolist() == [(1 << 62) + 1]
