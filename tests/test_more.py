import json

import pytest
from tests.helpers import raster

from rasterloom.__main__ import main
from rasterloom.errors import GraphError, InvalidChunkPlan
from rasterloom.jobs.resilience import CircuitBreaker, CircuitOpen, Metrics, retry
from rasterloom.operators import kernels as K
from rasterloom.sources.builder import DatasetBuilder, blocks, plan_chunk
from rasterloom.streaming.events import EventBus


def test_blocks():
    own = blocks((5, 7), 3, 1)
    assert [(b.y, b.x, b.rows, b.cols) for b in own][:3] == [(0, 0, 3, 3), (0, 3, 3, 3), (0, 6, 3, 1)] and sum(b.rows * b.cols for b in own) == 35
    assert own[0].read == (0, 0, 4, 4) and own[1].read == (0, 2, 4, 5)
    assert plan_chunk(1 << 30, 8) == 2048 and plan_chunk(1, 1) == 64
    for bad in (lambda: blocks((1, 1), 0), lambda: plan_chunk(0, 1)):
        with pytest.raises(InvalidChunkPlan):
            bad()


def test_dataset_of_files(spark, tmp_path):
    for k in range(2):
        raster(spark, [[k, k], [k, 5]], "red").frame().select("y", "x", "red").write.parquet(f"{tmp_path}/f{k}")
    files = [f"{tmp_path}/f{k}" for k in range(2)]
    builder = DatasetBuilder.from_files(files, ["2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"]).with_(shape=(2, 2))
    cube = builder.build(spark)
    assert cube.names == ["red"] and cube.frame().count() == 8 and len(builder.blocks()) == 1
    assert [tuple(r)[1:] for r in builder.layer_mappings(spark).collect()] == [("red", 0, 0), ("red", 1, 0)]
    empty = DatasetBuilder.from_template(cube).build(spark)
    assert empty.names == ["red"] and empty.frame().count() == 0
    with pytest.raises(GraphError):
        DatasetBuilder().blocks()


def test_workers_on_blocks(spark):
    cube = raster(spark, [[r * 6 + c for c in range(6)] for r in range(6)])

    def around(pdf):
        """The mean of each pixel's neighbourhood, from a halo of 1."""
        import pandas as pd

        at = {(y, x): v for y, x, v in zip(pdf.y, pdf.x, pdf.v, strict=True)}
        rows = [(y, x, sum(own) / len(own)) for y, x in zip(pdf.y[pdf.core], pdf.x[pdf.core], strict=True) if (own := [at[y + i, x + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (y + i, x + j) in at])]
        return pd.DataFrame(rows, columns=["y", "x", "m"])

    out = {(r["y"], r["x"]): r["m"] for r in K.apply_blocks(cube, around, "y int, x int, m double", 2, 1).collect()}
    assert len(out) == 36 and out[2, 2] == 14 and out[0, 0] == (0 + 1 + 6 + 7) / 4
    sums = K.apply_rows(cube, lambda p: p.groupby("y", as_index=False).v.sum(), "y int, v double").orderBy("y").collect()
    assert sums[0]["v"] == 15


def test_rows_in_runs_with_a_mask(spark):
    import pandas as pd

    cube = raster(spark, [[r * 6 + c for c in range(6)] for r in range(2)])
    mask = raster(spark, [[c % 2 for c in range(6)] for r in range(2)])

    def total(p):
        return pd.DataFrame([(p.y.iloc[0], p.x.min(), len(p), p.v[p.mask_v == 0].sum())], columns=["y", "x", "n", "v"])

    out = sorted(map(tuple, K.apply_rows(cube, total, "y int, x int, n long, v double", 4, mask).collect()))
    assert out == [(0, 0, 4, 2.0), (0, 4, 2, 4.0), (1, 0, 4, 14.0), (1, 4, 2, 10.0)]


def test_retry_and_breaker():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert retry(flaky, 3, sleep=pauses.append) == "ok" and pauses == [0.1, 0.2]
    with pytest.raises(ValueError):
        retry(lambda: int("x"), 2, retryable=lambda _: False, sleep=pauses.append)
    now = [0.0]
    breaker = CircuitBreaker(2, 10, lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(lambda: 1 / 0)
    with pytest.raises(CircuitOpen):
        breaker.call(lambda: 1)
    now[0] = 11
    assert breaker.state == "half-open" and breaker.call(lambda: 1) == 1 and breaker.state == "closed"


def test_metrics_and_events():
    m = Metrics()
    m.count("jobs", state="finished")
    m.observe("seconds", 0.5)
    assert 'jobs{state="finished"} 1' in m.text() and 'seconds_bucket{le="1.0"} 1' in m.text()
    bus = EventBus(2)
    q = bus.subscribe()
    for k in range(3):
        bus.publish({"k": k})
    assert [q.get()["k"] for _ in range(2)] == [1, 2]


def test_command_line(tmp_path, capsys):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"process_graph": {"a": {"process_id": "ad", "arguments": {}, "result": True}}}))
    assert main(["validate", str(path)]) == 1 and "did you mean add" in capsys.readouterr().out
    assert main(["processes"]) == 0 and len(json.loads(capsys.readouterr().out)) == 68


def test_json_of_too_many_rows_is_an_error(spark, monkeypatch):
    from rasterloom.errors import BackendError
    from rasterloom.sinks import result

    monkeypatch.setattr(result, "MAX_ROWS", 3, raising=False)
    assert len(json.loads(result.Result.of(spark.range(3), "JSON").to_bytes())) == 3
    with pytest.raises(BackendError):
        result.Result.of(spark.range(4), "JSON").to_bytes()
