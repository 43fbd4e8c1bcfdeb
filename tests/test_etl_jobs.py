import json
import time

import pytest
from tests.helpers import DATA, call, raster, series

from rasterloom.errors import GraphError
from rasterloom.etl.pipeline import Engine, PipelineSpec, sql_type
from rasterloom.jobs import manager as J
from rasterloom.jobs.provenance import graph_hash
from rasterloom.sinks import encode
from rasterloom.sinks.result import Result, stretched
from rasterloom.sinks.tiles import from_tiles, to_tiles

CSV = """user_id,event_id,country,amount
1,e1,US,42.5
2,e2,DE,99.0
1,e3,US,15.25
3,e4,IN,300
4,e5,US,0.99
1,e3,US,15.25
4,e8,US,77.1
"""


@pytest.fixture
def source(tmp_path):
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "sample.csv"
    path.write_text(CSV)
    return str(path)


def spec(source, **more):
    return PipelineSpec("csv", source, "events", "select user_id, event_id, amount from input where country = 'US'", "event_id", **more)


def test_pipeline_dedupes_within_and_across_runs(spark, source, tmp_path):
    engine = Engine(spark, str(tmp_path / "warehouse"))
    seen = []
    status = engine.run(spec(source), lambda s: seen.append(s.state))
    assert (status.state, status.rows_read, status.rows_written) == ("completed", 5, 4) and seen == ["running", "completed"]
    again = engine.run(spec(source))
    assert again.rows_written == 0 and engine.table("events").count() == 4
    assert len(engine.list()) == 2


def test_pipeline_failures(spark, source, tmp_path):
    engine = Engine(spark, str(tmp_path / "warehouse"))
    failed = engine.run(PipelineSpec("csv", source, "bad", "select nothing from input"))
    assert failed.state == "failed" and engine.table("bad") is None
    for wrong in ({"destination_table": "a-b"}, {"format": "xml"}, {"path": "/etc/passwd", "data_root": str(tmp_path)}):
        with pytest.raises(GraphError):
            PipelineSpec(**{"format": "csv", "path": source, "destination_table": "t", **wrong}).validate()
    assert [sql_type(t) for t in ("int", "boolean", "double", "date")] == ["INTEGER", "INTEGER", "REAL", "TEXT"]


def test_pipeline_in_the_background(spark, source, tmp_path):
    engine = Engine(spark, str(tmp_path / "warehouse"))
    job = engine.start(spec(source))
    for _ in range(300):
        if engine.status(job).state in ("completed", "failed"):
            break
        time.sleep(0.1)
    assert engine.status(job).state == "completed" and not engine.cancel(job)


GRAPH = {
    "process": {
        "process_graph": {
            "l": {"process_id": "load_collection", "arguments": {"id": "x", "spatial_extent": None, "temporal_extent": None}},
            "r": {"process_id": "reduce_dimension", "arguments": {"data": {"from_node": "l"}, "dimension": "t", "reducer": call("mean", data=DATA)}},
            "s": {"process_id": "save_result", "arguments": {"data": {"from_node": "r"}, "format": "JSON"}, "result": True},
        }
    }
}


def test_job_life(spark, tmp_path):
    jobs = J.JobManager(spark, lambda *a: series(spark, [1, 2, 6]), str(tmp_path))
    events = jobs.bus.subscribe()
    name = jobs.create(GRAPH, "mean")
    with pytest.raises(J.JobNotFinished):
        jobs.results(name)
    jobs.start(name).join()
    job = jobs.store.get(name)
    assert job.status == "finished" and job.progress == 100, job.logs
    with open(job.assets["result"]["href"]) as f:
        assert json.load(f)["values"] == [[3.0]]
    assert jobs.results(name)["assets"]["result"]["type"] == "JSON" and events.qsize() >= 3
    assert jobs.patch(name, title="other").title == "other"
    jobs.delete(name)
    with pytest.raises(J.JobNotFound):
        jobs.logs(name)


def test_job_errors(spark, tmp_path):
    jobs = J.JobManager(spark, lambda *a: 1 / 0, str(tmp_path))
    with pytest.raises(GraphError):
        jobs.create({"process": {}})
    name = jobs.create(GRAPH)
    jobs.start(name).join()
    assert jobs.store.get(name).status == "error"
    store = J.Store(str(tmp_path / "jobs.db"))
    store.save(J.Job("a", {}, status="running"))
    assert J.Store(str(tmp_path / "jobs.db")).get("a").status == "error"


def test_encoders(spark):
    cube = raster(spark, [[0, 5], [10, None]])
    assert {(r["y"], r["x"]): r["gray"] for r in stretched(cube).collect()} == {(0, 0): 0, (0, 1): 128, (1, 0): 255, (1, 1): 0}
    tiff = Result.of(cube).to_bytes()
    assert encode.is_tiff(tiff) and not encode.is_tiff(b"II")
    assert Result.of(cube, "png").to_bytes()[:4] == b"\x89PNG" and Result.of(cube, "whatever").format == "GTIFF"
    assert json.loads(Result.of(3.5, "JSON").to_bytes()) == 3.5


def test_tiles_round_trip(spark):
    cube = raster(spark, [[1, None, 3], [4, 5, 6], [7, 8, 9]])
    back = from_tiles(to_tiles(cube, 2), ["v"], 2)
    want = {(r["y"], r["x"]): r["v"] for r in cube.frame().where("v is not null").collect()}
    assert {(r["y"], r["x"]): r["v"] for r in back.frame().collect()} == want


def test_graph_hash_ignores_order():
    assert graph_hash({"a": 1, "b": 2}) == graph_hash({"b": 2, "a": 1}) != graph_hash({"a": 2})
