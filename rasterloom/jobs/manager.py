"""Graph jobs: created, queued, running, then finished, canceled or error; each is a Spark job group in a thread."""

from __future__ import annotations

import json
import sqlite3
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from ..errors import GraphError
from ..model import Cube
from ..plans import executor
from ..sinks.result import Result, manifest
from ..streaming.events import EventBus
from .provenance import record

SLOTS = 16
TIMEOUT = 600
STATES = ("created", "queued", "running", "canceled", "finished", "error")


class JobLocked(GraphError):
    code, http_status = "JobLocked", 409


class QueueFull(GraphError):
    code, http_status = "QueueFull", 503


class JobNotFound(GraphError):
    code, http_status = "JobNotFound", 404


class JobNotFinished(GraphError):
    code = "JobNotFinished"


@dataclass
class Job:
    id: str
    process: dict
    title: str | None = None
    description: str | None = None
    status: str = "created"
    progress: int = 0
    created: float = field(default_factory=time.time)
    updated: float = field(default_factory=time.time)
    assets: dict = field(default_factory=dict)
    logs: list = field(default_factory=list)


class Store:
    """Jobs in one small table. Jobs that were under way when the process ended are errors when it starts again."""

    def __init__(self, path: str = ":memory:") -> None:
        self.lock, self.db = threading.Lock(), sqlite3.connect(path, check_same_thread=False)
        self.db.execute("create table if not exists jobs (id text primary key, created real, body text)")
        for job in self.list():
            if job.status in ("queued", "running"):
                job.status = "error"
                self.save(job)

    def save(self, job: Job) -> None:
        job.updated = time.time()
        with self.lock:
            self.db.execute("insert or replace into jobs values (?, ?, ?)", (job.id, job.created, json.dumps(job.__dict__)))
            self.db.commit()

    def get(self, name: str) -> Job:
        with self.lock:
            row = self.db.execute("select body from jobs where id = ?", (name,)).fetchone()
        if not row:
            raise JobNotFound(f"no job {name!r}")
        return Job(**json.loads(row[0]))

    def list(self, limit: int = 1000) -> list[Job]:
        with self.lock:
            rows = self.db.execute("select body from jobs order by created desc limit ?", (limit,)).fetchall()
        return [Job(**json.loads(r[0])) for r in rows]

    def delete(self, name: str) -> None:
        with self.lock:
            self.db.execute("delete from jobs where id = ?", (name,))
            self.db.commit()


class JobManager:
    def __init__(self, spark: SparkSession, loader: Callable[..., Cube], out: str, store: Store | None = None) -> None:
        self.spark, self.loader, self.out, self.store, self.bus = spark, loader, out.rstrip("/"), store or Store(), EventBus()
        self.slots = threading.BoundedSemaphore(SLOTS)
        self.stopped: set[str] = set()

    def create(self, document: dict, title: str | None = None, description: str | None = None) -> str:
        if "process_graph" not in document.get("process", {}):
            raise GraphError("process.process_graph is missing")
        if found := executor.validate(document):
            raise GraphError(found[0]["message"])
        job = Job(uuid.uuid4().hex, document["process"], title, description)
        self.store.save(job)
        return job.id

    def patch(self, name: str, **changes: Any) -> Job:
        job = self.store.get(name)
        if job.status in ("queued", "running"):
            raise JobLocked(f"job {name} is {job.status}")
        for k, v in changes.items():
            if k not in ("title", "description", "process"):
                raise GraphError(f"{k!r} cannot be changed")
            setattr(job, k, v)
        self.store.save(job)
        return job

    def delete(self, name: str) -> None:
        self.cancel(name)
        self.store.delete(name)

    def estimate(self, name: str) -> dict:
        """The number of nodes; costs are not known."""
        return {"nodes": len(self.store.get(name).process["process_graph"]), "costs": None}

    def start(self, name: str) -> threading.Thread:
        job = self.store.get(name)
        if job.status in ("queued", "running"):
            raise JobLocked(f"job {name} is {job.status}")
        if not self.slots.acquire(blocking=False):
            raise QueueFull("too many jobs are under way")
        self._to(job, "queued", 0)
        thread = InheritableThread(target=self._run, args=(job,), daemon=True)
        thread.start()
        return thread

    def _to(self, job: Job, status: str, progress: int, message: str = "") -> None:
        job.status, job.progress = status, progress
        job.logs.append({"level": "error" if status == "error" else "info", "message": message or status, "time": time.time()})
        self.store.save(job)
        self.bus.publish({"job": job.id, "status": status, "progress": progress})

    def _run(self, job: Job) -> None:
        sc = self.spark.sparkContext
        timer = threading.Timer(TIMEOUT, lambda: sc.cancelJobGroup(job.id))
        try:
            sc.setJobGroup(job.id, job.title or job.id, interruptOnCancel=True)
            timer.start()
            self._to(job, "running", 10)
            value = executor.execute(self.spark, {"process": job.process}, self.loader)
            result = value if isinstance(value, Result) else Result.of(value)
            path = result.write(f"{self.out}/{job.id}/result.{result.format.lower()}")
            self._to(job, "running", 95)
            job.assets = {"result": {"href": path, "type": result.format, "provenance": record(job.process, value)}}
            self._to(job, "canceled" if job.id in self.stopped else "finished", 100)
        except Exception as x:
            self._to(job, "canceled" if job.id in self.stopped else "error", job.progress, str(x).splitlines()[0] if str(x) else type(x).__name__)
        finally:
            timer.cancel()
            self.slots.release()

    def cancel(self, name: str) -> bool:
        job = self.store.get(name)
        if job.status not in ("queued", "running"):
            return False
        self.stopped.add(name)
        self.spark.sparkContext.cancelJobGroup(name)
        return True

    def results(self, name: str) -> dict:
        job = self.store.get(name)
        if job.status != "finished":
            raise JobNotFinished(f"job {name} is {job.status}")
        return manifest(job.id, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(job.created)), job.assets)

    def logs(self, name: str) -> list[dict]:
        return self.store.get(name).logs


class GraphStore:
    """User-defined graphs by name: kept, not callable."""

    def __init__(self) -> None:
        self.graphs: dict[str, dict] = {}

    def put(self, name: str, graph: dict) -> None:
        self.graphs[name] = graph

    def get(self, name: str) -> dict:
        return self.graphs[name]

    def delete(self, name: str) -> None:
        del self.graphs[name]

    def list(self) -> list[str]:
        return sorted(self.graphs)
