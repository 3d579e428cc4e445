"""The life of sources, crawl runs and jobs, kept in the lake."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.history import upserted
from folioscope.plans.validate import Invalid
from folioscope.sources.store import Lake

#: From which states each state can be reached.
FROM = {"running": ("queued",), "completed": ("running",), "partial": ("running",), "failed": ("queued", "running"), "cancelled": ("queued", "running"), "interrupted": ("running",)}
ACTIVE = ("queued", "running")
#: What a run does, in order.
STAGES = ("crawl", "prepare", "persist", "embeddings", "complete")


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Jobs:
    def __init__(self, lake: Lake):
        self.lake = lake

    def _row(self, table: str, **values) -> DataFrame:
        from pyspark.sql.types import _parse_datatype_string

        from folioscope.schema import TABLES

        names = [f.name for f in _parse_datatype_string(TABLES[table]).fields]
        return self.lake.spark.createDataFrame([tuple(values.get(n) for n in names)], TABLES[table])

    def register_source(self, source_id: str, name: str, root_url: str) -> None:
        """Once for each id; the same again changes nothing, another root is refused."""

        def change(base):
            known = self.lake.read("source", base).where(F.col("source_id") == source_id).head()
            if known is not None:
                if known["root_url"] != root_url:
                    raise Invalid(f"{source_id} has another root")
                return {}
            return {"append": {"source": self._row("source", source_id=source_id, name=name, root_url=root_url, created_at=_now(), admission_revision=0)}}

        self.lake.transact(change)

    def reserve(self, job_id: str, source_id: str, crawl_id: str, operation: str) -> None:
        """A queued job; a source has one active job at most."""

        def change(base):
            if self.lake.read("source", base).where(F.col("source_id") == source_id).head() is None:
                raise Invalid(f"{source_id} is not registered")
            jobs = self.lake.read("crawl_job", base)
            if jobs.where((F.col("source_id") == source_id) & F.col("status").isin(*ACTIVE)).head() is not None:
                raise Invalid(f"{source_id} has an active job")
            if jobs.where(F.col("job_id") == job_id).head() is not None:
                raise Invalid(f"{job_id} exists")
            row = self._row("crawl_job", job_id=job_id, source_id=source_id, crawl_id=crawl_id, operation=operation, status="queued", created_at=_now())
            return {"append": {"crawl_job": row}}

        self.lake.transact(change)

    def move(self, job_id: str, status: str, error: str | None = None) -> None:
        """To another state, if the job may go there."""

        def change(base):
            jobs = self.lake.read("crawl_job", base)
            job = jobs.where(F.col("job_id") == job_id).head()
            if job is None:
                raise Invalid(f"{job_id} is unknown")
            if job["status"] not in FROM.get(status, ()):
                raise Invalid(f"{job['status']} can't become {status}")
            ended = status not in ACTIVE
            now = _now()
            took = int((now - job["created_at"]).total_seconds() * 1000) if ended else None
            fresh = self._row("crawl_job", **(job.asDict() | {"status": status, "error": error, "finished_at": now if ended else None, "elapsed_ms": max(0, took) if ended else None}))
            return {"replace": {"crawl_job": upserted(jobs, fresh, ["job_id"])}}

        self.lake.transact(change)

    @staticmethod
    def new_id() -> str:
        """An id that no other job has."""
        return f"job-{uuid.uuid4().hex}"

    def recover(self) -> int:
        """What ran when the process ended is interrupted; the number of such jobs."""
        running = self.lake.read("crawl_job").where("status = 'running'").count()
        if running:
            self.lake.transact(
                lambda base: {"replace": {"crawl_job": self.lake.read("crawl_job", base).withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))}}
            )
        return running

    def status(self, job_id: str) -> dict | None:
        """A job with its run's stage and summary."""
        base = self.lake.manifest()
        runs = self.lake.read("crawl_run", base).select("source_id", "crawl_id", F.col("status").alias("run_status"), "stage", "summary")
        row = self.lake.read("crawl_job", base).where(F.col("job_id") == job_id).join(runs, ["source_id", "crawl_id"], "left").head()
        return row.asDict() if row else None


class Runs:
    """One row for each crawl: where it is and what came of it."""

    def __init__(self, lake: Lake):
        self.lake = lake

    def _set(self, source_id: str, crawl_id: str, allowed: tuple[str, ...], **values) -> None:
        def change(base):
            rows = self.lake.read("crawl_run", base)
            run = rows.where((F.col("source_id") == source_id) & (F.col("crawl_id") == crawl_id)).head()
            if (run["status"] if run else None) not in allowed:
                raise Invalid(f"run {crawl_id} of {source_id} is {run['status'] if run else 'unknown'}")
            known = run.asDict() if run else {"source_id": source_id, "crawl_id": crawl_id}
            fresh = Jobs(self.lake)._row("crawl_run", **(known | values))
            return {"replace": {"crawl_run": upserted(rows, fresh, ["source_id", "crawl_id"])}}

        self.lake.transact(change)

    def start(self, source_id: str, crawl_id: str, configuration: str = "{}") -> None:
        self._set(source_id, crawl_id, (None, "interrupted", "failed"), status="running", stage="crawl", started_at=_now(), finished_at=None, configuration=configuration)

    def progress(self, source_id: str, crawl_id: str, stage: str) -> None:
        if stage not in STAGES:
            raise Invalid(f"{stage} is no stage")
        self._set(source_id, crawl_id, ("running",), stage=stage)

    def finish(self, source_id: str, crawl_id: str, status: str, summary: dict, error: str | None = None) -> None:
        done = {"stage": "complete"} if status == "completed" else {}
        self._set(source_id, crawl_id, ("running",), status=status, finished_at=_now(), summary=json.dumps(summary), error=error, **done)


class JobManager:
    """Runs jobs in the background: a few at a time, each with a deadline, after which its Spark jobs are cancelled."""

    def __init__(self, jobs: Jobs, most: int = 2, deadline_s: float = 300.0):
        self.jobs, self.most, self.deadline_s = jobs, most, deadline_s
        self._pool = ThreadPoolExecutor(most)
        self._running: dict[str, tuple[str, Future]] = {}
        self._lock = threading.Lock()

    def start(self, source_id: str, crawl_id: str, operation: str, work: Callable[[str], object]) -> str:
        """The id of a new job that calls work(job_id); refused while as many jobs run as may."""
        with self._lock:
            if sum(not f.done() for _, f in self._running.values()) >= self.most:
                raise Invalid("too many jobs are running")
            job = self.jobs.new_id()
            self.jobs.reserve(job, source_id, crawl_id, operation)
            group = f"folioscope-{job}"
            self._running[job] = (group, self._pool.submit(self._run, job, group, work))
        return job

    def _run(self, job: str, group: str, work: Callable[[str], object]) -> object:
        context = self.jobs.lake.spark.sparkContext
        context.setJobGroup(group, f"job {job}", True)
        timer = threading.Timer(self.deadline_s, self.cancel, (job, "deadline"))
        timer.start()
        try:
            return work(job)
        finally:
            timer.cancel()

    def cancel(self, job: str, why: str = "cancelled") -> None:
        group, _ = self._running[job]
        row = self.jobs.status(job)
        if row is not None and row["status"] in ACTIVE:
            self.jobs.move(job, "cancelled", why)
        self.jobs.lake.spark.sparkContext.cancelJobGroup(group)

    def wait(self, job: str, seconds: float | None = None) -> object:
        return self._running[job][1].result(seconds)

    def shutdown(self) -> None:
        """Cancel what runs and take no more."""
        for job, (_, future) in list(self._running.items()):
            if not future.done():
                self.cancel(job, "shutdown")
        self._pool.shutdown(wait=True, cancel_futures=True)
