"""Jobs in the background of the driver: threads whose Spark work shares the cluster fairly."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from ..sources.store import Store
from . import library, search


class JobQueue:
    """Runs calls in threads; each has its own scheduler pool (`spark.scheduler.mode=FAIR`) and a tag to cancel it by."""

    def __init__(self, store: Store, workers: int = 4):
        self.store, self.pool, self.jobs = store, ThreadPoolExecutor(workers, thread_name_prefix="weftlens"), {}

    def put(self, call: Callable, *args, **named) -> str:
        """Queue a call(store, ...); the job's id."""
        job = uuid.uuid4().hex
        sc = self.store.spark.sparkContext

        def run():
            sc.setLocalProperty("spark.scheduler.pool", threading.current_thread().name)
            sc.addJobTag(job)
            try:
                return call(self.store, *args, **named)
            finally:
                sc.removeJobTag(job)

        self.jobs[job] = self.pool.submit(run)
        return job

    def search(self, p: search.Params, results_id: str | None = None) -> tuple[str, str]:
        """Queue a search; (job, results_id). The results_id can be asked for its progress at once after the job has begun."""
        rid = results_id or uuid.uuid4().hex
        return self.put(search.submit, p, rid), rid

    def status(self, job: str) -> str:
        f: Future = self.jobs[job]
        if f.cancelled():
            return "Cancelled"
        if not f.done():
            return "Running" if f.running() else "Queued"
        return "Failed" if f.exception() else "Done"

    def result(self, job: str, timeout: float | None = None):
        """What the call returned; its exception is raised here."""
        return self.jobs[job].result(timeout)

    def cancel(self, job: str) -> None:
        if not self.jobs[job].cancel():
            self.store.spark.sparkContext.cancelJobsWithTag(job)

    def close(self) -> None:
        """Wait for all jobs."""
        self.pool.shutdown(wait=True)


class IngestQueue(JobQueue):
    """One worker: indexes of new features go on from the count, so ingests follow one another."""

    def __init__(self, store: Store):
        super().__init__(store, 1)

    def ingest(self, *args, **named) -> str:
        return self.put(library.ingest, *args, **named)
