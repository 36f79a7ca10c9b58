"""Enrichments as jobs: what each active enricher has to do for each repository, and what became of it.

A job is a log (see files.py) of its states: ``pending``, ``running`` until some time, then ``current``, ``superseded`` or
``failed``. Each step is an entry that one driver only can add, so a job is taken, and settled, once; one that a lost driver
was running is pending again when its time is over.
"""

from __future__ import annotations

import time
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame

from .files import Log, Stale
from .publish import Store


class Enrichments:
    """The jobs of a store. ``enrichers`` have an id, a version and ``enrich(repository, graph)``."""

    #: Seconds that a job may run, and how often one is tried that fails.
    SECONDS, ATTEMPTS = 3600, 3
    SCHEMA = "repository string, analyzer string, state string, version string, input string, detail string"

    def __init__(self, store: Store, enrichers: list, clock=time.time) -> None:
        self.store, self.clock = store, clock
        self.enrichers = {e.id: e for e in enrichers}

    def _folder(self, view: str) -> str:
        return f"enrichments/{quote(view, safe='')}"

    def _log(self, view: str, repository: str, analyzer: str) -> Log:
        return Log(self.store.files, f"{self._folder(view)}/{quote(repository, safe='')}/{quote(analyzer, safe='')}")

    def request(self, view: str) -> int:
        """Make a job of what has another input or version than its last one; returns how many."""
        made = 0
        for repository, input_ in self.store.pointer(view)["inputs"].items():
            for e in self.enrichers.values():
                log = self._log(view, repository, e.id)
                number = log.last()
                last = log.load(number)
                if last is None or (last["version"], last["input"]) != (e.version, input_):
                    made += log.append(number, {"state": "pending", "version": e.version, "input": input_, "attempt": 0})
        return made

    def _jobs(self, view: str):
        for r in self.store.files.names(self._folder(view)):
            for a in self.store.files.names(f"{self._folder(view)}/{r}"):
                log = self._log(view, unquote(r), unquote(a))
                number = log.last()
                yield unquote(r), unquote(a), log, number, log.load(number)

    def _open(self, job: dict) -> bool:
        """Whether a job can be taken: it waits, its driver is gone, or it failed and may be tried again."""
        return (
            job["state"] == "pending" or (job["state"] == "running" and job["until"] <= self.clock())
            or (job["state"] == "failed" and job["attempt"] < self.ATTEMPTS)
        )

    def run(self, view: str) -> dict[str, int]:
        """Take each open job once; returns how many came to which state. A result for an input that is no longer there is dropped."""
        counts: dict[str, int] = {}
        for repository, analyzer, log, number, job in list(self._jobs(view)):
            if analyzer not in self.enrichers or not self._open(job):
                continue
            running = {"state": "running", "version": job["version"], "input": job["input"], "attempt": job["attempt"] + 1, "until": self.clock() + self.SECONDS}
            if not log.append(number, running):
                continue  # another driver took it
            enricher, ended = self.enrichers[analyzer], "current"
            detail = ""
            try:
                if self.store.pointer(view)["inputs"].get(repository) != job["input"] or enricher.version != job["version"]:
                    raise Stale("the input or the enricher has changed")
                overrides, edges = enricher.enrich(repository, self.store.graph(view))
                self.store.enrich(view, repository, analyzer, job["input"], job["version"], overrides, edges)
            except Stale as e:
                ended, detail = "superseded", str(e)
            except Exception as e:  # noqa: BLE001 - an enricher is foreign code, and its error is its job's result
                ended, detail = "failed", f"{type(e).__name__}: {e}"[:500]
            log.append(number + 1, {**{k: running[k] for k in ("version", "input", "attempt")}, "state": ended, "detail": detail})
            log.trim(20)
            counts[ended] = counts.get(ended, 0) + 1
        return counts

    def status(self, view: str) -> DataFrame:
        """``repository, analyzer, state, version, input, detail``; a state that isn't settled names its version, as in ``pending:2``."""
        rows = []
        for repository, analyzer, _, _, job in self._jobs(view):
            state = job["state"] if job["state"] in ("current", "superseded", "failed") else f"{job['state']}:{job['version']}"
            rows.append((repository, analyzer, state, job["version"], job["input"], job.get("detail", "")))
        return self.store.spark.createDataFrame(rows, self.SCHEMA)
