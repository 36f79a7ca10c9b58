"""Enrichment jobs: each is taken and settled once, whatever happens to its driver."""

import pytest

from archgraph.operators.enrichment import Enrichments
from archgraph.operators.publish import Store
from archgraph.schema import EDGE, ENTITY, OVERRIDE


class Compiler:
    def __init__(self, spark, id_="rust", version="1", fails=(), during=lambda: None):
        self.spark, self.id, self.version, self.fails, self.during, self.seen = spark, id_, version, fails, during, []

    def enrich(self, repository, graph):
        self.seen.append(repository)
        self.during()
        if repository in self.fails:
            raise RuntimeError("no compiler here")
        return self.spark.createDataFrame([(f"repo://{repository}/x", "calls", "rust-call://h", f"repo://{repository}/h", "x:1", 1.0, "compiler")], OVERRIDE), None


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def publish(spark, store, **inputs):
    edges = {r: spark.createDataFrame([(f"repo://{r}/x", "calls", "rust-call://h", "x:1", 1.0, "ast")], EDGE) for r in inputs}
    store.publish("main", {r: (f, edges[r], spark.createDataFrame([], ENTITY)) for r, f in inputs.items()})


def states(jobs):
    return {r.repository: r.state for r in jobs.status("main").collect()}


def test_jobs_are_settled_once(spark, store):
    publish(spark, store, a="f1", b="f1", c="f1")
    # While c is being worked on, its input moves on.
    compiler = Compiler(spark, fails=("b",), during=lambda: compiler.seen == ["a", "b", "c"] and publish(spark, store, a="f1", b="f1", c="f2"))
    jobs = Enrichments(store, [compiler])
    assert jobs.request("main") == 3 and jobs.request("main") == 0
    assert set(states(jobs).values()) == {"pending:1"}
    assert jobs.run("main") == {"current": 1, "failed": 1, "superseded": 1}
    # A driver that starts anew tries what failed, and makes a job of the new input; what is settled stays.
    again = Compiler(spark, fails=("b",))
    jobs = Enrichments(Store(spark, store.root), [again])
    assert jobs.request("main") == 1 and states(jobs) == {"a": "current", "b": "failed", "c": "pending:1"}
    assert jobs.run("main") == {"failed": 1, "current": 1} and again.seen == ["b", "c"]
    assert jobs.run("main") == {"failed": 1} and jobs.run("main") == {}, "after three attempts a job stays failed"
    assert {r.to_id for r in store.graph("main").direct().collect()} == {"repo://a/h", "rust-call://h", "repo://c/h"}
    # A new version is a new job.
    newer = Enrichments(store, [Compiler(spark, version="2")])
    assert newer.request("main") == 3 and newer.run("main") == {"current": 3} and set(states(newer).values()) == {"current"}


def test_a_lost_driver_s_job_is_taken_when_its_time_is_over(spark, store):
    publish(spark, store, a="f1")
    now = [0.0]

    class Lost(BaseException):
        pass

    def vanish():
        raise Lost

    first, second = (Enrichments(store, [c], lambda: now[0]) for c in (Compiler(spark, during=vanish), Compiler(spark)))
    first.request("main")
    with pytest.raises(Lost):
        first.run("main")
    assert states(second) == {"a": "running:1"} and second.run("main") == {}
    now[0] += Enrichments.SECONDS + 1
    assert second.run("main") == {"current": 1} and first.run("main") == {}
