"""Revisions: diffs, reuse, overrides, stale results, garbage, and readers during a write."""

import pytest

from archgraph.operators import graph
from archgraph.operators.publish import Stale, Store, fingerprint, last_wins, validate_entities
from archgraph.schema import EDGE, ENTITY, OVERRIDE


def facts(spark, rows, entities=()):
    edges = spark.createDataFrame([(*r, 1.0, "ast", k) for k, r in enumerate(rows)], EDGE.simpleString()[7:-1].replace(":", " ") + ", ordinal int")
    return edges, spark.createDataFrame(list(entities), ENTITY)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_diff_reuse_and_garbage(spark, store):
    first = store.publish("main", {"r": ("f1", *facts(spark, [("a", "calls", "b", "a.rs:1"), ("removed", "calls", "b", "a.rs:3")]))})
    assert first == {"inserted": 2, "updated": 0, "removed": 0, "unchanged": 0, "revision": 1}
    before = store.graph("main")
    second = store.publish("main", {"r": ("f2", *facts(spark, [("a", "calls", "b", "a.rs:2"), ("new", "calls", "b", "a.rs:4")]))})
    assert second == {"inserted": 1, "updated": 1, "removed": 1, "unchanged": 0, "revision": 2}
    assert graph.context(store.graph("main"), "removed").edges.collect() == []
    assert before.states.count() == 2 and graph.context(before, "removed").edges.count() == 1, "a reader keeps its revision"
    same = store.publish("other", {"r": ("f2", *facts(spark, [("a", "calls", "b", "a.rs:2"), ("new", "calls", "b", "a.rs:4")]))})
    assert same["revision"] == 1 and store.pointer("other")["states"] == store.pointer("main")["states"]
    gone = store.collect_garbage(["main", "other"])
    assert len(gone) == 1 and store.graph("main").states.count() == 2


def test_last_duplicate_wins(spark, store):
    store.publish("main", {"r": ("f", *facts(spark, [("s", "calls", "t", "src/lib.rs:1"), ("s", "calls", "t", "src/lib.rs:2")]))})
    assert [r.evidence for r in store.graph("main").states.collect()] == ["src/lib.rs:2"]
    rows = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("j", 3, 1)], "k string, v int, at int")
    assert sorted(tuple(r) for r in last_wins(rows, ["k"], "at").collect()) == [("j", 3, 1), ("k", 2, 9)]


def test_enrichment_is_checked_carried_and_retracted(spark, store):
    def publish(fa, fb):
        return store.publish("main", {"a": (fa, *facts(spark, [("a/x", "calls", "rust-call://h", "x:1")])), "b": (fb, *facts(spark, [("b/x", "calls", "rust-call://k", "y:1")]))})

    def override(source, target, to):
        return spark.createDataFrame([(source, "calls", target, to, "x:1" if source[0] == "a" else "y:1", 0.6, "compiler")], OVERRIDE)

    publish("a1", "b1")
    assert store.enrich("main", "a", "rust", "a1", "v1", override("a/x", "rust-call://h", "a/h")) == 2
    assert store.enrich("main", "b", "rust", "b1", "v1", override("b/x", "rust-call://k", "b/k")) == 3
    with pytest.raises(Stale):
        store.enrich("main", "b", "rust", "b0", "v1", override("b/x", "rust-call://k", "b/z"))
    assert {r.to_id for r in store.graph("main").direct().collect()} == {"a/h", "b/k"}
    publish("a1", "b2")  # only b's input changes: a's enrichment is carried forward
    assert {r.to_id for r in store.graph("main").direct().collect()} == {"a/h", "rust-call://k"}
    store.enrich("main", "a", "rust", "a1", "v2", override("a/x", "rust-call://h", "a/h").where("false"))
    assert {r.to_id for r in store.graph("main").direct().collect()} == {"rust-call://h", "rust-call://k"}


def test_failed_publication_leaves_the_pointer(spark, store):
    store.publish("main", {"r": ("f1", *facts(spark, [("a", "calls", "b", "x:1")]))})
    before = store.pointer("main")
    broken = facts(spark, [("a", "calls", "c", "x:1")])[0].selectExpr("from_id", "relation", "raise_error('no') as to_id", "evidence", "confidence", "provenance")
    with pytest.raises(Exception):
        store.publish("main", {"r": ("f2", broken, facts(spark, [])[1])})
    assert store.pointer("main") == before and store.graph("main").states.count() == 1


def test_fingerprint_ignores_order_only(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "k string, v int")
    value = lambda d: fingerprint(d, ["k", "v"]).first()[0]
    assert value(a) == value(a.orderBy("v", ascending=False)) != value(a.distinct())
    assert value(spark.createDataFrame([("ab", "c")], "k string, v string")) != value(spark.createDataFrame([("a", "bc")], "k string, v string"))


def test_entity_facts_are_validated(spark):
    rows = [("1", "callable", ""), ("2", "graphql_type", "graphql_type:enum"), ("3", "graphql_type", "proto_type:enum"), ("4", "nonsense", ""), ("5", "proto_method", "rpc_cardinality:unary"), ("6", "callable", "proto_type:enum")]
    assert sorted(r.id for r in validate_entities(spark.createDataFrame(rows, ENTITY)).collect()) == ["3", "4", "6"]


def test_of_two_publishers_from_one_revision_the_second_is_stale(spark, store, monkeypatch):
    """Both read the same revision; the other one commits between this one's check and its commit."""
    store.publish("main", {"r": ("f1", *facts(spark, [("a", "calls", "b", "x:1")]))})
    other, plain = Store(spark, store.root), store._append

    def late(view, before, after):
        monkeypatch.setattr(store, "_append", plain)
        other.publish("main", {"r": ("f2", *facts(spark, [("a", "calls", "c", "x:1")]))})
        plain(view, before, after)

    monkeypatch.setattr(store, "_append", late)
    with pytest.raises(Stale):
        store.publish("main", {"r": ("f3", *facts(spark, [("a", "calls", "d", "x:1")]))})
    assert store.pointer("main")["revision"] == 2 and [r.to_id for r in store.graph("main").states.collect()] == ["c"]
    assert store.publish("main", {"r": ("f3", *facts(spark, [("a", "calls", "d", "x:1")]))})["revision"] == 3


def test_many_writers_of_one_name(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from archgraph.operators.files import Files, Log

    log = Log(Files(spark, f"file://{tmp_path}/log"), "v")
    for n in range(5):
        with ThreadPoolExecutor(8) as pool:
            assert sum(pool.map(lambda k: log.append(n, {"by": k}), range(8))) == 1
    assert log.last() == 5 and log.load(5)["by"] in range(8) and log.load(9) is None
    log.trim(2)
    assert log.last() == 5 and not log.append(1, {"by": "one who slept"}) and log.last() == 5


def test_a_lock_ends_with_its_time_and_fences_its_holder(spark, store):
    from archgraph.errors import ArchgraphError
    from archgraph.operators.files import Lease

    now = [1000.0]
    first, second = (Lease(store.files, clock=lambda: now[0]) for _ in range(2))
    crashed = first.hold("a long one", 60)
    crashed.__enter__()
    with pytest.raises(ArchgraphError, match="a long one"), second.hold("another", 60):
        pass
    now[0] += 30
    first.renew("a long one", 60)
    now[0] += 45
    with pytest.raises(ArchgraphError), second.hold("another", 60):
        pass
    now[0] += 30  # the holder is gone, and its time is over
    with second.hold("another", 60) as token:
        assert token == first.token + 1
        with pytest.raises(Stale):
            first.check()
        store.lease.token = first.token
        with pytest.raises(Stale):
            store.publish("main", {"r": ("f", *facts(spark, [("a", "calls", "b", "x:1")]))})
        store.lease.token = 0
    assert store.pointer("main")["revision"] == 0
    with first.hold("nested", 60) if not first.token else store.exclusive("nested"), store.exclusive("nested"):
        pass


def test_a_lock_refuses_other_operations_and_threads_of_its_holder(store):
    """One store held for an operation isn't free for another one, nor for the same one in another thread."""
    from concurrent.futures import ThreadPoolExecutor

    from archgraph.errors import ArchgraphError

    def hold(operation):
        with store.exclusive(operation):
            return store.lease.token

    with store.exclusive("a long one"), ThreadPoolExecutor(1) as pool:
        assert hold("a long one") == store.lease.token
        with pytest.raises(ArchgraphError, match="another must wait for a long one"):
            hold("another")
        with pytest.raises(ArchgraphError, match="must wait for a long one"):
            pool.submit(hold, "a long one").result()
    assert hold("another") > 0


def test_garbage_that_a_publisher_takes_up_stays(spark, store, monkeypatch):
    """Collections run between a state's reuse and its revision, and between its writing and its revision."""
    old, new = facts(spark, [("a", "calls", "old", "x:1")]), facts(spark, [("a", "calls", "new", "x:1")])
    store.publish("main", {"r": ("f1", *old)})
    state = store.pointer("main")["states"]["r"]
    store.publish("main", {"r": ("f2", *new)})
    assert store.garbage() == [state]
    other, plain = Store(spark, store.root), Store._append
    during = []

    def collect_first(self, view, before, after):
        during.append(other.collect_garbage())
        plain(self, view, before, after)

    monkeypatch.setattr(Store, "_append", collect_first)
    store.publish("main", {"r": ("f1", *old)})  # takes up the state that is garbage until then
    assert during == [[]] and [r.to_id for r in store.graph("main").states.collect()] == ["old"]
    monkeypatch.setattr(Store, "_append", plain)
    # The claim that had to wait is taken up again: what is named by now stays, and goes no more.
    other.collect_garbage()
    assert store.graph("main").states.count() == 1 and other.claimed() == set()
    # A publisher that comes after a claim doesn't take what is claimed.
    store.publish("main", {"r": ("f2", *new)})
    with other.flights.flight(60):
        assert other.collect_garbage() == [] and other.claimed() >= {f"states/{state}"}
        store.publish("main", {"r": ("f1", *old)})
        assert store.pointer("main")["states"]["r"] != state
    assert state in other.collect_garbage() and [r.to_id for r in store.graph("main").states.collect()] == ["old"]


def test_an_interrupted_collection_is_taken_up(spark, store, monkeypatch):
    for k in range(4):
        store.publish("main", {"r": (f"f{k}", *facts(spark, [("a", "calls", f"b{k}", "x:1")]))})
    monkeypatch.setattr(Store, "BATCH", 1)
    plain, seen = store.files.delete, []

    def failing(name):
        if name.startswith("states/") and len(seen) == 1:
            raise RuntimeError("the driver is gone")
        seen.append(name)
        plain(name)

    monkeypatch.setattr(store.files, "delete", failing)
    with pytest.raises(RuntimeError):
        store.collect_garbage()
    assert len(store.claimed()) == 2
    monkeypatch.setattr(store.files, "delete", plain)
    assert len(store.collect_garbage()) == 2 and store.garbage() == [] and store.claimed() == set()


def test_jobs_of_a_publication_do_not_grow_with_repositories(spark, store):
    def jobs(n):
        edges = spark.range(10 * n).selectExpr(f"concat('r', id % {n}) as _owner", "concat('r', id % 7, '/f', id) as from_id", "'calls' as relation", "'t' as to_id", "'x:1' as evidence", "1.0d as confidence", "'ast' as provenance")
        entities = spark.range(n).selectExpr("concat('r', id) as _owner", "concat('e', id) as id", "'callable' as kind", "'' as metadata")
        spark.sparkContext.setJobGroup(f"publish-{n}", "")
        store.publish_owned(f"view{n}", {f"r{k}": "f" for k in range(n)}, edges, entities)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"publish-{n}"))

    # Spark lists the files of many paths in a job of their own.
    assert jobs(40) <= jobs(3) + 2
    assert store.observations(store.pointer("view40")).count() == 400 and len(store.pointer("view40")["states"]) == 40


def test_clustered_edges_of_a_view(spark, store):
    store.publish("main", {"r": ("f1", *facts(spark, [("a", "calls", "b", "x:1"), ("b", "calls", "c", "x:2"), ("f", "defines", "a", "x:3")]))})
    assert store.graph("main").adjacency is None
    store.cluster("main")
    found = store.graph("main")
    assert found.adjacency is not None and {r.entity: r.hops for r in graph.impact(found, "c").entries.collect()} == {"b": 1, "a": 2}
    assert {r.from_id for r in graph.context(found, "a").edges.collect()} == {"a", "f"}
    store.collect_garbage()
    assert store.graph("main").adjacency is not None
    store.publish("main", {"r": ("f2", *facts(spark, [("a", "calls", "z", "x:1")]))})
    assert store.graph("main").adjacency is None and any(x.startswith("adjacency/") for x in store.collect_garbage())
