"""The seed graph's expectations, small fixtures, and random graphs against a plain model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from archgraph.functions import ids
from archgraph.operators import graph
from archgraph.operators.graph import Graph
from archgraph.plans import rules
from archgraph.schema import DEPENDENCY, EDGE, OVERRIDE, RELATIONS

#: A kiosk's order reserves stock by RPC and tells a printer by a topic; both ways end in one ledger.
SEED = [
    ("kiosk/OrderForm", "uses", "kiosk/orderHook", "OrderForm.vue:8"), ("kiosk/orderHook", "calls_graphql", "graphql/Mutation.placeOrder", "hook.ts:5"),
    ("graphql/Mutation.placeOrder", "resolved_by", "kitchen/OrderResolver.place", "schema.graphql:14"), ("kitchen/OrderResolver.place", "calls", "rpc/Stock.Reserve", "order_resolver.rb:31"),
    ("kitchen/OrderResolver.place", "publishes", "topic/orders.placed", "order_resolver.rb:36"), ("rpc/Stock.Reserve", "implemented_by", "stock/reserve", "stock.proto:22"),
    ("topic/orders.placed", "consumed_by", "printer/on_order", "printer.go:11"), ("stock/reserve", "calls", "stock/ledger", "reserve.go:40"),
    ("printer/on_order", "calls", "stock/ledger", "printer.go:19"),
]


def edges(spark, rows, confidence=1.0, provenance="ast"):
    return spark.createDataFrame([(*r, confidence, provenance)[:6] if len(r) == 4 else r for r in rows], EDGE)


def hops(answer):
    return {r.entity: r.hops for r in answer.entries.collect()}


@pytest.fixture(scope="module")
def seed(spark):
    return Graph(edges(spark, SEED))


def test_seed_impact(seed):
    found = graph.impact(seed, "rpc/Stock.Reserve")
    assert hops(found) == {"kitchen/OrderResolver.place": 1, "graphql/Mutation.placeOrder": 2, "kiosk/orderHook": 3, "kiosk/OrderForm": 4} and not found.truncated
    assert hops(graph.impact(seed, "stock/ledger"))["kitchen/OrderResolver.place"] == 3
    short = graph.impact(seed, "rpc/Stock.Reserve", 1)
    assert hops(short) == {"kitchen/OrderResolver.place": 1} and short.truncated
    with pytest.raises(ValueError):
        graph.impact(seed, "rpc/Stock.Reserve", 0)


def test_seed_context_and_views(spark, seed):
    assert graph.context(seed, "kitchen/OrderResolver.place").edges.count() == 3
    feature = Graph(edges(spark, [("rpc/Stock.Reserve", "implemented_by", "stock/reserve_batch", "stock.proto:22")]))
    assert [r.to_id for r in graph.context(feature, "rpc/Stock.Reserve").edges.collect()] == ["stock/reserve_batch"]
    unknown = graph.context(seed, "nowhere")
    assert unknown.edges.collect() == [] and [r.id for r in unknown.nodes.collect()] == ["nowhere"]


def test_seed_trace(seed):
    found = graph.trace(seed, "kiosk/OrderForm", "stock/ledger")
    path = [r.entity for r in found.entries.orderBy("hops").collect()]
    # Of the two ways the one through the RPC is the smaller sequence.
    assert path == ["kiosk/OrderForm", "kiosk/orderHook", "graphql/Mutation.placeOrder", "kitchen/OrderResolver.place", "rpc/Stock.Reserve", "stock/reserve", "stock/ledger"]
    rows = found.edges.orderBy("step").collect()
    assert [(r.from_id, r.to_id) for r in rows] == list(zip(path, path[1:]))
    every = {(r.from_id, r.to_id): r.edge_id for r in graph.with_edge_ids(graph.merge_edges(seed.direct())).collect()}
    assert {(r.from_id, r.to_id): r.edge_id for r in rows}.items() <= every.items()
    assert {r.id for r in found.nodes.collect()} == set(path)


def test_trace_ties_limits_and_ends(spark):
    diamond = Graph(edges(spark, [(a, "calls", b, "x:1") for a, b in (("start", "right"), ("start", "left"), ("right", "end"), ("left", "end"))]))
    assert [r.entity for r in graph.trace(diamond, "start", "end").entries.orderBy("hops").collect()] == ["start", "left", "end"]
    short = graph.trace(diamond, "start", "end", 1)
    assert short.entries.collect() == [] and short.truncated and {r.id for r in short.nodes.collect()} == {"start", "end"}
    none = graph.trace(diamond, "end", "start")
    assert none.entries.collect() == [] and not none.truncated
    same = graph.trace(diamond, "no", "no")
    assert hops(same) == {"no": 0} and same.edges.collect() == []


def test_structural_edges_are_context_only(spark):
    g = Graph(edges(spark, [("file", "defines", "caller", "f:1"), ("caller", "calls", "target", "f:2")]))
    assert graph.context(g, "file").edges.count() == 1
    assert graph.trace(g, "file", "target").entries.collect() == [] and graph.trace(g, "caller", "target").edges.count() == 1
    kinds = {r.id: r.kind for r in graph.context(g, "caller").nodes.collect()}
    assert kinds == {"file": "namespace", "caller": "callable", "target": "callable"}


def test_merge_and_generated(spark):
    rows = [("a", "calls", "b", "a.rs:1", 0.6, "unique_name_heuristic"), ("a", "calls", "b", "a.rs:2", 1.0, "ast"), ("a", "calls", "b", "a.rs:2", 1.0, "ast"), ("m", "defines", "g", "m:1", 1.0, "generated"), ("f", "field_of", "m", "m:2", 1.0, "generated")]
    merged = {(r.from_id, r.to_id): r for r in graph.merge_edges(edges(spark, rows)).collect()}
    assert merged["a", "b"].confidence == 1.0 and [e.line for e in merged["a", "b"].evidence] == [2, 1]
    nodes = graph.describe(spark.createDataFrame([("m",), ("g",), ("f",)], "node string"), edges(spark, rows))
    assert {r.id: r.origin for r in nodes.collect()} == {"m": "source", "g": "generated", "f": "generated"}


def test_overrides_and_rpc_rule(spark):
    states = edges(spark, [("client", "calls", "rust-call://helper", "c:1"), ("client", "calls", "rust-call://helper", "c:2"), ("helper", "calls", "deep", "h:1")])
    over = spark.createDataFrame([("client", "calls", "rust-call://helper", "repo://t/rust/lib/helper", "c:1", 0.6, "unique_name_heuristic")], OVERRIDE)
    rpc = edges(spark, [("grpc://S/M", "binds_contract", "proto-method://S/M", "p:1"), ("client", "calls_rpc", "grpc://S/M", "c:3"), ("grpc://S/M", "implemented_by", "server", "s:1")])
    g = Graph(states, over, rpc)
    direct = {(r.from_id, r.to_id, r.evidence) for r in g.direct().collect()}
    assert ("client", "rust-call://helper", "c:1") not in direct and ("client", "rust-call://helper", "c:2") in direct and ("client", "repo://t/rust/lib/helper", "c:1") in direct
    assert hops(graph.impact(g, "proto-method://S/M")) == {"grpc://S/M": 1, "client": 2, "server": 2}
    assert hops(graph.impact(g, "server")) == {}
    evidence = graph.trace(g, "client", "repo://t/rust/lib/helper").edges.first().evidence[0]
    assert evidence.source_kind == "inference" and evidence.detail == "unique_name_heuristic"


def model(rows, start, most, rpc=()):
    everything = [r for r in rows if r[1] in DEPENDENCY] + list(rpc)
    reach, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, _, b in everything:
            if b == x and a not in reach:
                reach.add(a)
                todo.append(a)
    chosen = [e for e in everything if e[2] in reach] + [e for e in rpc if e[1] == "implemented_by" and e[0].startswith("grpc://") and e[0] in reach]
    steps = {(a, b) if r == "implemented_by" and a.startswith("grpc://") else (b, a) for a, r, b in chosen}
    dist, level = {start: 0}, [start]
    for hop in range(1, most + 1):
        level = sorted({b for a, b in steps if a in level and b not in dist})
        dist |= {x: hop for x in level}
    return {k: v for k, v in dist.items() if v}


def test_impact_equals_a_plain_model(spark):
    rnd = random.Random(6)
    names = [f"n{i}" for i in range(9)] + ["grpc://a", "grpc://b"]
    for _ in range(3):
        rows = {(rnd.choice(names), rnd.choice(RELATIONS), rnd.choice(names)) for _ in range(16)}
        rpc = {(rnd.choice(names), rnd.choice(("implemented_by", "calls_rpc")), rnd.choice(names)) for _ in range(6)}
        g = Graph(edges(spark, [(*r, "e:1") for r in rows]), None, edges(spark, [(*r, "e:2") for r in rpc]))
        assert hops(graph.impact(g, "n1", 3)) == model(rows, "n1", 3, rpc)


def test_path_projection_and_labels(spark):
    g = Graph(edges(spark, [("repo://r/rust/a", "calls", "rust-call://x", "a.rs:1"), ("rust-call://x", "calls", "repo://r/rust/b", "x.rs:2")]))
    steps = graph.project_path(graph.trace(g, "repo://r/rust/a", "repo://r/rust/b")).collect()
    assert len(steps) == 1 and steps[0].to_id == "repo://r/rust/b" and [e.path for e in steps[0].evidence] == ["a.rs", "x.rs"]
    rows = [("repo://r/rust/x/y/run",), ("repo://r/rust/z/y/run",), ("repo://r/rust/solo",), ("grpc://S/M",)]
    nodes = spark.createDataFrame(rows, "id string").select("id", ids.entity_name(F.col("id")).alias("name"), ids.repository(F.col("id")).alias("repository"))
    assert {r.id: r.label for r in graph.labels(nodes).collect()} == {
        "repo://r/rust/x/y/run": "r · x/y · run", "repo://r/rust/z/y/run": "r · z/y · run", "repo://r/rust/solo": "r · solo", "grpc://S/M": "cross-repository · S.M",
    }


@pytest.mark.parametrize(
    "id_,expected",
    [("repo://r/rust/tests/a", True), ("repo://r/rust/a_test/x", True), ("repo://r/typescript/a.spec.ts/x", True), ("repo://r/elixir/MyTest/x/1", True), ("repo://r/rust/bench_x", True),
     ("repo://r/rust/x_spec", True), ("repo://r/rust/specs/a", True), ("repo://r/rust/BENCHES/a", True), ("repo://r/rust/a.test", True), ("repo://r/rust/contest/latest", False)],
)
def test_test_ids(spark, id_, expected):
    assert spark.createDataFrame([(id_,)], "id string").select(ids.is_test(F.col("id"))).first()[0] is expected


def test_masking_needs_all_four_columns(spark):
    over = spark.createDataFrame([("a", "calls", "b", "c", "x:1", 0.6, "ast")], OVERRIDE)
    rows = [("a", "calls", "b", "x:1"), ("a", "calls", "b", "x:2"), ("a", "uses", "b", "x:1"), ("a", "calls", "z", "x:1")]
    assert rules.masked(edges(spark, rows), over).count() == 3


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_clustered_graphs_answer_alike(spark):
    rnd = random.Random(21)
    names = [f"n{i}" for i in range(40)] + [f"grpc://S/M{i}" for i in range(6)]
    rows = sorted({(rnd.choice(names), rnd.choice(["calls", "uses", "defines", "implemented_by"]), rnd.choice(names), f"f:{rnd.randrange(9)}") for _ in range(160)})
    hub = [("hub", "calls", f"leaf{i}", "h:1") for i in range(300)]
    over = spark.createDataFrame([(*rows[0][:3], "n1", rows[0][3], 0.6, "unique_name_heuristic")], OVERRIDE)
    plain = Graph(edges(spark, rows + hub), over, edges(spark, [("grpc://S/M1", "implemented_by", "n7", "p:1"), ("n3", "calls_rpc", "grpc://S/M1", "p:2")]))
    built = plain.clustered()
    for name in ("n1", "n7", "grpc://S/M1", "hub", "leaf7", "nowhere"):
        assert hops(graph.impact(built, name)) == hops(graph.impact(plain, name))
        assert hops(graph.dependencies(built, name)) == hops(graph.dependencies(plain, name))
        key = lambda answer: sorted((r.edge_id, r.from_id, r.to_id, r.relation, r.confidence) for r in answer.edges.collect())
        assert key(graph.context(built, name)) == key(graph.context(plain, name))
    assert key(graph.trace(built, "n1", "n7")) == key(graph.trace(plain, "n1", "n7"))
    assert key(graph.dependencies(built, "n3", 2)) == key(graph.dependencies(plain, "n3", 2))


def test_a_level_reads_the_buckets_of_its_nodes_and_moves_no_edges(spark):
    from archgraph.plans.adjacency import Adjacency
    from archgraph.plans.fixpoint import seeds

    rows = [(f"a{i}", "calls", f"b{i % 50}", f"x:{i}") for i in range(2000)] + [("hub", "calls", f"b{i}", "h:1") for i in range(3000)]
    built = Graph(edges(spark, rows)).clustered().adjacency
    for level in (built.backward.pairs_of(["b7"]), built.forward.pairs_of(["a1", "a2"])):
        plan = spark._jvm.PythonSQLUtils.explainString(level.distinct()._jdf.queryExecution(), "formatted")
        assert "Exchange" not in plan and f"out of {built.buckets}" in plan and f"SelectedBucketsCount: {built.buckets} out" not in plan
    assert built.backward.pairs_of(["b7"]).count() == 41
    # A frontier that is too large to be broadcast comes to the edges' buckets; the edges stay.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = built.around("from_id", seeds(spark, *(f"a{i}" for i in range(1500))))
        plan = plan_of(joined)
        assert joined.count() == 1500 and plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    again = Adjacency.open(spark, built.root)
    assert again.buckets == built.buckets and Adjacency.open(spark, built.root + "x") is None
    # The hub's edges are several files of one bucket.
    files = [f for f in built.table("from_id").where("from_id = 'hub'").inputFiles()]
    assert len(files) > built.buckets


def test_no_task_writes_several_buckets(spark):
    rows = [(f"a{i}", "calls", f"b{i}", f"x:{i}") for i in range(4000)]
    built = Graph(edges(spark, rows)).clustered().adjacency
    for end in ("from_id", "to_id"):
        per_file = [r["count"] for r in built.table(end).groupBy(F.input_file_name(), F.pmod(F.hash(end), F.lit(built.buckets))).count().collect()]
        tasks = {re.search(r"part-(\d+)-", f).group(1) for f in built.table(end).inputFiles()}
        assert len(tasks) == len(per_file) == built.buckets and max(per_file) < 2 * len(rows) / built.buckets


def test_nodes_are_described_without_numbering_edges(spark, monkeypatch):
    rows = [("repo://a/b/rust/m/f", "calls", "grpc://S/M"), ("g", "defines", "made"), ("made", "calls", "repo://a/b/rust/m/f"), ("far", "calls", "g")]
    plain = Graph(edges(spark, [(*r, f"f:{k}") for k, r in enumerate(rows)]).withColumn("provenance", F.expr("if(from_id = 'made', 'generated', 'ast')")))
    want = [sorted(graph.describe(x.entries.selectExpr("entity as node"), x.edges).collect()) for x in (graph.impact(plain, "grpc://S/M"), graph.dependencies(plain, "far"))]
    monkeypatch.setattr(graph, "with_edge_ids", None)
    found = graph.impact(plain, "grpc://S/M"), graph.dependencies(plain, "far")
    starts = ("grpc://S/M", "far")
    assert [sorted(x.nodes.where(F.col("id") != s).collect()) for x, s in zip(found, starts)] == want
    assert graph.impact_groups(found[0]).count() > 0
