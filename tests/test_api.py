"""Index to answer, and rendering."""

import json

from archgraph import api
from archgraph.operators import graph, render
from archgraph.schema import EDGE


def test_index_query_and_reindex(spark, tmp_path, capsys):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "src/main.rs").write_text("fn main() { helper(); }\n")
    (root / "src/util.rs").write_text("pub fn helper() { deep(); }\nfn deep() {}\n")
    store = f"file://{tmp_path}/store"
    workspace = api.Workspace(spark, store)
    first = workspace.index({"acme/app": f"file://{root}"})
    assert first["revision"] == 1 and first["inserted"] > 0
    assert workspace.index({"acme/app": f"file://{root}"}) == {"revision": 1, "skipped": True}
    main, deep = "repo://acme/app/rust/main/main", "repo://acme/app/rust/util/deep"
    assert {r.entity: r.hops for r in workspace.dependencies(main).entries.collect()} == {"repo://acme/app/rust/util/helper": 1, deep: 2}
    assert api.main(["--store", store, "impact", deep, "--json"]) == 0
    body = json.loads(capsys.readouterr().out)
    assert body["schema"] == "archgraph.impact.v2" and [x["entity"] for x in body["entries"]] == ["repo://acme/app/rust/util/helper", main]
    assert api.main(["--store", store, "why", main, deep]) == 0
    assert capsys.readouterr().out.splitlines() == ["2 hops · 1 repositories · confidence 0.60", "acme/app · main · main", "  calls → acme/app · util · helper", "    src/main.rs:1", "  calls → acme/app · util · deep", "    src/util.rs:1"]
    (root / "src/util.rs").write_text("pub fn helper() {}\n")
    assert workspace.index({"acme/app": f"file://{root}"})["removed"] >= 1
    assert workspace.inspect("calls").count() == 1 and "Physical Plan" in workspace.explain()


def test_an_index_parses_changed_files_only_and_runs_recognizers_of_plugins(spark, tmp_path):
    from archgraph import plugins

    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    for k in range(8):
        (root / f"src/m{k}.rs").write_text(f"pub fn f{k}() {{ f{(k + 1) % 8}(); }}\n")

    def notes(text, repository, path):
        return [{"sort": "edge", "local_symbol": f"repo://{repository}/rust/{path}", "role": "uses", "target": "note://" + line[7:], "evidence": f"{path}:{n}"} for n, line in enumerate(text.splitlines(), 1) if line.startswith("// see ")]

    registry = plugins.builtin()
    registry.install(plugins.Plugin("notes", "1", recognizers={"notes": (r"\.rs$", notes)}))
    workspace = api.Workspace(spark, f"file://{tmp_path}/store", registry.activate(["baseline", "notes"]))
    first = workspace.index({"acme/app": f"file://{root}"})
    assert first["cached"] == 0 and first["parsed"] == 16  # by the frontend, and by recognizers
    (root / "src/m3.rs").write_text("// see manual\npub fn f3() { f5(); }\n")
    second = workspace.index({"acme/app": f"file://{root}"})
    assert (second["parsed"], second["cached"]) == (2, 14)
    key = lambda w: sorted((r.from_id, r.relation, r.to_id, r.evidence) for r in w.graph().effective().collect())
    assert ("repo://acme/app/rust/src/m3.rs", "uses", "note://manual", "src/m3.rs:1") in key(workspace)
    whole = api.Workspace(spark, f"file://{tmp_path}/other", registry.activate(["baseline", "notes"]))
    assert whole.index({"acme/app": f"file://{root}"})["parsed"] == 16 and key(whole) == key(workspace)


def test_index_across_repositories(spark, tmp_path, capsys):
    """A call from Elixir over a contract to Rust, and what can't be bound, through a store."""
    from test_frameworks import ELIXIR, SERVER

    for name, path, text in (("srv", "src/main.rs", SERVER), ("shop", "lib/s.ex", ELIXIR.replace("Stub.get_price(channel, 1)", "Stub.get_price(channel, 1)\n    Pricing.V1.Pricing.Stub.lost_call(channel, 1)")), ("api", "p.proto", 'syntax = "proto3"; package pricing.v1; message P {} service Pricing { rpc GetPrice (P) returns (P); }')):
        (tmp_path / name / path).parent.mkdir(parents=True)
        (tmp_path / name / path).write_text(text)
    workspace = api.Workspace(spark, f"file://{tmp_path}/store")
    assert workspace.index({r: f"file://{tmp_path}/{r}" for r in ("api", "shop", "srv")})["revision"] == 1
    client, server = "repo://shop/elixir/Shop.Prices/fetch/1", "repo://srv/rust/main/impl/Pricing-for-Svc/get_price"
    found = workspace.trace(client, server)
    assert [r.entity for r in found.entries.orderBy("hops").collect()] == [client, "grpc://pricing.v1.Pricing/GetPrice", server]
    assert [(r.relation, r.step) for r in found.edges.orderBy("step").collect()] == [("calls_rpc", 1), ("implemented_by", 2)]
    assert client in {r.entity for r in workspace.impact("proto-method://pricing.v1.Pricing/GetPrice").entries.collect()}
    assert [(r.code, r.repository, r.path, r.detail) for r in workspace.diagnostics().collect()] == [("grpc.contract_unmatched", "shop", "lib/s.ex", "pricing.v1.Pricing/LostCall")]
    assert api.main(["--store", f"file://{tmp_path}/store", "context", client, "--verbose"]) == 0
    assert "warning grpc.contract_unmatched shop lib/s.ex:" in capsys.readouterr().out


def test_plugins(spark):
    import pytest

    from archgraph import plugins

    registry = plugins.builtin()
    with pytest.raises(plugins.DuplicateId):
        registry.install(plugins.Plugin("baseline", "3"))
    with pytest.raises(plugins.DuplicateId):
        registry.install(plugins.Plugin("other", "1", (plugins.BaselineAnalyzer(),)))
    with pytest.raises(KeyError):
        registry.activate(["nowhere"])
    with pytest.raises(plugins.DuplicateId):
        registry.activate(["baseline", "baseline"])
    one = registry.activate(["baseline"]).identity()
    registry.install(plugins.Plugin("extra", "1"))
    assert registry.activate(["extra", "baseline"]).identity() == registry.activate(["baseline", "extra"]).identity() != one == registry.activate(["baseline"]).identity()
    with pytest.raises(ValueError):
        registry.activate(["extra"]).analyze(spark.createDataFrame([], "repository string, path string, content binary"))


def test_rendering(spark):
    rows = [("repo://r/rust/a", "calls", "rust-call://g", "a.rs:1", 1.0, "ast"), ("rust-call://g", "calls_rpc", "grpc://S/M", "g.rs:2", 1.0, "ast")]
    g = graph.Graph(spark.createDataFrame(rows, EDGE))
    answer = graph.trace(g, "repo://r/rust/a", "grpc://S/M")
    text = render.compact_text("trace", "repo://r/rust/a", answer)
    assert "1 hop · 1 repositories · confidence 1.00" in text and "rust-call" not in text
    why = render.compact_text("why", "repo://r/rust/a", answer)
    assert "a.rs:1" in why and "g.rs:2" in why
    raw = render.raw_text("trace", "repo://r/rust/a", answer)
    assert "rust-call://g" in raw and "e1 repo://r/rust/a --calls--> rust-call://g confidence 1.00" in raw
    context = render.compact_text("context", "grpc://S/M", graph.context(g, "grpc://S/M"), True)
    assert context.startswith("cross-repository · S.M")
    impact = render.compact_text("impact", "grpc://S/M", graph.impact(g, "grpc://S/M", 1))
    assert impact.endswith("truncated: more lies beyond the hop limit")
