"""Administration of a store, working trees, generated clients and embedded documents."""

import subprocess

import pytest

from archgraph import api, plugins
from archgraph.analysis import Analysis
from archgraph.errors import ArchgraphError
from archgraph.operators import modules
from archgraph.schema import DIAGNOSTIC, EDGE, OVERRIDE
from archgraph.sources import frameworks, git, languages

PROTO_TS = """// Code generated by a plugin. DO NOT EDIT
export const protobufPackage = "pricing.v1";
export interface Price { amount: number; }
export const Price = { encode(x: Price): number { return 1; } };
export const PricingServiceName = "pricing.v1.Pricing";
export class PricingClientImpl {
  getPrice(request: Price): Promise<Price> {
    const data = Price.encode(request);
    return this.rpc.request(this.service, "GetPrice", data);
  }
}
"""


def test_generated_clients():
    rows = frameworks.ts_proto(PROTO_TS, "web", "src/pricing.ts")
    module = "repo://web/typescript/src/pricing.ts"
    assert [(r["local_symbol"], r["service"], r["method"]) for r in rows if r["sort"] == "generated_client"] == [(f"{module}/PricingClientImpl/getPrice", "pricing.v1.Pricing", "GetPrice")]
    assert [(r["local_symbol"], r["target"]) for r in rows if r["sort"] == "message"] == [(f"{module}/Price", "proto-type://pricing.v1.Price")]
    assert frameworks.ts_proto("export const a = 1;", "web", "a.ts") == []


def test_stray_braces_cost_their_unit_only():
    for parse, path, text, code in (
        (languages.rust_facts, "src/a.rs", "fn a() {}\n lost() }\nfn b() { a(); }\n", "rust.parse_recovery"),
        (languages.typescript_facts, "a.ts", "function a() {}\n lost() }\nfunction b() { a(); }\n", "typescript.parse_recovery"),
        (languages.csharp_facts, "A.cs", "class A { void M() { } }\n lost() }\nclass B { void N() { } }\n", "csharp.parse_recovery"),
    ):
        rows = parse(text, "r", path)
        assert {r["id"]: r["evidence"] for r in rows if r["sort"] == "diagnostic"}[code] == f"{path}:2"
        assert sum(r["sort"] == "entity" and r["kind"] == "callable" for r in rows) == 2
        assert [r["sort"] for r in parse(text.replace("lost() }", "lost() {"), "r", path)] == ["diagnostic"]


def test_embedded_documents_across_files(spark):
    rows = [("docs.ts", "export const ME = gql`query Me { me }`;\n"), ("use.ts", "import { ME } from './docs';\nexport function load() { return client.query(ME); }\n")]
    files = spark.createDataFrame([("web", path, bytearray(text.encode())) for path, text in rows], "repository string, path string, content binary")
    bound = modules.resolve_modules(languages.analyze(files), files)[2]
    found = frameworks.embedded_calls(frameworks.recognize(files, ("typescript.graphql",)), bound).collect()
    assert [(r.from_id, r.to_id, r.evidence) for r in found] == [("repo://web/typescript/use.ts/load", "graphql-operation://Me", "use.ts:2")]


class RustOnly(plugins.WorkspaceAnalyzer):
    id, version = "rust", "1"

    def analyze(self, files):
        code = languages.analyze(files, ("rust",))
        none = lambda schema: files.sparkSession.createDataFrame([], schema)
        return Analysis(languages.edges(code), languages.entities(code), none(EDGE), none(OVERRIDE), none(DIAGNOSTIC))


def test_registry_lock_freshness_and_garbage(spark, tmp_path, capsys):
    root = tmp_path / "code"
    root.mkdir()
    (root / "main.rs").write_text("fn main() { helper(); }\nfn helper() {}\n")
    store, here = f"file://{tmp_path}/store", {"acme/app": f"file://{root}"}
    registry = plugins.builtin()
    registry.install(plugins.Plugin("rust", "1", (RustOnly(),)))
    workspace = api.Workspace(spark, store, registry.activate(["rust"]))
    with pytest.raises(ArchgraphError, match="workspace.not_registered"):
        workspace.index_registered("app")
    assert api.main(["--store", store, "register", "app", f"acme/app=file://{root}"]) == 0
    assert workspace.store.workspaces() == {"app": here}
    assert workspace.freshness(here, "app")["stale"]
    with workspace.store.exclusive("a long one"):
        with pytest.raises(ArchgraphError, match="a long one"):
            workspace.index_registered("app")
    assert workspace.index_registered("app")["revision"] == 1
    assert workspace.freshness(here, "app") == {"revision": 1, "stale": False, "dirty_repositories": []}
    (root / "main.rs").write_text("fn main() {}\n")
    assert workspace.freshness(here, "app") == {"revision": 1, "stale": True, "dirty_repositories": ["acme/app"]}
    assert workspace.index_registered("app")["removed"] > 0
    assert len(workspace.store.garbage(["app"])) == 1 and workspace.store.garbage(["app"], 0) == []
    seen = []
    assert workspace.store.collect_garbage(["app"], progress=lambda done, of: seen.append((done, of))) and seen == [(0, 1), (1, 1)]
    assert workspace.store.garbage(["app"]) == []
    capsys.readouterr()
    assert api.main(["--store", store, "inspect", "relations"]) == 0 and "observation\tfrom_id\tstring" in capsys.readouterr().out
    assert api.main(["--store", store, "workspaces"]) == 0 and capsys.readouterr().out == f"app acme/app=file://{root}\n"
    with pytest.raises(ValueError):
        ArchgraphError("no.such", "")


def test_git_topology(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    base = (tmp_path / "base").resolve()
    try:
        run("init", "-b", "main", str(base))
    except FileNotFoundError:
        pytest.skip("no git here")
    run("-C", str(base), "remote", "add", "origin", "git@example.org:acme/app.git")
    run("-C", str(base), "commit", "--allow-empty", "-m", "x")
    run("-C", str(base), "worktree", "add", str(base / "inner"), "-b", "side")
    run("-C", str(base), "worktree", "add", str(tmp_path / "gone"), "-b", "gone")
    subprocess.run(["rm", "-rf", str(tmp_path / "gone")], check=True)
    (base / "inner" / "src").mkdir()
    found = git.topology(base / "inner" / "src")
    assert found.identity == "example.org/acme/app" and [t.path for t in found.trees] == [str(base), str(base / "inner")]
    assert found.around(base / "inner" / "src").branch == "side" and found.around(base / "other").branch == "main"
    assert len({t.head for t in found.trees}) == 1 and len(found.trees[0].head) == 40
    assert found.around(tmp_path) is None and git.topology(tmp_path) is None
    assert git.remote_identity(None, "/x").startswith("local://")
