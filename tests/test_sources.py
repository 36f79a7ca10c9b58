"""Frontends and readers: source text to facts."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archgraph.operators import resolve
from archgraph.sources import files as source_files
from archgraph.sources import graphql, languages, manifests, protobuf


def calls(rows):
    return {(r["from_id"], r["to_id"]) for r in rows if r["sort"] == "edge" and r["relation"] == "calls"}


def defined(rows):
    return {r["to_id"] for r in rows if r["sort"] == "edge" and r["relation"] == "defines"}


def ids(rows, sort):
    return {r["id"] for r in rows if r["sort"] == sort}


def test_rust():
    text = """
    // fn commented() {}
    mod inner { pub fn leaf() { helper(); } fn helper() {} }
    struct T; trait Show { fn show(&self); }
    impl<X> Show for T<X> { fn show(&self) { println!("fn no() {{"); self.twice(); free(1); } }
    impl T { fn new() -> Self { free::<u8>(2); T } }
    fn free(x: u8) -> u8 { fn nested() {} other::path(x) }
    """
    rows = languages.rust_facts(text, "acme/app", "src/lib.rs")
    base = "repo://acme/app/rust/lib"
    assert defined(rows) == {f"{base}/{x}" for x in ("inner/leaf", "inner/helper", "impl/Show-for-T/show", "impl/T/new", "free")}
    found = calls(rows)
    assert (f"{base}/inner/leaf", f"{base}/inner/helper") in found
    assert (f"{base}/impl/Show-for-T/show", "rust-call://free") in found and (f"{base}/impl/Show-for-T/show", "rust-method://twice") in found
    assert (f"{base}/impl/T/new", "rust-call://free") in found and (f"{base}/free", "rust-call://path") in found
    assert "rust.receiver_method_resolution_unavailable" in ids(rows, "diagnostic")
    assert ids(languages.rust_facts("fn a() { {", "r", "a.rs"), "diagnostic") == {"rust.parse_recovery"}


def test_elixir():
    text = '''
defmodule App.Users do
  @moduledoc """
  def not_here(x) do
  """
  alias App.Repo
  use App.Web
  @behaviour App.Store
  def fetch(id, opts \\\\ []) do
    id |> normalize(opts) |> Repo.get(1)
  end
  defp normalize(a, b), do: fallback(a)
  defmodule Inner do
    def run(), do: :ok
  end
end
defimpl String.Chars, for: App.Users do
  def to_string(x), do: x
end
'''
    rows = languages.elixir_facts(text, "acme/app", "lib/users.ex")
    base = "repo://acme/app/elixir/"
    assert {base + x for x in ("App.Users", "App.Users/fetch/1", "App.Users/fetch/2", "App.Users/normalize/2", "App.Users.Inner", "App.Users.Inner/run/0", "String.Chars.App.Users/to_string/1")} <= defined(rows)
    found = calls(rows)
    assert (base + "App.Users/fetch/2", base + "App.Users/normalize/2") in found
    assert (base + "App.Users/fetch/2", "elixir-call://App.Repo/get/2") in found
    assert (base + "App.Users/normalize/2", "elixir-call://fallback/1") in found
    assert {(r["relation"], r["to_id"]) for r in rows if r["sort"] == "edge" and r["relation"] in ("uses", "implements")} == {
        ("uses", "elixir-module://App.Web"), ("implements", "elixir-module://App.Store"), ("implements", "elixir-module://String.Chars")
    }
    assert ids(languages.elixir_facts("defmodule A do\n", "r", "a.ex"), "diagnostic") == {"elixir.parse_recovery"}


def test_typescript():
    text = """
    import Base, { helper as h, other } from './base'; import * as ns from "pkg";
    export class Cart extends Base { total(x: number): number { return this.sum(x) + h(x); } private sum(x) { return x; } }
    export const run = async (c: Cart) => { c.total(1); new Cart(); local(); };
    function local() { if (true) { missing(); } }
    """
    rows = languages.typescript_facts(text, "r", "src/cart.ts")
    base = "repo://r/typescript/src/cart.ts"
    assert defined(rows) == {base, *(f"{base}/{x}" for x in ("Cart", "Cart/total", "Cart/sum", "run", "local"))}
    assert {(f"{base}/Cart/total", f"{base}/Cart/sum"), (f"{base}/Cart/total", "typescript-call://h"), (f"{base}/run", "typescript-method://c/total"), (f"{base}/run", f"{base}/Cart"), (f"{base}/run", f"{base}/local"), (f"{base}/local", "typescript-call://missing")} <= calls(rows)
    assert {(r["id"], r["to_id"], r["kind"]) for r in rows if r["sort"] == "import"} == {("Base", "./base", "default"), ("h", "./base", "helper"), ("other", "./base", "other"), ("ns", "pkg", "*")}


def test_csharp():
    text = """
    namespace Shop.Core;
    [Serializable] public class Cart : Base<int>, IStore {
        public Cart(int size) { }
        public int Total(List<int> xs, string? name = null) { return Sum(xs); }
        private static int Sum(this List<int> xs) => 0;
    }
    """
    rows = languages.csharp_facts(text, "r", "Cart.cs", "Shop")
    type_ = "repo://r/csharp/Shop/Cart.cs/Shop/Core/Cart"
    assert defined(rows) == {type_, f"{type_}/Cart(int)", f"{type_}/Total(List<int>,string?)", f"{type_}/Sum(List<int>)"}
    assert {r["to_id"] for r in rows if r["sort"] == "base"} == {"Base", "IStore"}
    assert languages.csharp_parameters("this A a, Dictionary<int, string> d, ref int c, string s = \"x\"") == [("A", "a", False, True), ("Dictionary<int, string>", "d", False, False), ("int", "c", False, False), ("string", "s", True, False)]


PROTO = """
syntax = "proto3"; package pricing.v1; import "other.proto";
message Price { int64 amount = 1; message Part { string name = 1; } enum Kind { NONE = 0; } Part part = 2; map<string, Part> parts = 3; oneof x { string a = 4; } reserved 9; }
enum Status { OK = 0; }
service Pricing { rpc GetPrice (Price) returns (Price.Part) { option deprecated = true; } rpc Watch (stream .pricing.v1.Price) returns (stream other.Thing); }
"""


def test_protobuf_source(spark):
    rows = protobuf.proto_facts(PROTO, "p.proto")
    assert ids(rows, "entity") == {
        "proto-type://pricing.v1.Price", "proto-type://pricing.v1.Price.Part", "proto-type://pricing.v1.Price.Kind", "proto-type://pricing.v1.Status", "proto-service://pricing.v1.Pricing",
        "proto-method://pricing.v1.Pricing/GetPrice", "proto-method://pricing.v1.Pricing/Watch", "proto-field://pricing.v1.Price.Part/name", *(f"proto-field://pricing.v1.Price/{x}" for x in ("amount", "part", "parts", "a")),
    }
    assert ("proto-method://pricing.v1.Pricing/Watch", "response_type", "proto-type://other.Thing") in {(r["from_id"], r["relation"], r["to_id"]) for r in rows if r["sort"] == "edge"}
    facts = protobuf.proto_sources(spark.createDataFrame([("p.proto", bytearray(PROTO.encode())), ("x.rs", bytearray(b"")), ("bad.proto", bytearray(b"message A {"))], "path string, content binary"))
    assert sorted(tuple(r) for r in protobuf.contract_methods(facts).collect()) == [("pricing.v1.Pricing", "GetPrice", "unary"), ("pricing.v1.Pricing", "Watch", "bidirectional_streaming")]
    assert [r.id for r in facts.where("sort = 'diagnostic'").collect()] == ["protobuf.compile_failed"]


def test_protobuf_descriptors_equal_the_source():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    found = pb.FileDescriptorSet()
    file = found.file.add(name="p.proto", package="pricing.v1")
    m = file.message_type.add(name="Price")
    m.field.add(name="amount")
    m.nested_type.add(name="Part").field.add(name="name")
    service = file.service.add(name="Pricing")
    service.method.add(name="GetPrice", input_type=".pricing.v1.Price", output_type=".pricing.v1.Price.Part", server_streaming=True)
    text = 'package pricing.v1; message Price { int64 amount = 1; message Part { string name = 1; } } service Pricing { rpc GetPrice (Price) returns (stream Price.Part); }'
    key = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert key(protobuf.descriptor_facts(found.SerializeToString(), "x")) == key(protobuf.proto_facts(text, "p.proto"))
    assert protobuf.descriptor_facts(b"\xff\xff", "x")[0]["id"] == "protobuf.compile_failed"


def test_graphql(spark):
    schema = '''
    schema { query: RootQuery }
    """Docs { not a type }"""
    type RootQuery { checkout(id: ID!, opts: Opts = {a: 1}): Cart! @source(name: "cart", subgraph: "shop"), search: [Result!]! }
    type Cart implements Node & Other { total: Int items: [Item] }
    type Item { name: String } interface Node { id: ID } union Result = | Cart | Item enum Kind { A B @deprecated } scalar Date input Opts { a: Int = 1 }
    '''
    operation = "query Checkout($id: ID!) { c: checkout(id: $id) { total ...CartItems } search { ... on Item { name } } } fragment CartItems on Cart { items { name } }"
    files = spark.createDataFrame([("r", "s.graphql", bytearray(schema.encode())), ("r", "o.gql", bytearray(operation.encode())), ("r", "bad.graphql", bytearray(b"type A {"))], "repository string, path string, content binary")
    facts = graphql.analyze(files).cache()
    edges = {(r.from_id, r.relation, r.to_id) for r in graphql.edges(facts).collect()}
    assert {("graphql-field://Query/checkout", "field_of", "graphql-type://Query"), ("graphql-field://Query/checkout", "response_type", "graphql-type://Cart"), ("graphql-field://Query/checkout", "uses", "graphql-type://Cart"),
            ("graphql-argument://Query/checkout/id", "request_type", "graphql-type://ID"), ("graphql-type://Cart", "implements", "graphql-type://Node"), ("graphql-type://Cart", "implements", "graphql-type://Other"),
            ("graphql-type://Result", "uses", "graphql-type://Item"), ("graphql-enum-value://Kind/B", "field_of", "graphql-type://Kind"), ("graphql-argument://operation/Checkout/id", "field_of", "graphql-operation://Checkout")} <= edges
    selected = {(r.from_id, r.to_id) for r in graphql.selection_edges(facts).collect()}
    op = "graphql-operation://Checkout"
    assert {(op, "graphql-field://Query/checkout"), (op, "graphql-field://Query/search"), ("graphql-field://Query/checkout", "graphql-field://Cart/total")} <= selected
    assert any(to == "graphql-field://Item/name" for _, to in selected) and any(to == "graphql-field://Cart/items" for _, to in selected)
    assert [tuple(r)[:2] for r in graphql.stitches(facts).collect()] == [("graphql-field://Query/checkout", "graphql-field://Query/cart")]
    assert [r.path for r in facts.where("sort = 'diagnostic'").collect()] == ["bad.graphql"]


def test_graphql_files_are_parsed_once(spark, tmp_path):
    """However many rounds the selections' types take, and in batches of many files' facts."""
    depth, log = 5, str(tmp_path / "log")
    schema = "type Query { f0: T0 } " + " ".join(f"type T{k} {{ f{k + 1}: T{k + 1} }}" for k in range(depth))
    operation = "query Q { " + " { ".join(f"f{k}" for k in range(depth)) + " }" * depth
    files = spark.createDataFrame([("r", "s.graphql", bytearray(schema.encode())), ("r", "q.graphql", bytearray(operation.encode()))], "repository string, path string, content binary")

    def logged(batches):
        for batch in batches:
            with open(log, "a") as out:
                out.writelines(f"{x}\n" for x in batch.column("path").to_pylist())
            yield batch

    facts = graphql.analyze(files.coalesce(1).mapInArrow(logged, files.schema))
    selected = graphql.selection_edges(facts)
    assert "Broadcast" not in selected._jdf.queryExecution().executedPlan().toString()  # file sizes tell nothing of memory here
    got = {(r.from_id, r.to_id) for r in selected.collect()}
    ids = ["graphql-operation://Q", "graphql-field://Query/f0", *(f"graphql-field://T{k}/f{k + 1}" for k in range(depth - 1))]
    assert got == set(zip(ids, ids[1:]))
    assert sorted(open(log).read().split()) == ["q.graphql", "s.graphql"]
    batch = pa.RecordBatch.from_pydict({"repository": ["r"] * 30, "path": [f"{k}.graphql" for k in range(30)], "content": [schema.encode()] * 30})
    each = len(graphql.document_facts(schema, "r", "s"))
    assert [x.num_rows for x in graphql._run(iter([batch]))] == [30 * each]


def test_scan_fingerprints_and_analysis(spark, tmp_path):
    root = tmp_path / "build" / "repo"
    for name, text in {"src/lib.rs": "fn a() { b(); } fn b() {}", "node_modules/x.js": "f()", "lib/m.ex": "defmodule M do\nend", "README.md": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    found = source_files.scan(spark, f"file://{root}", "acme")
    assert sorted(r.path for r in found.select("path").collect()) == ["lib/m.ex", "src/lib.rs"]
    before = [source_files.inventory(found).first().digest, source_files.state_fingerprint(found).first().fingerprint]
    assert before[1] == source_files.state_fingerprint(found.repartition(3)).first().fingerprint
    facts = languages.analyze(found)
    assert {(r.from_id, r.to_id) for r in languages.edges(facts).where("relation = 'calls'").collect()} == {("repo://acme/rust/lib/a", "repo://acme/rust/lib/b")}
    cache = found.select(F.sha2("content", 256).alias("sha"), F.lit("v1").alias("version")).limit(1)
    assert source_files.cache_misses(found.withColumn("version", F.lit("v1")), cache).count() == 1
    (root / "src/lib.rs").write_text("fn a() {}")
    again = source_files.scan(spark, f"file://{root}", "acme")
    assert before[1] != source_files.state_fingerprint(again).first().fingerprint and before[0] != source_files.inventory(again).first().digest


def test_identity_and_decoding(spark):
    rows = [("git@github.com:acme/app.git", "/x"), ("https://user@host.org/acme/app.git", "/x"), ("ssh://git@host:22/a/b", "/x"), (None, "/x")]
    got = [r[0] for r in spark.createDataFrame(rows, "remote string, path string").select(source_files.repository_identity(F.col("remote"), F.col("path"))).collect()]
    assert got[:3] == ["github.com/acme/app", "host.org/acme/app", "host:22/a/b"] and got[3].startswith("local://")
    raw = [bytearray("é".encode()), bytearray(b"\xef\xbb\xbfx"), bytearray("é".encode("utf-16")), bytearray(b"\xfe\xff\x00a"), bytearray(b"a\xff")]
    got = [tuple(r[0]) for r in spark.createDataFrame([(x,) for x in raw], "c binary").select(source_files.decode_source(F.col("c"))).collect()]
    assert got == [("é", False), ("x", False), ("é", False), ("a", False), ("a�", True)]


def test_manifests(spark):
    texts = {
        "a/package.json": '{"name": "@acme/a", "dependencies": {"@nestjs/core": "1"}, "devDependencies": {"x": "2"}}',
        "tsconfig.json": '{ // c\n "extends": "./base.json", "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"],}, }, }',
        "Cargo.toml": '[package]\nname = "p"\n[dependencies]\ntonic = "0.1"\nserde = { version = "1" }\n[dev-dependencies]\nrand = "1"\n',
        "mix.exs": 'defp deps do\n [{:grpc, "~> 0.5"}, {:absinthe, path: "x"}]\nend',
        "App/App.csproj": '<Project><PropertyGroup><AssemblyName>Shop</AssemblyName></PropertyGroup><ItemGroup><ProjectReference Include="..\\Core\\Core.csproj"/><Compile Remove="x/**"/></ItemGroup></Project>',
        "P.prefab": "a: 1\n  m_Script: {fileID: 1, guid: 0123456789abcdef0123456789abcdef, type: 3}\n", "S.cs.meta": "guid: 0123456789abcdef0123456789abcdef\n",
        "A.asmdef": '{"name": "Game", "references": ["Core"]}',
    }
    files = spark.createDataFrame([("r", p, bytearray(t.encode())) for p, t in texts.items()], "repository string, path string, content binary")
    assert [tuple(r) for r in manifests.packages(files).collect()] == [("r", "a", "@acme/a")]
    assert {r.dependency for r in manifests.package_dependencies(files).collect()} == {"@nestjs/core", "x"}
    config = manifests.tsconfigs(files).first()
    assert (config.extends, config.base_url, config.paths) == ("./base.json", "src", {"@/*": ["*"]})
    assert {r.dependency for r in manifests.cargo_dependencies(files).collect()} == {"tonic", "serde", "rand"}
    assert {r.dependency for r in manifests.mix_dependencies(files).collect()} == {"grpc", "absinthe"}
    project = manifests.csharp_projects(files).first()
    assert (project.assembly, project.references, project.removed) == ("Shop", ["../Core/Core.csproj"], ["x/**"])
    types = spark.createDataFrame([("S.cs", "repo://r/csharp/S")], "path string, id string")
    hit, missing = resolve.prefab_scripts(manifests.unity_prefabs(files).where("kind = 'script'"), manifests.unity_metas(files), types)
    assert [(r.from_id, r.to_id, r.evidence) for r in hit.collect()] == [("repo://r/unity-prefab/P.prefab", "repo://r/csharp/S", "P.prefab:2")] and missing.collect() == []
    assert tuple(manifests.unity_assemblies(files).first())[2:] == ("Game", ["Core"])
