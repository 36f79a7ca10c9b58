"""Resolvers that no SQL query covers, and streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from archgraph.functions import ids
from archgraph.operators import bench_graphs, resolve
from archgraph.operators.publish import Stale
from archgraph.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reexports_settings_and_providers(spark):
    exports = spark.createDataFrame([("a", "X"), ("a", "default"), ("b", "Y")], "file string, name string")
    again = spark.createDataFrame([("i", "*", "a", "*"), ("j", "Z", "i", "X"), ("i", "*", "j", "*"), ("j", "*", "i", "*")], "file string, name string, source_file string, source_name string")
    found = rows(resolve.reexport_origins(exports, again))
    assert ("i", "X", "a", "X") in found and ("j", "Z", "a", "X") in found and ("i", "Z", "a", "X") in found and not any(r[:2] == ("i", "default") for r in found)
    own = spark.createDataFrame([("base", "k", "1"), ("base", "m", "2"), ("child", "k", "3")], "file string, key string, value string")
    extends = spark.createDataFrame([("child", "base"), ("base", "child"), ("leaf", "child")], "file string, parent string")
    assert rows(resolve.inherited_settings(own, extends)) == [("base", "k", "1"), ("base", "m", "2"), ("child", "k", "3"), ("child", "m", "2"), ("leaf", "k", "3"), ("leaf", "m", "2")]
    provides = spark.createDataFrame([("m1", "T", "A", True), ("m2", "T", "B", True), ("m3", "U", "C", True), ("m3", "P", "D", False)], "module string, token string, target string, exported boolean")
    imports = spark.createDataFrame([("app", "m1", False), ("app", "m2", False), ("shared", "m3", True), ("app", "shared", False), ("m3", "shared", True)], "module string, imported string, re_exported boolean")
    found = rows(resolve.resolve_providers(provides, imports))
    assert ("app", "U", "C") in found and not any(r[:2] == ("app", "T") for r in found) and ("m1", "T", "A") in found and not any(r[:2] == ("app", "P") for r in found)


def test_unique_matches(spark):
    registrations = spark.createDataFrame([("IStore", "Store", "p:1"), ("IStore", "Twice", "p:2")], "service string, implementation string, evidence string")
    types = spark.createDataFrame([("IStore", "i"), ("Store", "s"), ("Twice", "t1"), ("Twice", "t2")], "name string, id string")
    assert [(r.from_id, r.to_id) for r in resolve.register_services(registrations, types).collect()] == [("i", "s")]
    stitch = spark.createDataFrame([("a", "b", "e"), ("a", "a", "e"), ("a", "no", "e")], "gateway_id string, upstream_id string, evidence string")
    assert [(r.from_id, r.to_id) for r in resolve.stitched_fields(stitch, spark.createDataFrame([("a",), ("b",)], "id string")).collect()] == [("a", "b")]
    calls = spark.createDataFrame([(1, "x", "y"), (2, "z", "y"), (3, "z", "q")], "n int, a string, b string")
    first = spark.createDataFrame([("x", "t1"), ("z", "t2"), ("z", "t3")], "a string, target string")
    second = spark.createDataFrame([("y", "t9")], "b string, target string")
    assert [(r.n, r.target) for r in resolve.prioritized(calls, [(first, ["a"]), (second, ["b"])]).orderBy("n").collect()] == [(1, "t1"), (2, "t9"), (3, None)]
    edges = spark.createDataFrame([("repo://t/x", "calls", "y", "e", 1.0, "ast"), ("repo://u/x", "calls", "y", "e", 1.0, "ast"), ("grpc://s", "calls", "y", "e", 1.0, "ast")], "from_id string, relation string, to_id string, evidence string, confidence double, provenance string")
    assert [r.from_id for r in resolve.escapes_target(edges, "t").collect()] == ["repo://u/x"]
    graph = spark.createDataFrame([("a", "b"), ("a", "c")], "from_repository string, to_repository string")
    context, affected = resolve.neighbours(graph)
    assert rows(context) == [("a", ["b", "c"])] and rows(affected) == [("b", ["a"]), ("c", ["a"])]


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(ids.snake_to_pascal(F.lit("get_price"))) == "GetPrice" and one(ids.pascal_to_snake(F.lit("GetHTTPPrice"))) == "get_http_price"
    assert one(ids.pascal_to_camel(F.lit("GetPrice"))) == "getPrice" and one(ids.simple_type_name(F.lit("A.B.List<C.D>?"))) == "List"
    assert one(ids.normalize_path(F.lit("a/./b/../c//d"))) == "a/c/d"


def test_topologies(spark):
    n = 3000
    plain = {(i, i + 1) for i in range(n)} | {(i, i + 2) for i in range(0, n - 2, 2)} | {(i, i + k) for i in range(0, n - 7, 10) for k in range(3, 8)} | {(i, i + k) for i in range(0, n - 158, 1000) for k in range(8, 158)}
    assert {tuple(r) for r in bench_graphs.corpus(spark, n).collect()} == {(a, b) for a, b in plain if b < n}
    assert {tuple(r) for r in bench_graphs.tree(spark, 50, 3).collect()} == {(i, i * 3 + k) for i in range(50) for k in (1, 2, 3) if i * 3 + k < 50}


def test_debounce(spark):
    t0 = datetime(2024, 1, 1)
    at = [0, 100, 250, 700, 5000, *range(5150, 8300, 150)]
    changes = spark.createDataFrame([(t0 + timedelta(milliseconds=x), "*" if x == 100 else f"s{x}") for x in at], "ts timestamp, source string")
    found = [(r.changes, r.sources) for r in jobs.debounce(changes).orderBy("started").collect()]
    assert [n for n, _ in found] == [3, 1, 22] and found[0][1] == ["*"]
    assert [r.changes for r in jobs.debounce_capped(changes).orderBy("started").collect()] == [3, 1, 14, 8]


def test_jobs_coalesce_and_drop_stale_results(spark, tmp_path):
    data = tmp_path / "in"
    rows_ = [("w", "a", "rust", "f1", 1), ("w", "a", "rust", "f2", 2), ("w", "b", "rust", "f1", 1), ("w", "b", "rust", "f1", 1), ("w", "c", "rust", "old", 5)]
    schema = "workspace string, repository string, analyzer string, fingerprint string, requested long"
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(data))
    done = []

    def handle(row):
        if row.fingerprint == "old":
            raise Stale("moved on")
        done.append((row.repository, row.fingerprint))

    jobs.run_jobs(spark.readStream.schema(schema).parquet(str(data)), handle, str(tmp_path / "check")).awaitTermination(60)
    assert sorted(done) == [("a", "f2"), ("b", "f1")]


def test_typescript_modules(spark):
    from archgraph.analysis import analyze_workspace

    sources = {
        ("web", "tsconfig.base.json"): '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["src/lib/*"]}}}',
        ("web", "tsconfig.json"): '{"extends": "./tsconfig.base"}',
        ("web", "src/app.ts"): """import go, { helper as h } from './lib'; import * as ns from '@lib/math'; import { Tax, shared } from "@acme/kit/tax";
            // import { fake } from './lib/math'
            export function run(x) { h(); go(); ns.add(1); Tax.rate(); shared(); x.unknown(); new Local(); Local.make(); fake(); }
            class Local { static make() { return 1; } }""",
        ("web", "src/lib/index.ts"): "export { add as helper } from './math';\nexport * from './math';\nimport { start } from './start';\nexport { start as default };",
        ("web", "src/lib/math.ts"): "export const add = (a) => a;\nexport default function other() {}",
        ("web", "src/lib/start.d.ts"): "export function start() {}",
        ("js", "a/jsconfig.json"): '{"compilerOptions": {"paths": {"~": ["./lib/x"]}}}',
        ("js", "a/m.js"): "import { f } from '~';\nfunction g() { f(); }",
        ("js", "m.js"): "import { f } from '~';\nfunction g() { f(); }",
        ("js", "a/lib/x.jsx"): "export function f() {}",
        ("kit", "pkg/package.json"): '{"name": "@acme/kit", "exports": {"./*": {"import": "./lib/*.js", "default": "./lib/*.ts"}}}',
        ("kit", "pkg/lib/tax.ts"): "export class Tax { static rate() { return 2; } }\nfunction hidden() {}\nexport { hidden as shared };",
    }
    files = spark.createDataFrame([(r, p, t.encode()) for (r, p), t in sources.items()], "repository string, path string, content binary")
    found = analyze_workspace(files, ())
    run, web, kit = "repo://web/typescript/src/app.ts/run", "repo://web/typescript/src/", "repo://kit/typescript/pkg/lib/tax.ts/"
    got = {(r.to_id, r.confidence) for r in found.edges.where("relation = 'calls'").collect() if r.from_id == run}
    js = {(r.from_id, r.to_id) for r in found.edges.where("relation = 'calls'").collect() if r.from_id.startswith("repo://js/")}
    assert js == {("repo://js/javascript/a/m.js/g", "repo://js/javascript/a/lib/x.jsx/f"), ("repo://js/javascript/m.js/g", "javascript-call://f")}
    exact = {web + "lib/math.ts/add", web + "lib/start.d.ts/start", kit + "Tax/rate", kit + "hidden", web + "app.ts/Local", web + "app.ts/Local/make"}
    assert got == {(x, 1.0) for x in exact} | {("typescript-method://x/unknown", 0.6), ("typescript-call://fake", 0.6)}
    assert [(r.code, r.path, r.line, r.detail) for r in found.diagnostics.collect()] == [("typescript.receiver_resolution_incomplete", "src/app.ts", 3, "1 unresolved receiver calls")]


def test_csharp_calls(spark):
    from archgraph.operators import resolve
    from archgraph.sources import languages

    sources = {
        "Cart.cs": """namespace Shop;
            public class Base { public int Size() { return 1; } }
            public class Cart : Base {
                public Cart(int n) { Reset(); }
                void Reset() { }
                public void Add(string name) { }
                public void Add(Item item, int n = 1) { this.Reset(); }
                public static Cart Make() => new Cart(3);
            }""",
        "Use.cs": """namespace Shop;
            public static class More { public static void Twice(this Cart cart, int n) { } }
            public class Use {
                public void Run(Item item, Cart cart, Cart other) {
                    var mine = new Cart(1); // Reset();
                    cart.Add("x");
                    cart.Add(item);
                    mine.Size();
                    Cart.Make();
                    other.Twice(2);
                    cart.Add(a, b, c);
                    cart.Add(unknown);
                    Missing();
                    string s = "cart.Size()";
                }
            }""",
    }
    files = spark.createDataFrame([("r", p, t.encode()) for p, t in sources.items()], "repository string, path string, content binary")
    got = {(r.from_id.rsplit("/", 2)[-2] + "/" + r.from_id.rsplit("/", 1)[-1], r.to_id.split(".cs/Shop/")[1], r.evidence) for r in resolve.csharp_calls(languages.analyze(files)).collect()}
    run = "Use/Run(Item,Cart,Cart)"
    assert got == {
        ("Cart/Cart(int)", "Cart/Reset()", "Cart.cs:4"), ("Cart/Add(Item,int)", "Cart/Reset()", "Cart.cs:7"), ("Cart/Make()", "Cart/Cart(int)", "Cart.cs:8"),
        (run, "Cart/Cart(int)", "Use.cs:5"), (run, "Cart/Add(string)", "Use.cs:6"), (run, "Cart/Add(Item,int)", "Use.cs:7"), (run, "Base/Size()", "Use.cs:8"),
        (run, "Cart/Make()", "Use.cs:9"), (run, "More/Twice(Cart,int)", "Use.cs:10"),
    }


def test_elixir_calls(spark):
    from archgraph.analysis import analyze_workspace

    sources = {
        ("a", "lib/u.ex"): """defmodule App.Users do
  import App.Text, only: [trim: 1,
    pad: 2]
  alias App.Text, as: T
  use Other.Web
  def run(x) do
    trim(x)
    neg(x)
    T.upper(x)
  end
  def scoped(x) do
    import App.More
    Unknown.go(x)
    more(x)
  end
end
defmodule App.Sums do
  import App.Math, except: [neg: 1]
  def both(x), do: add(neg(x), 1)
end
""",
        ("a", "lib/t.ex"): "defmodule App.Text do\n  def trim(x), do: x\n  def upper(x), do: x\nend\ndefmodule App.Math do\n  def add(a, b), do: a\n  def neg(a), do: a\nend\n",
        ("b", "lib/w.ex"): "defmodule Other.Web do\n  def trim(x), do: x\nend\n",
    }
    files = spark.createDataFrame([(r, p, t.encode()) for (r, p), t in sources.items()], "repository string, path string, content binary")
    found = analyze_workspace(files, ())
    got = {(r.from_id.split("/elixir/")[1], r.to_id, r.evidence, r.confidence) for r in found.edges.where("relation = 'calls'").collect()}
    here, users = "repo://a/elixir/", "App.Users/run/1"
    assert got == {
        (users, here + "App.Text/trim/1", "lib/u.ex:7", 1.0), (users, here + "App.Text/upper/1", "lib/u.ex:9", 1.0),
        (users, "elixir-call://neg/1", "lib/u.ex:8", 0.6), ("App.Users/scoped/1", "elixir-call://Unknown/go/1", "lib/u.ex:13", 0.6),
        ("App.Users/scoped/1", "elixir-call://App.More/more/1", "lib/u.ex:14", 0.6), ("App.Sums/both/1", here + "App.Math/add/2", "lib/u.ex:19", 1.0),
        ("App.Sums/both/1", "elixir-call://neg/1", "lib/u.ex:19", 0.6),
    }
    refs = {(r.relation, r.unresolved_to, r.resolved_to) for r in found.overrides.collect()}
    assert refs == {("imports", "elixir-module://App.Text", here + "App.Text"), ("imports", "elixir-module://App.Math", here + "App.Math"), ("uses", "elixir-module://Other.Web", "repo://b/elixir/Other.Web")}
