"""Registered queries of the source frontends and of functions over names and paths: source texts are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import testgraph as G
from .functions import ids
from .registry import query
from .sources import files, graphql, languages, protobuf, trees

_AST = "cast({c} as double) as confidence, 'ast' as provenance"


def _sources(spark, sf_dir, path: str, text: str, table: str = "part", where: str = "true"):
    """Rows repository, path, content; ``path`` and ``text`` are SQL over a table."""
    text = text.replace("{", "{{").replace("}", "}}")  # braces name tables
    rows = G.frame(spark, sf_dir, f"select concat('acme/app', p_size % 3) as repository, {path} as path, {text} as text from {{{table}}} where {where}")
    return rows.select("repository", "path", F.encode("text", "utf-8").alias("content"))


_REPO = "concat('repo://acme/app', p_size % 3)"


def _edge(source: str, relation: str, target: str, evidence: str, confidence: float = 1.0) -> str:
    return f"select concat({source}) as from_id, '{relation}' as relation, concat({target}) as to_id, concat({evidence}) as evidence, {_AST.format(c=confidence)} from {{part}}"


_RUST = f"{_REPO}, '/rust/m', p_partkey"


@query(_edge(_RUST, "defines", f"{_RUST}, '/f', p_partkey", "'src/m', p_partkey, '.rs:1'") + " union all " + _edge(f"{_RUST}, '/f', p_partkey", "calls", "'rust-call://f', p_partkey + 1", "'src/m', p_partkey, '.rs:2'", 0.6))
def rust_edges(spark, sf_dir):
    return languages.edges(languages.analyze(_sources(spark, sf_dir, "concat('src/m', p_partkey, '.rs')", "concat('pub fn f', p_partkey, '() {\\n    f', p_partkey + 1, '();\\n}\\n')")))


_EX = f"{_REPO}, '/elixir/App.M', p_partkey"


@query(
    _edge(f"{_REPO}, '/elixir-source/lib/m', p_partkey, '.ex'", "defines", _EX, "'lib/m', p_partkey, '.ex:1'")
    + " union all " + _edge(_EX, "defines", f"{_EX}, '/run', p_partkey, '/1'", "'lib/m', p_partkey, '.ex:2'")
    + " union all " + _edge(f"{_EX}, '/run', p_partkey, '/1'", "calls", "'elixir-call://App.M', p_partkey + 1, '/go/1'", "'lib/m', p_partkey, '.ex:3'", 0.6)
)
def elixir_edges(spark, sf_dir):
    text = "concat('defmodule App.M', p_partkey, ' do\\n  def run', p_partkey, '(x) do\\n    App.M', p_partkey + 1, '.go(x)\\n  end\\nend\\n')"
    return languages.edges(languages.analyze(_sources(spark, sf_dir, "concat('lib/m', p_partkey, '.ex')", text)))


_TS = f"{_REPO}, '/typescript/src/m', p_partkey, '.ts'"
_TS_AT = "'src/m', p_partkey, '.ts"


@query(
    _edge(f"{_REPO}, '/typescript-source/src/m', p_partkey, '.ts'", "defines", _TS, f"{_TS_AT}'")
    + " union all " + _edge(_TS, "defines", f"{_TS}, '/C', p_partkey", f"{_TS_AT}:1'")
    + " union all " + _edge(f"{_TS}, '/C', p_partkey", "defines", f"{_TS}, '/C', p_partkey, '/run'", f"{_TS_AT}:2'")
    + " union all " + _edge(_TS, "defines", f"{_TS}, '/go', p_size", f"{_TS_AT}:4'")
    + " union all " + _edge(f"{_TS}, '/C', p_partkey, '/run'", "calls", f"{_TS}, '/go', p_size", f"{_TS_AT}:2'")
)
def typescript_edges(spark, sf_dir):
    text = "concat('export class C', p_partkey, ' {\\n  run() { return go', p_size, '(); }\\n}\\nexport function go', p_size, '() { return 1; }\\n')"
    return languages.edges(languages.analyze(_sources(spark, sf_dir, "concat('src/m', p_partkey, '.ts')", text)))


_CS = f"{_REPO}, '/csharp/default/src/M', p_partkey, '.cs/App/C', p_partkey"


@query(
    _edge(f"{_REPO}, '/csharp-source/default/src/M', p_partkey, '.cs'", "defines", _CS, "'src/M', p_partkey, '.cs'")
    + " union all " + _edge(_CS, "defines", f"{_CS}, '/Run', p_size, '(int)'", "'src/M', p_partkey, '.cs:3'")
)
def csharp_edges(spark, sf_dir):
    text = "concat('namespace App {\\npublic class C', p_partkey, ' : B {\\n  public void Run', p_size, '(int x) { }\\n}\\n}\\n')"
    return languages.edges(languages.analyze(_sources(spark, sf_dir, "concat('src/M', p_partkey, '.cs')", text)))


@query("select distinct concat('acme/app', p_size % 3) as repository, 'rust.parse_recovery' as code, 'warning' as severity, concat('src/m', p_partkey, '.rs') as path from part where p_partkey % 7 = 0")
def parse_diagnostics(spark, sf_dir):
    text = "case when p_partkey % 7 = 0 then 'fn f( {' else 'fn f() {}' end"
    return languages.diagnostics(languages.analyze(_sources(spark, sf_dir, "concat('src/m', p_partkey, '.rs')", text)))


@query("select distinct concat('acme/app', p_size % 3) as repository from part where p_partkey % 50 = 0")
def incomplete_repositories(spark, sf_dir):
    text = "case when p_partkey % 50 = 0 then 'fn f( {' else 'fn f() {}' end"
    return languages.incomplete(languages.analyze(_sources(spark, sf_dir, "concat('src/m', p_partkey, '.rs')", text)))


_FIELD = "'graphql-field://T', p_partkey, '/f', p_size"
_OTHER = "'graphql-type://T', p_partkey + 1"
_GQL_AT = "'s', p_partkey, '.graphql:2'"


@query(" union all ".join(_edge(_FIELD, r, t, _GQL_AT) for r, t in (("field_of", "'graphql-type://T', p_partkey"), ("response_type", _OTHER), ("uses", _OTHER))))
def graphql_schema_edges(spark, sf_dir):
    text = "concat('type T', p_partkey, ' {\\n  f', p_size, ': T', p_partkey + 1, '\\n}\\n')"
    return graphql.edges(graphql.analyze(_sources(spark, sf_dir, "concat('s', p_partkey, '.graphql')", text)))


@query("""select concat('graphql-operation://Q', p_partkey) as from_id, 'selects' as relation, concat('graphql-field://Query/f', p_partkey) as to_id, concat('s', p_partkey, '.graphql:5') as evidence, cast(1.0 as double) as confidence, 'ast' as provenance from part
    union all select concat('graphql-field://Query/f', p_partkey), 'selects', concat('graphql-field://T', p_partkey, '/g'), concat('s', p_partkey, '.graphql:5'), 1.0, 'ast' from part""")
def graphql_selections(spark, sf_dir):
    text = "concat('type Query { f', p_partkey, ': T', p_partkey, ' }\\ntype T', p_partkey, ' { g: Int }\\n\\nquery Q', p_partkey, ' {\\nf', p_partkey, ' { g } }\\n')"
    return graphql.selection_edges(graphql.analyze(_sources(spark, sf_dir, "concat('s', p_partkey, '.graphql')", text)))


def _proto(spark, sf_dir):
    text = "concat('syntax = \"proto3\"; package p', p_size, '; message M', p_partkey, ' { int32 a = 1; message N { int32 b = 1; } } service S', p_partkey, ' { rpc G (M', p_partkey, ') returns (stream M', p_partkey, '); }')"
    return protobuf.proto_sources(_sources(spark, sf_dir, "concat('p', p_partkey, '.proto')", text))


@query("select distinct concat('p', p_size, '.S', p_partkey) as service, 'G' as method, 'server_streaming' as cardinality from part")
def proto_methods(spark, sf_dir):
    return protobuf.contract_methods(_proto(spark, sf_dir))


_M = "concat('p', p_size, '.M', p_partkey)"


@query(f"""select concat('proto-type://', {_M}) as id, 'proto_type' as kind, 'proto_type:message' as metadata from part union all select concat('proto-type://', {_M}, '.N'), 'proto_type', 'proto_type:message' from part
    union all select concat('proto-field://', {_M}, '/a'), 'proto_field', '' from part union all select concat('proto-field://', {_M}, '.N/b'), 'proto_field', '' from part
    union all select concat('proto-service://p', p_size, '.S', p_partkey), 'proto_service', '' from part union all select concat('proto-method://p', p_size, '.S', p_partkey, '/G'), 'proto_method', 'rpc_cardinality:server_streaming' from part""")
def proto_entities(spark, sf_dir):
    return protobuf.entities(_proto(spark, sf_dir))


_TREE = "select p_partkey as n, concat(case p_size % 6 when 0 then 'src/' when 1 then 'node_modules/x/' when 2 then '.next/' when 3 then 'vendor/' when 4 then 'coverage/' else '' end, case p_partkey % 9 when 0 then 'a.rs' when 1 then 'tsconfig.json' when 2 then 'tsconfigs.json' when 3 then 'jsconfig.app.json' when 4 then 'M.cs.meta' when 5 then 'M.png.meta' when 6 then 'buf.lock' when 7 then 'q.gql' else 'notes.txt' end) as path from {part}"


@query(f"select n, path, not list_has_any(string_split(path, '/'), ['node_modules', '.next', 'coverage']) and not regexp_matches(path, '(tsconfigs[.]json|png[.]meta|notes[.]txt)$') as taken from ({_TREE})")
def accepted_paths(spark, sf_dir):
    return G.frame(spark, sf_dir, _TREE).select("n", "path", files.taken(F.col("path")).alias("taken"))


_REMOTES = "select s_suppkey as n, concat('/home/x/app', s_suppkey) as path, case s_suppkey % 4 when 0 then concat('git@example.org:acme/app', s_suppkey, '.git') when 1 then concat('https://me@example.org/acme/app', s_suppkey, '.git') when 2 then concat('ssh://git@example.org/acme/app', s_suppkey) else '' end as remote from {supplier}"


@query(f"select n, case when remote <> '' then concat('example.org/acme/app', n) else concat('local://', sha256(path)) end as identity from ({_REMOTES})")
def repository_identities(spark, sf_dir):
    return G.frame(spark, sf_dir, _REMOTES).select("n", files.repository_identity(F.col("remote"), F.col("path")).alias("identity"))


@query("select p_partkey as n, concat('class C', p_partkey, ' {}') as text, false as lossy from part")
def decoded_sources(spark, sf_dir):
    rows = G.frame(spark, sf_dir, "select p_partkey as n, concat('class C', p_partkey, ' {{}}') as text from {part}")
    marks = {"UTF-16LE": "FFFE", "UTF-16BE": "FEFF", "UTF-8": "EFBBBF"}
    made = [F.concat(F.unhex(F.lit(m)), F.encode("text", e)) for e, m in marks.items()] + [F.encode("text", "UTF-8")]
    content = F.when(F.col("n") % 4 == 0, made[0]).when(F.col("n") % 4 == 1, made[1]).when(F.col("n") % 4 == 2, made[2]).otherwise(made[3])
    return rows.select("n", files.decode_source(content).alias("x")).select("n", "x.text", "x.lossy")


@query("""with f as (select concat('r', p_size % 5) as r, concat('src/f', p_partkey, '.rs') as path, sha256(p_name) as sha from part)
    select r as repository, sha256(concat(strlen(r), ':', r, '1:0', '0:', string_agg(concat(strlen(path), ':', path, sha), '' order by path))) as fingerprint from f group by r""")
def state_fingerprints(spark, sf_dir):
    rows = G.frame(spark, sf_dir, "select concat('r', p_size % 5) as repository, concat('src/f', p_partkey, '.rs') as path, p_name from {part}")
    return files.state_fingerprint(rows.select("repository", "path", F.encode("p_name", "utf-8").alias("content")))


#: Two inventories of the parts as files: some changed, some only in one.
_INVENTORY = "select concat('r', p_size % 3) as repository, concat('src/', p_size % 7, '/', p_brand, '/f', p_partkey, '.rs') as path, sha2(concat(p_name, {extra}), 256) as digest, p_partkey from {{part}} where {where}"
_INVENTORIES = tuple(_INVENTORY.format(extra=e, where=w) for e, w in (("''", "p_partkey % 50 <> 3"), ("case when p_partkey % 40 = 7 and p_size % 7 < 3 then 'new' else '' end", "p_partkey % 60 <> 11")))
_BOTH = "with a as ({}), b as ({}), c as (select coalesce(a.repository, b.repository) as repository, coalesce(a.path, b.path) as path, a.path is not null as old, b.path is not null as new, a.digest is distinct from b.digest as changed from a full join b on a.repository = b.repository and a.path = b.path)".format(*(x.replace("sha2(", "sha256(").replace(", 256)", ")") for x in _INVENTORIES))


def _trees(spark, sf_dir):
    return [trees.directory_digests(G.frame(spark, sf_dir, x).select("repository", "path", trees.file_digest(F.col("path"), F.col("digest")).alias("digest"))) for x in _INVENTORIES]


@query(f"""{_BOTH}, s as (select *, string_split(path, '/') as parts from c), d as (select repository, array_to_string(parts[1:k], '/') as directory, old, new, changed from (select *, unnest(range(0, len(parts))) as k from s) t)
    select repository, directory, nullif(count(*) filter (where old), 0) as files_before, nullif(count(*) filter (where new), 0) as files_after from d group by repository, directory having bool_or(changed)""")
def changed_directories(spark, sf_dir):
    """Directories above a created, changed or deleted file, by their digests."""
    return trees.changed_directories(*_trees(spark, sf_dir))


@query(f"{_BOTH} select repository, path, case when not old then 'created' when not new then 'deleted' else 'changed' end as kind from c where changed")
def inventory_changes(spark, sf_dir):
    return trees.changed_files(*(G.frame(spark, sf_dir, x) for x in _INVENTORIES))


_CACHED = "select sha256(concat(p_name, p_partkey)) as sha, concat('v', p_size % 2) as version from part where p_size % 3 = 0"


@query(f"select p_partkey as n from part where (sha256(concat(p_name, p_partkey)), 'v1') not in (select (sha, version) from ({_CACHED}))")
def analysis_cache_misses(spark, sf_dir):
    rows = G.frame(spark, sf_dir, "select p_partkey as n, p_name, p_size from {part}").withColumn("content", F.encode(F.concat("p_name", F.col("n").cast("string")), "utf-8"))
    cache = rows.where("p_size % 3 = 0").select(F.sha2("content", 256).alias("sha"), F.expr("concat('v', p_size % 2)").alias("version"))
    return files.cache_misses(rows.withColumn("version", F.lit("v1")), cache).select("n")


_HEADERS = "select p_partkey as n, concat('lib/m', p_partkey, case p_size % 4 when 0 then '.pb.ex' when 1 then '.g.cs' when 2 then '.gen.ts' else '.ex' end) as path, case when p_partkey % 3 = 0 then '# Autogenerated by x' when p_partkey % 3 = 1 then '// <auto-generated>' else '// Do not edit' end as text from {part}"


@query(f"""select n, case when path like '%.pb.ex' then true when path like '%.ex' then text like '%Autogenerated by%' when path like '%.g.cs' then true else true end as generated from ({_HEADERS})""")
def generated_sources(spark, sf_dir):
    return G.frame(spark, sf_dir, _HEADERS).select("n", files.generated(F.col("path"), F.col("text")).alias("generated"))


_NAMES = "select distinct p_size as n, concat('fetch_item_', p_size, '_by_id') as snake, concat('FetchHTTPItem', p_size, 'ById') as pascal from {part}"


@query(f"""select n, list_aggregate(list_transform(string_split(snake, '_'), lambda x: concat(upper(x[1]), x[2:])), 'string_agg', '') as as_pascal,
    lower(regexp_replace(regexp_replace(pascal, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) as as_snake, concat(lower(pascal[1]), pascal[2:]) as as_camel from ({_NAMES})""")
def name_conversions(spark, sf_dir):
    rows = G.frame(spark, sf_dir, _NAMES)
    return rows.select("n", ids.snake_to_pascal(F.col("snake")).alias("as_pascal"), ids.pascal_to_snake(F.col("pascal")).alias("as_snake"), ids.pascal_to_camel(F.col("pascal")).alias("as_camel"))


_TYPED = "select p_partkey as n, concat('App.Models.Order', p_size, case p_size % 3 when 0 then '<System.Int32>' when 1 then '?' else '' end) as name from {part}"


@query(f"select n, concat('Order', regexp_extract(name, 'Order([0-9]+)', 1)) as simple from ({_TYPED})")
def simple_type_names(spark, sf_dir):
    return G.frame(spark, sf_dir, _TYPED).select("n", ids.simple_type_name(F.col("name")).alias("simple"))


_PATHS = "select p_partkey as n, concat('src/a', p_size, case p_partkey % 4 when 0 then '/../b' when 1 then '/./c' when 2 then '/x/../../d' else '' end, '/f.ts') as path from {part}"


@query(f"select n, case n % 4 when 0 then 'src/b/f.ts' when 1 then replace(path, '/./', '/') when 2 then 'src/d/f.ts' else path end as normal from ({_PATHS})")
def normalized_paths(spark, sf_dir):
    return G.frame(spark, sf_dir, _PATHS).select("n", ids.normalize_path(F.col("path")).alias("normal"))


#: Two contracts' worth of servers and clients, as Rust servers, Elixir clients and their protobuf contract.
_WORKSPACE = " union all ".join(
    (
        "select 'srv' as repository, concat('src/m', n_nationkey, '.rs') as path, concat('mod pb {{ tonic::include_proto!(\"pricing.v', n_nationkey, '\"); }}\nstruct Svc;\nimpl pb::pricing_server::Pricing for Svc {{ async fn get_price(&self) -> u8 {{ 1 }} }}\n') as text from {nation}",
        "select 'shop', concat('lib/s', n_nationkey, '.ex'), concat('defmodule Pricing', n_nationkey, '.Service do\n  use GRPC.Service, name: \"pricing.v', n_nationkey, '.Pricing\"\nend\ndefmodule Shop', n_nationkey, ' do\n  def fetch(c) do\n    Pricing', n_nationkey, '.Stub.get_price(c, 1)\n  end\nend\n') from {nation}",
        "select 'api', concat('p', n_nationkey, '.proto'), concat('syntax = \"proto3\"; package pricing.v', n_nationkey, '; message P {{}} service Pricing {{ rpc GetPrice (P) returns (P); }}') from {nation}",
    )
)


@query("""with n as (select n_nationkey as n, concat('grpc://pricing.v', n_nationkey, '.Pricing/GetPrice') as op from nation)
    select op as from_id, 'binds_contract' as relation, concat('proto-method://pricing.v', n, '.Pricing/GetPrice') as to_id, concat('src/m', n, '.rs:3') as evidence, 1.0::double as confidence from n
    union all select op, 'binds_contract', concat('proto-method://pricing.v', n, '.Pricing/GetPrice'), concat('lib/s', n, '.ex:6'), 0.6 from n
    union all select op, 'implemented_by', concat('repo://srv/rust/m', n, '/impl/Pricing-for-Svc/get_price'), concat('src/m', n, '.rs:3'), 1.0 from n
    union all select concat('repo://shop/elixir/Shop', n, '/fetch/1'), 'calls_rpc', op, concat('lib/s', n, '.ex:6'), 0.6 from n""")
def index_workspace_edges(spark, sf_dir):
    from .analysis import analyze_workspace

    rows = G.frame(spark, sf_dir, _WORKSPACE).select("repository", "path", F.encode("text", "utf-8").alias("content"))
    return analyze_workspace(rows).bound.select("from_id", "relation", "to_id", "evidence", "confidence")


#: Modules that reach a definition through a re-export, and one of another repository's package.
_MODULES = " union all ".join(
    (
        "select 'web' as repository, concat('src/m', n_nationkey, '.ts') as path, concat('import {{ f as g }} from \"./lib', n_nationkey, '\";\nimport * as ns from \"@acme/kit/x', n_nationkey, '\";\nexport function run() {{ g(); ns.h(); }}\n') as text from {nation}",
        "select 'web', concat('src/lib', n_nationkey, '.ts'), concat('export {{ f }} from \"./deep', n_nationkey, '\";\n') from {nation}",
        "select 'web', concat('src/deep', n_nationkey, '.ts'), 'export function f() {{ return 1; }}\n' from {nation}",
        "select 'kit', concat('x', n_nationkey, '.ts'), 'export const h = () => 1;\n' from {nation}",
        "select 'kit', 'package.json', '{{\"name\": \"@acme/kit\"}}' from {region} where r_regionkey = 0",
    )
)


@query("""with c as (select concat('repo://web/typescript/src/m', n_nationkey, '.ts/run') as from_id, n_nationkey as n, concat('src/m', n_nationkey, '.ts:3') as evidence, 1.0::double as confidence from nation)
    select from_id, concat('repo://web/typescript/src/deep', n, '.ts/f') as to_id, evidence, confidence from c
    union all select from_id, concat('repo://kit/typescript/x', n, '.ts/h'), evidence, confidence from c""")
def typescript_module_calls(spark, sf_dir):
    from .analysis import analyze_workspace

    rows = G.frame(spark, sf_dir, _MODULES).select("repository", "path", F.encode("text", "utf-8").alias("content"))
    return analyze_workspace(rows, ()).edges.where("relation = 'calls'").select("from_id", "to_id", "evidence", "confidence")


_CS_USE = "concat('repo://acme/r/csharp/default/src/Use', n_nationkey, '.cs/App/Use', n_nationkey, '/Run(C', n_nationkey, ')')"
_CS_OF = "concat('repo://acme/r/csharp/default/src/C', n_nationkey, '.cs/App/C', n_nationkey, "


@query(f"""select {_CS_USE} as from_id, {_CS_OF}'/Add(string)') as to_id, concat('src/Use', n_nationkey, '.cs:4') as evidence from nation
    union all select {_CS_USE}, {_CS_OF}'/Add(int,int)'), concat('src/Use', n_nationkey, '.cs:5') from nation""")
def csharp_calls(spark, sf_dir):
    """Overloads by their arguments' number and types, through a declared receiver."""
    from .operators import resolve

    types = "concat('namespace App;\\npublic class C', n_nationkey, ' {{\\n  public void Add(string s) {{ }}\\n  public void Add(int a, int b) {{ }}\\n}}\\n')"
    uses = "concat('namespace App;\\npublic class Use', n_nationkey, ' {{\\n  public void Run(C', n_nationkey, ' c) {{\\n    c.Add(\"x\");\\n    c.Add(1, 2); c.Add(); }}\\n}}\\n')"
    text = f"select 'acme/r' as repository, concat('src/C', n_nationkey, '.cs') as path, {types} as text from {{nation}} union all select 'acme/r', concat('src/Use', n_nationkey, '.cs'), {uses} from {{nation}}"
    rows = G.frame(spark, sf_dir, text).select("repository", "path", F.encode("text", "utf-8").alias("content"))
    return resolve.csharp_calls(languages.analyze(rows)).select("from_id", "to_id", "evidence")


@query("""select concat('repo://a/elixir/App.U', n_nationkey, '/run/1') as from_id, concat('repo://a/elixir/App.T', n_nationkey, x) as to_id, concat('lib/u', n_nationkey, '.ex:', line) as evidence, 1.0::double as confidence
    from nation, (values ('/trim/1', 4), ('/upper/1', 5)) v(x, line)
    union all select concat('repo://a/elixir/App.U', n_nationkey, '/run/1'), 'elixir-call://pad/1', concat('lib/u', n_nationkey, '.ex:6'), 0.6 from nation""")
def elixir_calls(spark, sf_dir):
    """Calls by module and arity, and through an import that takes some functions."""
    from .analysis import analyze_workspace

    uses = "concat('defmodule App.U', n_nationkey, ' do\\n  import App.T', n_nationkey, ', only: [trim: 1]\\n  def run(x) do\\n    trim(x)\\n    App.T', n_nationkey, '.upper(x)\\n    pad(x)\\n  end\\nend\\n')"
    defines = "concat('defmodule App.T', n_nationkey, ' do\\n  def trim(x), do: x\\n  def upper(x), do: x\\n  def pad(x), do: x\\nend\\n')"
    text = f"select 'a' as repository, concat('lib/u', n_nationkey, '.ex') as path, {uses} as text from {{nation}} union all select 'a', concat('lib/t', n_nationkey, '.ex'), {defines} from {{nation}}"
    rows = G.frame(spark, sf_dir, text).select("repository", "path", F.encode("text", "utf-8").alias("content"))
    return analyze_workspace(rows, ()).edges.where("relation = 'calls'").select("from_id", "to_id", "evidence", "confidence")
