"""Registered queries of administration, compiler events, generated code and working trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import testgraph as G
from .operators import administration, graph, resolve
from .plans.shared import materialize
from .queries_sources import _REPO, _edge, _sources
from .registry import query
from .sources import frameworks, git, languages

_ANALYZERS = "select concat('r', p_partkey % 30) as repository, case when p_partkey % 30 = 7 then null else concat('a', p_size % 7) end as analyzer, concat('v', p_size % 3) as version from {part}"


@query(f"""with t as (select distinct * from ({_ANALYZERS})) select repository, coalesce(string_agg(len(analyzer) || ':' || analyzer || len(version) || ':' || version, '' order by analyzer, version), 'none') as identity from t group by repository""")
def analysis_identities(spark, sf_dir):
    return administration.analysis_identities(G.frame(spark, sf_dir, _ANALYZERS))


_MEMBERS = "select concat('w', s_nationkey) as workspace, concat('r', s_suppkey) as repository, concat('1:a2:v', s_suppkey % 4) as identity from {supplier}"


@query(f"""select workspace, 'repositories:' || string_agg(len(repository) || ':' || repository || ':' || len(identity) || ':' || identity, ':' order by repository) || ':core-rules:6' as identity from ({_MEMBERS}) group by workspace""")
def workspace_identities(spark, sf_dir):
    return administration.workspace_identities(G.frame(spark, sf_dir, _MEMBERS))


_CACHED = "select concat('s', c_custkey) as sha, concat('v', c_nationkey % 3) as version from {customer}"
_ASKED = "select concat('s', o_custkey) as sha, concat('v', o_orderkey % 3) as version from {orders}"


@query(f"with c as (select distinct * from ({_CACHED})), f as ({_ASKED}) select f.version, count(c.sha) as hits, count(*) - count(c.sha) as misses from f left join c using (sha, version) group by f.version")
def cache_statistics(spark, sf_dir):
    return administration.cache_statistics(G.frame(spark, sf_dir, _ASKED), G.frame(spark, sf_dir, _CACHED))


_NOW = "select concat('r', s_suppkey) as repository, concat('i', s_nationkey % 2) as identity, concat('f', s_suppkey % 5) as fingerprint from {supplier}"
_THEN = "select concat('r', s_suppkey) as repository, concat('i', s_suppkey % 2) as identity, concat('f', s_suppkey % 5) as fingerprint from {supplier} where s_suppkey % 7 <> 0"


@query(f"select repository, identity, fingerprint, (repository, identity, fingerprint) in (select (repository, identity, fingerprint) from ({_THEN})) as cached from ({_NOW})")
def prepared_repositories(spark, sf_dir):
    return administration.prepare(G.frame(spark, sf_dir, _NOW), G.frame(spark, sf_dir, _THEN))


_VIEWS = "select concat('v', n_nationkey) as view, n_regionkey + 1 as revision from {nation}"
_DIRTY = "select concat('v', s_nationkey) as view, case when s_suppkey % 4 = 0 then null else concat('r', s_suppkey % 6) end as repository from {supplier}"
_ACTIVE = "select concat('v', c_nationkey) as view from {customer} where c_acctbal < 0"


@query(f"""with d as ({_DIRTY}), a as ({_ACTIVE}) select view, revision, view in (select view from d) as stale, view in (select view from a) as indexing,
    coalesce((select string_agg(distinct repository, ',' order by repository) from d where d.view = v.view), '') as dirty from ({_VIEWS}) v""")
def view_freshness(spark, sf_dir):
    found = administration.freshness(*(G.frame(spark, sf_dir, x) for x in (_VIEWS, _DIRTY, _ACTIVE)))
    return found.select("view", "revision", "stale", "indexing", F.array_join("dirty_repositories", ",").alias("dirty"))


_FOUND = (
    "select concat('r', p_size % 5) as repository, concat('code', p_partkey % 3) as code, case when p_size % 2 = 0 then 'warning' else 'known_limitation' end as severity, concat('p', p_partkey % 11) as path, "
    "case when p_partkey % 4 = 0 then null else cast(p_size as bigint) end as line, case when p_partkey % 5 = 0 then null else concat('d', p_size % 3) end as detail from {part}"
)


@query(f"select distinct * from ({_FOUND}) order by code nulls first, severity nulls first, repository nulls first, path nulls first, line nulls first, detail nulls first limit 40")
def first_diagnostics(spark, sf_dir):
    return administration.ordered_diagnostics(G.frame(spark, sf_dir, _FOUND), 40)


_QUEUE = "select concat('state', o_orderkey) as state, o_orderdate as queued from {orders}"


@query(f"select * from ({_QUEUE}) order by queued, state limit 64")
def gc_queue(spark, sf_dir):
    return administration.garbage_queue(G.frame(spark, sf_dir, _QUEUE), 64)


_ONE = "select concat('k', p_size) as k, p_partkey % 3 as v from {part}"
_TWO = "select concat('k', p_size) as k, p_partkey % 4 as v from {part}"


@query(f"select *, 'a' as side from (({_ONE}) except all ({_TWO})) union all select *, 'b' from (({_TWO}) except all ({_ONE}))")
def differing_facts(spark, sf_dir):
    return administration.differing_facts(G.frame(spark, sf_dir, _ONE), G.frame(spark, sf_dir, _TWO))


_NOTED = "select concat('order/', l_orderkey) as from_id, 'uses' as relation, concat('part/', l_partkey) as to_id, case when l_linenumber % 3 = 0 then concat('note ', l_partkey) else concat('f', l_linenumber % 4, '.rs:', l_partkey) end as evidence, cast(1.0 as double) as confidence, 'ast' as provenance from {lineitem}"


@query(f"""with e as (select from_id, to_id, min(regexp_extract(evidence, '^(.*):[0-9]+$', 1)) as path from ({_NOTED}) where contains(evidence, ':') group by all), f as (select from_id, arg_min(path, to_id) as path from e group by all)
    select concat('order/', o_orderkey) as id, coalesce(path, 'unknown source') as path from orders left join f on from_id = concat('order/', o_orderkey)""")
def test_evidence_paths(spark, sf_dir):
    tests = G.frame(spark, sf_dir, "select concat('order/', o_orderkey) as id from {orders}")
    return administration.first_evidence_paths(tests, graph.merge_edges(G.frame(spark, sf_dir, _NOTED)))


@query("select ts, concat('u', user_id) as source from events union all select distinct time_bucket(interval '60 seconds', ts) + interval '60 seconds', '*' from events")
def reconciled_changes(spark, sf_dir):
    return administration.reconciliations(G.frame(spark, sf_dir, "select ts, concat('u', user_id) as source from {events}"))


_N = "cast(null as string)"
_COMPILED = (
    f"select s_suppkey as ordinal, concat('acme/app', s_suppkey % 3) as repository, 'module' as kind, concat('lib/m', s_suppkey, '.ex') as file, cast(1 as bigint) as line, {_N} as caller_module, {_N} as caller_function, "
    f"concat('App.M', s_suppkey) as target, {_N} as function, false as from_macro, concat('run/0,f', s_suppkey, '/1') as definitions from {{supplier}} "
    "union all select 1000000 + l_orderkey * 10 + l_linenumber, concat('acme/app', l_suppkey % 3), case l_linenumber % 7 when 0 then 'remote_function' when 1 then 'local_function' when 2 then 'import' when 3 then 'alias' when 4 then 'require' when 5 then 'imported_macro' else 'other' end, "
    "concat('lib/m', l_suppkey, '.ex'), case when l_quantity > 40 then 0 else l_orderkey end, case when l_quantity < 5 then null else concat('App.M', l_suppkey) end, case when l_quantity < 10 then null else concat('f', l_suppkey, '/1') end, "
    f"case when l_partkey % 9 = 0 then ':timer' else concat('App.M', l_partkey % 20) end, case l_partkey % 3 when 0 then 'run/0' when 1 then concat('f', l_suppkey, '/1') else 'other/2' end, l_discount > 0.05, {_N} from {{lineitem}}"
)
_COMPILED_SOURCES = "select concat('acme/app', s_suppkey % 3) as repository, concat('lib/m', s_suppkey, '.ex') as path from {supplier} where s_suppkey % 5 <> 0"
_PLACED = f"""with p as (select e.* from ({_COMPILED}) e join (select distinct * from ({_COMPILED_SOURCES})) s on s.repository = e.repository and s.path = e.file),
    m as (select repository, target, arg_max(definitions, ordinal) as definitions from p where kind = 'module' group by all), c as (select repository, target as module, unnest(string_split(definitions, ',')) as f from m)"""


def _compiler(spark, sf_dir):
    events = G.frame(spark, sf_dir, _COMPILED).withColumn("definitions", F.split("definitions", ","))
    return resolve.compiler_observations(events, G.frame(spark, sf_dir, _COMPILED_SOURCES))


@query(f"""{_PLACED}, r as (select *, case when kind in ('remote_function', 'local_function', 'imported_macro') then 'calls' when kind = 'import' then 'imports' when kind = 'require' then 'requires' when kind = 'alias' then 'uses' end as relation from p),
    t as (select *, case when kind = 'local_function' then caller_module else target end as module, 'repo://' || repository || case when caller_module is null then '/elixir-source/' || file else '/elixir/' || caller_module || coalesce('/' || caller_function, '') end as from_id from r where relation is not null)
    select distinct from_id, relation, case when relation = 'calls' then case when exists (select 1 from c where c.repository = t.repository and c.module = t.module and c.f = t.function) then 'repo://' || repository || '/elixir/' || module || '/' || function else 'elixir-call://' || module || '/' || function end
        when exists (select 1 from m where m.repository = t.repository and m.target = t.module) then 'repo://' || repository || '/elixir/' || module when starts_with(module, ':') then 'erlang-module://' || ltrim(module, ':') else 'elixir-module://' || module end as to_id,
        file || case when line = 0 then '' else ':' || line end || ' (compiler ' || kind || case when from_macro then ' via macro expansion' else '' end || ')' as evidence, case when from_macro then 0.6::double else 1.0::double end as confidence, 'compiler' as provenance from t where module is not null""")
def compiler_observations(spark, sf_dir):
    return _compiler(spark, sf_dir)[0]


@query(f"{_PLACED} select 'repo://' || repository || '/elixir/' || target as id, 'namespace' as kind, '' as metadata from m union all select distinct 'repo://' || repository || '/elixir/' || module || '/' || f, 'callable', '' from c")
def compiler_entities(spark, sf_dir):
    return _compiler(spark, sf_dir)[1]


def _once(facts):
    """Facts that several branches of a plan read: each would parse the files again."""
    return materialize(facts, "facts")


_USER = f"{_REPO}, '/elixir/App.User', p_partkey"
_USING_AT = "'lib/m', p_partkey, '.ex:"


@query(
    " union all ".join(
        (
            _edge(_USER, "defines", f"{_USER}, '/run', p_size, '/1'", _USING_AT + "5'"),
            _edge(f"{_USER}, '/run', p_size, '/1'", "calls", "'elixir-call://helper/1'", _USING_AT + "5'", 0.6),
            _edge(f"{_USER}, '/run', p_size, '/1'", "calls", f"{_USER}, '/own/0'", _USING_AT + "5'"),
            _edge(_USER, "implements", "'elixir-module://App.Worker'", _USING_AT + "4'"),
        )
    ).replace("'ast'", "'generated'")
)
def macro_uses(spark, sf_dir):
    text = (
        "concat('defmodule App.Base', p_partkey, ' do\\n  defmacro __using__(_opts) do\\n    quote do\\n      @behaviour App.Worker\\n      def run', p_size, '(x), do: helper(own())\\n    end\\n  end\\nend\\n"
        "defmodule App.User', p_partkey, ' do\\n  use App.Base', p_partkey, '\\n  def own() do\\n    1\\n  end\\nend\\n')"
    )
    return resolve.macro_uses(_once(languages.analyze(_sources(spark, sf_dir, "concat('lib/m', p_partkey, '.ex')", text))))


@query("""select concat('acme/app', p_size % 3) as repository, concat('item', p_size) as field, 'Query' as parent, concat('repo://acme/app', p_size % 3, '/elixir/App.R/get/3') as resolver, concat('lib/s', p_partkey, '.ex:4') as evidence from part
    union all select concat('acme/app', p_size % 3), 'other', concat('Extra', p_partkey), concat('repo://acme/app', p_size % 3, '/elixir/App.R/other/3'), concat('lib/s', p_partkey, '.ex:9') from part""")
def imported_parents(spark, sf_dir):
    text = (
        "concat('defmodule S do\\n object :queries', p_partkey, ' do\\n  field :item_', p_size, ', :t do\\n   resolve &App.R.get/3\\n  end\\n end\\n object :extra', p_partkey, ' do\\n  field :other, :t do\\n   resolve &App.R.other/3\\n  end\\n end\\n"
        " query do\\n  import_fields :queries', p_partkey, '\\n end\\nend\\n')"
    )
    return frameworks.imported_parents(_once(frameworks.recognize(_sources(spark, sf_dir, "concat('lib/s', p_partkey, '.ex')", text), ("elixir.absinthe",))))


_GENERATED = "select concat('m/C', p_partkey, 'Client/get') as local_symbol, concat('pkg.C', p_size) as service from {part}"
_CALLING = "select concat('m/C', l_partkey, 'Client/get') as to_id, case when l_partkey % 2 = 0 then concat('m/C', l_partkey, 'Client/get') else 'm/other' end as from_id, case when l_partkey % 3 = 0 then 'uses' else 'calls' end as relation from {lineitem}"


@query(f"select * from ({_GENERATED}) where local_symbol in (select to_id from ({_CALLING}) where relation = 'calls' and from_id <> to_id)")
def used_clients(spark, sf_dir):
    return frameworks.used_clients(G.frame(spark, sf_dir, _GENERATED), G.frame(spark, sf_dir, _CALLING))


_TS = f"{_REPO}, '/typescript/src/m', p_partkey, '.ts'"


@query(_edge(f"{_TS}, '/go', p_size", "calls_graphql", "'graphql-operation://Q', p_partkey", "'src/m', p_partkey, '.ts:2'"))
def embedded_calls(spark, sf_dir):
    text = "concat('const DOC = gql`query Q', p_partkey, ' { me }`;\\nexport function go', p_size, '() { return client.query(DOC); }\\n')"
    found = frameworks.recognize(_sources(spark, sf_dir, "concat('src/m', p_partkey, '.ts')", text), ("typescript.graphql",))
    return frameworks.embedded_calls(_once(found), spark.createDataFrame([], "file string, local string, imported string, target_file string"))


_RS = f"{_REPO}, '/rust/m', p_partkey"


@query(" union all ".join((_edge(_RS, "defines", f"{_RS}, '/a', p_partkey", "'src/m', p_partkey, '.rs:1'"), _edge(_RS, "defines", f"{_RS}, '/b'", "'src/m', p_partkey, '.rs:3'"), _edge(f"{_RS}, '/b'", "calls", f"{_RS}, '/a', p_partkey", "'src/m', p_partkey, '.rs:3'"))))
def recovered_edges(spark, sf_dir):
    text = "concat('fn a', p_partkey, '() {}\\n lost() }\\nfn b() { a', p_partkey, '(); }\\n')"
    return languages.edges(languages.analyze(_sources(spark, sf_dir, "concat('src/m', p_partkey, '.rs')", text)))


_PLACES = "select concat('/w/t', p_size % 9, '/d', p_size % 4, '/f', p_partkey) as place from {part}"
_TREES = "select distinct concat('/w/t', s_suppkey % 9, case when s_nationkey % 2 = 0 then '' else concat('/d', s_suppkey % 4) end) as tree, s_suppkey % 5 = 0 as prunable from {supplier}"


@query(f"with p as ({_PLACES}), t as (select distinct tree from ({_TREES}) where not prunable) select p.place, (select arg_max(tree, length(tree)) from t where p.place = tree or starts_with(p.place, tree || '/')) as tree from p")
def working_trees(spark, sf_dir):
    return git.choose_trees(G.frame(spark, sf_dir, _PLACES), G.frame(spark, sf_dir, _TREES))
