"""Registered queries of resolvers, publication, projection and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import testgraph as G
from .operators import graph, publish, resolve
from .queries import _CANDIDATES, _CONTEXT, _EFFECTIVE, _METHODS, _OWNERS, _evidence_text, _MASK, supply  # noqa: F401
from .registry import ORACLE_SQL, query
from .streaming import jobs


def _place(n: str) -> str:
    return f"case when ({n}) % 3 = 1 then concat('repo://acme/app/elixir-source/lib/m', {n}, '.ex') else concat('repo://acme/app/rust/m/f', {n}) end"


#: One path, every third node of which is a namespace that answers don't show.
_PATH = (
    f"select n_nationkey as n, {_place('n_nationkey')} as from_id, case when n_nationkey % 2 = 0 then 'calls' else 'uses' end as relation, {_place('n_nationkey + 1')} as to_id, "
    "concat('src/p', n_nationkey % 4, '.rs:', n_nationkey) as evidence, case when n_nationkey % 5 = 0 then cast(0.6 as double) else cast(1.0 as double) end as confidence, 'ast' as provenance from {nation}"
)


@query(f"""with s as ({_PATH}), t as (select *, case when (n + 1) % 3 <> 1 or n = (select max(n) from s) then 1 else 0 end as stop from s),
    r as (select *, coalesce(sum(stop) over (order by n rows between unbounded preceding and 1 preceding), 0) as run from t),
    e as (select *, concat('ast|', regexp_extract(evidence, '^(.*):', 1), '|', regexp_extract(evidence, ':([0-9]+)$', 1), '|') as ref from r)
    select cast(run + 1 as bigint) as step, arg_max(to_id, n) as to_id, arg_max(relation, n) as relation, min(confidence) as confidence, string_agg(distinct ref, ';' order by ref) as evidence from e group by run""")
def path_projection(spark, sf_dir):
    edges = G.frame(spark, sf_dir, _PATH)
    n = edges.agg(F.max("n")).first()[0]
    ends = [edges.where(F.col("n") == 0).first().from_id, edges.where(F.col("n") == n).first().to_id]
    found = graph.project_path(graph.trace(graph.Graph(edges.drop("n")), *ends))
    return found.select(F.col("step").cast("long").alias("step"), "to_id", "relation", "confidence", _evidence_text(F.col("evidence")).alias("evidence"))


_TESTED = (
    "select case when p_size % 3 = 0 then concat('repo://acme/app/rust/tests/t', p_partkey) else concat('repo://acme/app/rust/m/f', p_partkey) end as from_id, 'calls' as relation, "
    "case when p_partkey < 60 then 'repo://acme/app/rust/core/run' else concat('repo://acme/app/rust/m/f', p_partkey % 60) end as to_id, concat('src/x.rs:', p_partkey) as evidence, cast(1.0 as double) as confidence, 'ast' as provenance from {part}"
)
_CALLERS = f"with recursive s as ({_TESTED}), r(node, hops) as (select 'repo://acme/app/rust/core/run', 0 union select s.from_id, r.hops + 1 from r join s on s.to_id = r.node where r.hops < 32), m as (select node, min(hops) as hops from r group by node having min(hops) > 0)"


@query(f"{_CALLERS} select case when hops = 1 then 'direct' else 'callable' end as grp, count(*) filter (not contains(node, '/tests/')) as n, count(*) filter (contains(node, '/tests/')) as hidden_tests from m group by 1")
def impact_hidden_tests(spark, sf_dir):
    return graph.impact_groups(graph.impact(graph.Graph(G.frame(spark, sf_dir, _TESTED)), "repo://acme/app/rust/core/run"))


@query(f"{_CALLERS}, a as (select node as id from m union select 'repo://acme/app/rust/core/run') select id, case when contains(id, '/tests/') then 'hidden' else 'primary' end as visibility from a")
def shown_nodes(spark, sf_dir):
    found = graph.impact(graph.Graph(G.frame(spark, sf_dir, _TESTED)), "repo://acme/app/rust/core/run")
    return graph.visibility(found.nodes).select("id", "visibility")


@query(f"select id, case when test then 'hidden' when origin <> 'source' then 'supporting' when kind in ('namespace', 'proto_file') then 'hidden' else 'primary' end as visibility from ({ORACLE_SQL['entity_attrs']})")
def visibility(spark, sf_dir):
    from .queries import entity_attrs

    return graph.visibility(entity_attrs(spark, sf_dir)).select("id", "visibility")


_FACTS = "select concat('part/', p_partkey) as id, 'service' as kind, '' as metadata from {part} where p_size < 25"


@query(f"""{_CONTEXT}, f as ({_FACTS}), n as (select from_id as id from m union select to_id from m)
    select id, case when id in (select id from f) then 'service' when starts_with(id, 'supplier/') then 'callable' when starts_with(id, 'part/') or starts_with(id, 'grpc://') then 'rpc' else 'unknown' end as kind from n""")
def described_kinds(spark, sf_dir):
    g = supply(spark, sf_dir, True, True)
    g.entities = G.frame(spark, sf_dir, _FACTS)
    return graph.context(g, "part/12").nodes.select("id", "kind")


@query(f"{_EFFECTIVE} select * from d where relation = 'requires'")
def inspect_relation(spark, sf_dir):
    return supply(spark, sf_dir, True, True).effective().where("relation = 'requires'")


_EXPORTS = "select distinct concat('f', p_partkey % 20) as file, case when p_size % 7 = 0 then 'default' else concat('n', p_size % 10) end as name from {part}"
_REEXPORTS = "select distinct concat('f', 20 + s_suppkey % 20) as file, case when s_nationkey % 3 = 0 then '*' else concat('n', s_nationkey % 10) end as name, concat('f', s_suppkey % 37) as source_file, concat('n', (s_nationkey + 1) % 10) as source_name from {supplier}"


@query(f"""with recursive e as ({_EXPORTS}), x as ({_REEXPORTS}), r(file, name, origin_file, origin_name) as (select file, name, file, name from e
    union select x.file, case when x.name = '*' then r.name else x.name end, r.origin_file, r.origin_name from r join x on x.source_file = r.file and ((x.name = '*' and r.name <> 'default') or (x.name <> '*' and x.source_name = r.name))) select * from r""")
def reexport_origins(spark, sf_dir):
    return resolve.reexport_origins(G.frame(spark, sf_dir, _EXPORTS), G.frame(spark, sf_dir, _REEXPORTS))


_SETTINGS = "select concat('t', s_suppkey % 30) as file, concat('k', s_nationkey % 4) as key, min(concat('v', s_suppkey)) as value from {supplier} group by 1, 2"
_EXTENDS = "select distinct concat('t', s_suppkey % 30) as file, concat('t', cast(floor((s_suppkey % 30) / 2) as int)) as parent from {supplier}"


@query(f"""with recursive o as ({_SETTINGS}), x as ({_EXTENDS}), c(file, source, depth) as (select file, file, 0 from (select file from o union select file from x) f union select c.file, x.parent, c.depth + 1 from c join x on x.file = c.source where c.depth < 12)
    select c.file, o.key, arg_min(o.value, c.depth) as value from c join o on o.file = c.source group by all""")
def inherited_settings(spark, sf_dir):
    return resolve.inherited_settings(G.frame(spark, sf_dir, _SETTINGS), G.frame(spark, sf_dir, _EXTENDS))


_PROVIDES = "select distinct concat('m', p_partkey % 25) as module, concat('T', p_size % 12) as token, concat('C', p_size % 24) as target, p_size % 3 <> 0 as exported from {part} where p_size < 30"
_MODULES = "select distinct concat('m', s_suppkey % 25) as module, concat('m', s_nationkey) as imported, s_suppkey % 2 = 0 as re_exported from {supplier}"


@query(f"""with recursive p as ({_PROVIDES}), i as ({_MODULES}), x(module, token, target) as (select module, token, target from p where exported union select i.module, x.token, x.target from x join i on i.imported = x.module where i.re_exported),
    s as (select module, token, target from p union select i.module, x.token, x.target from i join x on x.module = i.imported) select module, token, min(target) as target from s group by all having count(distinct target) = 1""")
def provider_resolution(spark, sf_dir):
    return resolve.resolve_providers(G.frame(spark, sf_dir, _PROVIDES), G.frame(spark, sf_dir, _MODULES))


_REGISTERED = "select concat('IS', o_custkey % 30) as service, concat('S', o_custkey % 45) as implementation, concat('P.cs:', o_orderkey) as evidence from {orders}"
_TYPES = "select distinct concat(case when p_size % 2 = 0 then 'IS' else 'S' end, p_partkey % 40) as name, concat('repo://r/csharp/a/T', p_partkey % 45) as id from {part} where p_partkey < 60"
_EDGE_ENDS = "cast(1.0 as double) as confidence, 'ast' as provenance"


@query(f"""with r as ({_REGISTERED}), t as ({_TYPES}), u as (select name, min(id) as id from t group by name having count(distinct id) = 1)
    select distinct a.id as from_id, 'implemented_by' as relation, b.id as to_id, evidence, {_EDGE_ENDS} from r join u a on a.name = service join u b on b.name = implementation""")
def registered_services(spark, sf_dir):
    return resolve.register_services(G.frame(spark, sf_dir, _REGISTERED), G.frame(spark, sf_dir, _TYPES))


_PREFABS = "select concat('repo://g/unity-prefab/P', o_custkey % 50) as prefab, concat('guid', o_orderkey % 70) as guid, concat('P.prefab:', o_orderkey) as evidence from {orders}"
_METAS = "select distinct concat('guid', p_partkey % 60) as guid, concat('S', p_partkey % 80, '.cs') as path from {part} where p_partkey < 90"
_SCRIPTS = "select distinct concat('S', p_partkey % 75, '.cs') as path, concat('repo://g/csharp/S', p_partkey % 150) as id from {part} where p_partkey < 100"
_SCRIPT_OF = f"with r as ({_PREFABS}), m as (select guid, min(path) as path from ({_METAS}) group by guid having count(distinct path) = 1), t as (select path, min(id) as id from ({_SCRIPTS}) group by path having count(distinct id) = 1), s as (select guid, id from m join t using (path))"


@query(f"{_SCRIPT_OF} select distinct prefab as from_id, 'uses' as relation, id as to_id, evidence, {_EDGE_ENDS} from r join s using (guid)")
def prefab_script_edges(spark, sf_dir):
    return resolve.prefab_scripts(*(G.frame(spark, sf_dir, x) for x in (_PREFABS, _METAS, _SCRIPTS)))[0]


@query(f"{_SCRIPT_OF} select distinct prefab, guid, evidence, 'unity.prefab_script_unresolved' as code from r where guid not in (select guid from s)")
def prefab_scripts_unresolved(spark, sf_dir):
    return resolve.prefab_scripts(*(G.frame(spark, sf_dir, x) for x in (_PREFABS, _METAS, _SCRIPTS)))[1]


_MESSAGES = "select concat('r', p_size % 4) as repository, concat('T', p_partkey % 60) as type, case when p_size % 2 = 0 then 'Start' else 'Update' end as message, concat('repo://r', p_size % 4, '/csharp/T', p_partkey % 60, '/m', p_partkey) as method, concat('T.cs:', p_partkey) as evidence from {part}"
_INHERITS = "select distinct concat('r', s_suppkey % 4) as repository, concat('T', s_suppkey % 60) as type, case when s_nationkey < 6 then 'MonoBehaviour' else concat('T', (s_suppkey * 7) % 60) end as base from {supplier}"


@query(f"""with recursive m as ({_MESSAGES}), b as ({_INHERITS}), c(repository, type) as (select distinct repository, 'MonoBehaviour' from m union select b.repository, b.type from c join b on b.repository = c.repository and b.base = c.type)
    select distinct concat('unity://UnityEngine.MonoBehaviour/', message) as from_id, 'implemented_by' as relation, method as to_id, evidence, {_EDGE_ENDS} from m join c using (repository, type)""")
def lifecycle_edges(spark, sf_dir):
    return resolve.lifecycle_edges(G.frame(spark, sf_dir, _MESSAGES), G.frame(spark, sf_dir, _INHERITS))


_STITCHES = "select concat('graphql-field://G/f', o_custkey % 40) as gateway_id, concat('graphql-field://', case when o_orderkey % 5 = 0 then 'G' else 'U' end, '/f', o_custkey % 45) as upstream_id, concat('s.graphql:', o_orderkey) as evidence from {orders}"
_STITCHED = "select distinct concat('graphql-field://', case when p_size % 2 = 0 then 'G' else 'U' end, '/f', p_partkey % 42) as id from {part}"


@query(f"with s as ({_STITCHES}), f as ({_STITCHED}) select gateway_id as from_id, 'resolved_by' as relation, upstream_id as to_id, evidence, cast(1.0 as double) as confidence, 'descriptor' as provenance from s where gateway_id <> upstream_id and gateway_id in (select id from f) and upstream_id in (select id from f)")
def stitched_fields(spark, sf_dir):
    return resolve.stitched_fields(G.frame(spark, sf_dir, _STITCHES), G.frame(spark, sf_dir, _STITCHED))


_MODULE_CALLS = "select o_orderkey as call, concat('m', o_custkey % 20) as module, concat('f', o_custkey % 35) as name from {orders}"
_OWN = "select distinct concat('m', p_partkey % 20) as module, concat('f', p_size % 35) as name, concat('m', p_partkey % 20, '.f', p_partkey % 70) as target from {part} where p_size < 40"
_ANY = "select distinct concat('f', s_suppkey % 35) as name, concat('g', s_suppkey % 50) as target from {supplier}"


@query(f"""with c as ({_MODULE_CALLS}), o as (select module, name, min(target) as t from ({_OWN}) group by all having count(distinct target) = 1), a as (select name, min(target) as t from ({_ANY}) group by all having count(distinct target) = 1)
    select c.*, coalesce(o.t, a.t) as target from c left join o using (module, name) left join a on a.name = c.name""")
def prioritized_calls(spark, sf_dir):
    return resolve.prioritized(G.frame(spark, sf_dir, _MODULE_CALLS), [(G.frame(spark, sf_dir, _OWN), ["module", "name"]), (G.frame(spark, sf_dir, _ANY), ["name"])])


_ALIASED = "select o_orderkey as key, concat(case o_custkey % 4 when 0 then '@app/core/' when 1 then '@app/' when 2 then '@lib/x/' else 'left/' end, 'm', o_custkey % 50) as specifier from {orders}"
_ALIASES = "select * from (values ('@app/', 'src/app/'), ('@app/core/', 'src/core/'), ('@lib/', 'libs/')) as t(prefix, target)"


@query(f"""with i as ({_ALIASED}), a as ({_ALIASES}), j as (select key, specifier, prefix, target, row_number() over (partition by key order by length(prefix) desc) as n from i join a on starts_with(specifier, prefix))
    select key, concat(target, substr(specifier, length(prefix) + 1)) as path from j where n = 1""")
def alias_expansion(spark, sf_dir):
    return resolve.expand_aliases(G.frame(spark, sf_dir, _ALIASED), G.frame(spark, sf_dir, _ALIASES))


@query("""with recursive t as (select user_id, ts, epoch_ms(ts) as t, row_number() over (partition by user_id order by ts, event_type) as n, epoch_ms(ts) - lag(epoch_ms(ts)) over (partition by user_id order by ts, event_type) as gap from events),
    r(user_id, n, t, started) as (select user_id, n, t, ts from t where n = 1 union all select t.user_id, t.n, t.t, case when t.gap > 36000000 or t.t - epoch_ms(r.started) >= 72000000 then t.ts else r.started end from r join t on t.user_id = r.user_id and t.n = r.n + 1)
    select user_id, started, count(*) as changes from r group by all""")
def debounce_capped(spark, sf_dir):
    changes = G.frame(spark, sf_dir, "select user_id, ts, event_type as source from {events}")
    return jobs.debounce_capped(changes, "600 minutes", "1200 minutes", ("user_id",)).select("user_id", "started", "changes")


@query("""with t as (select user_id, ts, case when event_type = 'error' then '*' else event_type end as source, epoch_ms(ts) - epoch_ms(lag(ts) over (partition by user_id order by ts)) > 3600000 as gap from events),
    b as (select user_id, ts, source, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts) as burst from t)
    select user_id, min(ts) as started, case when bool_or(source = '*') then '*' else string_agg(distinct source, ',' order by source) end as sources from b group by user_id, burst""")
def debounce_absorbed(spark, sf_dir):
    changes = G.frame(spark, sf_dir, "select user_id, ts, case when event_type = 'error' then '*' else event_type end as source from {events}")
    return jobs.debounce(changes, "3600001 milliseconds", ("user_id",)).select("user_id", "started", F.array_join("sources", ",").alias("sources"))


_ENRICHED = "select concat('o', s_suppkey) as owner, concat('r', s_nationkey) as repository, concat('fp', s_suppkey % 5) as input_fingerprint from {supplier}"
_NOW_INPUTS = "select concat('r', n_nationkey) as repository, concat('fp', n_regionkey) as fingerprint from {nation}"


@query(f"with o as ({_ENRICHED}), i as ({_NOW_INPUTS}) select o.* from o join i on i.repository = o.repository and i.fingerprint = o.input_fingerprint")
def enrichment_carry(spark, sf_dir):
    return publish.valid_owners(G.frame(spark, sf_dir, _ENRICHED), G.frame(spark, sf_dir, _NOW_INPUTS))


_EXPECTED = "select distinct concat('r', c_nationkey) as repository, concat('a', c_custkey % 3) as analyzer, concat('v', c_custkey % 2) as version from {customer}"
_PRESENT = "select distinct concat('r', s_nationkey) as repository, concat('a', s_suppkey % 3) as analyzer, concat('v', s_suppkey % 2) as version from {supplier}"


@query(f"{_EXPECTED} except {_PRESENT}")
def missing_enrichments(spark, sf_dir):
    return publish.missing_enrichments(G.frame(spark, sf_dir, _EXPECTED), G.frame(spark, sf_dir, _PRESENT))


_PAIRS = f"with s as ({G.SUPPLY}), o as ({_OWNERS}) select distinct a.repository as a, b.repository as b from s join o a on a.id = from_id join o b on b.id = to_id where a.repository <> b.repository"


def _neighbours(spark, sf_dir):
    return resolve.neighbours(resolve.repository_graph(G.frame(spark, sf_dir, G.SUPPLY), G.frame(spark, sf_dir, _OWNERS)))


@query(f"select a as repository, string_agg(b, ',' order by b) as context from ({_PAIRS}) group by a")
def repository_context(spark, sf_dir):
    return _neighbours(spark, sf_dir)[0].select("repository", F.array_join("context", ",").alias("context"))


@query(f"select b as repository, string_agg(a, ',' order by a) as affected from ({_PAIRS}) group by b")
def affected_repositories(spark, sf_dir):
    return _neighbours(spark, sf_dir)[1].select("repository", F.array_join("affected", ",").alias("affected"))


@query(f"with s as ({G.SUPPLY}), o as ({_OWNERS}) select distinct a.repository as from_repository, b.repository as to_repository, evidence from s join o a on a.id = from_id join o b on b.id = to_id where a.repository <> b.repository")
def repository_evidence(spark, sf_dir):
    return resolve.repository_evidence(G.frame(spark, sf_dir, G.SUPPLY), G.frame(spark, sf_dir, _OWNERS))


_OLD = "select concat('k', p_partkey) as k, p_size as v from {part}"
_NEW = "select concat('k', p_partkey * 2) as k, p_size + 100 as v from {part}"


@query(f"with o as ({_OLD}), n as ({_NEW}) select * from o where k not in (select k from n) union all select * from n")
def upsert_facts(spark, sf_dir):
    return publish.upsert(G.frame(spark, sf_dir, _OLD), G.frame(spark, sf_dir, _NEW), ["k"])


@query(f"with o as ({_OLD}), n as ({_NEW}) select * from o where k not in (select k from n)")
def delete_facts(spark, sf_dir):
    return publish.delete(G.frame(spark, sf_dir, _OLD), G.frame(spark, sf_dir, _NEW), ["k"])


@query(f"with o as ({_OLD}), n as ({_NEW}) select k, min(v) as v from (select k, v, 0 as r from o union all select k, v, 1 from n) t where r = (select min(case when x.k in (select k from o) then 0 else 1 end) from (select t.k as k) x) group by k")
def extend_unique(spark, sf_dir):
    return publish.extend_unique(G.frame(spark, sf_dir, _OLD), G.frame(spark, sf_dir, _NEW), ["k"])


@query(f"""with c as (select distinct * from ({_CANDIDATES})), m as ({_METHODS}) select c.*, case when c.cardinality <> 'unary' then 'grpc.cardinality_unsupported' when m.service is null then 'grpc.contract_unmatched' else 'resolved' end as status
    from c left join m using (service, method, cardinality)""")
def grpc_statuses(spark, sf_dir):
    candidates = G.frame(spark, sf_dir, _CANDIDATES).distinct()
    # A candidate that comes in two cardinalities has a diagnostic for one of them only.
    found = resolve.resolve_grpc(candidates, G.frame(spark, sf_dir, _METHODS))[2]
    return publish.grpc_statuses(candidates, found)


@query(f"with c as (select distinct * from ({_CANDIDATES})), m as ({_METHODS}) select distinct concat('grpc://', service, '/', method) as id, 'grpc_operation' as kind, concat('rpc_cardinality:', cardinality) as metadata from c join m using (service, method, cardinality) where cardinality = 'unary'")
def grpc_entities(spark, sf_dir):
    return resolve.resolve_grpc(G.frame(spark, sf_dir, _CANDIDATES), G.frame(spark, sf_dir, _METHODS))[0]


_MADE = "select concat('repo://acme/app', p_size % 3, '/rust/f', p_partkey) as from_id, 'calls' as relation, concat('repo://acme/lib/rust/g', p_partkey) as to_id, concat('a.rs:', p_partkey) as evidence, cast(1.0 as double) as confidence, 'compiler' as provenance from {part}"


@query(f"select * from ({_MADE}) where not starts_with(from_id, 'repo://acme/app1/')")
def escaping_edges(spark, sf_dir):
    return resolve.escapes_target(G.frame(spark, sf_dir, _MADE), "acme/app1")


_KINDS = "select concat('e', p_partkey) as id, case p_size % 5 when 0 then 'graphql_type' when 1 then 'callable' when 2 then 'grpc_operation' when 3 then 'thing' else 'proto_type' end as kind, case p_partkey % 4 when 0 then 'graphql_type:enum' when 1 then '' when 2 then 'rpc_cardinality:unary' else 'proto_type:message' end as metadata from {part}"


@query(f"select * from ({_KINDS}) where not (kind <> 'thing' and (metadata = '' or (kind = 'graphql_type' and metadata = 'graphql_type:enum') or (kind = 'grpc_operation' and metadata = 'rpc_cardinality:unary') or (kind = 'proto_type' and metadata = 'proto_type:message')))")
def invalid_entities(spark, sf_dir):
    return publish.validate_entities(G.frame(spark, sf_dir, _KINDS))


_REVISIONS = "select concat('view', c_nationkey) as view, c_custkey as revision from {customer}"


@query(f"select view, max(revision) + 1 as revision from ({_REVISIONS}) group by view")
def next_revisions(spark, sf_dir):
    return publish.next_revision(G.frame(spark, sf_dir, _REVISIONS))


_OBSERVED = "select concat('state', l_suppkey % 20) as state, concat('f', l_orderkey, '/', l_linenumber) as fact from {lineitem}"
_VIEW = "select concat('r', s_nationkey) as repository, concat('state', s_suppkey % 13) as state from {supplier}"


@query(f"select fact from ({_OBSERVED}) where state in (select state from ({_VIEW}))")
def selected_states(spark, sf_dir):
    from .plans import rules

    return rules.selected_states(G.frame(spark, sf_dir, _OBSERVED), G.frame(spark, sf_dir, _VIEW))


#: Types with four fields each; names that are declared, defined by others (some by each other), and calls on chains of up to five parts.
_FIELDS = "select concat('T', n) as type, concat('f', j) as name, concat('T', (n * 7 + j * 5 + 3) % 40) as target from (select distinct p_size % 40 as n from {part}) a cross join (select 0 as j union all select 1 union all select 2 union all select 3) b where (n + j) % 9 <> 4"
_BINDINGS = "select distinct concat('s', p_partkey % 20) as scope, concat('v', p_partkey % 60) as name, concat('T', p_partkey % 40) as type from {part} where p_partkey % 3 = 0 and p_partkey <= 60"
_PARTS = (
    "select concat('s', p_partkey % 20) as scope, concat('x', p_partkey) as owner, case p_partkey % 8 when 0 then concat('x', p_partkey + 20) when 4 then concat('x', p_partkey - 20) when 1 then concat('x', p_partkey + 20) when 6 then concat('x', p_partkey + 20) else concat('v', p_partkey % 60) end as head, "
    "p_partkey % 5 as more, concat('f', p_size % 4) as f1, concat('f', p_partkey % 4) as f2, concat('f', (p_size + p_partkey) % 4) as f3, concat('f', p_size % 3) as f4 from {part}"
)


@query(f"""with recursive f as ({_FIELDS}), b as ({_BINDINGS}), c as (select scope, owner, ([head, f1, f2, f3, f4])[1:1 + more] as parts from ({_PARTS})),
    r(scope, owner, k, type) as (
        select c.scope, c.owner, 1, b.type from c join b on b.scope = c.scope and b.name = c.parts[1]
        union select n.scope, n.owner, case when r.k < len(me.parts) then r.k + 1 else 1 end, case when r.k < len(me.parts) then f.target else r.type end
        from r join c me on me.scope = r.scope and me.owner = r.owner
            join c n on n.scope = r.scope and ((r.k < len(me.parts) and n.owner = r.owner) or (r.k = len(me.parts) and n.parts[1] = r.owner and not exists (select 1 from b where b.scope = n.scope and b.name = n.parts[1])))
            left join f on f.type = r.type and f.name = me.parts[r.k + 1] and r.k < len(me.parts)
        where r.k = len(me.parts) or f.target is not null)
    select r.scope, r.owner, r.type from r join c using (scope, owner) where r.k = len(c.parts)""")
def receiver_chains(spark, sf_dir):
    parts = G.frame(spark, sf_dir, _PARTS).selectExpr("scope", "owner", "slice(array(head, f1, f2, f3, f4), 1, 1 + cast(more as int)) as parts")
    return resolve.receiver_types(parts, G.frame(spark, sf_dir, _BINDINGS), G.frame(spark, sf_dir, _FIELDS))
