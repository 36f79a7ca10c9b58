"""Graphs derived from the relational test tables, as SQL that Spark and DuckDB both run.

Tables stand in braces: Spark gets them as DataFrames, DuckDB by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of ``sql`` over the tables of a directory."""
    used = {t for t in re.findall(r"\{(\w+)\}", sql)}
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


_E = "cast({c} as double) as confidence, '{p}' as provenance"


def _edges(rest: str, confidence: float = 1.0, provenance: str = "ast") -> str:
    head, tail = rest.split(" from {", 1)
    return f"select {head}, {_E.format(c=confidence, p=provenance)} from {{{tail}"


#: Supply chain: customer -> order -> part -> supplier -> nation -> region; structural nation -> customer.
SUPPLY = " union all ".join(
    (
        _edges("concat('customer/', o_custkey) as from_id, 'calls' as relation, concat('order/', o_orderkey) as to_id, concat('orders/', o_orderkey, ':1') as evidence from {orders}"),
        _edges("concat('order/', l_orderkey) as from_id, 'uses' as relation, concat('part/', l_partkey) as to_id, concat('lineitem/', l_orderkey, ':', l_linenumber) as evidence from {lineitem}"),
        _edges("concat('part/', l_partkey) as from_id, 'implemented_by' as relation, concat('supplier/', l_suppkey) as to_id, concat('part/', l_partkey) as evidence from {lineitem} group by l_partkey, l_suppkey", 0.6, "unique_name_heuristic"),
        _edges("concat('supplier/', s_suppkey) as from_id, 'requires' as relation, concat('nation/', s_nationkey) as to_id, concat('supplier/', s_suppkey, ':2') as evidence from {supplier}"),
        _edges("concat('nation/', n_nationkey) as from_id, 'requires' as relation, concat('region/', n_regionkey) as to_id, concat('nation/', n_nationkey) as evidence from {nation}", 1.0, "descriptor"),
        _edges("concat('nation/', c_nationkey) as from_id, 'defines' as relation, concat('customer/', c_custkey) as to_id, concat('customer/', c_custkey, ':3') as evidence from {customer}"),
    )
)
#: Overrides of some order lines: to another part.
OVERRIDES = (
    "select concat('order/', l_orderkey) as from_id, 'uses' as relation, concat('part/', l_partkey) as unresolved_to, concat('part/', (l_partkey * 7 + 1) % 200) as resolved_to, "
    "concat('lineitem/', l_orderkey, ':', l_linenumber) as evidence, cast(0.6 as double) as confidence, 'unique_name_heuristic' as provenance from {lineitem} where l_quantity >= 49"
)
#: Revision-scoped RPC edges of small parts: bound to contracts, called by orders, implemented by suppliers.
RPC = " union all ".join(
    (
        _edges("concat('grpc://Part/', p_partkey) as from_id, 'binds_contract' as relation, concat('proto-method://Part/', p_partkey) as to_id, concat('part/', p_partkey, ':4') as evidence from {part} where p_partkey < 100"),
        _edges("concat('order/', l_orderkey) as from_id, 'calls_rpc' as relation, concat('grpc://Part/', l_partkey) as to_id, concat('lineitem/', l_orderkey, ':', l_linenumber) as evidence from {lineitem} where l_partkey < 100"),
        _edges("concat('grpc://Part/', l_partkey) as from_id, 'implemented_by' as relation, concat('supplier/', l_suppkey) as to_id, concat('part/', l_partkey, ':5') as evidence from {lineitem} where l_partkey < 100 group by l_partkey, l_suppkey"),
    )
)
#: A dense cyclic graph of users and numbers.
EVENTS = (
    "select concat('u', user_id) as from_id, 'calls' as relation, concat('u', regexp_extract(props, '([0-9]+)', 1)) as to_id, concat('events:', event_id) as evidence, "
    "case when event_type = 'error' then cast(0.6 as double) else cast(1.0 as double) end as confidence, 'ast' as provenance from {events}"
)
#: Each customer's orders as a chain by date.
CHAIN = (
    "select concat('order/', o_orderkey) as from_id, 'calls' as relation, concat('order/', nxt) as to_id, concat('orders/', o_orderkey, ':1') as evidence, cast(1.0 as double) as confidence, 'ast' as provenance "
    "from (select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt from {orders}) t where nxt is not null"
)
#: Ids of many kinds, from orders and parts.
IDS = (
    "select case p_partkey % 16 "
    "when 0 then concat('repo://acme/app', p_size, '/rust/mod', p_partkey, '/run') when 1 then concat('repo://acme/app', p_size, '/elixir/App.Mod', p_size, '/fetch/', p_partkey % 4) "
    "when 2 then concat('repo://acme/app', p_size, '/elixir/App.Mod', p_partkey) when 3 then concat('repo://acme/app', p_size, '/elixir-source/lib/m', p_partkey, '.ex') "
    "when 4 then concat('grpc://shop.v1.Pricing', p_size, '/Get', p_partkey) when 5 then concat('proto-method://shop.v1.Pricing/', 'Get', p_partkey) "
    "when 6 then concat('graphql-field://Query/f', p_partkey) when 7 then concat('elixir-call://App.M/run/', p_partkey % 5) when 8 then concat('rust-call://helper_', p_partkey) "
    "when 9 then concat('repo://acme/app', p_size, '/typescript/tests/x', p_partkey, '.spec.ts/it') when 10 then concat('repo://acme/rust/app/rust/test_', p_partkey) "
    "when 11 then concat('repo://acme/app/unity-prefab/Assets/P', p_partkey, '.prefab') when 12 then concat('elixir-module://Ecto.Repo', p_partkey) "
    "when 13 then concat('proto-field://shop.v1.Price/f', p_partkey) when 14 then concat('unity://UnityEngine.MonoBehaviour/', 'Start') else concat('service:', p_partkey) end as id from {part}"
)
