"""Analysis of a workspace's files: frontends, recognizers and resolvers, from rows of source text to facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import ids
from .operators import modules, resolve
from .plans.shared import materialize
from .schema import DIAGNOSTIC
from .sources import frameworks, graphql, languages, manifests, protobuf
from .sources.facts_cache import FactCache


@dataclass
class Analysis:
    """``edges`` and ``entities`` of the files; ``bound`` edges between them, which hold in one revision; overrides and diagnostics."""

    edges: DataFrame
    entities: DataFrame
    bound: DataFrame
    overrides: DataFrame
    diagnostics: DataFrame


def analyze_workspace(files: DataFrame, recognizers: tuple[str, ...] = tuple(frameworks.RECOGNIZERS), own: dict | None = None, cache: FactCache | None = None) -> Analysis:
    """Facts of rows repository, path, content. Each frontend is one map over its files; resolvers are joins over what those yield.

    ``own`` are recognizers of plugins, by name; a ``cache`` has the facts of files that were parsed before.
    """

    def parsed(name: str, pattern: str, parse) -> DataFrame:
        return materialize(parse(files) if cache is None else cache.facts(files, name, pattern, parse), name)

    own = own or {}
    code = parsed("code", "|".join(f"(?:{x[0]})" for x in languages.FRONTENDS.values()), languages.analyze)
    schema = parsed("schema", r"\.(graphql|gql)$", graphql.analyze)
    proto = materialize(protobuf.proto_sources(files), "contracts")
    found = None
    if recognizers or own:
        patterns = [frameworks.RECOGNIZERS[x][0] for x in recognizers] + [x[0] for x in own.values()]
        found = parsed("recognized", "|".join(f"(?:{x})" for x in patterns), lambda rows: frameworks.recognize(rows, recognizers, own))
    settled, receivers, imports = modules.resolve_modules(code, files)
    generated = materialize(resolve.macro_uses(code), "macro-uses")
    edges = materialize(modules.settle(languages.edges(code), settled.union(resolve.elixir_calls(code))).unionByName(resolve.csharp_calls(code)).unionByName(generated).unionByName(graphql.edges(schema)).unionByName(graphql.selection_edges(schema)).unionByName(protobuf.edges(proto)), "edges")
    given = generated.where("relation = 'defines'").select(F.col("to_id").alias("id"), F.lit("callable").alias("kind"), F.lit("").alias("metadata"))
    entities = languages.entities(code).unionByName(given).unionByName(graphql.entities(schema)).unionByName(protobuf.entities(proto))
    definitions = entities.where("kind = 'callable'").select(ids.repository(F.col("id")).alias("repository"), "id").where("repository is not null")
    overrides = resolve.unique_name_overrides(edges, definitions).union(resolve.elixir_modules(edges))
    diagnostics = languages.diagnostics(code).select("repository", "code", "severity", "path", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("detail")).union(receivers.select(*DIAGNOSTIC.names))
    if found is None:
        return Analysis(edges, entities.distinct(), edges.where("false"), overrides, diagnostics)
    fields = schema.where("sort = 'field_type'").select("repository", F.col("from_id").alias("parent"), F.col("kind").alias("field"), F.concat(F.lit("graphql-field://"), "from_id", F.lit("/"), "kind").alias("id")).distinct()
    operations, rpc, unresolved = _grpc(found, protobuf.contract_methods(proto), edges)
    resolvers = frameworks.imported_parents(found)
    # A field of one repository's schema may be resolved in another; where its own schema lacks it, any one schema's will do.
    own = resolve.bind_graphql(resolvers, fields)
    anywhere = resolve.bind_graphql(resolvers.withColumn("repository", F.lit("")), fields.withColumn("repository", F.lit("")))
    bound_fields = own.union(anywhere.join(own.select("to_id", "evidence"), ["to_id", "evidence"], "left_anti").select(*own.columns))
    types = entities.where("kind = 'namespace' and id like 'repo://%/csharp/%'").select(F.element_at(F.split("id", "[/.]"), -1).alias("name"), "id")
    services = resolve.register_services(found.where("sort = 'registration'").select("service", F.col("target").alias("implementation"), "evidence"), types)
    methods = found.where("sort = 'lifecycle'").select("repository", F.col("parent").alias("type"), F.col("method").alias("message"), F.col("target").alias("method"), "evidence")
    lifecycle = resolve.lifecycle_edges(methods, found.where("sort = 'base'").select("repository", F.col("parent").alias("type"), F.col("target").alias("base")))
    scripts = entities.where("kind = 'namespace' and id like 'repo://%/csharp/%.cs/%'").select(F.regexp_extract("id", r"/csharp/[^/]*/(.*\.cs)/", 1).alias("path"), "id")
    prefabs, lost = resolve.prefab_scripts(manifests.unity_prefabs(files).where("kind = 'script'").select("prefab", "guid", "evidence"), manifests.unity_metas(files).select("guid", "path"), scripts)
    stitched = resolve.stitched_fields(graphql.stitches(schema), fields.select("id"))
    # What a plugin's recognizer says is an edge is one: its role is the relation.
    said = found.where("sort = 'edge'").select(F.col("local_symbol").alias("from_id"), F.col("role").alias("relation"), F.col("target").alias("to_id"), "evidence", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit("ast").alias("provenance"))
    bound = rpc.select(*edges.columns).union(said.select(*edges.columns))
    for more in (bound_fields, services, lifecycle, prefabs, stitched, frameworks.message_edges(found), frameworks.embedded_calls(found, imports)):
        bound = bound.union(more.select(*edges.columns))
    place = F.regexp_extract("evidence", r"^(.*?)(?::[0-9]+)?$", 1)
    line = F.regexp_extract("evidence", r":([0-9]+)$", 1).try_cast("long")

    def located(rows: DataFrame, code_: str, repository, severity: str = "known_limitation", detail=None) -> DataFrame:
        return rows.select(repository.alias("repository"), F.col(code_).alias("code"), F.lit(severity).alias("severity"), place.alias("path"), line.alias("line"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))

    diagnostics = (
        diagnostics.union(located(found.where("sort = 'diagnostic'"), "service", F.col("repository")))
        .union(located(unresolved, "code", ids.repository(F.col("local_symbol")), "warning", F.concat("service", F.lit("/"), "method")))
        .union(located(lost, "code", ids.repository(F.col("prefab")), detail=F.col("guid"))).select(*DIAGNOSTIC.names).distinct()
    )
    documents = found.where("sort = 'document'").select(F.col("target").alias("id"), F.lit("graphql_operation").alias("kind"), F.col("method").alias("metadata"))
    return Analysis(edges, entities.union(operations.select("id", "kind", "metadata")).union(documents).distinct(), bound.distinct(), overrides, diagnostics)


def _grpc(found: DataFrame, methods: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return resolve.resolve_grpc(frameworks.grpc_candidates(found, methods, edges), methods)
