"""Column functions over entity ids: kind, name, repository, origin, test, and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RELATIONS

# Markers that follow a repository in an id, in order of preference.
REPOSITORY_MARKERS = (
    "elixir-source", "typescript-source", "javascript-source", "csharp-source", "unity-prefab",
    "rust", "elixir", "typescript", "javascript", "csharp",
)
# Id prefixes and the kind they stand for.
PREFIX_KINDS = (
    ("grpc://", "rpc"), ("proto-method://", "rpc"), ("rpc/", "rpc"), ("rpc://", "rpc"),
    ("graphql-field://", "graphql_field"), ("graphql-argument://", "graphql_argument"), ("graphql-enum-value://", "graphql_enum_value"),
    ("graphql-operation://", "graphql_operation"), ("graphql-type://", "graphql_type"), ("kafka-topic://", "kafka_topic"),
)
LATE_PREFIX_KINDS = (
    ("rust-call://", "callable"), ("rust-method://", "callable"), ("elixir-call://", "callable"),
    ("elixir-module://", "namespace"), ("erlang-module://", "namespace"),
    ("proto-field://", "proto_field"), ("proto-service://", "proto_service"),
)
EXTERNAL_PREFIXES = ("rust-call://", "rust-method://", "elixir-call://", "elixir-module://", "erlang-module://", "unity://")
TEST_SEGMENTS = ("test", "tests", "spec", "specs", "bench", "benches")

_ARITY = r"(?s)^.*/elixir/(?:.*/)?([^/]+)/\+?([0-9]+)$"


def relation_rank(relation: Column) -> Column:
    """The place of a relation in result order, from 0."""
    return F.array_position(F.array(*map(F.lit, RELATIONS)), relation) - 1


def infer_kind(id_: Column) -> Column:
    out = F
    for prefix, kind in PREFIX_KINDS:
        out = out.when(id_.startswith(prefix), kind)
    out = out.when(id_.contains("/unity-prefab/"), "unity_prefab")
    for prefix, kind in LATE_PREFIX_KINDS:
        out = out.when(id_.startswith(prefix), kind)
    out = out.when(id_.contains("/elixir-source/"), "namespace")
    out = out.when(id_.rlike(_ARITY), "callable").when(id_.contains("/elixir/"), "namespace")
    return out.otherwise("unknown")


def kind_hint(relation: Column, is_source: Column, id_: Column) -> Column:
    """The kind that an edge suggests for one of its ends."""
    inferred = infer_kind(id_)
    by_edge = (
        F.when((relation == "defines") & is_source, "namespace")
        .when(relation.isin("defines", "calls") | ((relation == "implemented_by") & ~is_source), "callable")
        .when(relation == "calls_graphql", F.when(is_source, "callable").otherwise("graphql_operation"))
        .when(((relation == "calls_rpc") & ~is_source) | (relation == "implemented_by"), "rpc")
        .when(((relation == "selects") & ~is_source) | ((relation == "resolved_by") & is_source), "graphql_field")
        .otherwise("unknown")
    )
    return F.when(inferred != "unknown", inferred).otherwise(by_edge)


def kind_priority(kind: Column) -> Column:
    return F.when(kind == "unknown", 0).when(kind == "namespace", 1).when(kind == "callable", 2).otherwise(3)


def entity_name(id_: Column) -> Column:
    call = r"(?s)^elixir-call://(?:(.*)/)?([^/]*)/\+?([0-9]+)$"
    rpc = r"(?s)^(?:proto-method|grpc)://([^/]*)/(.*)$"
    module = F.regexp_extract(id_, call, 1)
    called = F.concat(F.when(module != "", F.concat(module, F.lit("."))).otherwise(""), F.regexp_extract(id_, call, 2), F.lit("/"), F.regexp_extract(id_, call, 3))
    parts = F.filter(F.split(id_, "[/:]"), lambda x: x != "")
    return (
        F.when(id_.startswith("elixir-module://"), F.regexp_replace(id_, "^elixir-module://", ""))
        .when(id_.rlike(call), called)
        .when(id_.rlike(rpc), F.concat(F.element_at(F.split(F.regexp_extract(id_, rpc, 1), "[.]"), -1), F.lit("."), F.regexp_extract(id_, rpc, 2)))
        .when(id_.rlike(_ARITY), F.concat(F.regexp_extract(id_, _ARITY, 1), F.lit("/"), F.regexp_extract(id_, _ARITY, 2)))
        .otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), id_))
    )


def repository(id_: Column) -> Column:
    """The repository of a ``repo://`` id: what stands before the last marker of the first kind found; else null."""
    found = [F.regexp_extract(id_, rf"(?s)^repo://(.*)/{m}/", 1) for m in REPOSITORY_MARKERS]
    return F.coalesce(*(F.when(id_.rlike(rf"(?s)^repo://.*/{m}/"), x) for m, x in zip(REPOSITORY_MARKERS, found)))


def origin(id_: Column) -> Column:
    external = F.lit(False)
    for prefix in EXTERNAL_PREFIXES:
        external = external | id_.startswith(prefix)
    return F.when(external, "external_dependency").otherwise("source")


def is_test(id_: Column) -> Column:
    def segment(part: Column) -> Column:
        low = F.lower(part)
        return low.isin(*TEST_SEGMENTS) | low.rlike(r"[._](test|spec)([.]|$)") | part.endswith("Test")

    name = F.element_at(F.split(id_, "/"), -1)
    return F.exists(F.split(id_, "/"), segment) | name.rlike("^(test|spec|bench)_") | name.rlike("_(test|spec)$")


def evidence_ref(from_id: Column, to_id: Column, evidence: Column, provenance: Column) -> Column:
    """Struct (source_kind, repository, path, line, detail) of an edge's evidence text."""
    placed = r"(?s)^(.*):\+?([0-9]+)$"
    line = F.try_to_number(F.regexp_extract(evidence, placed, 2), F.lit("9999999999")).cast("long")
    line = F.when(evidence.rlike(placed) & (line <= 4294967295), line)
    path = F.when(line.isNotNull(), F.regexp_extract(evidence, placed, 1)).when(provenance == "descriptor", evidence)
    kind = F.when(provenance == "unique_name_heuristic", "inference").when(provenance.isin("ast", "compiler", "descriptor", "generated"), provenance).otherwise("unknown")
    detail = F.when(provenance == "unique_name_heuristic", provenance).when(path.isNull(), evidence)
    return F.struct(
        kind.alias("source_kind"), F.coalesce(repository(from_id), repository(to_id)).alias("repository"),
        path.alias("path"), line.alias("line"), detail.alias("detail"),
    )


def symbol_scope(id_: Column, name: Column) -> Column:
    """The scope segments between a repo id's language and its name, without callback and field; null without scope."""
    inner = F.regexp_extract(id_, r"(?s)^repo://", 0)
    repo = repository(id_)
    rest = F.substring(id_, F.length(repo) + F.lit(9), F.length(id_))
    symbol = F.when((inner != "") & F.instr(rest, "/").cast("boolean"), F.substring(rest, F.instr(rest, "/") + 1, F.length(rest)))
    scope = F.when(symbol.endswith(F.concat(F.lit("/"), name)), F.substring(symbol, F.lit(1), F.length(symbol) - F.length(name) - 1))
    return F.filter(F.split(scope, "/"), lambda x: ~x.isin("callback", "field"))


def snake_to_pascal(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")


def pascal_to_snake(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def pascal_to_camel(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def simple_type_name(text: Column) -> Column:
    """A type's bare name: without ``?``, namespace and type arguments."""
    return F.element_at(F.split(F.substring_index(F.regexp_replace(text, r"\?+$", ""), "<", 1), "[.]"), -1)


def normalize_path(path: Column) -> Column:
    """``.`` and ``..`` segments resolved."""
    step = lambda kept, x: F.when(x.isin("", "."), kept).when((x == "..") & (F.size(kept) > 0), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def identity_text(*parts: Column) -> Column:
    """Length-prefixed parts, one after another, so that no two lists of parts share a text."""
    return F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))
