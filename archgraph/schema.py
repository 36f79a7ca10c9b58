"""Vocabularies and row types of architecture graphs."""

from __future__ import annotations

from pyspark.sql import types as T

# Relations in result order, and those that only describe structure.
RELATIONS = (
    "binds_contract", "calls", "calls_graphql", "calls_rpc", "consumed_by", "defines", "field_of", "implements",
    "implemented_by", "imports", "publishes", "requires", "request_type", "resolved_by", "selects", "response_type", "uses",
)
STRUCTURAL = ("defines", "field_of", "request_type", "response_type")
DEPENDENCY = tuple(r for r in RELATIONS if r not in STRUCTURAL)
EXACT, INFERRED = 1.0, 0.6
PROVENANCES = ("ast", "compiler", "descriptor", "generated", "unique_name_heuristic")
ENTITY_KINDS = (
    "callable", "graphql_argument", "graphql_enum_value", "graphql_field", "graphql_operation", "graphql_type", "grpc_operation",
    "kafka_topic", "namespace", "proto_field", "proto_method", "proto_service", "proto_type", "service", "unity_prefab",
)
METADATA = {
    "graphql_operation": ("mutation", "query", "subscription"),
    "graphql_type": ("enum", "input", "interface", "object", "scalar", "union"),
    "rpc_cardinality": ("bidirectional_streaming", "client_streaming", "server_streaming", "unary"),
    "proto_type": ("enum", "message"),
}
#: Kinds that may carry metadata, and of which sort.
METADATA_OF = {"graphql_operation": "graphql_operation", "graphql_type": "graphql_type", "grpc_operation": "rpc_cardinality", "proto_method": "rpc_cardinality", "proto_type": "proto_type"}
SEVERITIES = ("known_limitation", "warning")
DEFAULT_MAX_HOPS = 32

EDGE = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("from_id", "relation", "to_id", "evidence")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("provenance", T.StringType())]
)
EDGE_COLUMNS = EDGE.names
OVERRIDE = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("from_id", "relation", "unresolved_to", "resolved_to", "evidence")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("provenance", T.StringType())]
)
ENTITY = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "kind", "metadata")])
GRPC_CANDIDATE = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("local_symbol", "role", "service", "method", "cardinality", "evidence")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("provenance", T.StringType())]
)
DIAGNOSTIC = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("repository", "code", "severity", "path")]
    + [T.StructField("line", T.LongType()), T.StructField("detail", T.StringType())]
)
