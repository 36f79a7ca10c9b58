"""Protocol buffers: compiled descriptor sets, and a parser of a .proto subset (proto2 and proto3 declarations)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_COLUMNS
from .mapping import batches_of, dealt

FACTS = "sort string, id string, kind string, metadata string, from_id string, relation string, to_id string, evidence string, confidence double, provenance string"
_ARROW = pa.schema([(n, pa.float64() if n == "confidence" else pa.string()) for n in (x.split()[0] for x in FACTS.split(", "))])


def cardinality(client_streams: bool, server_streams: bool) -> str:
    return ("bidirectional_streaming" if server_streams else "client_streaming") if client_streams else ("server_streaming" if server_streams else "unary")


class _Facts:
    def __init__(self, evidence: str) -> None:
        self.rows: list[dict] = []
        self.evidence = evidence

    def entity(self, id_: str, kind: str, metadata: str = "") -> None:
        self.rows.append({"sort": "entity", "id": id_, "kind": kind, "metadata": metadata})

    def edge(self, from_id: str, relation: str, to_id: str) -> None:
        self.rows.append({"sort": "edge", "from_id": from_id, "relation": relation, "to_id": to_id, "evidence": self.evidence, "confidence": 1.0, "provenance": "descriptor"})

    def diagnostic(self, code: str, detail: str) -> None:
        self.rows.append({"sort": "diagnostic", "id": code, "metadata": detail, "evidence": self.evidence})

    def message(self, name: str, parent: str | None, fields: list[str]) -> None:
        self.entity(f"proto-type://{name}", "proto_type", "proto_type:message")
        if parent:
            self.edge(f"proto-type://{parent}", "defines", f"proto-type://{name}")
        for field in fields:
            self.entity(f"proto-field://{name}/{field}", "proto_field")
            self.edge(f"proto-field://{name}/{field}", "field_of", f"proto-type://{name}")

    def enum(self, name: str, parent: str | None) -> None:
        self.entity(f"proto-type://{name}", "proto_type", "proto_type:enum")
        if parent:
            self.edge(f"proto-type://{parent}", "defines", f"proto-type://{name}")

    def method(self, service: str, name: str, request: str, response: str, kind: str) -> None:
        id_ = f"proto-method://{service}/{name}"
        self.entity(id_, "proto_method", f"rpc_cardinality:{kind}")
        self.edge(f"proto-service://{service}", "defines", id_)
        self.edge(id_, "request_type", f"proto-type://{request}")
        self.edge(id_, "response_type", f"proto-type://{response}")


def descriptor_facts(data: bytes, path: str) -> list[dict]:
    """Facts of a FileDescriptorSet; each file is its own evidence."""
    from google.protobuf import descriptor_pb2

    out: list[dict] = []
    try:
        found = descriptor_pb2.FileDescriptorSet.FromString(data)
    except Exception as error:  # the message class depends on the protobuf build
        facts = _Facts(path)
        facts.diagnostic("protobuf.compile_failed", str(error))
        return facts.rows

    for file in found.file:
        facts = _Facts(file.name)
        prefix = f"{file.package}." if file.package else ""

        def walk(message, name, parent, facts=facts):
            facts.message(name, parent, [f.name for f in message.field])
            for inner in message.nested_type:
                if not inner.options.map_entry:
                    walk(inner, f"{name}.{inner.name}", name)
            for enum in message.enum_type:
                facts.enum(f"{name}.{enum.name}", name)

        for message in file.message_type:
            walk(message, prefix + message.name, None)
        for enum in file.enum_type:
            facts.enum(prefix + enum.name, None)
        for service in file.service:
            facts.entity(f"proto-service://{prefix}{service.name}", "proto_service")
            for m in service.method:
                facts.method(prefix + service.name, m.name, m.input_type.lstrip("."), m.output_type.lstrip("."), cardinality(m.client_streaming, m.server_streaming))
        out += facts.rows
    return out


_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[A-Za-z_][\w.]*|\.[A-Za-z_][\w.]*|[-+]?\d[\w.+-]*|[{}\[\]()<>;=,:/]', re.S)


def proto_facts(text: str, path: str) -> list[dict]:
    """Facts of one .proto source. Types are looked up in the file's own scopes, else in its package, else taken as written."""
    facts = _Facts(path)
    tokens = [t for t in _TOKEN.findall(text) if not t.startswith(("//", "/*"))]
    package = ""
    at = 0
    for i, t in enumerate(tokens[:-1]):
        if t == "package" and (i == 0 or tokens[i - 1] in ";}"):
            package = tokens[i + 1]
            break
    prefix = f"{package}." if package else ""
    types: set[str] = set()
    methods: list[tuple] = []

    def skip_block(i: int) -> int:
        depth = 0
        while i < len(tokens):
            depth += (tokens[i] == "{") - (tokens[i] == "}")
            i += 1
            if depth == 0:
                return i
        raise ValueError("block without end")

    def message(i: int, name: str, parent: str | None) -> int:
        types.add(name)
        fields: list[str] = []
        inner: list[tuple[str, int, str]] = []
        i += 1
        depth = 1
        while depth:
            t = tokens[i]
            if t in ("message", "enum") and i + 2 < len(tokens) and tokens[i + 2] == "{":
                inner.append((t, i + 2, f"{name}.{tokens[i + 1]}"))
                i = skip_block(i + 2)
            elif t in ("option", "reserved", "extensions") and tokens[i - 1] in "{};":
                while tokens[i] != ";":
                    i += 1
            elif t == "{":
                depth, i = depth + 1, i + 1
            elif t == "}":
                depth, i = depth - 1, i + 1
            elif t == "[":
                while tokens[i] != "]":
                    i += 1
                i += 1
            elif t == "=" and re.fullmatch(r"[A-Za-z_]\w*", tokens[i - 1]):
                fields.append(tokens[i - 1])
                i += 1
            else:
                i += 1
        facts.message(name, parent, fields)
        for kind, start, full in inner:
            if kind == "message":
                message(start, full, name)
            else:
                types.add(full)
                facts.enum(full, name)
        return i

    try:
        while at < len(tokens):
            t = tokens[at]
            if t == "message" and tokens[at + 2] == "{":
                at = message(at + 2, prefix + tokens[at + 1], None)
            elif t == "enum" and tokens[at + 2] == "{":
                types.add(prefix + tokens[at + 1])
                facts.enum(prefix + tokens[at + 1], None)
                at = skip_block(at + 2)
            elif t == "service" and tokens[at + 2] == "{":
                service, end = prefix + tokens[at + 1], skip_block(at + 2)
                facts.entity(f"proto-service://{service}", "proto_service")
                body = " ".join(tokens[at + 3 : end - 1])
                for m in re.finditer(r"\brpc (\w+) \( (stream )?(\.?[\w.]+) \) returns \( (stream )?(\.?[\w.]+) \)", body):
                    methods.append((service, m[1], m[3], m[5], cardinality(bool(m[2]), bool(m[4]))))
                at = end
            elif t == "{":
                at = skip_block(at)
            else:
                at += 1
    except (ValueError, IndexError) as error:
        broken = _Facts(path)
        broken.diagnostic("protobuf.compile_failed", f"unbalanced source: {error}")
        return broken.rows

    def full(name: str) -> str:
        if name.startswith("."):
            return name[1:]
        scope = package.split(".") if package else []
        for k in range(len(scope), -1, -1):
            if (tried := ".".join([*scope[:k], name])) in types:
                return tried
        return name if "." in name else prefix + name

    for service, name, request, response, kind in methods:
        facts.method(service, name, full(request), full(response), kind)
    return facts.rows


def _rows(parse):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield parse(content, path)

    return lambda batches: batches_of(run(batches), _ARROW)


def descriptor_sets(files: DataFrame) -> DataFrame:
    """Facts (``FACTS``) of rows path, content (bytes of descriptor sets)."""
    return dealt(files).select("path", "content").mapInArrow(_rows(descriptor_facts), FACTS)


def proto_sources(files: DataFrame) -> DataFrame:
    """Facts (``FACTS``) of the .proto files among rows path, content."""
    return dealt(files.where(F.col("path").endswith(".proto"))).select("path", "content").mapInArrow(_rows(lambda c, p: proto_facts(bytes(c).decode("utf-8", "replace"), p)), FACTS)


def entities(facts: DataFrame) -> DataFrame:
    return facts.where("sort = 'entity'").select("id", "kind", F.coalesce("metadata", F.lit("")).alias("metadata")).distinct()


def edges(facts: DataFrame) -> DataFrame:
    return facts.where("sort = 'edge'").select(*EDGE_COLUMNS).distinct()


def contract_methods(facts: DataFrame) -> DataFrame:
    """``service, method, cardinality`` for resolve.resolve_grpc."""
    found = facts.where("sort = 'entity' and kind = 'proto_method'")
    rest = F.regexp_replace("id", "^proto-method://", "")
    return found.select(F.substring_index(rest, "/", 1).alias("service"), F.substring_index(rest, "/", -1).alias("method"), F.regexp_replace("metadata", "^rpc_cardinality:", "").alias("cardinality")).distinct()
