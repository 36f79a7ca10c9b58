"""Recognizers of frameworks: RPC clients and servers, GraphQL resolvers, service registrations and lifecycle methods.

Each reads one file and yields rows for a resolver of ``operators/resolve.py``:

- ``grpc``: local symbol, role, service, method (resolve_grpc, once joined to the contracts' cardinalities)
- ``resolver``: field, parent, resolver (bind_graphql)
- ``generated_client``: as grpc, for those that are called (used_clients); ``message``: generated types and their contracts
- ``document`` and ``argument``: embedded operations by constant, and what callables pass on (embedded_calls)
- ``field_import``: objects whose fields another one imports (imported_parents)
- ``registration``: service, implementation (register_services)
- ``lifecycle`` and ``base``: methods by message, and types' bases (lifecycle_edges)
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphql, languages
from .languages import blank_cs, blank_elixir, blank_rust, blank_ts
from .mapping import batches_of, dealt

FACTS = "repository string, path string, sort string, local_symbol string, role string, service string, method string, field string, parent string, target string, evidence string, confidence double"
_NAMES = [x.split()[0] for x in FACTS.split(", ")]
_ARROW = pa.schema([(n, pa.float64() if n == "confidence" else pa.string()) for n in _NAMES])

# Messages that the engine sends to behaviours, all without parameters, and what their methods return.
LIFECYCLE = {
    "Awake": ("void",), "Start": ("void", "IEnumerator"), "FixedUpdate": ("void",), "Update": ("void",), "LateUpdate": ("void",), "OnEnable": ("void",), "OnDisable": ("void",),
    "OnDestroy": ("void",), "OnGUI": ("void",), "OnValidate": ("void",), "OnDrawGizmos": ("void",), "OnDrawGizmosSelected": ("void",),
}


def pascal(name: str) -> str:
    return "".join(x[:1].upper() + x[1:] for x in name.split("_"))


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _owner(rows: list[dict], line: int) -> str | None:
    """The callable defined last before a line."""
    kinds = {r["id"]: r["kind"] for r in rows if r["sort"] == "entity"}
    found = [(int(r["evidence"].rsplit(":", 1)[1]), r["to_id"]) for r in rows if r["sort"] == "edge" and r["relation"] == "defines" and re.search(r":\d+$", r["evidence"])]
    before = [x for x in found if x[0] <= line and kinds.get(x[1]) == "callable"]
    return max(before)[1] if before else None


def rust_tonic(text: str, repository: str, path: str) -> list[dict]:
    """Servers are ``impl x_server::X for T``; clients are bound by ``XClient::new`` or ``connect``. The file includes one package, or none is known."""
    packages = set(re.findall(r'include_proto!\s*\(\s*"([\w.]+)"\s*\)', text))
    clean = blank_rust(text)
    servers = list(re.finditer(r"\bimpl\b[^{};]*?\b(\w+)_server::(\w+)\s+for\s+(\w+)[^{};]*\{", clean))
    clients = list(re.finditer(r"\blet\s+(?:mut\s+)?(\w+)\s*(?::[^=;]+)?=\s*(?:\w+::)*(\w+)Client(?:::<[^>]*>)?::(?:new|connect|with_\w+)\s*\(", clean))
    if not servers and not clients:
        return []
    if len(packages) != 1:
        return [{"sort": "diagnostic", "service": "rust.tonic_package_unresolved", "evidence": path}]
    package, rows, out = packages.pop(), languages.rust_facts(text, repository, path), []
    blocks = languages._blocks(clean) or {}
    for m in servers:
        end = blocks.get(m.end() - 1, len(clean))
        for f in re.finditer(r"\bfn\s+(\w+)", clean[m.end() : end]):
            line = _line(text, m.end() + f.start())
            if symbol := _owner(rows, line):
                out.append({"sort": "grpc", "local_symbol": symbol, "role": "server", "service": f"{package}.{m[2]}", "method": pascal(f[1]), "evidence": f"{path}:{line}", "confidence": 1.0})
    for m in clients:
        for c in re.finditer(rf"\b{m[1]}\s*\.\s*(\w+)\s*\(", clean[m.end() :]):
            line = _line(text, m.end() + c.start())
            if symbol := _owner(rows, line):
                out.append({"sort": "grpc", "local_symbol": symbol, "role": "client", "service": f"{package}.{m[2]}", "method": pascal(c[1]), "evidence": f"{path}:{line}", "confidence": 0.6})
    return out


def elixir_grpc(text: str, repository: str, path: str) -> list[dict]:
    """Services name their contract; servers use a service module; stubs are called by module. Joined by ``elixir_services``."""
    clean, out = blank_elixir(text), []
    rows = languages.elixir_facts(text, repository, path)
    modules = [(m.start(), m[1]) for m in re.finditer(r"\bdefmodule\s+([\w.]+)", clean)]
    inside = lambda at: next((n for s, n in reversed(modules) if s <= at), None)
    for m in re.finditer(r'\buse\s+GRPC\.Service\s*,[^\n]*?name:\s*"([\w.]+)"', text):
        out.append({"sort": "service_module", "local_symbol": inside(m.start()), "service": m[1], "evidence": f"{path}:{_line(text, m.start())}"})
    for m in re.finditer(r"\buse\s+GRPC\.Server\s*,[^\n]*?service:\s*([\w.]+)", clean):
        module = inside(m.start())
        for r in rows:
            if r["sort"] == "edge" and r["relation"] == "defines" and r["to_id"].startswith(f"repo://{repository}/elixir/{module}/") and r["to_id"].endswith("/2"):
                out.append({"sort": "server_function", "local_symbol": r["to_id"], "target": m[1], "method": pascal(r["to_id"].split("/")[-2]), "evidence": r["evidence"], "confidence": 1.0})
    for m in re.finditer(r"\b([A-Z][\w.]*)\.Stub\.(\w+)\s*\(", clean):
        if symbol := _owner(rows, _line(text, m.start())):
            out.append({"sort": "stub_call", "local_symbol": symbol, "target": m[1], "method": pascal(m[2]), "evidence": f"{path}:{_line(text, m.start())}", "confidence": 0.6})
    return out


def elixir_absinthe(text: str, repository: str, path: str) -> list[dict]:
    """Fields resolved by a captured function: ``resolve &Mod.fun/3`` inside ``object :name`` or a root; and the objects whose fields another one imports."""
    clean, out = blank_elixir(text), []
    objects = [(m.start(), m[1] or m[2]) for m in re.finditer(r"\bobject\s+:(\w+)|^\s*(query|mutation|subscription)\s+do\b", clean, re.M)]
    fields = [(m.start(), m[1]) for m in re.finditer(r"\bfield\s*\(?\s*:(\w+)", clean)]
    for m in re.finditer(r"\bresolve\s*\(?\s*&([\w.]+)\.(\w+[?!]?)/(\d)", clean):
        field = next((n for s, n in reversed(fields) if s <= m.start()), None)
        owner = next((n for s, n in reversed(objects) if s <= m.start()), None)
        parent = owner and pascal(owner)
        if field:
            head, *rest = field.split("_")
            out.append({"sort": "resolver", "local_symbol": owner, "field": head + "".join(x.title() for x in rest), "parent": parent, "target": f"repo://{repository}/elixir/{m[1]}/{m[2]}/{m[3]}", "evidence": f"{path}:{_line(text, m.start())}"})
    for m in re.finditer(r"\bimport_fields\s*\(?\s*:(\w+)", clean):
        owner = next((n for s, n in reversed(objects) if s <= m.start()), None)
        if owner:
            out.append({"sort": "field_import", "parent": pascal(owner), "target": m[1], "evidence": f"{path}:{_line(text, m.start())}"})
    return out


def nestjs(text: str, repository: str, path: str) -> list[dict]:
    """gRPC methods and GraphQL resolvers by decorator, and clients by ``getService``."""
    clean, out = blank_ts(text), []
    rows = languages.typescript_facts(text, repository, path)

    def decorated(at: int) -> tuple[str | None, str]:
        m = re.compile(r"(?:async\s+|public\s+|private\s+)*([A-Za-z_$][\w$]*)\s*\(").search(clean, _after(clean, at))
        if not m:
            return None, ""
        line = _line(text, m.start(1))
        return next((r["to_id"] for r in rows if r["sort"] == "edge" and r["relation"] == "defines" and r["evidence"] == f"{path}:{line}" and r["to_id"].endswith("/" + m[1])), None), m[1]

    for m in re.finditer(r"@Grpc(Stream)?Method\s*\(\s*(?:['\"]([\w.]+)['\"])?\s*(?:,\s*['\"](\w+)['\"])?\s*\)", text):
        line = f"{path}:{_line(text, m.start())}"
        if m[1]:
            out.append({"sort": "diagnostic", "service": "typescript.nestjs_grpc_streaming_unsupported", "evidence": line})
            continue
        symbol, name = decorated(m.start())
        if m[2] is None or symbol is None:
            out.append({"sort": "diagnostic", "service": "typescript.nestjs_grpc_literal_unresolved", "evidence": line})
        else:
            out.append({"sort": "grpc", "local_symbol": symbol, "role": "server", "service": m[2], "method": m[3] or name[:1].upper() + name[1:], "evidence": line, "confidence": 1.0})
    for m in re.finditer(r"(?:this\.)?(\w+)\s*=\s*[\w.]+\.getService\s*(?:<[\w.]+>)?\s*\(\s*['\"]([\w.]+)['\"]", text):
        for c in re.finditer(rf"\b{m[1]}\s*\.\s*(\w+)\s*\(", clean):
            if symbol := _owner(rows, _line(text, c.start())):
                out.append({"sort": "grpc", "local_symbol": symbol, "role": "client", "service": m[2], "method": c[1][:1].upper() + c[1][1:], "evidence": f"{path}:{_line(text, c.start())}", "confidence": 0.6})
    parents = [(m.start(), m[1]) for m in re.finditer(r"@Resolver\s*\(\s*(?:\(\s*\w*\s*\)\s*=>\s*)?(\w+)?", clean)]
    for m in re.finditer(r"@(Query|Mutation|Subscription|ResolveField)\s*\(", clean):
        symbol, name = decorated(m.start())
        named = re.search(r"name:\s*['\"](\w+)['\"]|\(\s*['\"](\w+)['\"]", text[m.start() : _after(clean, m.start())])
        parent = m[1] if m[1] != "ResolveField" else next((n for s, n in reversed(parents) if s <= m.start()), None)
        if symbol:
            out.append({"sort": "resolver", "field": (named and (named[1] or named[2])) or name, "parent": parent, "target": symbol, "evidence": f"{path}:{_line(text, m.start())}"})
    return out


def ts_proto(text: str, repository: str, path: str) -> list[dict]:
    """Generated RPC clients: methods of ``XClientImpl`` by the request they send, those of ``XClient`` by the file's package; and message types, which are both interface and constant."""
    if "protobufPackage" not in text and "ServiceName" not in text:
        return []
    clean, rows, out = blank_ts(text), languages.typescript_facts(text, repository, path), []
    constants = {m[1]: m[3] for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=;]+)?=\s*(['\"])([^'\"]+)\2", text)}
    kinds = {r["id"]: r["kind"] for r in rows if r["sort"] == "entity"}
    for m in re.finditer(r"\bthis\.rpc\.request\s*\(\s*[^,()]+,\s*['\"](\w+)['\"]", text):
        line = _line(text, m.start())
        symbol = _owner(rows, line)
        found = symbol and re.search(r"/(\w+)ClientImpl/\w+$", symbol)
        if found and (service := constants.get(f"{found[1]}ServiceName")):
            out.append({"sort": "generated_client", "local_symbol": symbol, "service": service, "method": m[1], "evidence": f"{path}:{line}", "confidence": 1.0})
    package = constants.get("protobufPackage")
    if package is None:
        return out
    for r in rows:
        if r["sort"] == "edge" and r["relation"] == "defines" and kinds.get(r["to_id"]) == "callable" and (m := re.search(r"/(\w+)Client/(\w+)$", r["to_id"])):
            out.append({"sort": "generated_client", "local_symbol": r["to_id"], "service": f"{package}.{m[1]}", "method": m[2][:1].upper() + m[2][1:], "evidence": r["evidence"], "confidence": 1.0})
    if languages.generated_typescript(text, path):
        both = set(re.findall(r"^\s*export\s+interface\s+([A-Za-z]\w*)", clean, re.M)) & set(re.findall(r"^\s*export\s+const\s+([A-Za-z]\w*)", clean, re.M))
        for name in sorted(x for x in both if "_" not in x):
            out.append({"sort": "message", "local_symbol": f"repo://{repository}/typescript/{path}/{name}", "target": f"proto-type://{package}.{name}", "evidence": path, "confidence": 1.0})
    return out


def ts_graphql(text: str, repository: str, path: str) -> list[dict]:
    """Embedded documents: constants bound to tagged templates, with each operation in them, and the names that callables pass as arguments."""
    clean, out = blank_ts(text), []
    module = f"repo://{repository}/{'javascript' if path.endswith(('.js', '.jsx')) else 'typescript'}/{path}"
    here = set()
    for m in re.finditer(r"\bconst\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:gql|graphql)\s*\(?\s*(?:/\*\s*GraphQL\s*\*/\s*)?`([^`]*)`", text):
        if clean[m.start()] != "c":
            continue  # in a comment or string
        here.add(m[1])
        for r in graphql.document_facts(re.sub(r"\$\{[^}]*\}", "", m[2]), repository, path):
            if r["sort"] == "entity" and r["kind"] == "graphql_operation":
                out.append({"sort": "document", "local_symbol": f"{module}/{m[1]}", "target": r["id"], "method": r["metadata"], "evidence": f"{path}:{_line(text, m.start())}"})
    names = here | {local for local, _, imported in languages.typescript_imports(text, clean) if imported != "*"}
    if not names:
        return out
    rows = languages.typescript_facts(text, repository, path)
    for m in re.finditer(r"[(,]\s*([A-Za-z_$][\w$]*)\s*(?=[,)])", clean):
        if m[1] in names and (symbol := _owner(rows, line := _line(text, m.start(1)))):
            out.append({"sort": "argument", "local_symbol": symbol, "field": m[1], "target": module, "evidence": f"{path}:{line}"})
    return out


def _after(clean: str, at: int) -> int:
    """The end of a decorator's brackets."""
    depth = 0
    for i in range(clean.find("(", at), len(clean)):
        depth += (clean[i] == "(") - (clean[i] == ")")
        if depth == 0:
            return i + 1
    return len(clean)


def dotnet_di(text: str, repository: str, path: str) -> list[dict]:
    """``AddScoped<IService, Service>()`` and its like."""
    clean = blank_cs(text)
    return [
        {"sort": "registration", "service": m[1].split(".")[-1], "target": m[2].split(".")[-1], "evidence": f"{path}:{_line(text, m.start())}"}
        for m in re.finditer(r"\.(?:Try)?Add(?:Keyed)?(?:Scoped|Singleton|Transient)\s*<\s*([\w.]+)\s*,\s*([\w.]+)\s*>", clean)
    ]


def unity_lifecycle(text: str, repository: str, path: str) -> list[dict]:
    """Methods that an engine's message may mean, by name, return type and no parameters; and bases, for resolve.lifecycle_edges."""
    rows, lines, out = languages.csharp_facts(text, repository, path), blank_cs(text).split("\n"), []
    simple = lambda id_: id_.rsplit("/", 1)[1].rsplit(".", 1)[-1]
    for r in rows:
        if r["sort"] == "base":
            out.append({"sort": "base", "parent": simple(r["id"]), "target": r["to_id"], "evidence": r["evidence"]})
        elif r["sort"] == "edge" and r["relation"] == "defines" and r["to_id"].endswith("()"):
            name = r["to_id"].rsplit("/", 1)[1][:-2]
            line = lines[int(r["evidence"].rsplit(":", 1)[1]) - 1]
            if re.search(rf"\b(?:{'|'.join(LIFECYCLE.get(name, ('$.',)))})\s+{name}\s*\(", line):
                out.append({"sort": "lifecycle", "parent": simple(r["from_id"]), "method": name, "target": r["to_id"], "evidence": r["evidence"], "confidence": 1.0})
    return out


RECOGNIZERS: dict[str, tuple[str, Callable[[str, str, str], list[dict]]]] = {
    "rust.tonic": (r"\.rs$", rust_tonic), "elixir.grpc": (r"\.exs?$", elixir_grpc), "elixir.absinthe": (r"\.exs?$", elixir_absinthe),
    "typescript.nestjs": (r"\.tsx?$", nestjs), "typescript.ts-proto": (r"\.tsx?$", ts_proto), "typescript.graphql": (r"\.(ts|tsx|js|jsx)$", ts_graphql), "csharp.dotnet-di": (r"\.cs$", dotnet_di), "csharp.unity": (r"\.cs$", unity_lifecycle),
}


def recognize(files: DataFrame, names: tuple[str, ...] = tuple(RECOGNIZERS), own: dict | None = None) -> DataFrame:
    """Rows (``FACTS``) of the chosen recognizers over rows repository, path, content: one map over the files."""
    every = {x: RECOGNIZERS[x] for x in names} | (own or {})
    chosen = [(re.compile(every[x][0]), every[x][1]) for x in sorted(every)]

    def run(batches):
        for batch in batches:
            for repository, path, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text = bytes(content or b"").decode("utf-8", "replace")
                rows = [{"repository": repository, "path": path} | r for pattern, find in chosen if pattern.search(path) for r in find(text, repository, path)]
                yield rows

    wanted = "|".join(f"(?:{x[0]})" for x in every.values())
    return dealt(files.where(F.col("path").rlike(wanted)).select("repository", "path", "content")).mapInArrow(lambda batches: batches_of(run(batches), _ARROW), FACTS)


def imported_parents(facts: DataFrame) -> DataFrame:
    """``facts``' resolvers, with each object that imports their own one's fields as parent, else their own. One row for each parent."""
    imports = facts.where("sort = 'field_import'").selectExpr("repository", "target as local_symbol", "parent as _parent").distinct()
    resolvers = facts.where("sort = 'resolver'").select("repository", "local_symbol", "field", "parent", F.col("target").alias("resolver"), "evidence")
    return resolvers.join(imports, ["repository", "local_symbol"], "left").select("repository", "field", F.coalesce("_parent", "parent").alias("parent"), "resolver", "evidence")


def used_clients(generated: DataFrame, edges: DataFrame) -> DataFrame:
    """Of generated clients' methods (local_symbol and more) those that something else calls."""
    calls = edges.where("relation = 'calls' and from_id <> to_id").select(F.col("to_id").alias("local_symbol")).distinct()
    return generated.join(calls, "local_symbol", "left_semi")


def message_edges(facts: DataFrame) -> DataFrame:
    """``binds_contract`` edges from generated message types to their contracts."""
    return facts.where("sort = 'message'").select(F.col("local_symbol").alias("from_id"), F.lit("binds_contract").alias("relation"), F.col("target").alias("to_id"), "evidence", "confidence", F.lit("generated").alias("provenance")).distinct()


def embedded_calls(facts: DataFrame, bound: DataFrame) -> DataFrame:
    """``calls_graphql`` edges from callables to the operations of the documents they pass on: the file's own, else an imported one.

    ``bound``: file, local, imported, target_file of all imports.
    """
    documents = facts.where("sort = 'document'").select(F.col("local_symbol").alias("document"), F.col("target").alias("to_id")).distinct()
    passed = facts.where("sort = 'argument'").select("local_symbol", F.col("field").alias("local"), F.col("target").alias("file"), "evidence")
    named = passed.join(bound.where("imported <> '*'").select("file", "local", F.concat("target_file", F.lit("/"), "imported").alias("other")), ["file", "local"], "left")
    named = named.withColumn("own", F.concat("file", F.lit("/"), "local")).join(documents.select(F.col("document").alias("own"), F.lit(True).alias("here")).distinct(), "own", "left")
    met = named.withColumn("document", F.when(F.col("here"), F.col("own")).otherwise(F.col("other"))).join(documents, "document")
    return met.select(F.col("local_symbol").alias("from_id"), F.lit("calls_graphql").alias("relation"), "to_id", "evidence", F.lit(1.0).alias("confidence"), F.lit("ast").alias("provenance")).distinct()


def grpc_candidates(facts: DataFrame, methods: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``schema.GRPC_CANDIDATE`` rows: direct ones, generated clients that ``edges`` call, and Elixir's by service module; a short service name is the only contract's that ends with it."""
    direct = facts.where("sort = 'grpc'").select("local_symbol", "role", "service", "method", "evidence", "confidence", F.lit("ast").alias("provenance"))
    if edges is not None:
        made = used_clients(facts.where("sort = 'generated_client'"), edges)
        direct = direct.union(made.select("local_symbol", F.lit("client"), "service", "method", "evidence", "confidence", F.lit("generated")).distinct())
    modules = facts.where("sort = 'service_module'").selectExpr("local_symbol as module", "service as full").distinct()
    used = facts.where("sort in ('server_function', 'stub_call')").withColumn("module", F.when(F.col("sort") == "stub_call", F.concat("target", F.lit(".Service"))).otherwise(F.col("target")))
    elixir = used.join(modules, "module").select("local_symbol", F.when(F.col("sort") == "stub_call", "client").otherwise("server").alias("role"), F.col("full").alias("service"), "method", "evidence", "confidence", F.lit("ast").alias("provenance"))
    known = methods.select("service").distinct()
    short = known.groupBy(F.substring_index("service", ".", -1).alias("short")).agg(F.min("service").alias("only"), F.count("*").alias("n")).where("n = 1")
    both = direct.union(elixir)
    named = both.join(known.withColumn("exact", F.lit(True)), "service", "left").join(short, F.col("service") == F.col("short"), "left").withColumn("service", F.when(F.col("exact"), F.col("service")).otherwise(F.coalesce("only", "service")))
    cardinality = methods.groupBy("service", "method").agg(F.min("cardinality").alias("cardinality"))
    return named.join(cardinality, ["service", "method"], "left").select("local_symbol", "role", "service", "method", F.coalesce("cardinality", F.lit("unary")).alias("cardinality"), "evidence", "confidence", "provenance")
