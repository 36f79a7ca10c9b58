"""GraphQL: schema documents and operations as entities and edges."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_COLUMNS
from .mapping import batches_of, dealt

FACTS = "repository string, path string, sort string, id string, kind string, metadata string, from_id string, relation string, to_id string, evidence string, confidence double, provenance string"
_ARROW = pa.schema([(n, pa.float64() if n == "confidence" else pa.string()) for n in (x.split()[0] for x in FACTS.split(", "))])
_TOKEN = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|#[^\n]*|\.\.\.|[A-Za-z_]\w*|-?\d[\w.+-]*|[{}()\[\]!:=|&@$]|\n', re.S)
BUILT_IN = ("Boolean", "Float", "ID", "Int", "String")
ROOTS = ("query", "mutation", "subscription")


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, int]] = []
        line = 1
        for m in _TOKEN.finditer(text):
            t = m[0]
            if t == "\n":
                line += 1
            elif not t.startswith(('"', "#")):
                self.tokens.append((t, line))
            else:
                if t[0] == '"' and not t.startswith('"""'):
                    self.tokens.append((t, line))
                line += t.count("\n")
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][0] if self.at + k < len(self.tokens) else ""

    def line(self) -> int:
        return self.tokens[min(self.at, len(self.tokens) - 1)][1] if self.tokens else 1

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or wanted is not None and t != wanted:
            raise ValueError(f"expected {wanted or 'more'} at line {self.line()}")
        self.at += 1
        return t

    def skip(self, opening: str, closing: str) -> None:
        depth = 0
        while True:
            t = self.take()
            depth += (t == opening) - (t == closing)
            if depth == 0:
                return

    def strings(self) -> None:
        while self.peek().startswith('"'):
            self.take()

    def directives(self) -> dict[str, dict[str, str]]:
        found = {}
        while self.peek() == "@":
            self.take()
            name = self.take()
            found[name] = {}
            if self.peek() == "(":
                begin = self.at
                self.skip("(", ")")
                part = [t for t, _ in self.tokens[begin : self.at]]
                for i in range(1, len(part) - 2):
                    if part[i + 1] == ":":
                        found[name][part[i]] = part[i + 2].strip('"')
        return found

    def type_name(self) -> str:
        while self.peek() == "[":
            self.take()
        name = self.take()
        while self.peek() in ("]", "!"):
            self.take()
        return name

    def default(self) -> None:
        if self.peek() == "=":
            self.take()
            if self.peek() in ("[", "{"):
                self.skip(self.peek(), "]" if self.peek() == "[" else "}")
            elif self.peek() == "$":
                self.take()
                self.take()
            else:
                self.take()


class _Schema:
    """Facts of one document. ``types``: field -> type name, for operations."""

    def __init__(self, repository: str, path: str) -> None:
        self.repository, self.path, self.rows = repository, path, []
        self.roots = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}

    def entity(self, id_: str, kind: str, metadata: str = "") -> None:
        self.rows.append({"sort": "entity", "id": id_, "kind": kind, "metadata": metadata})

    def edge(self, from_id: str, relation: str, to_id: str, line: int) -> None:
        self.rows.append({"sort": "edge", "from_id": from_id, "relation": relation, "to_id": to_id, "evidence": f"{self.path}:{line}", "confidence": 1.0, "provenance": "ast"})

    def shown(self, name: str) -> str:
        """A root type by its standard name."""
        return next((k.capitalize() for k, v in self.roots.items() if v == name), name)

    def uses(self, from_id: str, relation: str, type_name: str, line: int) -> None:
        to = f"graphql-type://{self.shown(type_name)}"
        if type_name in BUILT_IN:
            self.entity(to, "graphql_type", "graphql_type:scalar")
        self.edge(from_id, relation, to, line)
        self.edge(from_id, "uses", to, line)

    def arguments(self, r: _Reader, owner: str, of: str) -> None:
        r.take("(")
        while r.peek() != ")":
            r.strings()
            line, name = r.line(), r.take()
            r.take(":")
            type_name = r.type_name()
            r.default()
            r.directives()
            id_ = f"graphql-argument://{owner}/{name}"
            self.entity(id_, "graphql_argument")
            self.edge(id_, "field_of", of, line)
            self.uses(id_, "request_type", type_name, line)
        r.take(")")

    def fields(self, r: _Reader, name: str, is_input: bool) -> None:
        owner = self.shown(name)
        r.take("{")
        while r.peek() != "}":
            r.strings()
            line, field = r.line(), r.take()
            id_ = f"graphql-field://{owner}/{field}"
            self.entity(id_, "graphql_field")
            self.edge(id_, "field_of", f"graphql-type://{owner}", line)
            if r.peek() == "(":
                self.arguments(r, f"{owner}/{field}", id_)
            r.take(":")
            type_name = r.type_name()
            self.uses(id_, "request_type" if is_input else "response_type", type_name, line)
            self.rows.append({"sort": "field_type", "id": id_, "kind": field, "from_id": owner, "to_id": self.shown(type_name)})
            r.default()
            source = r.directives().get("source")
            if source and source.get("name") and source.get("subgraph"):
                self.rows.append({"sort": "stitch", "from_id": id_, "to_id": f"graphql-field://{owner}/{source['name']}", "metadata": source["subgraph"], "evidence": f"{self.path}:{line}"})
        r.take("}")

    def read(self, text: str) -> list[dict]:
        named = re.search(r"\bschema\b[^{]*\{([^}]*)\}", re.sub(r"#[^\n]*", "", text))
        if named:
            self.roots |= {k: v for k, v in re.findall(r"\b(query|mutation|subscription)\s*:\s*(\w+)", named[1])}
        r = _Reader(text)
        try:
            while r.peek():
                self.definition(r)
        except ValueError:
            self.rows = [{"sort": "diagnostic", "id": "graphql.parse_recovery", "evidence": self.path}]
        return [{"repository": self.repository, "path": self.path} | x for x in self.rows]

    def definition(self, r: _Reader) -> None:
        r.strings()
        if not r.peek():
            return
        if r.peek() == "extend":
            r.take()
        word = r.peek()
        if word in (*ROOTS, "{"):
            return self.operation(r)
        if word == "fragment":
            r.take()
            name = r.take()
            r.take("on")
            on = r.take()
            r.directives()
            begin = r.at
            r.skip("{", "}")
            self.rows.append({"sort": "fragment", "id": name, "kind": on, "metadata": " ".join(t for t, _ in r.tokens[begin : r.at])})
            return None
        if word == "schema":
            r.take()
            r.directives()
            return r.skip("{", "}")
        if word == "directive":
            while r.peek() and r.peek() != "on":
                r.take()
            r.take("on")
            if r.peek() == "|":
                r.take()
            r.take()
            while r.peek() == "|":
                r.take()
                r.take()
            return None
        kinds = {"type": "object", "input": "input", "interface": "interface", "union": "union", "enum": "enum", "scalar": "scalar"}
        if word not in kinds:
            raise ValueError(f"unknown definition {word}")
        r.take()
        line, name = r.line(), r.take()
        id_ = f"graphql-type://{self.shown(name)}"
        self.entity(id_, "graphql_type", f"graphql_type:{kinds[word]}")
        if r.peek() == "implements":
            r.take()
            while r.peek() not in ("{", "@", "") and (r.peek() == "&" or re.fullmatch(r"\w+", r.peek())):
                other = r.take()
                if other != "&":
                    self.edge(id_, "implements", f"graphql-type://{other}", line)
        r.directives()
        if word == "union" and r.peek() == "=":
            r.take()
            if r.peek() == "|":
                r.take()
            while True:
                self.edge(id_, "uses", f"graphql-type://{r.take()}", line)
                if r.peek() != "|":
                    break
                r.take()
        elif word == "enum" and r.peek() == "{":
            r.take()
            while r.peek() != "}":
                r.strings()
                at, value = r.line(), r.take()
                r.directives()
                self.entity(f"graphql-enum-value://{self.shown(name)}/{value}", "graphql_enum_value")
                self.edge(f"graphql-enum-value://{self.shown(name)}/{value}", "field_of", id_, at)
            r.take("}")
        elif r.peek() == "{":
            self.fields(r, name, word == "input")
        return None

    def operation(self, r: _Reader) -> None:
        line = r.line()
        kind = r.take() if r.peek() != "{" else "query"
        name = r.take() if re.fullmatch(r"[A-Za-z_]\w*", r.peek() or "") else f"anonymous@{self.path}"
        id_ = f"graphql-operation://{name}"
        self.entity(id_, "graphql_operation", f"graphql_operation:{kind}")
        if r.peek() == "(":
            r.take()
            while r.peek() != ")":
                r.take("$")
                at, variable = r.line(), r.take()
                r.take(":")
                type_name = r.type_name()
                r.default()
                r.directives()
                argument = f"graphql-argument://operation/{name}/{variable}"
                self.entity(argument, "graphql_argument")
                self.edge(argument, "field_of", id_, at)
                self.uses(argument, "request_type", type_name, at)
            r.take(")")
        r.directives()
        self.selection(r, id_, kind.capitalize(), line)

    def selection(self, r: _Reader, parent: str, on: str, line: int) -> None:
        """Selections are facts (sort 'select') with the path of field names below a root type; types are joined later."""

        def walk(prefix: str) -> None:
            r.take("{")
            while r.peek() != "}":
                at = r.line()
                if r.peek() == "...":
                    r.take()
                    if r.peek() == "on" or r.peek() in ("{", "@"):
                        target = ""
                        if r.peek() == "on":
                            r.take()
                            target = r.take()
                        r.directives()
                        walk(f"{prefix}/<{target}>" if target else prefix)
                    else:
                        spread = r.take()
                        r.directives()
                        self.rows.append({"sort": "spread", "id": spread, "from_id": parent, "to_id": prefix, "evidence": f"{self.path}:{at}"})
                    continue
                name = r.take()
                if r.peek() == ":":
                    r.take()
                    name = r.take()
                if r.peek() == "(":
                    r.skip("(", ")")
                r.directives()
                self.rows.append({"sort": "select", "id": name, "from_id": parent, "to_id": prefix, "evidence": f"{self.path}:{at}"})
                if r.peek() == "{":
                    walk(f"{prefix}/{name}")
            r.take("}")

        walk(on)


def document_facts(text: str, repository: str, path: str) -> list[dict]:
    return _Schema(repository, path).read(text)


def _found(batches):
    for batch in batches:
        for repository, path, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
            yield document_facts(bytes(content or b"").decode("utf-8", "replace"), repository, path)


def _run(batches):
    return batches_of(_found(batches), _ARROW)


def analyze(files: DataFrame) -> DataFrame:
    """Facts (``FACTS``) of the GraphQL files among rows repository, path, content."""
    return dealt(files.where(F.col("path").rlike(r"\.(graphql|gql)$")).select("repository", "path", "content")).mapInArrow(_run, FACTS)


def expand_fragments(facts: DataFrame) -> DataFrame:
    """``facts``' selections with those that fragment spreads bring in; each fragment counts once an operation."""
    from ..plans.fixpoint import fixpoint

    # A fragment's name holds within its repository.
    spreads = facts.where("sort = 'spread'").select("repository", "from_id", F.col("id").alias("fragment"), F.col("to_id").alias("prefix"), "evidence")
    bodies = facts.where("sort = 'fragment'").groupBy("repository", F.col("id").alias("fragment")).agg(F.min(F.struct(F.col("kind").alias("on_type"), "metadata")).alias("body")).select("repository", "fragment", "body.*")
    inner = bodies.select("repository", "fragment", F.explode(F.regexp_extract_all("metadata", F.lit(r"\.\.\. (\w+)"), 1)).alias("inner")).where("inner <> 'on'")
    reached = fixpoint(
        spreads.select("repository", "from_id", "fragment", "evidence"),
        lambda new: new.join(inner, ["repository", "fragment"]).select("repository", "from_id", F.col("inner").alias("fragment"), "evidence"), ["repository", "from_id", "fragment"], "fragments",
    )
    names = bodies.select("repository", "fragment", F.col("on_type"), F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.regexp_replace("metadata", r"\([^()]*\)", ""), r"\.\.\. (on )?\w+|\w+ :|@ \w+", ""), F.lit(r"(?<!\w)(\w+)"), 1))).alias("id"))
    extra = reached.join(names, ["repository", "fragment"]).select(F.col("id"), "from_id", F.concat(F.lit("<"), "on_type", F.lit(">")).alias("to_id"), "evidence")
    return facts.where("sort = 'select'").select("id", "from_id", "to_id", "evidence").unionByName(extra).distinct()


def selection_edges(facts: DataFrame) -> DataFrame:
    """``selects`` edges from operations to fields, and from fields to nested ones, by each path's types."""
    from ..plans.fixpoint import fixpoint
    from ..plans.shared import materialize

    # Each round reads all of these again: files shall be parsed once, and rows made distinct once.
    facts = materialize(facts.where("sort in ('field_type', 'select', 'spread', 'fragment')").select("repository", "sort", "id", "kind", "metadata", "from_id", "to_id", "evidence"), "selections")
    types = facts.where("sort = 'field_type'").select(F.col("from_id").alias("owner"), F.col("kind").alias("field"), F.col("to_id").alias("type")).distinct()
    types = materialize(types, "field-types")
    selections = materialize(expand_fragments(facts).select(F.col("from_id").alias("operation"), F.col("to_id").alias("path"), F.col("id").alias("field"), "evidence"), "distinct-selections")
    # A path's type follows from its parent path's, one field at a time.
    roots = selections.where(~F.col("path").contains("/")).select("operation", "path", F.regexp_replace("path", "[<>]", "").alias("type")).distinct()
    child = materialize(selections.select(F.col("operation").alias("op"), F.col("path").alias("parent"), F.col("field").alias("step")).distinct(), "steps")
    inline = materialize(_inline(selections), "inline-fragments")

    # Names that are alike take far less room in files than in memory, so no join here may go by file sizes and broadcast.
    t = types.selectExpr("owner", "field as step", "type as next").hint("merge")
    typed = fixpoint(
        roots,
        lambda new: new.join(child.hint("merge"), (new.operation == child.op) & (new.path == child.parent)).join(t, (F.col("type") == t.owner) & (child.step == t.step)).select("operation", F.concat("path", F.lit("/"), child.step).alias("path"), F.col("next").alias("type"))
        .union(new.join(inline.hint("merge"), (new.operation == inline.op2) & (new.path == inline.outer)).select("operation", F.col("path2").alias("path"), F.col("type2").alias("type"))),
        ["operation", "path"], "selection types", hint="merge",
    )
    found = selections.join(typed.hint("merge"), ["operation", "path"]).select("operation", "path", "field", "evidence", F.concat(F.lit("graphql-field://"), "type", F.lit("/"), "field").alias("to_id"))
    known = types.select(F.concat(F.lit("graphql-field://"), "owner", F.lit("/"), "field").alias("to_id")).distinct()
    found = found.join(known.hint("merge"), "to_id", "left_semi")
    parent = found.select("operation", F.concat("path", F.lit("/"), "field").alias("path"), F.col("to_id").alias("parent_id")).distinct()
    out = found.join(parent.hint("merge"), ["operation", "path"], "left").select(F.coalesce("parent_id", "operation").alias("from_id"), F.lit("selects").alias("relation"), "to_id", "evidence", F.lit(1.0).alias("confidence"), F.lit("ast").alias("provenance"))
    return out.distinct().select(*EDGE_COLUMNS)


def _inline(selections: DataFrame) -> DataFrame:
    """Inline fragments name their type in the path: ``op2, outer, path2, type2``."""
    inner = selections.select("operation", "path").where(F.col("path").rlike(r"/<\w+>$")).distinct()
    return inner.select(F.col("operation").alias("op2"), F.regexp_replace("path", r"/<\w+>$", "").alias("outer"), F.col("path").alias("path2"), F.regexp_extract("path", r"<(\w+)>$", 1).alias("type2"))


def edges(facts: DataFrame) -> DataFrame:
    return facts.where("sort = 'edge'").select(*EDGE_COLUMNS).distinct()


def entities(facts: DataFrame) -> DataFrame:
    return facts.where("sort = 'entity'").select("id", "kind", "metadata").distinct()


def stitches(facts: DataFrame) -> DataFrame:
    """``gateway_id, upstream_id, evidence`` for resolve.stitched_fields."""
    return facts.where("sort = 'stitch'").select(F.col("from_id").alias("gateway_id"), F.col("to_id").alias("upstream_id"), "evidence")
