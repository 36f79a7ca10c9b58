"""Source frontends: definitions and calls of Rust, Elixir, TypeScript/JavaScript and C# files.

Each frontend blanks comments and strings, walks blocks once, and yields entities, edges
and diagnostics (the columns of ``FACTS``). They read a subset: what they can't balance is
reported as ``<language>.parse_recovery``, and the file yields no facts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_COLUMNS
from .mapping import batches_of, dealt

FACTS = "repository string, path string, sort string, id string, kind string, from_id string, relation string, to_id string, evidence string, confidence double, provenance string"
_ARROW = pa.schema([(n, pa.float64() if n == "confidence" else pa.string()) for n in (x.split()[0] for x in FACTS.split(", "))])


class Facts:
    def __init__(self, repository: str, path: str) -> None:
        self.repository, self.path, self.rows = repository, path, []

    def entity(self, id_: str, kind: str) -> None:
        self.rows.append({"sort": "entity", "id": id_, "kind": kind})

    def edge(self, from_id: str, relation: str, to_id: str, line: int | None, provenance: str = "ast", confidence: float = 1.0) -> None:
        evidence = self.path if line is None else f"{self.path}:{line}"
        self.rows.append({"sort": "edge", "from_id": from_id, "relation": relation, "to_id": to_id, "evidence": evidence, "confidence": confidence, "provenance": provenance})

    def diagnostic(self, code: str, line: int | None = None) -> None:
        self.rows.append({"sort": "diagnostic", "id": code, "evidence": self.path if line is None else f"{self.path}:{line}"})

    def failed(self, code: str) -> list[dict]:
        self.rows = []
        self.diagnostic(code)
        return self.finish()

    def finish(self) -> list[dict]:
        return [{"repository": self.repository, "path": self.path} | r for r in self.rows]


def _blank(pattern: re.Pattern) -> Callable[[str], str]:
    return lambda text: pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_C_COMMENTS = r"//[^\n]*|/\*.*?\*/"
blank_rust = _blank(re.compile(_C_COMMENTS + r'|r(#*)".*?"\1|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\n]{1,8})\'', re.S))
blank_ts = _blank(re.compile(_C_COMMENTS + r'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`', re.S))
blank_cs = _blank(re.compile(_C_COMMENTS + r'|\$?@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'|^[ \t]*#[^\n]*', re.S | re.M))
blank_elixir = _blank(re.compile(r'#[^\n]*|"""(?:.*?)"""|"(?:[^"\\]|\\.)*"|\'\'\'(?:.*?)\'\'\'|~[a-zA-Z]\((?:[^)\\]|\\.)*\)', re.S))


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _blocks(text: str) -> dict[int, int] | None:
    """The closing brace of each opening one; None where they don't balance."""
    stack, pairs = [], {}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif not stack:
            return None
        else:
            pairs[stack.pop()] = m.start()
    return None if stack else pairs


def _recovered(text: str) -> tuple[str, dict[int, int] | None, list[int]]:
    """(text, pairs of braces, places of errors): top-level units that a stray closing brace ends are blanked.

    A brace that is never closed is missing syntax, whose place nothing tells: pairs then are None.
    """
    depth, start, errors, out = 0, 0, [], list(text)
    for m in re.finditer(r"[{};]", text):
        if m[0] == "{":
            depth += 1
        elif m[0] == ";":
            start = m.end() if depth == 0 else start
        elif depth:
            depth -= 1
            start = m.end() if depth == 0 else start
        else:
            errors.append(m.start())
            out[start : m.end()] = re.sub(r"[^\n]", " ", text[start : m.end()])
            start = m.end()
    clean = "".join(out)
    return clean, _blocks(clean), errors


def _opening(text: str, at: int, stops: str = ";") -> int:
    """The first brace after ``at`` outside round and square brackets, or -1 if the declaration ends first."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and c == "{":
            return i
        elif depth == 0 and c in stops:
            return -1
    return -1


# --- Rust ---

_RUST_ITEM = re.compile(r"\b(?:(mod)\s+(\w+)\s*(?=\{)|(impl)\b(?:\s*<[^{}]*?>)?\s+([^{;]+?)\s*(?=\{)|(trait)\s+(\w+)|(fn)\s+(\w+))")
_RUST_CALL = re.compile(r"(?<![\w.!])((?:[A-Za-z_]\w*::)*)([a-z_]\w*)\s*(?:::<[^()]*?>)?\(|\.\s*([a-z_]\w*)\s*(?:::<[^()]*?>)?\(")
_RUST_WORDS = frozenset("if while for match return loop in fn move let as else unsafe where impl dyn ref mut async await Some None Ok Err".split())


def rust_facts(text: str, repository: str, path: str) -> list[dict]:
    facts, clean = Facts(repository, path), blank_rust(text)
    clean, pairs, errors = _recovered(clean)
    if pairs is None:
        return facts.failed("rust.parse_recovery")
    for at in errors:
        facts.diagnostic("rust.parse_recovery", _line(text, at))
    module = re.sub(r"\.rs$", "", re.sub(r"(^|/)src/", r"\1", path))
    source = f"repo://{repository}/rust/{module}"
    facts.entity(source, "namespace")
    scopes: list[tuple[int, int, str]] = []  # begin, end, name
    functions: list[tuple[int, int, str, str, int]] = []  # begin, end, scope, name, line
    for m in _RUST_ITEM.finditer(clean):
        begin = _opening(clean, m.end())
        if begin < 0:
            continue
        end = pairs[begin]
        if m[1]:
            scopes.append((begin, end, m[2]))
        elif m[3]:
            header = re.sub(r"\s+where\b.*", "", m[4], flags=re.S)
            bare = lambda t: re.sub(r"<.*", "", t.strip(), flags=re.S).split("::")[-1].strip("&' ")
            trait, _, target = header.rpartition(" for ")
            scopes.append((begin, end, f"impl/{bare(trait)}-for-{bare(target)}" if trait else f"impl/{bare(target)}"))
        elif m[5]:
            scopes.append((begin, end, m[6]))
        elif not any(b < m.start() < e for b, e, *_ in functions):
            scope = "/".join(n for b, e, n in scopes if b < m.start() < e)
            functions.append((begin, end, scope, m[8], _line(text, m.start())))
    by_name: dict[tuple[str, str], list[str]] = {}
    named = []
    for begin, end, scope, name, line in functions:
        id_ = "/".join(x for x in (source, scope, name) if x)
        named.append((begin, end, scope, id_))
        by_name.setdefault((scope, name), []).append(id_)
        facts.entity(id_, "callable")
        facts.edge(source, "defines", id_, line)
    receivers = 0
    first = None
    for begin, end, scope, id_ in named:
        for m in _RUST_CALL.finditer(clean, begin, end):
            line = _line(text, m.start(2) if m[2] else m.start(3))
            if m[3]:
                receivers, first = receivers + 1, first or line
                facts.edge(id_, "calls", f"rust-method://{m[3]}", line, confidence=0.6)
            elif m[2] not in _RUST_WORDS and clean[m.end(2) : m.end(2) + 1] != "!":
                local = by_name.get((scope, m[2]), []) if not m[1] and "impl/" not in scope else []
                facts.edge(id_, "calls", local[0] if len(local) == 1 else f"rust-call://{m[2]}", line, confidence=1.0 if len(local) == 1 else 0.6)
    if receivers:
        facts.diagnostic("rust.receiver_method_resolution_unavailable", first)
    return facts.finish()


# --- Elixir ---

_EX_TOKEN = re.compile(r"\b(defmodule|defprotocol|defimpl|def|defp|defmacro|defmacrop|defdelegate|defstruct|fn|do|end|case|alias|import|require|use|@behaviour|@callback)\b(?!:)(:)?|@(behaviour|callback)\b")
_EX_NAME = r"[A-Z][\w]*(?:\.[A-Z]\w*)*"
_EX_CALL = re.compile(rf"(?<![\w.@:&])(?:({_EX_NAME})\.)?([a-z_]\w*[?!]?)\(")
_EX_WORDS = frozenset("if unless case cond for with fn def defp defmodule defmacro quote unquote when and or not in do raise receive try send spawn".split())


def _arity(text: str, at: int) -> tuple[int, int, int]:
    """(least, most, end) arity of an argument list whose bracket opens at ``at``."""
    depth, count, defaults, seen = 0, 0, 0, False
    for i in range(at, len(text)):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                n = count + 1 if seen else 0
                return n - defaults, n, i
        elif depth == 1 and c == ",":
            count += 1
        if depth == 1 and text.startswith("\\\\", i):
            defaults += 1
        if depth >= 1 and i > at and not c.isspace():
            seen = True
    return 0, 0, len(text)


_EX_HEAD = re.compile(r"\b(?:defp?|defdelegate|defmacrop?)$")
_EX_FILTER = re.compile(r"\s*,\s*(only|except):\s*(?:\[([^\]]*)\]|:(\w+))")


def _import_filter(clean: str, at: int) -> dict[str, list[str] | None]:
    """What an import takes: ``only`` these (null: all) ``except`` those, as name/arity."""
    found = {"only": None, "except": []}
    while m := _EX_FILTER.match(clean, at):
        names = [f"{name}/{n}" for name, n in re.findall(r"(\w+[?!]?):\s*(\d+)", m[2] or "")]
        if m[3] != "functions":  # of macros nothing is called
            found[m[1]] = names
        at = m.end()
    return found


def elixir_facts(text: str, repository: str, path: str) -> list[dict]:
    facts, clean = Facts(repository, path), blank_elixir(text)
    source = f"repo://{repository}/elixir-source/{path}"
    facts.entity(source, "namespace")
    base = f"repo://{repository}/elixir/"
    # Blocks open with do (not do:) or fn, and close with end.
    stack: list[tuple[str, object]] = []
    pending: tuple[str, object] | None = None
    functions: dict[str, int] = {}
    seen: set[tuple[str, str]] = set()
    calls: list[tuple[str, int, str | None, str, int]] = []
    aliases: dict[str, str] = {}
    definitions: dict[str, set[tuple[str, int]]] = {}

    def module() -> str | None:
        return next((str(v) for k, v in reversed(stack) if k == "module"), None)

    def use(relation: str, name: str, at: int) -> None:
        here = module()
        if here:
            full = aliases.get(name.split(".")[0], name.split(".")[0]) + name[len(name.split(".")[0]) :]
            if (relation, full) not in seen or relation != "uses":
                facts.edge(base + here, relation, f"elixir-module://{full}", _line(text, at))
                seen.add((relation, full))

    spans: list[tuple[int, str]] = []
    for m in re.finditer(rf"\b(defmodule|defprotocol)\s+({_EX_NAME})|\bdefimpl\s+({_EX_NAME})\s*,\s*for:\s*({_EX_NAME})|\b(defp?|defdelegate|defmacrop?)\s+([a-z_]\w*[?!]?)|\b(alias|import|require|use)\s+({_EX_NAME})(?:\s*,\s*as:\s*(\w+))?|@(behaviour)\s+({_EX_NAME})|\b(do)\b(?!:)|\b(fn)\b|\b(end)\b|\bdo:", clean):
        if m[1]:
            outer = module()
            pending = ("module", re.sub("^Elixir\\.", "", m[2] if outer is None or "." in m[2] and m[2].startswith(outer + ".") else f"{outer}.{m[2]}"))
            facts.edge(base + outer if outer else source, "defines", base + str(pending[1]), _line(text, m.start()))
            facts.entity(base + str(pending[1]), "namespace")
        elif m[3]:
            pending = ("module", f"{m[3]}.{m[4]}")
            facts.entity(base + str(pending[1]), "namespace")
            facts.edge(source, "defines", base + str(pending[1]), _line(text, m.start()))
            facts.edge(base + str(pending[1]), "implements", f"elixir-module://{m[3]}", _line(text, m.start()))
        elif m[5]:
            here = module()
            if here is None or m[5].startswith("defmacro"):
                pending = ("using" if m[6] == "__using__" else "macro", None)
                continue
            after = m.end()
            least, most, end = _arity(clean, after) if clean[after : after + 1] == "(" else (0, 0, after)
            if any(k == "using" for k, _ in stack):
                # Functions that a module gets which uses this one.
                for n in range(least, most + 1):
                    facts.rows.append({"sort": "using_defines", "id": base + here, "kind": f"{m[6]}/{n}", "evidence": f"{path}:{_line(text, m.start())}"})
                pending = ("block", None)
                spans.append((end, f"using:{here}/{m[6]}/{most}"))
                continue
            for n in range(least, most + 1):
                id_ = f"{base}{here}/{m[6]}/{n}"
                if id_ not in functions:
                    functions[id_] = _line(text, m.start())
                    facts.entity(id_, "callable")
                    facts.edge(base + here, "defines", id_, functions[id_])
                definitions.setdefault(here, set()).add((m[6], n))
            pending = ("function", f"{base}{here}/{m[6]}/{most}")
            spans.append((end, str(pending[1])))
        elif m[7]:
            if m[7] == "alias":
                aliases[m[9] or m[8].split(".")[-1]] = m[8]
            else:
                use({"import": "imports", "require": "requires", "use": "uses"}[m[7]], m[8], m.start())
                if m[7] == "import" and module():
                    # Inside a function an import holds there, else in the module.
                    scope = next((v for k, v in reversed(stack) if k in ("function", "module")), None)
                    head = m[8].split(".")[0]
                    row = {"sort": "import", "id": aliases.get(head, head) + m[8][len(head) :], "from_id": scope if str(scope).startswith(base) else f"{base}{scope}"}
                    facts.rows.append(row | {"provenance": json.dumps(_import_filter(clean, m.end())), "evidence": f"{path}:{_line(text, m.start())}"})
        elif m[10]:
            if module() and any(k == "using" for k, _ in stack):
                head, _, tail = m[11].partition(".")
                facts.rows.append({"sort": "using_implements", "id": base + str(module()), "to_id": f"elixir-module://{'.'.join(x for x in (aliases.get(head, head), tail) if x)}", "evidence": f"{path}:{_line(text, m.start())}"})
            else:
                use("implements", m[11], m.start())
        elif m[12]:
            stack.append(pending or ("block", None))
            pending = None
        elif m[13]:
            stack.append(("block", None))
        elif m[14]:
            if not stack:
                return facts.failed("elixir.parse_recovery")
            stack.pop()
        else:
            pending = None  # a body on the same line
    if stack:
        return facts.failed("elixir.parse_recovery")
    starts = [s for s, _ in spans]
    for m in _EX_CALL.finditer(clean):
        if m[2] in _EX_WORDS:
            continue
        k = next((i for i in range(len(starts) - 1, -1, -1) if starts[i] <= m.start()), None)
        if k is None:
            continue
        _, n, _ = _arity(clean, m.end() - 1)
        before = clean[: m.start()].rstrip()
        if _EX_HEAD.search(before[-12:]):
            continue  # the head of a definition
        n += before.endswith("|>")
        owner = spans[k][1]
        if owner.startswith("using:"):
            within, name, arity = owner.removeprefix("using:").rsplit("/", 2)
            head, _, tail = (m[1] or "").partition(".")
            full = ".".join(x for x in (aliases.get(head, head), tail) if x)
            facts.rows.append({"sort": "using_calls", "id": base + within, "kind": f"{name}/{arity}", "to_id": f"elixir-call://{full}/{m[2]}/{n}" if full else f"{m[2]}/{n}", "evidence": f"{path}:{_line(text, m.start())}"})
            continue
        here = owner[len(base) :].rsplit("/", 2)[0]
        calls.append((owner, _line(text, m.start()), m[1], m[2], n))
        if m[1]:
            head, _, tail = m[1].partition(".")
            full = ".".join(x for x in (aliases.get(head, head), tail) if x)
            facts.edge(owner, "calls", f"elixir-call://{full}/{m[2]}/{n}", _line(text, m.start()), confidence=0.6)
        elif (m[2], n) in definitions.get(here, ()):
            facts.edge(owner, "calls", f"{base}{here}/{m[2]}/{n}", _line(text, m.start()))
        else:
            facts.edge(owner, "calls", f"elixir-call://{m[2]}/{n}", _line(text, m.start()), confidence=0.6)
    return facts.finish()


# --- TypeScript and JavaScript ---

_TS_ITEM = re.compile(
    r"\b(class|interface|enum|namespace)\s+([A-Za-z_$][\w$]*)(?:\s*<[^{}]*?>)?(?:\s+extends\s+([\w$.]+))?|\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?=[<(])"
    r"|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?(?=function\b|\([^()]*\)\s*(?::[^=;{}]+)?=>|[A-Za-z_$][\w$]*\s*=>)"
)
_TS_METHOD = re.compile(r"(?:^|[;{}\n)])\s*(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^(){};]*>)?\(")
_TS_CALL = re.compile(r"(?<![\w$.])(new\s+)?((?:[A-Za-z_$][\w$]*\.)*)([A-Za-z_$][\w$]*)\s*\(")
_TS_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\*\s+as\s+([\w$]+)|\{([^}]*)\})?\s*from\s*(['\"])([^'\"]+)\4")
_TS_WORDS = frozenset("if for while switch catch function return typeof await super constructor import new delete void in of class else do".split())


_TS_EXPORT = re.compile(
    r"\bexport\s+(?:(default)\s+(?:(?:async\s+|abstract\s+)*(?:function\s*\*?|class|interface|enum)\s+)?([A-Za-z_$][\w$]*)"
    r"|(?:(?:declare|abstract|async|const(?=\s+enum))\s+)*(?:class|interface|enum|namespace|function\s*\*?|const|let|var|type)\s+([A-Za-z_$][\w$]*)"
    r"|(?:type\s+)?\{([^}]*)\}(?:\s*from\s*(['\"])([^'\"]+)\5)?|(?:type\s+)?\*\s*from\s*(['\"])([^'\"]+)\7)"
)


def typescript_exports(text: str, clean: str) -> Iterator[tuple[str, str, str | None]]:
    """(exported name, local name, source or None) of each export; ``*`` for all of a source's. ``clean`` is the text without comments and strings."""
    for m in _TS_EXPORT.finditer(text):
        if clean[m.start()] != "e":
            continue  # in a comment or string
        if m[1]:
            if m[2] not in _TS_WORDS | {"async"}:
                yield "default", m[2], None
        elif m[3]:
            yield m[3], m[3], None
        elif m[8]:
            yield "*", "*", m[8]
        else:
            for item in re.sub(r"//[^\n]*|/\*.*?\*/", "", m[4], flags=re.S).split(","):
                local, _, name = item.strip().removeprefix("type ").partition(" as ")
                if local.strip():
                    yield (name or local).strip(), local.strip(), m[6]


def typescript_imports(text: str, clean: str | None = None) -> Iterator[tuple[str, str, str]]:
    """(local name, source, imported name) of each import; ``default`` and ``*`` as names of those."""
    for m in _TS_IMPORT.finditer(text):
        if clean is not None and clean[m.start()] != "i":
            continue  # in a comment or string
        if m[1]:
            yield m[1], m[5], "default"
        if m[2]:
            yield m[2], m[5], "*"
        for item in (m[3] or "").split(","):
            name, _, local = item.strip().removeprefix("type ").partition(" as ")
            if name.strip():
                yield (local or name).strip(), m[5], name.strip()


def generated_typescript(text: str, path: str) -> bool:
    """Whether a file was generated, by its name or its first 20 lines."""
    head = "\n".join(text.split("\n", 20)[:20]).lower()
    return bool(re.search(r"\.(generated|gen)\.\w+$", path)) or any(x in head for x in ("@generated", "generated by", "do not edit"))


def typescript_facts(text: str, repository: str, path: str) -> list[dict]:
    language = "javascript" if path.endswith((".js", ".jsx")) else "typescript"
    facts, clean = Facts(repository, path), blank_ts(text)
    clean, pairs, errors = _recovered(clean)
    if pairs is None:
        return facts.failed("typescript.parse_recovery")
    for at in errors:
        facts.diagnostic("typescript.parse_recovery", _line(text, at))
    source, module = f"repo://{repository}/{language}-source/{path}", f"repo://{repository}/{language}/{path}"
    for id_ in (source, module):
        facts.entity(id_, "namespace")
    facts.edge(source, "defines", module, None)
    items: list[tuple[int, int, str, str, int]] = []  # begin, end, name, kind, at
    for m in _TS_ITEM.finditer(clean):
        name = m[2] or m[4] or m[5]
        begin = _opening(clean, m.end(), ";" if m[1] or m[4] else ";\n")
        end = pairs[begin] if begin >= 0 else m.end()
        items.append((begin if begin >= 0 else m.end(), end, name, "namespace" if m[1] else "callable", m.start()))
    for begin, end, name, kind, at in list(items):
        if kind != "namespace":
            continue
        for m in _TS_METHOD.finditer(clean, begin, end):
            inner = max((b for b in pairs if b < m.start(1) < pairs[b]), default=-1)
            if inner == begin and m[1] not in _TS_WORDS - {"constructor"}:
                start = _opening(clean, m.start(1))
                if start >= 0 and start < end:
                    items.append((start, pairs[start], m[1], "callable", m.start(1)))
    items.sort()
    ids: list[tuple[int, int, str, str]] = []
    local: dict[str, list[str]] = {}
    for begin, end, name, kind, at in items:
        outer = [i for b, e, i, _ in ids if b < at < e]
        id_ = f"{outer[-1] if outer else module}/{name}"
        ids.append((begin, end, id_, kind))
        local.setdefault(name, []).append(id_)
        facts.entity(id_, kind)
        facts.edge(outer[-1] if outer else module, "defines", id_, _line(text, at))
    for m in _TS_CALL.finditer(clean):
        owner = [i for b, e, i, k in ids if b < m.start() < e and k == "callable"]
        if m[3] in _TS_WORDS or not owner or re.search(r"\bfunction\s*\*?\s*$", clean[: m.start()]):
            continue
        receiver, line = m[2].rstrip("."), _line(text, m.start(3))
        if receiver == "this":
            scope = owner[-1].rsplit("/", 1)[0]
            target = f"{scope}/{m[3]}" if f"{scope}/{m[3]}" in local.get(m[3], ()) else f"{language}-method://this/{m[3]}"
        elif receiver:
            target = f"{language}-method://{receiver}/{m[3]}"
        elif m[1]:
            target = local[m[3]][0] if len(local.get(m[3], ())) == 1 else f"{language}-constructor://{m[3]}"
        elif m[3] in {i.rsplit("/", 1)[1] for *_, i, k in ids if i in local.get(m[3], ())} and len(local[m[3]]) == 1:
            target = local[m[3]][0]
        else:
            target = f"{language}-call://{m[3]}"
        if target != owner[-1] or receiver:
            facts.edge(owner[-1], "calls", target, line, confidence=1.0 if target.startswith("repo://") else 0.6)
    for name, origin, imported in typescript_imports(text, clean):
        facts.rows.append({"sort": "import", "id": name, "kind": imported, "from_id": module, "to_id": origin, "evidence": path})
    for name, named, origin in typescript_exports(text, clean):
        facts.rows.append({"sort": "export", "id": name, "kind": named, "from_id": module, "to_id": origin, "evidence": path})
    return facts.finish()


# --- C# ---

_CS_ITEM = re.compile(r"\b(namespace)\s+([\w.]+)\s*(;)?|\b(class|struct|interface|record|enum)\s+(?:class\s+|struct\s+)?(\w+)(?:\s*<[^{}();]*>)?(?:\s*\([^{}]*?\))?(?:\s*:\s*([^{};]+?))?\s*(?=[{;]|where\b)")
_CS_METHOD = re.compile(r"(?:^|[;{}\]\n])\s*((?:(?:public|private|protected|internal|static|async|override|virtual|sealed|abstract|partial|extern|new|unsafe)\s+)*)(?:([\w.<>\[\],?]+)\s+)?(\w+)\s*(?:<[\w, ]+>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*(?:base|this)\s*\([^{}]*?\)\s*)?(?:where[^{;]*)?(?=\{|=>)")
_CS_WORDS = frozenset("if for foreach while switch catch using lock return new typeof nameof sizeof fixed await throw when get set add remove else do".split())


def csharp_parameters(text: str) -> list[tuple[str, str, bool, bool]]:
    """(type, name, optional, extension) of each parameter."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            part = re.sub(r"^\s*(?:\[[^\]]*\]\s*)*", "", text[start:i]).strip()
            start = i + 1
            if part:
                head, _, default = part.partition("=")
                words = head.split()
                extension = words[:1] == ["this"]
                words = [w for w in words if w not in ("this", "ref", "out", "in", "params", "scoped")]
                out.append((" ".join(words[:-1]) or words[-1], words[-1], bool(default), extension))
    return out


_CS_CALL = re.compile(r"(?<![\w.])(new\s+)?((?:\w+\s*\??\.\s*)*)(\w+)\s*(?:<[\w, .<>?\[\]]*>)?\s*\(")
_CS_LOCAL = re.compile(r"(?<![\w.])([A-Za-z_][\w.]*(?:<[\w, .<>?\[\]]*>)?(?:\[\])?\??)\s+([A-Za-z_]\w*)\s*(?:=\s*(?:new\s+([\w.]+(?:<[\w, .<>?\[\]]*>)?)|\(([\w.]+)\)\s*\w)?|;)")


def _simple(type_: str) -> str:
    return type_.rstrip("?").split("<", 1)[0].rsplit(".", 1)[-1]


def _body(clean: str, at: int, pairs: dict[int, int]) -> int:
    """Where the body that begins at ``at``, a block or an arrow's expression, ends."""
    at += len(clean[at:]) - len(clean[at:].lstrip())
    if clean.startswith("{", at):
        return pairs[at]
    depth = 0
    for i in range(at, len(clean)):
        depth += (clean[i] in "([{") - (clean[i] in ")]}")
        if clean[i] == ";" and depth <= 0:
            return i
    return len(clean)


def _arguments(text: str, clean: str, at: int) -> list[str]:
    """The argument expressions of the call whose bracket opens at ``at``."""
    out, depth, start = [], 0, at + 1
    for i in range(at, len(clean)):
        c = clean[i]
        if c in ")]}":
            depth -= 1
        if depth == 1 and c == "," or depth == 0:
            if part := text[start:i].strip() if i > at else "":
                out.append(re.sub(r"^(?:\w+\s*:(?!:)\s*|(?:ref|out|in)\s+)", "", part))
            start = i + 1
        if c in "([{":
            depth += 1
        if depth == 0:
            break
    return out


def _csharp_calls(text: str, clean: str, pairs: dict[int, int], path: str, methods: list[tuple[int, int, str, list]]) -> Iterator[dict]:
    """Calls of each method: name, kind, the receiver and its declared type, and the types of arguments, as far as declarations tell."""
    for begin, end, id_, parameters in methods:
        inner = [(b, e) for b, e, other, _ in methods if begin < b and e <= end and other != id_]
        known = {name: type_ for type_, name, *_ in parameters}
        for m in _CS_LOCAL.finditer(clean, begin, end):
            type_ = m[3] or m[4] or m[1]
            if type_ != "var" and m[1] not in _CS_WORDS:
                known.setdefault(m[2], type_)
        for m in _CS_CALL.finditer(clean, begin, end):
            if m[3] in _CS_WORDS or any(b <= m.start() < e for b, e in inner):
                continue
            receiver = re.sub(r"[\s?]", "", m[2]).rstrip(".")
            if clean[: m.start()].rstrip().endswith((".", ".?")) and not m[1]:
                continue  # a member of what another call returned
            types = [known.get(x) or ("string" if x.startswith('"') else None) for x in _arguments(text, clean, m.end() - 1)]
            yield {
                "sort": "call", "id": m[3], "kind": "constructor" if m[1] else "member" if receiver else "direct", "from_id": id_, "relation": receiver,
                "to_id": _simple(known.get(receiver, "")), "provenance": json.dumps([x and _simple(x) for x in types]), "evidence": f"{path}:{_line(text, m.start())}",
            }


def csharp_facts(text: str, repository: str, path: str, assembly: str = "default") -> list[dict]:
    facts, clean = Facts(repository, path), blank_cs(text)
    clean, pairs, errors = _recovered(clean)
    if pairs is None:
        return facts.failed("csharp.parse_recovery")
    for at in errors:
        facts.diagnostic("csharp.parse_recovery", _line(text, at))
    source, root = f"repo://{repository}/csharp-source/{assembly}/{path}", f"repo://{repository}/csharp/{assembly}/{path}"
    facts.entity(source, "namespace")
    scopes: list[tuple[int, int, str]] = []
    types: list[tuple[int, int, str]] = []
    for m in _CS_ITEM.finditer(clean):
        outer = "/".join(n for b, e, n in scopes if b < m.start() < e)
        if m[1]:
            begin = m.end() if m[3] else _opening(clean, m.end())
            if begin >= 0:
                scopes.append((begin, len(clean) if m[3] else pairs[begin], m[2].replace(".", "/")))
            continue
        begin = _opening(clean, m.end())
        end = pairs[begin] if begin >= 0 else m.end()
        id_ = "/".join(x for x in (root, outer, m[5]) if x)
        if begin >= 0:
            scopes.append((begin, end, m[5]))
            types.append((begin, end, id_))
        facts.entity(id_, "namespace")
        facts.edge(source, "defines", id_, None)
        for base in (m[6] or "").split(","):
            if name := re.sub(r"<.*", "", base.strip(), flags=re.S).split(".")[-1]:
                facts.rows.append({"sort": "base", "id": id_, "kind": m[4], "to_id": name, "evidence": f"{path}:{_line(text, m.start())}"})
    methods: list[tuple[int, int, str, list]] = []
    for begin, end, type_id in types:
        for m in _CS_METHOD.finditer(clean, begin, end):
            inner = max((b for b in pairs if b < m.start(3) < pairs[b]), default=-1)
            if inner != begin or m[3] in _CS_WORDS or m[2] in ("new", "return", "await", "throw", "else"):
                continue
            parameters = csharp_parameters(m[4])
            id_ = f"{type_id}/{m[3]}({','.join(t for t, *_ in parameters)})"
            facts.entity(id_, "callable")
            facts.edge(type_id, "defines", id_, _line(text, m.start(3)))
            methods.append((m.end(), _body(clean, m.end(), pairs), id_, parameters))
            described = {"types": [_simple(t) for t, *_ in parameters], "optional": sum(o for *_, o, _ in parameters), "extension": bool(parameters and parameters[0][3])}
            facts.rows.append({"sort": "method", "id": id_, "kind": m[3], "from_id": type_id, "provenance": json.dumps(described)})
    facts.rows += _csharp_calls(text, clean, pairs, path, methods)
    return facts.finish()


FRONTENDS: dict[str, tuple[str, Callable[[str, str, str], list[dict]]]] = {
    "rust": (r"\.rs$", rust_facts), "elixir": (r"\.exs?$", elixir_facts), "typescript": (r"\.(ts|tsx|js|jsx)$", typescript_facts), "csharp": (r"\.cs$", csharp_facts),
}


def decode(content: bytes) -> tuple[str, bool]:
    """(text, whether bytes were lost) by the byte order mark: UTF-8, or UTF-16 of either order."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"", "utf-8")):
        if content.startswith(mark):
            body = content[len(mark) :]
            try:
                return body.decode(encoding), False
            except UnicodeDecodeError:
                return body.decode(encoding, "replace"), True
    raise AssertionError("the empty mark fits any content")


def _run(frontends: list[tuple[re.Pattern, Callable]]):
    def run(batches):
        for batch in batches:
            for repository, path, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text, lossy = decode(bytes(content or b""))
                for pattern, parse in frontends:
                    if pattern.search(path):
                        rows = parse(text, repository, path)
                        if lossy and path.endswith(".cs"):
                            rows = [*rows, {"repository": repository, "path": path, "sort": "diagnostic", "id": "csharp.lossy_encoding", "evidence": path}]
                        yield rows

    return lambda batches: batches_of(run(batches), _ARROW)


def analyze(files: DataFrame, languages: tuple[str, ...] = tuple(FRONTENDS)) -> DataFrame:
    """Facts (``FACTS``) of rows repository, path, content: one map over the files."""
    chosen = [(re.compile(FRONTENDS[x][0]), FRONTENDS[x][1]) for x in languages]
    wanted = "|".join(f"(?:{FRONTENDS[x][0]})" for x in languages)
    return dealt(files.where(F.col("path").rlike(wanted)).select("repository", "path", "content")).mapInArrow(_run(chosen), FACTS)


def edges(facts: DataFrame) -> DataFrame:
    return facts.where("sort = 'edge'").select(*EDGE_COLUMNS)


def entities(facts: DataFrame) -> DataFrame:
    return facts.where("sort = 'entity'").select("id", "kind", F.lit("").alias("metadata")).distinct()


def diagnostics(facts: DataFrame) -> DataFrame:
    """``repository, code, severity, path``; a parse recovery makes its repository incomplete."""
    severity = F.when(F.col("id").endswith(".parse_recovery"), "warning").otherwise("known_limitation")
    return facts.where("sort = 'diagnostic'").select("repository", F.col("id").alias("code"), severity.alias("severity"), "path").distinct()


def incomplete(facts: DataFrame) -> DataFrame:
    return diagnostics(facts).where(F.col("code").endswith(".parse_recovery")).select("repository").distinct()
