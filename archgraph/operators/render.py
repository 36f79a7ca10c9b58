"""Answers as JSON, compact text and raw text: for the small results of single queries, on the driver."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..schema import RELATIONS
from . import graph
from .graph import Answer

VERSIONS = {"context": 1, "dependencies": 2, "impact": 2, "trace": 2, "why": 2}
#: How a relation reads from its target's side.
PASSIVE = {
    "binds_contract": "bound by", "calls": "called by", "calls_graphql": "called by", "calls_rpc": "called by", "consumed_by": "consumes", "defines": "defined by",
    "field_of": "has field", "implements": "implemented by", "implemented_by": "implements", "imports": "imported by", "publishes": "published by",
    "requires": "required by", "request_type": "request of", "resolved_by": "resolves", "selects": "selected by", "response_type": "response of", "uses": "used by",
}


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def evidence_label(e) -> str:
    place = f"{e['path']}:{e['line']}" if e["path"] and e["line"] is not None else e["path"] or ""
    return place or e["detail"] or "no evidence"


def _collect(answer: Answer) -> tuple[dict, list[dict], list[dict]]:
    nodes = {r["id"]: r.asDict(True) for r in answer.nodes.collect()}
    order = ["step"] if "step" in answer.edges.columns else []
    edges = [r.asDict(True) for r in answer.edges.collect()]
    edges.sort(key=lambda e: [e[k] for k in order] + [e["from_id"], e["to_id"], RELATIONS.index(e["relation"])])
    entries = [r.asDict() for r in answer.entries.orderBy("hops", "entity").collect()]
    return nodes, edges, entries


def to_json(kind: str, root: str, answer: Answer, metadata: dict | None = None, pretty: bool = False) -> str:
    """One JSON document; confidence has the precision of 32 bits."""
    import numpy as np

    nodes, edges, entries = _collect(answer)
    body = {
        "schema": f"archgraph.{kind}.v{VERSIONS[kind]}", "root": root, "truncated": answer.truncated, "metadata": metadata or {},
        "nodes": [nodes[k] for k in sorted(nodes)],
        "edges": [e | {"confidence": float(str(np.float32(e["confidence"])))} for e in edges],
        "entries": entries,
    }
    return json.dumps(body, ensure_ascii=False, sort_keys=True, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def raw_text(kind: str, root: str, answer: Answer) -> str:
    nodes, edges, entries = _collect(answer)
    out = [f"{kind} {root}", "", "nodes"]
    out += [f"  {n['id']} [{n['kind']}] {n['origin']}{' test' if n['test'] else ''}" for _, n in sorted(nodes.items())]
    out += ["", "edges"]
    for e in edges:
        out.append(f"  {e['edge_id']} {e['from_id']} --{e['relation']}--> {e['to_id']} confidence {e['confidence']:.2f}")
        out += [f"    {x['source_kind']} {evidence_label(x)}" for x in e["evidence"]]
    out += ["", "entries"] + [f"  {x['hops']} {x['entity']}" for x in entries]
    if answer.truncated:
        out.append("truncated")
    return "\n".join(out)


def _labels(answer: Answer) -> dict[str, str]:
    return {r.id: r.label for r in graph.labels(answer.nodes).collect()}


def compact_text(kind: str, root: str, answer: Answer, include_tests: bool = False, show_evidence: bool = False) -> str:
    """What a reader needs first: shown nodes only, by direction, group or step."""
    labels = _labels(answer)
    shown = {r.id: r.visibility for r in graph.visibility(answer.nodes, include_tests).collect()}
    name = lambda x: labels.get(x, x)
    if kind == "context":
        _, edges, _ = _collect(answer)
        out = [name(root)]
        for e in edges:
            other = e["to_id"] if e["from_id"] == root else e["from_id"]
            if shown.get(other) == "primary":
                out.append(f"  {e['relation'].replace('_', ' ') if e['from_id'] == root else PASSIVE[e['relation']]} {name(other)}")
        return "\n".join(out)
    if kind in ("trace", "why"):
        steps = [r.asDict(True) for r in graph.project_path(answer, include_tests).orderBy("step").collect()]
        if not steps:
            return f"{name(root)}\nno path" + (" within the limit" if answer.truncated else "")
        repositories = {r.repository for r in answer.nodes.collect() if r.repository}
        out = [f"{plural(len(steps), 'hop')} · {len(repositories)} repositories · confidence {min(s['confidence'] for s in steps):.2f}", name(root)]
        for s in steps:
            out.append(f"  {s['relation'].replace('_', ' ')} → {name(s['to_id'])}")
            if kind == "why" or show_evidence:
                out += [f"    {evidence_label(e)}" for e in s["evidence"]]
        return "\n".join(out)
    rows = answer.entries.join(graph.visibility(answer.nodes, include_tests), F.col("entity") == F.col("id")).collect()
    groups: dict[str, list[str]] = {}
    hidden = 0
    for r in sorted(rows, key=lambda r: (r.hops, r.entity)):
        if r.test and not include_tests:
            hidden += 1
        elif r.visibility == "primary":
            groups.setdefault("direct" if r.hops == 1 else r.kind.replace("_", " "), []).append(name(r.entity))
    out = [f"{kind} of {name(root)}: {plural(sum(map(len, groups.values())), 'entity', 'entities')}"]
    for group, names in groups.items():
        out += [f"{group} ({len(names)})", *(f"  {x}" for x in names)]
    if hidden:
        out.append(f"{plural(hidden, 'test')} hidden")
    if answer.truncated:
        out.append("truncated: more lies beyond the hop limit")
    return "\n".join(out)
