"""The public surface: a workspace of views, its queries and its administration; and a command line over it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArchgraphError
from .operators import graph, render
from .operators.enrichment import Enrichments
from .operators.publish import Store
from .plans.shared import materialize, scratch
from .plugins import Active, builtin
from .schema import DEFAULT_MAX_HOPS, DIAGNOSTIC
from .sources import files as source_files
from .sources import trees
from .sources.facts_cache import FactCache


class Workspace:
    """Repositories indexed into a store, and the five queries over a view of it."""

    def __init__(self, spark: SparkSession, root: str, plugins: Active | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.plugins = plugins or builtin().activate(["baseline"])

    def index(self, repositories: dict[str, str], view: str = "main") -> dict:
        """Scan, analyze, resolve and publish {repository: directory}, alone on the store; unchanged input under unchanged plugins is skipped."""
        operation = f"index {view}"
        with self.store.exclusive(operation):
            files = None
            for repository, directory in repositories.items():
                found = source_files.scan(self.spark, directory, repository)
                files = found if files is None else files.unionByName(found)
            names, identity = list(repositories), self.plugins.identity()[:16]
            known = {r.repository: r.fingerprint for r in trees.tree_fingerprint(files).collect()}  # one row a repository
            prints = {r: f"{known.get(r, 'empty')}-{identity}" for r in names}
            at = self.store.pointer(view)
            if at["inputs"] == prints and at["revision"]:
                return {"revision": at["revision"], "skipped": True}
            with scratch(self.spark):
                return self._publish(view, files, prints, operation)

    def _publish(self, view: str, files: DataFrame, prints: dict[str, str], operation: str) -> dict:
        cache = FactCache(self.spark, self.store.root, self.plugins.identity()[:16])
        found, names = self.plugins.analyze(files, cache), list(prints)
        # Facts that name no repository (schemas, contracts) belong to the first one.
        owned = lambda rows, c: materialize(rows.withColumn("_owner", F.coalesce(_owner(F.col(c), names), F.lit(names[0]))), "owned")
        edges, entities = owned(found.edges.withColumn("ordinal", F.col("evidence")), "from_id"), owned(found.entities, "id")
        self.store.lease.renew(operation, self.store.LEASE)
        out = self.store.publish_owned(view, prints, edges, entities, found.overrides, found.bound, found.diagnostics)
        self.store.cluster(view)
        return out | {"parsed": cache.misses, "cached": cache.hits}

    def register(self, name: str, repositories: dict[str, str]) -> None:
        """Remember a workspace's repositories by name."""
        self.store.register(name, repositories)

    def index_registered(self, name: str) -> dict:
        """Index a registered workspace into the view of its name."""
        known = self.store.workspaces()
        if name not in known:
            raise ArchgraphError("workspace.not_registered", name)
        return self.index(known[name], name)

    def enrichments(self) -> Enrichments:
        """The jobs of the active plugins' enrichers."""
        return Enrichments(self.store, self.plugins.enrichers())

    def enrich(self, view: str = "main") -> dict[str, int]:
        """Run the active plugins' enrichers for what they haven't seen; returns how many jobs came to which state."""
        jobs = self.enrichments()
        jobs.request(view)
        return jobs.run(view)

    def freshness(self, repositories: dict[str, str], view: str = "main") -> dict:
        """``revision, stale, dirty_repositories``: which of the repositories differ from what the view holds."""
        at, identity = self.store.pointer(view), self.plugins.identity()[:16]
        dirty = []
        for repository, directory in sorted(repositories.items()):
            found = trees.tree_fingerprint(source_files.scan(self.spark, directory, repository)).first()
            if at["inputs"].get(repository) != f"{found.fingerprint if found else 'empty'}-{identity}":
                dirty.append(repository)
        return {"revision": at["revision"], "stale": bool(dirty), "dirty_repositories": dirty}

    def relations(self, view: str = "main") -> DataFrame:
        """``relation, column, type`` of what can be inspected in a view."""
        rows = [(name, f.name, f.dataType.simpleString()) for name, schema in (*self.store.TABLES.items(), ("diagnostic", DIAGNOSTIC)) for f in schema]
        return self.spark.createDataFrame(rows, "relation string, column string, type string")

    def grpc_bindings(self, view: str = "main") -> DataFrame:
        """The view's edges that tie RPC operations to contracts, clients and servers."""
        found = self.graph(view).effective()
        return found.where("from_id like 'grpc://%' or to_id like 'grpc://%'").orderBy("from_id", "relation", "to_id")

    def diagnostics(self, view: str = "main", limit: int | None = None) -> DataFrame:
        """What the analysis of the view's sources couldn't tell."""
        return self.store.diagnostics(view, limit)

    def graph(self, view: str = "main") -> graph.Graph:
        return self.store.graph(view)

    def context(self, entity: str, view: str = "main") -> graph.Answer:
        return graph.context(self.graph(view), entity)

    def dependencies(self, entity: str, view: str = "main", max_hops: int = DEFAULT_MAX_HOPS) -> graph.Answer:
        return graph.dependencies(self.graph(view), entity, max_hops)

    def impact(self, entity: str, view: str = "main", max_hops: int = DEFAULT_MAX_HOPS) -> graph.Answer:
        return graph.impact(self.graph(view), entity, max_hops)

    def trace(self, source: str, target: str, view: str = "main", max_hops: int = DEFAULT_MAX_HOPS) -> graph.Answer:
        return graph.trace(self.graph(view), source, target, max_hops)

    why = trace

    def inspect(self, relation: str | None = None, view: str = "main") -> DataFrame:
        """The view's observations, of one relation or all, in order."""
        found = self.graph(view).effective()
        return (found if relation is None else found.where(F.col("relation") == relation)).orderBy("from_id", "relation", "to_id")

    def explain(self, view: str = "main") -> str:
        """The physical plan of the view's direct edges."""
        return self.spark._jvm.PythonSQLUtils.explainString(self.graph(view).direct()._jdf.queryExecution(), "formatted")


def _owner(id_, repositories: list[str]):
    """The longest of these repositories that an id starts with."""
    out = F
    for r in sorted(repositories, key=len, reverse=True):
        out = out.when(id_.startswith(f"repo://{r}/"), r)
    return out.otherwise(None)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="archgraph")
    parser.add_argument("--store", required=True, help="directory of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index repositories given as name=directory")
    index.add_argument("repositories", nargs="+")
    index.add_argument("--view", default="main")
    register = commands.add_parser("register", help="remember a workspace's repositories, given as name=directory")
    register.add_argument("workspace")
    register.add_argument("repositories", nargs="+")
    commands.add_parser("workspaces", help="list registered workspaces")
    reindex = commands.add_parser("reindex", help="index a registered workspace")
    reindex.add_argument("workspace")
    inspect = commands.add_parser("inspect", help="list relations, observations, grpc-bindings or diagnostics of a view")
    inspect.add_argument("what", choices=("relations", "observations", "grpc-bindings", "diagnostics"))
    inspect.add_argument("--view", default="main")
    gc = commands.add_parser("gc", help="delete states that no view holds")
    gc.add_argument("views", nargs="*", help="all views count, whether named here or not")
    gc.add_argument("--status", action="store_true", help="only list them")
    for kind in ("context", "dependencies", "impact", "trace", "why"):
        one = commands.add_parser(kind)
        one.add_argument("entity")
        if kind in ("trace", "why"):
            one.add_argument("target")
        one.add_argument("--view", default="main")
        one.add_argument("--max-hops", type=int, default=DEFAULT_MAX_HOPS)
        one.add_argument("--include-tests", action="store_true")
        one.add_argument("--verbose", action="store_true", help="list the view's diagnostics after the answer")
        form = one.add_mutually_exclusive_group()
        for flag in ("--json", "--json-pretty", "--raw"):
            form.add_argument(flag, action="store_true")
    args = parser.parse_args(argv)
    if getattr(args, "max_hops", 1) <= 0:
        parser.error("--max-hops must be positive")
    from .session import session

    spark = SparkSession.getActiveSession() or session()
    workspace = Workspace(spark, args.store)
    if args.command == "index":
        print(workspace.index(dict(x.split("=", 1) for x in args.repositories), args.view))
        return 0
    if args.command == "register":
        workspace.register(args.workspace, dict(x.split("=", 1) for x in args.repositories))
        return 0
    if args.command == "workspaces":
        for name, repositories in sorted(workspace.store.workspaces().items()):
            print(name, *(f"{r}={d}" for r, d in sorted(repositories.items())))
        return 0
    if args.command == "reindex":
        print(workspace.index_registered(args.workspace))
        return 0
    if args.command == "inspect":
        rows = {"relations": workspace.relations, "observations": lambda v: workspace.inspect(None, v), "grpc-bindings": workspace.grpc_bindings, "diagnostics": workspace.diagnostics}[args.what](args.view)
        for row in rows.toLocalIterator():
            print(*("" if x is None else x for x in row), sep="\t")
        return 0
    if args.command == "gc":
        if args.status:
            print(*workspace.store.garbage(), sep="\n")
            return 0
        with workspace.store.exclusive("gc"):
            workspace.store.collect_garbage(progress=lambda done, of: print(f"{done} of {of}"))
        return 0
    if args.command == "context":
        answer = workspace.context(args.entity, args.view)
    elif args.command in ("trace", "why"):
        answer = workspace.trace(args.entity, args.target, args.view, args.max_hops)
    else:
        answer = getattr(workspace, args.command)(args.entity, args.view, args.max_hops)
    if args.json or args.json_pretty:
        print(render.to_json(args.command, args.entity, answer, {"view": args.view, "revision": workspace.store.pointer(args.view)["revision"]}, args.json_pretty))
    elif args.raw:
        print(render.raw_text(args.command, args.entity, answer))
    else:
        print(render.compact_text(args.command, args.entity, answer, args.include_tests))
    if args.verbose:
        for r in workspace.diagnostics(args.view).toLocalIterator():
            print(f"{r.severity} {r.code} {r.repository} {r.path or ''}{f':{r.line}' if r.line is not None else ''}{f' ({r.detail})' if r.detail else ''}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
