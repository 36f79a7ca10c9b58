"""Publication of repository states as immutable revisions of a view.

A revision is a directory of Parquet tables and one file in its view's log, under the number
that follows the revision it was made from. Such a file is created whole or not at all, and
by one writer only; so of two that start from one revision the second is ``Stale``, and nothing is lost.
Readers take the largest number once and so see one revision; a write that fails leaves the log as it was. States are keyed by
their content, and a state that exists is not written again.

Garbage is claimed before it is deleted. A publisher says that it is in flight before it looks at claims, and takes no
state that is claimed; a claim waits for the publishers that were in flight when it was made, and what
a view names by then stays. So no state goes between its writing, or its reuse, and its revision.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import identity_text
from ..plans.adjacency import Adjacency
from ..schema import DIAGNOSTIC, EDGE, EDGE_COLUMNS, ENTITY, OVERRIDE
from ..errors import ArchgraphError
from .files import Files, Flights, Lease, Log, Stale


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of rows with equal keys, the last by ``ordinal``. An aggregate with a map-side part: no window over a hot key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_last")).select(*keys, "_last.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def extend_unique(first: DataFrame, then: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``first``, and those of ``then`` with keys that it lacks."""
    return first.unionByName(then.join(first.select(*keys), keys, "left_anti"))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def diff(current: DataFrame, following: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: inserted, updated, removed and unchanged keys."""
    a = current.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_a"))
    b = following.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNull()).alias("inserted"),
        F.count_if(F.col("_a") & F.col("_b") & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("updated"),
        F.count_if(F.col("_b").isNull()).alias("removed"),
        F.count_if(F.col("_a") & F.col("_b") & F.col("_old").eqNullSafe(F.col("_new"))).alias("unchanged"),
    )


def fingerprint(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """A digest of a set of rows that doesn't depend on their order.

    Each row's SHA-256 of its length-prefixed columns; rows are summed in buckets by the
    digest's first byte pair, and the buckets' digests in order: no task gathers all rows.
    """
    by = by or []
    row = F.sha2(identity_text(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)), 256)
    hashed = rows.select(*by, row.alias("_row"))
    # Within a bucket the sum over digests (as numbers, wrapped) stands for the set.
    parts = [F.sum(F.conv(F.substring("_row", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"_s{k}") for k in range(5)]
    bucket = hashed.groupBy(*by, F.substring("_row", 1, 2).alias("_bucket")).agg(F.count("*").alias("_n"), *parts)
    text = F.concat_ws(",", "_bucket", "_n", *(f"_s{k}" for k in range(5)))
    return bucket.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(text)), ";"), 256).alias("fingerprint"))


def ordered_fingerprint(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """SHA-256 of each group's sorted, joined rows: for groups as small as one file's or repository's facts."""
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in columns))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def carry_forward(previous: DataFrame, current: DataFrame, valid_owners: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of the previous revision whose owner is still valid, and that the current one doesn't have."""
    return previous.join(valid_owners.select("owner").distinct(), "owner", "left_semi").join(current.select(*keys), keys, "left_anti")


def valid_owners(owners: DataFrame, inputs: DataFrame) -> DataFrame:
    """Owners whose repository's input fingerprint is unchanged. ``owners``: owner, repository, input_fingerprint; ``inputs``: repository, fingerprint."""
    return owners.join(inputs, (owners.repository == inputs.repository) & (owners.input_fingerprint == inputs.fingerprint), "left_semi")


def unreferenced_states(states: DataFrame, live: DataFrame) -> DataFrame:
    """States that no current revision refers to: what garbage collection claims."""
    return states.join(live.select("state").distinct(), "state", "left_anti")


def missing_enrichments(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Of the expected (repository, analyzer, version), those not present."""
    return expected.join(present, ["repository", "analyzer", "version"], "left_anti")


def grpc_statuses(candidates: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Candidates with their diagnostic's code, or ``resolved``."""
    # A candidate that also comes in another cardinality has a diagnostic for one of the two.
    keys = ["local_symbol", "role", "service", "method", "evidence", "_unary"]
    found = diagnostics.withColumn("_unary", F.col("code") != "grpc.cardinality_unsupported").select(*keys, "code")
    return candidates.withColumn("_unary", F.col("cardinality") == "unary").join(found, keys, "left").select(*candidates.columns, F.coalesce("code", F.lit("resolved")).alias("status"))


def validate_entities(entities: DataFrame) -> DataFrame:
    """Entity rows whose kind is unknown or whose metadata doesn't suit it: empty for valid facts."""
    from ..schema import ENTITY_KINDS, METADATA, METADATA_OF

    good = F.col("metadata").isNull() | (F.col("metadata") == "")
    for kind, sort in METADATA_OF.items():
        good = good | ((F.col("kind") == kind) & F.col("metadata").isin(*(f"{sort}:{v}" for v in METADATA[sort])))
    return entities.where(~(F.col("kind").isin(*ENTITY_KINDS) & good))


class Store:
    """Views and their revisions under one directory of any Hadoop file system."""

    TABLES = {"observation": EDGE, "entity": ENTITY, "override": OVERRIDE}
    #: Seconds that a lock is held, and that a publication may take.
    LEASE, FLIGHT = 900, 6 * 3600
    #: Log entries of a view that stay, and paths that are deleted before a claim is written anew.
    ENTRIES, BATCH = 100, 100

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)
        self.lease, self.flights = Lease(self.files), Flights(self.files)

    def _log(self, view: str) -> Log:
        return Log(self.files, f"views/{quote(view, safe='')}")

    def views(self) -> list[str]:
        return [unquote(x) for x in self.files.names("views")]

    def pointer(self, view: str) -> dict:
        """The view's current revision: revision, states (by repository), inputs, version."""
        log = self._log(view)
        return log.load(log.last()) or {"revision": 0, "states": {}, "inputs": {}, "enrichments": {}}

    def _append(self, view: str, before: dict, after: dict) -> None:
        """Add the revision that follows ``before``; ``Stale`` if another one did."""
        self.lease.check()
        if not self._log(view).append(before["revision"], after):
            raise Stale(f"view {view} has moved on")

    def publish(self, view: str, facts: dict[str, tuple[str, DataFrame, DataFrame]], overrides: DataFrame | None = None, extra: DataFrame | None = None, diagnostics: DataFrame | None = None) -> dict:
        """Publish a revision from {repository: (input fingerprint, edges with ordinal, entities)}; returns the counts of changed facts."""

        def owned(k: int) -> DataFrame | None:
            frames = [x[k].withColumn("_owner", F.lit(r)) for r, x in facts.items()]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

        return self.publish_owned(view, {r: x[0] for r, x in facts.items()}, owned(1), owned(2), overrides, extra, diagnostics)

    def publish_owned(self, view: str, inputs: dict[str, str], edges: DataFrame | None, entities: DataFrame | None, overrides: DataFrame | None = None, extra: DataFrame | None = None, diagnostics: DataFrame | None = None) -> dict:
        """Publish a revision of the repositories {name: input fingerprint} from facts with an ``_owner``; returns the counts of changed facts.

        A state is its facts' digest; an existing one is reused. All repositories are validated, digested and
        written together, so the number of jobs doesn't grow with them. With the same states and no
        overrides or extra edges the revision's data is only a new log entry.
        """
        with self.flights.flight(self.FLIGHT) as flight:
            before = self.pointer(view)
            old = self.observations(before)
            states = self._write_states(inputs, edges, entities) if inputs else {}
            revision = before["revision"] + 1
            after = before | {"revision": revision, "states": states, "inputs": inputs}
            # Enrichments whose input is unchanged are carried forward as they are.
            after["enrichments"] = {k: v for k, v in before["enrichments"].items() if inputs.get(v["repository"]) == v["input"]}
            folder = f"{self.root}/revisions/{quote(view, safe='')}/{revision}-{uuid.uuid4().hex}"
            for name, frame, schema in (("override", overrides, OVERRIDE), ("extra", extra, EDGE), ("diagnostic", diagnostics, DIAGNOSTIC)):
                after[name] = None
                if frame is not None:
                    after[name] = f"{folder}/{name}"
                    frame.select(*schema.names).write.parquet(after[name])
            counts = diff(old, self.observations(after), ["from_id", "relation", "to_id"], ["evidence", "confidence", "provenance"]).first().asDict()
            self.flights.check(flight)
            self._append(view, before, after)
        return counts | {"revision": revision}

    def _write_states(self, inputs: dict[str, str], edges: DataFrame, entities: DataFrame) -> dict[str, str]:
        """The state of each repository; those that aren't there yet are written, each as a whole."""
        bad = validate_entities(entities).limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].id} has the kind {bad[0].kind!r} with the metadata {bad[0].metadata!r}")
        if "ordinal" in edges.columns:
            edges = last_wins(edges, ["_owner", "from_id", "relation", "to_id"], "ordinal")
        tables = {"observation": edges.select("_owner", *EDGE_COLUMNS), "entity": entities.select("_owner", "id", "kind", "metadata")}
        # One row for each repository.
        digests = [{r["_owner"]: r.fingerprint for r in fingerprint(x, [c for c in x.columns if c != "_owner"], ["_owner"]).collect()} for x in tables.values()]
        claimed, states = self.claimed(), {}
        for repository, fingerprint_ in inputs.items():
            state = f"{repository}-{fingerprint_}-" + "-".join(x[repository][:16] if repository in x else "empty" for x in digests)
            state = "".join(c if c.isalnum() or c in "-_." else "_" for c in state)
            states[repository] = f"{state}-{uuid.uuid4().hex[:8]}" if f"states/{state}" in claimed else state
        new = {r: s for r, s in states.items() if not self.files.exists(f"states/{s}")}
        if new:
            made = f"states/.{uuid.uuid4().hex}"
            names = F.broadcast(self.spark.createDataFrame(list(new.items()), "_owner string, _state string"))  # one row for each repository
            for name, table in tables.items():
                table.join(names, "_owner").drop("_owner").write.partitionBy("_state").parquet(f"{self.root}/{made}/{name}")
            for state in set(new.values()):
                for name in tables:
                    part = f"{made}/{name}/_state={state}"
                    if self.files.exists(part):
                        self.files.rename(part, f"{made}/whole/{state}/{name}")
                    else:  # a repository without such facts
                        self.files.fs.mkdirs(self.files.path(f"{made}/whole/{state}/{name}"))
                self.files.rename(f"{made}/whole/{state}", f"states/{state}")
            self.files.delete(made)
        return states

    def enrich(self, view: str, repository: str, analyzer: str, input_fingerprint: str, version: str, overrides: DataFrame, edges: DataFrame | None = None) -> int:
        """Publish one analyzer's result for a repository as a new revision, if the repository still has the input it was made for.

        The analyzer's earlier facts for the repository are replaced; all others stay.
        """
        from .resolve import escapes_target

        for made in (overrides, edges):
            if made is not None and (out := escapes_target(made, repository).limit(1).collect()):
                raise ValueError(f"{out[0].from_id} is not of {repository}")
        with self.flights.flight(self.FLIGHT) as flight:
            before = self.pointer(view)
            if before["inputs"].get(repository) != input_fingerprint:
                raise Stale(f"{repository} is no longer at {input_fingerprint}")
            revision = before["revision"] + 1
            owner = f"{len(analyzer)}:{analyzer}{repository}"
            base = f"{self.root}/revisions/{quote(view, safe='')}/{revision}-{uuid.uuid4().hex}"
            overrides.select(*OVERRIDE.names).write.parquet(f"{base}/override")
            if edges is not None:
                edges.select(*EDGE_COLUMNS).write.parquet(f"{base}/edge")
            entry = {"repository": repository, "analyzer": analyzer, "version": version, "input": input_fingerprint, "override": f"{base}/override", "edge": f"{base}/edge" if edges is not None else None}
            self.flights.check(flight)
            self._append(view, before, before | {"revision": revision, "enrichments": before["enrichments"] | {owner: entry}})
        return revision

    def _read(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def observations(self, pointer: dict) -> DataFrame:
        return self._read([f"{self.root}/states/{s}/observation" for s in pointer["states"].values()], EDGE)

    def entities(self, pointer: dict) -> DataFrame:
        return self._read([f"{self.root}/states/{s}/entity" for s in pointer["states"].values()], ENTITY)

    def _adjacency(self, at: dict) -> str:
        """Where the clustered edges of a revision lie: revisions with the same facts share them."""
        facts = [sorted(at["states"].values()), at.get("override"), at.get("extra"), sorted((x["override"], x["edge"] or "") for x in at["enrichments"].values())]
        return f"adjacency/{hashlib.sha256(json.dumps(facts).encode()).hexdigest()[:32]}"

    def cluster(self, view: str) -> None:
        """Cluster the current revision's edges both ways, unless they are."""
        with self.flights.flight(self.FLIGHT):
            path = self._adjacency(self.pointer(view))
            if not self.files.exists(path):
                self.graph(view).clustered(f"{self.root}/{path}")

    def graph(self, view: str):
        """The view's graph at its current revision, which is looked up once; with clustered edges, if it has such."""
        from .graph import Graph

        at = self.pointer(view)
        overrides = [x["override"] for x in at["enrichments"].values()] + ([at["override"]] if at.get("override") else [])
        edges = [x["edge"] for x in at["enrichments"].values() if x["edge"]] + ([at["extra"]] if at.get("extra") else [])
        return Graph(self.observations(at), self._read(overrides, OVERRIDE) if overrides else None, self._read(edges, EDGE) if edges else None, self.entities(at), Adjacency.open(self.spark, f"{self.root}/{self._adjacency(at)}"))

    def diagnostics(self, view: str, limit: int | None = None) -> DataFrame:
        """The diagnostics of the view's current revision, in order; at most ``limit``."""
        at = self.pointer(view).get("diagnostic")
        from .administration import ordered_diagnostics

        return ordered_diagnostics(self._read([at] if at else [], DIAGNOSTIC), limit)

    def _live(self) -> set[str]:
        """What any view's current revision names."""
        out = set()
        for view in self.views():
            at = self.pointer(view)
            out |= {f"states/{s}" for s in at["states"].values()} | {self._adjacency(at)}
            named = [at.get(k) for k in ("override", "extra", "diagnostic")] + [x[k] for x in at["enrichments"].values() for k in ("override", "edge")]
            out |= {x.removeprefix(f"{self.root}/").rpartition("/")[0] for x in named if x}
        return out

    def _unnamed(self, keep: Callable[[str], bool] = lambda s: False) -> list[str]:
        """Paths of states, revisions and clustered edges that no view names."""
        live = self._live()
        found = [f"states/{s}" for s in self.files.names("states") if not keep(s)] + [f"adjacency/{a}" for a in self.files.names("adjacency")]
        found += [f"revisions/{v}/{r}" for v in self.files.names("revisions") for r in self.files.names(f"revisions/{v}")]
        return [x for x in found if x not in live]

    def garbage(self, views: list[str] = (), limit: int | None = None, keep: Callable[[str], bool] = lambda s: False) -> list[str]:
        """The states that no view's current revision names, in order; at most ``limit``. All views of the store count, those in ``views`` or not."""
        return sorted(x.removeprefix("states/") for x in self._unnamed(keep) if x.startswith("states/"))[:limit]

    def claimed(self) -> set[str]:
        """What is to be deleted, and must not be taken."""
        return {x for name in self.files.names("gc") for x in (self.files.load(f"gc/{name}") or {"paths": []})["paths"]}

    def collect_garbage(self, views: list[str] = (), keep: Callable[[str], bool] = lambda s: False, progress: Callable[[int, int], None] = lambda done, of: None) -> list[str]:
        """Claim what no view names, and delete what is claimed and has waited for its publishers; returns the names of what went.

        ``progress`` is told how many states are done of how many. A claim that must wait, or that an interrupted collection
        left, is taken up by the next one.
        """
        claimed = self.claimed()
        if new := [x for x in self._unnamed(keep) if x not in claimed]:
            name = f"gc/{uuid.uuid4().hex}.json"
            self.files.create(name, {"paths": new, "waits_for": []})
            # Whoever set out before the claim was there is in flight now; whoever comes later sees it.
            self.files.replace(name, {"paths": new, "waits_for": self.flights.now()})
        flying = set(self.flights.now())
        claims = {n: self.files.load(f"gc/{n}") for n in self.files.names("gc")}
        ripe = {n: c["paths"] for n, c in claims.items() if c and not flying & set(c["waits_for"])}
        total, done, gone = sum(x.startswith("states/") for paths in ripe.values() for x in paths), 0, []
        progress(0, total)
        for name, paths in sorted(ripe.items()):
            for at in range(0, len(paths), self.BATCH):
                live = self._live()
                for path in paths[at : at + self.BATCH]:
                    if path not in live:
                        self.files.delete(path)
                        gone.append(path.removeprefix("states/"))
                    if path.startswith("states/"):
                        done += 1
                        progress(done, total)
                self.files.replace(f"gc/{name}", {"paths": paths[at + self.BATCH :], "waits_for": []})
            self.files.delete(f"gc/{name}")
        for view in self.views():
            self._log(view).trim(self.ENTRIES)
        return sorted(gone)

    def exclusive(self, operation: str):
        """Hold the store's lock for one operation; a second one is refused until it ends, or its time is over."""
        return self.lease.hold(operation, self.LEASE)

    def workspaces(self) -> dict[str, dict[str, str]]:
        """Registered workspaces: name to {repository: directory}."""
        try:
            return self.files.load("workspaces.json") or {}
        except json.JSONDecodeError as e:
            raise ArchgraphError("workspace.registry_failed", str(e)) from e

    def register(self, name: str, repositories: dict[str, str]) -> None:
        """Add or replace a workspace; the registry is replaced as a whole, by a rename."""
        with self.exclusive(f"register {name}"):
            self.files.replace("workspaces.json", self.workspaces() | {name: repositories})


def next_revision(revisions: DataFrame) -> DataFrame:
    """``view, revision``: one more than the view's highest, which for a view without any is 1."""
    return revisions.groupBy("view").agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Of jobs with one (workspace, repository, analyzer) the latest by ``requested``; identical ones count once."""
    keys = ["workspace", "repository", "analyzer"]
    return last_wins(jobs.withColumn("_at", F.struct("requested", "fingerprint")), keys, "_at").select(*jobs.columns)
