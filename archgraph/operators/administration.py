"""What administration asks of a workspace: identities of analyses, cache figures, freshness, orders and limits of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import identity_text

# Fixed value: the version of the rules over edges, part of each workspace's identity.
RULES_VERSION = "6"
DIAGNOSTIC_ORDER = ("code", "severity", "repository", "path", "line", "detail")


def analysis_identities(analyzers: DataFrame) -> DataFrame:
    """``repository, identity``: each repository's distinct analyzers (analyzer, version) in order, each name with its length; ``none`` without any."""
    bounded = F.sort_array(F.collect_set(F.when(F.col("analyzer").isNotNull(), F.struct("analyzer", "version"))))
    text = F.array_join(F.transform(bounded, lambda x: identity_text(x["analyzer"], x["version"])), "")
    return analyzers.groupBy("repository").agg(text.alias("t")).select("repository", F.when(F.col("t") == "", "none").otherwise(F.col("t")).alias("identity"))


def workspace_identities(identities: DataFrame, rules_version: str = RULES_VERSION) -> DataFrame:
    """``workspace, identity`` over rows workspace, repository, identity: a workspace has few repositories."""
    one = F.struct("repository", F.format_string("%d:%s:%d:%s", F.octet_length("repository"), F.col("repository"), F.octet_length("identity"), F.col("identity")).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_set(one)), lambda x: x["t"]), ":")
    return identities.groupBy("workspace").agg(F.concat(F.lit("repositories:"), joined, F.lit(f":core-rules:{rules_version}")).alias("identity"))


def cache_statistics(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``version, hits, misses`` of files (sha, version) in a cache (sha, version)."""
    known = cache.select("sha", "version").distinct().withColumn("hit", F.lit(True))
    found = files.join(known, ["sha", "version"], "left")
    return found.groupBy("version").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def prepare(repositories: DataFrame, cache: DataFrame) -> DataFrame:
    """``repository, identity, fingerprint, cached``: what is analyzed as now (same identity and input) needs no analysis. ``cache``: repository, identity, fingerprint."""
    known = cache.select("repository", "identity", "fingerprint").distinct().withColumn("_known", F.lit(True))
    return repositories.join(known, ["repository", "identity", "fingerprint"], "left").select("repository", "identity", "fingerprint", F.col("_known").isNotNull().alias("cached"))


def freshness(views: DataFrame, dirty: DataFrame, active: DataFrame) -> DataFrame:
    """``view, revision, stale, indexing, dirty_repositories`` of views: what an answer says on its own age.

    ``dirty``: view, repository (null: changed as a whole). ``active``: view, of running and queued jobs.
    """
    changed = dirty.groupBy("view").agg(F.sort_array(F.collect_set("repository")).alias("dirty_repositories"))
    busy = active.select("view").distinct().withColumn("busy", F.lit(True))
    found = views.join(changed, "view", "left").join(busy, "view", "left")
    none = F.expr("cast(array() as array<string>)")
    return found.select("view", "revision", F.col("dirty_repositories").isNotNull().alias("stale"), F.col("busy").isNotNull().alias("indexing"), F.coalesce("dirty_repositories", none).alias("dirty_repositories"))


def ordered_diagnostics(diagnostics: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct diagnostics in order, nulls first; at most ``limit``."""
    out = diagnostics.distinct().orderBy(*DIAGNOSTIC_ORDER)
    return out if limit is None else out.limit(limit)


def garbage_queue(queue: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` states that wait for collection, by the time they were queued."""
    return queue.orderBy("queued", "state").limit(limit)


def differing_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with ``side``: empty where a state may be reused. Repeated rows count."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def first_evidence_paths(tests: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, path`` of each test: the first path among its edges' evidence, by (to_id, relation order) and place; without one ``unknown source``.

    ``edges`` are merged ones: from_id, to_id, relation, evidence (structs with path).
    """
    from ..functions.ids import relation_rank

    first = F.try_element_at(F.filter("evidence", lambda e: e["path"].isNotNull()), F.lit(1))["path"]
    placed = edges.select(F.col("from_id").alias("id"), F.struct("to_id", relation_rank(F.col("relation")).alias("r")).alias("at"), first.alias("path")).where("path is not null")
    found = placed.groupBy("id").agg(F.min_by("path", "at").alias("path"))
    return tests.select("id").join(found, "id", "left").select("id", F.coalesce("path", F.lit("unknown source")).alias("path"))


def reconciliations(changes: DataFrame, every: int = 60) -> DataFrame:
    """Changes (ts, source) with one to all sources, ``*``, for each ``every`` seconds that saw any: what a missed event left is found at the next."""
    ticks = changes.select(F.window("ts", f"{every} seconds")["end"].alias("ts"), F.lit("*").alias("source")).distinct()
    return changes.select("ts", "source").union(ticks)
