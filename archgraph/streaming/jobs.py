"""Streams of file changes and of enrichment jobs: debouncing, coalescing, and discarding stale results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.publish import Stale, latest_jobs

QUIET, MOST = "200 milliseconds", "2 seconds"


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(float(n) * {"millisecond": 1, "second": 1000, "minute": 60_000}[unit.rstrip("s")])


def debounce(changes: DataFrame, quiet: str = QUIET, by: tuple[str, ...] = ()) -> DataFrame:
    """Bursts of changes of a stream (or table) with a column ``ts``: a gap of ``quiet`` ends one.

    ``started, ended, changes, sources``; a change to ``*`` stands for all sources.
    """
    window = F.session_window("ts", quiet)
    out = changes.groupBy(*by, window.alias("w")).agg(F.count("*").alias("changes"), F.sort_array(F.collect_set("source")).alias("sources"))
    absorbed = F.when(F.array_contains("sources", "*"), F.array(F.lit("*"))).otherwise(F.col("sources"))
    return out.select(*by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes", absorbed.alias("sources"))


def debounce_capped(changes: DataFrame, quiet: str = QUIET, most: str = MOST, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``debounce`` over a table, but a burst also ends where it has lasted ``most``; the next change then starts another.

    Bursts first, by gaps, in a window; inside one a fold over its times, which are one
    row's, finds the cuts. ``burst, run, started, changes`` of each.
    """
    order = Window.partitionBy(*by).orderBy("ts", "source") if by else Window.orderBy("ts", "source")
    gap = (F.timestamp_diff("MILLISECOND", F.lag("ts").over(order), "ts") > _milliseconds(quiet)).cast("int")
    marked = changes.withColumn("burst", F.sum(F.coalesce(gap, F.lit(0))).over(order))
    times = marked.groupBy(*by, "burst").agg(F.sort_array(F.collect_list("ts")).alias("times"))
    kind = dict(changes.dtypes)["ts"]
    run = f"struct<started: {kind}, changes: bigint>"
    # A run is added to the list when it is over, so that a change costs no copy of the list.
    cut = f"""aggregate(times, named_struct('runs', cast(array() as array<{run}>), 'open', cast(null as {run})),
        (s, t) -> if(s.open is not null and timestampdiff(MILLISECOND, s.open.started, t) < {_milliseconds(most)},
            named_struct('runs', s.runs, 'open', named_struct('started', s.open.started, 'changes', s.open.changes + 1)),
            named_struct('runs', if(s.open is null, s.runs, concat(s.runs, array(s.open))), 'open', named_struct('started', t, 'changes', 1L))),
        s -> concat(s.runs, array(s.open)))"""
    runs = times.select(*by, "burst", F.posexplode(F.expr(cut)).alias("run", "x"))
    return runs.select(*by, "burst", "run", "x.started", "x.changes")


def accept_current(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """``results`` with ``accepted``: made for the input its repository has now; else it is late, and discarded."""
    now = inputs.select("repository", F.col("fingerprint").alias("_now"))
    return results.join(now, "repository", "left").withColumn("accepted", F.col("input_fingerprint").eqNullSafe(F.col("_now")) & F.col("_now").isNotNull()).drop("_now")


def run_jobs(jobs: DataFrame, handle, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch's latest jobs, one a (workspace, repository, analyzer), to ``handle(row)``.

    A job whose input has moved on raises ``Stale`` in the handler, and is dropped.
    """

    def batch(frame: DataFrame, number: int) -> None:
        for row in latest_jobs(frame).toLocalIterator():
            try:
                handle(row)
            except Stale:
                continue

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(spark, root: str, pattern: str = "*", max_files: int = 1000) -> DataFrame:
    """A stream of changed files below ``root``: ts, source."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    return files.select(F.col("modificationTime").alias("ts"), F.col("path").alias("source"))

