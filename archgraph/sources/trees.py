"""Digests of source trees by directory, inventories, and what changed between two of them.

A directory's digest is a set digest of all files below it: sums, modulo 2 ** 64 in several lanes, of each
file's digest over its place and content. Sums are worked out with a map-side part, so no row
ever gathers the files of a directory or of a repository, and one aggregate over the files' ancestors has the digests of all levels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import identity_text
from ..operators.files import Files, Log

#: Lanes of 48 bits that a file's digest is summed in.
LANES = 5


def file_digest(path: Column, *facts: Column) -> Column:
    """SHA-256, in hex, of a file's path and what is known of it."""
    return F.sha2(identity_text(path, *(F.coalesce(x.cast("string"), F.lit("\0")) for x in facts)), 256)


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root, which is the empty text, to its own."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def set_digest(digest: Column) -> list[Column]:
    """Aggregates, by name, of which the order of rows and how they are dealt out are no part."""
    return [F.count("*").alias("files"), *(F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"_lane{k}") for k in range(LANES))]


def directory_digests(files: DataFrame) -> DataFrame:
    """``repository, directory, files, digest`` of each directory of ``repository, path, digest`` rows, the root included."""
    each = files.select("repository", F.explode(ancestors(F.col("path"))).alias("directory"), "digest")
    sums = each.groupBy("repository", "directory").agg(*set_digest(F.col("digest")))
    return sums.select("repository", "directory", "files", F.sha2(F.concat_ws(",", "files", *(f"_lane{k}" for k in range(LANES))), 256).alias("digest"))


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """``repository, fingerprint`` of ``repository, path, content`` rows: the digest of each repository's root.

    Contents are hashed where they lie; what is shuffled is a row of sums for each repository and task.
    """
    hashed = files.select("repository", file_digest(F.col("path"), F.sha2("content", 256)).alias("digest"))
    sums = hashed.groupBy("repository").agg(*set_digest(F.col("digest")))
    return sums.select("repository", F.sha2(F.concat_ws(",", "repository", "files", *(f"_lane{k}" for k in range(LANES))), 256).alias("fingerprint"))


def changed_directories(before: DataFrame, after: DataFrame) -> DataFrame:
    """``repository, directory, files_before, files_after`` of the directories whose digests differ; a new or lost one has null for a side.

    ``before`` and ``after`` are rows of ``directory_digests``; a changed file changes the directories above it, and no others.
    """
    keys = ["repository", "directory"]
    a = before.select(*keys, F.col("files").alias("files_before"), F.col("digest").alias("_before"))
    b = after.select(*keys, F.col("files").alias("files_after"), F.col("digest").alias("_after"))
    return a.join(b, keys, "full_outer").where("not (_before <=> _after)").select(*keys, "files_before", "files_after")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``repository, path, kind`` of files that were created, changed or deleted; ``before`` and ``after`` have repository, path, digest."""
    keys = ["repository", "path"]
    both = before.select(*keys, F.col("digest").alias("_before")).join(after.select(*keys, F.col("digest").alias("_after")), keys, "full_outer")
    kind = F.when(F.col("_before").isNull(), "created").when(F.col("_after").isNull(), "deleted").otherwise("changed")
    return both.where("not (_before <=> _after)").select(*keys, kind.alias("kind"))


class Watch:
    """A directory tree that is watched by inventories, in any store that Spark lists.

    Each poll lists the tree, and the difference to the last inventory is one batch of a change log; a stream reads
    that log, and its checkpoint says how far. A log entry is what makes a poll count, and is written once:
    a poll that is interrupted leaves nothing, and what it would have found is found by the next one. Every ``full_every`` polls contents
    are read, too, so that a change that kept a file's length and time is found. More than ``most`` changes of one
    poll are one row with the source ``*``, which stands for all.

    Changes that are made and taken back between two polls are one change where the file's time differs, else none.
    """

    SCHEMA = "ts timestamp, source string, kind string, poll long"
    INVENTORY = "repository string, path string, digest string, content string"

    def __init__(self, spark: SparkSession, root: str, state: str, pattern: str = "*", full_every: int = 0, most: int = 10_000) -> None:
        self.spark, self.root, self.state, self.pattern, self.full_every, self.most = spark, root, state.rstrip("/"), pattern, full_every, most
        self.files = Files(spark, self.state)
        self.log = Log(self.files, "polls")

    def _listed(self, full: bool) -> DataFrame:
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", self.pattern).load(self.root)
        content = F.sha2("content", 256) if full else F.lit(None).cast("string")
        return found.select(F.lit("").alias("repository"), "path", file_digest(F.col("path"), F.col("length"), F.col("modificationTime")).alias("digest"), content.alias("content"))

    def _inventory(self, entry: dict | None) -> DataFrame:
        if not entry:
            return self.spark.createDataFrame([], self.INVENTORY)
        return self.spark.read.schema(self.INVENTORY).parquet(f"{self.state}/{entry['inventory']}")

    def poll(self) -> int:
        """List the tree once; returns how many rows the change log got."""
        number = self.log.last()
        last = self.log.load(number)
        full = bool(self.full_every) and number % self.full_every == 0
        name = uuid.uuid4().hex
        self._listed(full).write.parquet(f"{self.state}/inventories/{name}")
        now = self._inventory({"inventory": f"inventories/{name}"})
        before = self._inventory(last)
        changes = changed_files(before, now)
        if full:
            # Files whose length and time are as they were, and whose content isn't what the last full pass read.
            known = self._inventory(self._last_full(last)).select("path", F.col("digest").alias("_digest"), F.col("content").alias("_content"))
            silent = now.join(known, "path").where("digest = _digest and content <> _content").select("repository", "path", F.lit("changed").alias("kind"))
            changes = changes.union(silent).distinct()
        rows = changes.select(F.current_timestamp().alias("ts"), F.col("path").alias("source"), "kind")
        if (n := rows.count()) > self.most:
            rows, n = self.spark.range(1).select(F.current_timestamp().alias("ts"), F.lit("*").alias("source"), F.lit("changed").alias("kind")), 1
        batch = f"batches/.{name}"
        if n:
            rows.withColumn("poll", F.lit(number + 1).cast("long")).coalesce(1).write.parquet(f"{self.state}/{batch}")
        entry = {"inventory": f"inventories/{name}", "batch": batch if n else None, "full": f"inventories/{name}" if full else (last or {}).get("full")}
        if not self.log.append(number, entry):
            return 0  # another poll was faster
        self._show(number + 1, entry)
        self._trim(number, last, entry)
        return n

    def _last_full(self, entry: dict | None) -> dict | None:
        return {"inventory": entry["full"]} if entry and entry.get("full") else None

    def _show(self, number: int, entry: dict) -> None:
        """Put a poll's batch where the stream reads; of one that was interrupted before, the next poll does it."""
        if entry["batch"] and self.files.exists(entry["batch"]):
            for part in self.files.names(entry["batch"]):
                if part.startswith("part-"):
                    self.files.rename(f"{entry['batch']}/{part}", f"changes/{number:020d}-{part}")
            self.files.delete(entry["batch"])

    def _trim(self, number: int, last: dict | None, entry: dict) -> None:
        if last:
            self._show(number, last)
            if last["inventory"] != entry["full"]:
                self.files.delete(last["inventory"])
        if last and last.get("full") and last["full"] != entry["full"]:
            self.files.delete(last["full"])
        self.log.trim(10)

    def stream(self) -> DataFrame:
        """``ts, source, kind, poll`` of the changes, each once."""
        self.files.fs.mkdirs(self.files.path("changes"))
        return self.spark.readStream.schema(self.SCHEMA).parquet(f"{self.state}/changes")

    def every(self, interval: str, checkpoint: str):
        """Poll at each ``interval``, in a query of its own."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda frame, number: self.poll()).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
