"""Facts of files by what they were parsed from: a file that was parsed before is not parsed again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import identity_text
from ..plans.shared import exists, materialize

KEYS = "repository string, path string, key string, batch string"


class FactCache:
    """Tables of facts below ``root`` for one version of the analysis.

    A batch of files is written facts first, and then the keys of its files, so that what an interrupted run left is
    under no key and never read. A key is a file's repository, path and content.
    """

    def __init__(self, spark: SparkSession, root: str, version: str) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/facts/{version}"
        self.hits = self.misses = 0

    def facts(self, files: DataFrame, name: str, pattern: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``parse`` of the files whose path matches ``pattern``; only those without facts are parsed."""
        keys, table = f"{self.root}/{name}/keys", f"{self.root}/{name}/rows"
        content = F.sha2("content", 256)
        keyed = files.where(F.col("path").rlike(pattern)).select("repository", "path", F.sha2(identity_text(F.col("repository"), F.col("path"), content), 256).alias("key"))
        keyed = materialize(keyed, "file-keys")
        if exists(self.spark, keys):
            known = self.spark.read.schema(KEYS).parquet(keys).select("key", "batch")
            found = keyed.join(known.groupBy("key").agg(F.min("batch").alias("batch")), "key", "left")
        else:
            found = keyed.withColumn("batch", F.lit(None).cast("string"))
        found = materialize(found, "files-known")
        new, old = found.where("batch is null").drop("batch"), found.where("batch is not null")
        n_new, n_old = new.count(), old.count()
        self.hits, self.misses = self.hits + n_old, self.misses + n_new
        current = old
        if n_new or not exists(self.spark, table):
            batch = uuid.uuid4().hex
            asked = files.join(F.broadcast(new) if n_new <= 10_000 else new, ["repository", "path"], "left_semi")
            rows = parse(asked)
            rows.join(new.select("repository", "path", "key"), ["repository", "path"]).select(*rows.columns, "key", F.lit(batch).alias("batch")).write.mode("append").parquet(table)
            added = new.withColumn("batch", F.lit(batch))
            added.select("repository", "path", "key", "batch").write.mode("append").parquet(keys)
            current = old.unionByName(added)
        stored = self.spark.read.parquet(table)
        return stored.join(current.select("key", "batch"), ["key", "batch"], "left_semi").drop("key", "batch")
