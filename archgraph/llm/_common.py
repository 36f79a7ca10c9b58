"""Helpers shared by the corpus operators: shared-folder tables, column picking, Arrow batches."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize, scratch, shared_path, shared_root  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start with ``names`` and clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = name
        while candidate.lower() in taken:
            candidate = f"_{candidate}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return df[f"`{name}`"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z, and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of a table's files that one sorted range should hold.
RANGE_BYTES = 64_000_000


#: As many as a bucketed table may have.
MOST_RANGES = 100_000


def ranges_of(rows: DataFrame) -> int:
    """Into how many ranges or buckets to deal ``rows``: by the size of the tables they come from, and at least as many as a shuffle has."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 62)  # Spark's default for a size it doesn't know is above that
    return max(shuffle_partitions(rows.sparkSession), min(MOST_RANGES, -(-size // RANGE_BYTES)))


#: Keys with more than this part of all rows are looked up by a broadcast: so many at most.
PARTS = 1024


def look_up(rows: DataFrame, known: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``known``, which has each key once and says by ``weight`` how many rows look it up.

    Keys of more than a part of ``total`` rows are broadcast, ``PARTS`` of them at most; so no
    other key's rows outweigh a task.
    """
    heavy = F.col(weight) * PARTS > total
    columns = [c for c in known.columns if c not in (*keys, weight)]
    most = known.where(heavy).select(*keys, F.struct(*columns).alias("_heavy"))
    rest = known.where(~heavy).select(*keys, F.struct(*columns).alias("_light"))
    first = rows.join(F.broadcast(most), keys, "left")
    found, others = first.where("_heavy is not null"), first.where("_heavy is null").drop("_heavy")
    light = others.join(rest, keys, "left")
    return found.select(*rows.columns, "_heavy.*").union(light.select(*rows.columns, "_light.*"))


#: Rows that are worth a file of their own in a table of the shared folder.
ROWS_A_FILE = 20_000


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than about ``rows`` rows are worth, however many a shuffle has.

    On a local store Hadoop starts a process for each file and folder that it makes.
    """
    parts = 1 + rows // ROWS_A_FILE
    return df.coalesce(parts) if parts < shuffle_partitions(df.sparkSession) else df


#: Rows and bytes handed to Python code at once: texts may be long, so both are bounded.
SLICE_ROWS, SLICE_BYTES = 2048, 3_000_000
#: Tokenizing gains by larger slices: a word is looked up once in each.
TOKEN_SLICE_BYTES = 6_000_000


def _release() -> None:
    """Give freed memory back to the system: workers live on, and share an executor's memory with its heap."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


#: What this worker remembers to save time. Workers outlive their tasks.
MEMOS: list[dict] = []


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES, remember: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of rows and bytes (a single longer row is a slice of its own).

    Unless ``remember``, the worker gives up its memos, which are of no use to this work.
    """
    pa.set_memory_pool(pa.system_memory_pool())  # other pools keep what they free
    if not remember:
        for memo in MEMOS:
            memo.clear()
    for batch in batches:
        _release()
        lengths = np.zeros(batch.num_rows, dtype=np.int64)
        for column_ in batch.columns:
            if pa.types.is_string(column_.type) or pa.types.is_binary(column_.type):
                lengths += pc.fill_null(pc.binary_length(column_), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            until = int(np.searchsorted(ends, before + size, side="right"))
            until = min(max(until, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, until - at)
            at = until


def map_columns(make: Callable[[pa.RecordBatch], list[pa.Array]], schema: pa.Schema):
    """A function for ``mapInArrow`` that turns each slice into the arrays of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays(make(part), schema=schema)

    return run


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: an existing path as it is, else by the tokenizer package."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
