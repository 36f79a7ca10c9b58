"""Token ids of a corpus in Simple-8b files, in ascending doc_id order, and their reading.

The documents are range-partitioned and sorted by doc_id, then each task tokenizes its
range and writes images (simple8b.py) of whole documents, in order. Images are the rows
of a table whose files Spark's writer commits, so a lost task leaves no half file, in any
store Spark can write. Each image knows how many ids its range holds before it; the ids
before each range are a running sum over one number for each range, on the driver.

Defined cases: null texts are empty, and still have the end id; rows with one doc_id are
ordered by their text; null ids come first; empty tables give no rows;
very long texts are encoded whole; other columns pass through no further, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import TOKEN_SLICE_BYTES, shared_path, shuffle_partitions, slices
from .bpe import encoder
from .simple8b import from_image, to_image

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Ids at which an image is closed; a longer document makes a longer image.
IMAGE_IDS = 1 << 18
TABLE = "part int, image_no int, before long, n_docs long, n_ids long, image binary"


def _write_images(vocabulary: str, end_id: int | None):
    def run(batches):
        coder = encoder(vocabulary)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, held, size = [], [], 0

        def close():
            image = to_image(doc_ids, held)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "image_no": number, "before": before, "n_docs": len(held), "n_ids": size, "image": image}],
                schema=pa.schema([("part", pa.int32()), ("image_no", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())]),
            )

        kind = coder.dtype if end_id is None or end_id < 1 << 16 else np.dtype("<u4")
        tail = np.zeros(0, kind) if end_id is None else np.array([end_id], kind)
        for batch in slices(batches, rows=1 << 14, size=TOKEN_SLICE_BYTES, remember=True):
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                doc_ids.append(doc_id)
                held.append(np.concatenate([ids.astype(kind, copy=False), tail]))
                size += len(held[-1])
                if size >= IMAGE_IDS:
                    yield close()
                    number, before = number + 1, before + size
                    doc_ids, held, size = [], [], 0
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = END_ID) -> str:
    """Write the ids of all documents under ``path``; returns the path."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = picked.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")).mapInArrow(_write_images(vocabulary, end_id), TABLE).write.option("compression", "none").parquet(path)
    return path


def _read_images(base: dict[int, int]):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, before = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                doc_ids, lengths, ids = from_image(batch.column(2)[row].as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + before + base[part], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def range_starts(table: DataFrame) -> dict[int, int]:
    """Ids before each range: a running sum over one row for each range."""
    sums = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    out, total = {}, 0
    for part, n in sums:
        out[part], total = total, total + n
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files."""
    stored = spark.read.schema(TABLE).parquet(path)
    return stored.select("part", "before", "image").mapInArrow(_read_images(range_starts(stored)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_round(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int | None = END_ID) -> DataFrame:
    """Write the documents' tokens to the shared folder, and read them back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, shared_path(spark, "tokens"), vocabulary, end_id))
