"""Packing of tokenized documents into sequences, along a space-filling curve.

1. Each document is tokenized once; its ids are hashed to a vector of ``BUCKETS`` signed
   counts, projected to four dimensions by a fixed random matrix, put on a grid and given
   its Hilbert key. Keys, lengths and ids are a table in the shared folder.
2. The table is range-sorted by (key, doc_id): neighbours on the curve are neighbours in
   a range, and copies of one text, which share a key, are spread by their ids.
3. Each range is one stream of ids, cut at every ``length`` ids: no padding but at the
   range's end. That rest is cut into powers of two, which need none either.

Defined cases: a null text is empty and has the end id only; a document longer than a
sequence is in several; rows with one doc_id are packed each; empty tables give no rows;
other columns pass through no further, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import TOKEN_SLICE_BYTES, materialize, shuffle_partitions, slices
from .bpe import encoder
from .hilbert import hilbert_key

VOCABULARY = "byte_bpe_50k.json"
END_ID = 1
LENGTH = 2048
BUCKETS, DIMS, GRID_BITS, SEED = 256, 4, 15, 11


def document_keys(documents: list[np.ndarray], vocabulary_size: int) -> np.ndarray:
    """The Hilbert key of each document's ids."""
    rng = np.random.default_rng(SEED)
    matrix = rng.standard_normal((BUCKETS, DIMS))
    bucket = rng.integers(0, BUCKETS, vocabulary_size)
    vectors = np.zeros((len(documents), BUCKETS))
    for k, ids in enumerate(documents):
        if len(ids):
            vectors[k] = np.log1p(np.bincount(bucket[ids], minlength=BUCKETS))
    vectors -= vectors.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    points = vectors @ matrix / np.where(norm > 0, norm, 1)
    grid = (1 / (1 + np.exp(-1.7 * points)) * (1 << GRID_BITS)).astype(np.int64)
    return hilbert_key(np.clip(grid, 0, (1 << GRID_BITS) - 1), GRID_BITS)


def _tokenize(vocabulary: str, end_id: int):
    def run(batches):
        coder = encoder(vocabulary)
        size = max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        tail = np.array([end_id], dtype=coder.dtype)
        for batch in slices(batches, rows=1 << 14, size=TOKEN_SLICE_BYTES, remember=True):
            ids = coder.encode(batch.column(1).to_pylist())
            keys = document_keys(ids, size)
            whole = [np.concatenate([x, tail]).astype(coder.dtype) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys), pa.array([x.dtype.itemsize for x in whole], pa.int32()), pa.array([x.tobytes() for x in whole], pa.binary())],
                names=["doc_id", "curve_key", "id_bytes", "ids"],
            )

    return run


PIECES = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
PIECE_COLUMNS = ", ".join(f"{x} long" for x in PIECES.names)


def powers(rest: int) -> list[int]:
    """``rest`` as powers of two, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(length: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 36
        sequence, used = 0, 0
        open_: list[tuple] = []  # pieces of the open sequence, with their ids
        done: list[tuple] = []

        def flush():
            columns = list(zip(*done)) if done else [[]] * len(PIECES.names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PIECES)

        def close():
            nonlocal sequence, used
            at = 0
            for doc_id, start, ids, total in open_:
                done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")), total, base + sequence, at))
                at += len(ids)
            open_.clear()
            sequence, used = sequence + 1, 0

        def add(doc_id, ids, start, total, limit):
            nonlocal used
            while len(ids):
                part = ids[: limit - used]
                open_.append((doc_id, start, part, total))
                used += len(part)
                ids, start = ids[len(part) :], start + len(part)
                if used == limit:
                    return ids, start
            return ids, start

        for batch in slices(batches):
            for doc_id, width, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.frombuffer(packed, dtype=f"<u{width}")
                total, start = len(ids), 0
                while len(ids):
                    ids, start = add(doc_id, ids, start, total, length)
                    if used == length:
                        close()
            if len(done) >= 8192:
                yield flush()
        rest = list(open_)
        open_.clear()
        sizes, used = powers(used), 0
        for doc_id, start, ids, total in rest:
            while len(ids):
                ids, start = add(doc_id, ids, start, total, sizes[0])
                if used == sizes[0]:
                    close()
                    sizes.pop(0)
        yield flush()

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of each piece."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokenized = materialize(picked.mapInArrow(_tokenize(vocabulary, end_id), "doc_id long, curve_key long, id_bytes int, ids binary"), "tokenized")
    ranged = tokenized.repartitionByRange(shuffle_partitions(docs.sparkSession), "curve_key", "doc_id")
    ordered = ranged.sortWithinPartitions("curve_key", "doc_id", "ids")
    return ordered.select("doc_id", "id_bytes", "ids").mapInArrow(_pack(length), PIECE_COLUMNS)
