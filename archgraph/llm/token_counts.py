"""Token counts through a digest cache.

A cache table maps (tokenizer digest, digest of the normalised content) to a count. The
texts' digests are joined to it; of the misses each distinct text is encoded once, and its
count is appended. The result is a join of all rows' digests to the cache.

Normalised content is the text itself, null as the empty text: any other change could
change a count. The tokenizer's digest is of its file and the library's version, so that
another tokenizer or library never reads old counts.

Distinct misses are an aggregate with a map-side part, so a text that a third of all rows
share reaches the encoder once. Concurrent writers may append a digest twice, with the
same count: reading takes one.

Defined cases: null ids and repeated rows are counted each; the empty text has 0 tokens;
very long texts are encoded whole; an empty table gives no rows; other columns pass through no
further, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shared_root, slices, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = "content binary, n_tokens long, tokenizer string"


@lru_cache(maxsize=4)
def tokenizer_digest(name: str) -> str:
    library = "sentencepiece" if name.endswith(".model") else "tokenizers"
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f"{library} {version(library)} ".encode() + f.read()).hexdigest()


@lru_cache(maxsize=2)
def _counter(name: str):
    """A function from texts to their counts, by the file's library."""
    if name.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _count(name: str):
    def run(batches):
        count = _counter(name)
        for batch in slices(batches):
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """``content, n_tokens`` of the cache at ``path`` for one tokenizer; empty where there is no cache yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/tokenizer={tokenizer}")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], "content binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer).select("content", "n_tokens")


def count_tokens(docs: DataFrame, cache: str | None = None, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    ``cache`` is the cache table's path, by default one in the shared folder.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_root(spark)}/archgraph/token-counts"
    tokenizer = tokenizer_digest(vocabulary)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.unhex(F.sha2(text, 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    misses = docs.select(content.alias("content"), text.alias("text")).join(read_cache(spark, cache, tokenizer), "content", "left_anti")
    distinct = misses.groupBy("content").agg(F.first("text").alias("text"))
    counted = distinct.mapInArrow(_count(vocabulary), "content binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    known = read_cache(spark, cache, tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
