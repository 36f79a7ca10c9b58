"""Exact duplicates by a heavy-hitter split: Misra-Gries, broadcast winners, ordinary shuffle for the rest.

Texts are equal when identical after lower-casing A-Z only; equality is that of the SHA-256
of the normalised text. Of equal texts the row with the largest doc_id stays.

1. One pass over the texts makes ``doc_id, sha``, a table in the shared folder.
2. Each task sums its digests into a Misra-Gries summary of ``counters`` entries; the
   summaries are merged by digest. A digest with more than 1 / (counters + 1) of all rows
   is always among the entries; the merged table's largest ``counters`` are candidates.
3. The candidates' exact counts and winners come from an aggregate with map-side partial
   sums: at most ``counters`` rows. That bounded table is broadcast, and settles the hot
   digests' rows where they lie.
4. All other digests have few rows each, and one window over a shuffle settles them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, map_columns, materialize, slices

COUNTERS = 1024


def text_digest(text: str | None) -> bytes:
    # bytes.lower changes A-Z only, and UTF-8 has those bytes for those letters only.
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()


def _digests(batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column(0), pa.array([text_digest(x) for x in batch.column(1).to_pylist()], pa.binary())]


def digests(docs: DataFrame) -> DataFrame:
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(map_columns(_digests, pa.schema([("doc_id", pa.int64()), ("sha", pa.binary())])), "doc_id long, sha binary")


def _summaries(counters: int, at: int):
    """For ``mapInArrow``: the frequent items of column ``at`` with at most ``counters`` entries; each count is short by at most n / (counters + 1)."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            # A batch's own counts first: one subtraction settles many items at once.
            counts = batch.column(at).value_counts()
            for item, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
                held[item] = held.get(item, 0) + n
            if len(held) > counters:
                least = sorted(held.values(), reverse=True)[counters]
                held = {k: v - least for k, v in held.items() if v > least}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["sha", "n"])

    return run


def frequent(hashed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests of ``hashed`` (column sha): each with over 1 / (counters + 1) of the rows is among them."""
    parts = hashed.select("sha").mapInArrow(_summaries(counters, 0), "sha binary, n long")
    return parts.groupBy("sha").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sha").limit(counters).select("sha")


def _winners(hashed: DataFrame, counters: int) -> DataFrame:
    hot = hashed.join(F.broadcast(frequent(hashed, counters)), "sha", "left_semi")
    exact = hot.groupBy("sha").agg(F.max("doc_id").alias("hot_keep"), F.count("*").alias("hot_size")).where("hot_size > 1")
    return materialize(exact, "winners")


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Defined cases: null texts equal empty ones; of rows that share both text and largest
    doc_id one is kept; null ids are smaller than any; an empty table gives no rows; very
    long texts are hashed whole; other columns pass through no further, whatever their names.
    """
    hashed = materialize(digests(docs), "digests")
    winners = _winners(hashed, counters)
    marked = hashed.join(F.broadcast(winners), "sha", "left")
    # Hot rows are settled in place. Rows that tie with the winner's id are few; a window settles them.
    lost = marked.where("hot_size is not null and not (doc_id <=> hot_keep)").selectExpr("doc_id", "hot_keep as keep_id", "hot_size as group_size", "false as kept", "sha")
    tie = Window.partitionBy("sha").orderBy("doc_id")
    won = marked.where("hot_size is not null and doc_id <=> hot_keep").withColumn("rank", F.row_number().over(tie))
    won = won.selectExpr("doc_id", "hot_keep as keep_id", "hot_size as group_size", "rank = 1 as kept", "sha")
    of = Window.partitionBy("sha")
    rest = marked.where("hot_size is null").select(
        "doc_id", F.max("doc_id").over(of).alias("keep_id"), F.count("*").over(of).alias("group_size"),
        (F.row_number().over(of.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"), "sha",
    )
    return lost.union(won).union(rest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_largest(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The digest is made beside the row, so that hot rows are removed where they lie, and each
    other row is shuffled once, by its digest.
    """
    sha, keep, size, rank = fresh(docs, "_sha", "_keep", "_size", "_rank")
    at = docs.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{sha}` binary"])

    def run(batches):
        for part in slices(batches):
            yield part.append_column(sha, pa.array([text_digest(x) for x in part.column(at).to_pylist()], pa.binary()))

    winners = _winners(materialize(digests(docs), "digests"), counters).selectExpr(f"sha as `{sha}`", f"hot_keep as `{keep}`", f"hot_size as `{size}`")
    marked = docs.mapInArrow(run, schema).join(F.broadcast(winners), sha, "left")
    marked = marked.where(f"`{size}` is null or cast(doc_id as long) <=> `{keep}`")
    order = Window.partitionBy(sha).orderBy(F.col("doc_id").cast("long").desc_nulls_last())
    return marked.withColumn(rank, F.row_number().over(order)).where(f"`{rank}` = 1").select(*(f"`{c}`" for c in docs.columns))
