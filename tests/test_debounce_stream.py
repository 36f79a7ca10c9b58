"""Capped debouncing of a stream equals the fold over a table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from archgraph.streaming import jobs
from archgraph.streaming.debounce import PROVIDER, debounce_stream


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, batches, schema, by, quiet, most, delay):
    """The runs of a stream whose batches are these frames."""
    data = tmp_path / "in"
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(str(data / f"b={k:03d}"))
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(data)).drop("b")
    query = debounce_stream(changes, by, quiet, most, delay).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out")), query


def test_stream_equals_the_fold_over_a_table(rocks, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = [0, 100, 250, 700, 5000, *range(5150, 8300, 150)]
    rows = [(t0 + timedelta(milliseconds=x), w) for x in at for w in ("w1", "w2") if w == "w1" or x % 100 == 0]
    schema = "ts timestamp, workspace string"
    # Changes come late and out of order, within the delay; the last one only moves the watermark on.
    batches = [rows[1:4] + rows[6:9], rows[:1] + rows[4:6] + rows[9:20][::-1], rows[20:], [(t0 + timedelta(minutes=5), "end")]]
    frames = [rocks.createDataFrame(x, schema) for x in batches]
    found, query = run(rocks, tmp_path, frames, schema, ("workspace",), jobs.QUIET, jobs.MOST, "10 seconds")
    want = jobs.debounce_capped(rocks.createDataFrame(rows, schema).withColumn("source", F.lit("s")), by=("workspace",)).select("workspace", "started", "changes")
    assert sorted(map(tuple, found.where("workspace <> 'end'").collect())) == sorted(map(tuple, want.collect()))
    assert {r.changes for r in found.where("workspace = 'w1'").collect()} == {3, 1, 14, 8}
    # What is left is the open run of the last key; no other key has a row.
    assert query.lastProgress is None or all(s["numRowsTotal"] <= 12 for s in query.lastProgress["stateOperators"])


def test_given_events(rocks, tmp_path, sf_dir):
    events = rocks.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("user_id")).where("ts is not null and user_id % 4 = 1")
    ordered = events.orderBy("ts").collect()
    schema = "ts timestamp, user_id long"
    parts = [ordered[k : k + len(ordered) // 4 + 1] for k in range(0, len(ordered), len(ordered) // 4 + 1)]
    frames = [rocks.createDataFrame(x[::-1], schema) for x in parts]
    frames.append(rocks.createDataFrame([(ordered[-1].ts + timedelta(days=400), -1)], schema))
    found, _ = run(rocks, tmp_path, frames, schema, ("user_id",), "600 minutes", "1200 minutes", "300 days")
    want = jobs.debounce_capped(events.withColumn("source", F.lit("s")), "600 minutes", "1200 minutes", ("user_id",)).select("user_id", F.date_trunc("millisecond", "started").alias("started"), "changes")
    key = lambda rows: sorted((r.user_id, r.started, r.changes) for r in rows)
    assert key(found.where("user_id > 0").collect()) == key(want.collect())
