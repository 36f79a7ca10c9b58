"""Digests by directory, and a watched tree: what is created, changed, deleted and changed back."""

import os
import random

import pytest
from pyspark.sql import functions as F

from archgraph.sources import trees
from archgraph.sources.trees import Watch


def frame(spark, files):
    rows = [("r", p, c) for p, c in files.items()]
    return spark.createDataFrame(rows, "repository string, path string, content string").withColumn("digest", trees.file_digest(F.col("path"), F.sha2("content", 256)))


def test_changed_directories_are_those_above_changed_files(spark):
    rnd = random.Random(3)
    before = {f"{rnd.choice('ab')}/{rnd.choice('cd')}/{rnd.choice('ef')}{i}" if i % 5 else f"top{i}": str(rnd.random()) for i in range(60)}
    after = dict(before)
    names = sorted(before)
    after[names[3]] = "changed"
    del after[names[20]]
    after["a/new/file"] = "created"
    assert spark.createDataFrame([("a/b/c",), ("x",)], "p string").select(trees.ancestors(F.col("p")).alias("a")).collect() == [(["", "a", "a/b"],), ([""],)]
    changed = {names[3], names[20], "a/new/file"}
    above = lambda p: {"/".join(p.split("/")[:k]) for k in range(p.count("/") + 1)}
    count = lambda files, d: sum(d in above(p) for p in files) or None
    want = {(d, count(before, d), count(after, d)) for p in changed for d in above(p)}
    digests = [trees.directory_digests(frame(spark, x)) for x in (before, after)]
    found = trees.changed_directories(*digests)
    assert {(r.directory, r.files_before, r.files_after) for r in found.collect()} == want
    kinds = {(r.path, r.kind) for r in trees.changed_files(frame(spark, before), frame(spark, after)).collect()}
    assert kinds == {(names[3], "changed"), (names[20], "deleted"), ("a/new/file", "created")}
    assert "collect_list" not in digests[0]._jdf.queryExecution().toString()


def test_fingerprints_ignore_order_only(spark):
    files = {f"d/f{i}": str(i) for i in range(50)}
    value = lambda x: trees.tree_fingerprint(frame(spark, x)).first().fingerprint
    plain = value(files)
    assert trees.tree_fingerprint(frame(spark, files).repartition(7, "content")).first().fingerprint == plain
    swapped = files | {"d/f1": "2", "d/f2": "1"}
    assert len({plain, value(swapped), value({k: v for k, v in files.items() if k != "d/f9"}), value(files | {"e": "1"})}) == 4
    assert "collect_list" not in trees.tree_fingerprint(frame(spark, files))._jdf.queryExecution().toString()


def test_a_watched_tree(spark, tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)

    def write(name, text, at):
        (root / name).write_text(text)
        os.utime(root / name, (at, at))

    def drain():
        """What a stream that goes on from its checkpoint has seen so far."""
        watch.stream().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "seen")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.poll, r.source.rsplit("/", 1)[1], r.kind) for r in spark.read.schema(Watch.SCHEMA).parquet(str(tmp_path / "seen")).collect())

    watch = Watch(spark, f"file://{root}", f"file://{tmp_path}/watch", full_every=3)
    write("src/a.rs", "one", 1000)
    write("src/b.rs", "two", 1000)
    assert watch.poll() == 2 and watch.poll() == 0
    assert drain() == [(1, "a.rs", "created"), (1, "b.rs", "created")]
    write("src/a.rs", "changed", 2000)
    (root / "src/b.rs").unlink()
    write("src/c.rs", "new", 2000)
    assert watch.poll() == 3
    write("src/a.rs", "one", 3000)  # changed back
    # Another driver goes on from the log.
    watch = Watch(spark, f"file://{root}", f"file://{tmp_path}/watch", full_every=3)
    assert watch.poll() == 1
    want = [(1, "a.rs", "created"), (1, "b.rs", "created"), (3, "a.rs", "changed"), (3, "b.rs", "deleted"), (3, "c.rs", "created"), (4, "a.rs", "changed")]
    assert drain() == want
    write("src/c.rs", "odd", 2000)  # neither length nor time tells
    assert [watch.poll(), watch.poll(), watch.poll()] == [0, 0, 1]
    assert drain() == [*want, (7, "c.rs", "changed")]


def test_an_interrupted_poll_loses_nothing(spark, tmp_path, monkeypatch):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a").write_text("x")
    watch = Watch(spark, f"file://{root}", f"file://{tmp_path}/watch", most=2)
    monkeypatch.setattr(watch, "_show", lambda number, entry: (_ for _ in ()).throw(RuntimeError("the driver is gone")))
    with pytest.raises(RuntimeError):
        watch.poll()
    watch = Watch(spark, f"file://{root}", f"file://{tmp_path}/watch", most=2)
    for k in range(3):
        (root / f"b{k}").write_text("y")
    assert watch.poll() == 1
    rows = spark.read.schema(Watch.SCHEMA).parquet(f"file://{tmp_path}/watch/changes").orderBy("poll").collect()
    assert [(r.poll, r.source.rsplit("/", 1)[-1]) for r in rows] == [(1, "a"), (2, "*")]
    # A poll whose number another one took leaves nothing.
    plain = watch.log.append
    monkeypatch.setattr(watch.log, "append", lambda number, entry: plain(number, {"inventory": entry["inventory"], "batch": None, "full": None}) and False)
    (root / "c").write_text("z")
    assert watch.poll() == 0
