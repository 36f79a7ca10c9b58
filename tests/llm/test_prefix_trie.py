"""The prefix trie of conversations against a trie that is built by hand."""

import hashlib
import random
import zlib

from archgraph.llm import prefix_trie as operator
from archgraph.llm.prefix_trie import look_up, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, DEPTH string, owner int"


def brute(rows):
    """{path: node} by definition; turns in the order of their conversation."""
    by_conv = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            by_conv.setdefault(conv_id, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    original = {c: [x[3:] for x in sorted(t)] for c, t in by_conv.items()}
    nodes, full = {}, {}
    for c in original:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(original.get(base, [])[:h] + original[c][h:])
        full[c] = path
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        ends = ",".join(map(str, sorted(c for c in members if full[c] == path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:16]


def check(spark, rows, parts=None):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = prefix_trie(frame if parts is None else frame.repartition(parts))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows), key=key)


def test_random_conversations(spark):
    rnd = random.Random(2)
    rows = []
    for c in [*range(-12, 40), 1 << 62, (1 << 63) - 1, -(1 << 63)]:
        for turn in range(rnd.randint(1, 12)):
            rows.append((c, rnd.choice([turn, turn, turn, None, 3]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "b", "", None, "é", "user:a"])))
    rows += [(None, 1, "user", "nobody's"), *rows[:7]]
    rnd.shuffle(rows)
    check(spark, rows, 3)


def test_a_long_conversation_over_several_ranges(spark, monkeypatch):
    """One conversation has most rows, and copies share long paths: ranges begin inside them."""
    rnd = random.Random(3)
    long_ = [("user", rnd.choice("ab")) for _ in range(70)]
    rows = [(c, t, r, x) for c in (100, 105, 110, 111, 112) for t, (r, x) in enumerate(long_ if c != 112 else long_[:40])]
    rows += [(c, 0, "user", "hello") for c in range(7)]
    monkeypatch.setattr(operator, "ranges_of", lambda rows: 9)
    check(spark, rows, 3)


def test_turnless_conversations_and_an_empty_table(spark):
    alone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    check(spark, [(alone, 1, "user", "a"), (alone, 2, "user", "b")])
    check(spark, [(alone, 1, "user", "a"), (alone + 1000 - alone % 5, 0, "user", "b"), (None, 0, "user", "c")])
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text_and_many_copies(spark):
    rows = [(c, t, "user", x) for c in range(0, 60, 5) for t, x in enumerate(["long " * 50_000, "short", "é" * 1000])]
    check(spark, rows)


def test_blocks_of_ids_hash_as_one_text(spark, monkeypatch):
    monkeypatch.setattr(operator, "ranges_of", lambda rows: 5)
    rows = [(c, 0, "user", "same") for c in range(0, 45_000, 5)]
    got = {r.depth: r for r in prefix_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    ids = [c for c in range(0, 45_000, 5)]
    # With no shared turns or with some, each is rebuilt to its one turn.
    assert got[1].n_convs == len(ids) and got[1].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[0].saved_tokens == (len(ids) - 1) * 4


def test_look_up_of_heavy_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(600)], "k long, v long")
    known = rows.groupBy("k").count().selectExpr("k", "count as w", "k * 2 as twice").where("k <> 3")
    got = look_up(rows, known, ["k"], "w", 600)
    assert sorted(tuple(r) for r in got.select("k", "v", "twice").collect()) == sorted((k, i, None if k == 3 else 2 * k) for i in range(600) for k in [1 if i % 3 else i])
