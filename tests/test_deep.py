"""Pointer doubling against plain searches: chains, rings, branches, and starts anywhere."""

import random

from pyspark.sql import functions as F

from archgraph.plans.deep import contract, deep_closure


def reach(pairs, starts):
    seen, todo = set(starts), list(starts)
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    while todo:
        for x in after.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def test_equals_a_plain_search(spark):
    rnd = random.Random(5)
    pairs = set()
    at = 0
    for _ in range(7):  # chains
        n = rnd.randint(1, 40)
        pairs |= {(at + k, at + k + 1) for k in range(n)}
        at += n + 2
    for n in (1, 2, 5, 16):  # rings
        pairs |= {(at + k, at + (k + 1) % n) for k in range(n)}
        at += n
    chained = at
    pairs |= {(rnd.randrange(chained - 24), rnd.randrange(chained - 24)) for _ in range(12)}  # branches, some of them back
    frame = spark.createDataFrame(sorted(pairs) + [(None, 1), (1, None)], "from_id long, to_id long")
    for starts in ([0], [20], [chained - 1], [chained - 20], [7, 90], [10_000]):
        got = [r.node for r in deep_closure(frame, spark.createDataFrame([(s,) for s in starts], "node long")).collect()]
        assert len(got) == len(set(got)) and set(got) == reach(pairs, starts), starts
    assert deep_closure(frame.where("false"), spark.createDataFrame([(3,)], "node long")).collect() == [(3,)]


def test_rounds_are_logarithmic(spark):
    chain = spark.range(20_000).select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    found = contract(chain)
    assert found.rounds <= 16 and found.chains.where("head = 0 and place = node").count() == 20_001 and found.joints.isEmpty()


def test_rows_that_are_written_grow_with_the_links_only(spark, monkeypatch):
    from archgraph.plans import deep

    written = []

    def counted(df, label, write=deep.materialize):
        table = write(df, label)
        written.append(table.count())
        return table

    monkeypatch.setattr(deep, "materialize", counted)
    monkeypatch.setattr(deep, "HELD", 200, raising=False)
    n = 20_000
    chain = spark.range(n).select((F.col("id") * 7919 % (n + 1)).alias("from_id"), ((F.col("id") + 1) * 7919 % (n + 1)).alias("to_id"))
    ring = spark.range(3000).select((F.col("id") + n + 1).alias("from_id"), ((F.col("id") + 1) % 3000 + n + 1).alias("to_id"))
    found = contract(chain.union(ring))
    assert sum(written) < 10 * (n + 3000)
    assert found.chains.count() == n + 1 + 3000 and found.chains.where(f"node <= {n} and head = 0 and node = place * 7919 % {n + 1}").count() == n + 1
    assert found.chains.where(f"head = {n + 1} and place = node - head").count() == 3000 and found.rings.collect() == [(n + 1,)]
