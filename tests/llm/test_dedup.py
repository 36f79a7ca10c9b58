"""Quality rules, exact, near and line duplicates against brute force on small tables."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from archgraph.llm import components, exact_dedup, line_dedup, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha binary, component_id string, fp string, h long, rank int, _kept int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, b"x", "c", "f", 1, 2, 3) for i, t in rows], SCHEMA)


def words(rnd, n, size=60):
    return " ".join("w%d" % rnd.randrange(size) for _ in range(n))


def corpus():
    rnd = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "É"), (7, "é"), (8, "x" * 200_000)]
    base = [words(rnd, 120, 4000) for _ in range(12)]
    for k, text in enumerate(base):
        for c in range(k):
            edited = text.split(" ")
            for _ in range(c % 4):
                edited[rnd.randrange(len(edited))] = "edit%d" % rnd.randrange(50)
            rows.append((100 * k + c + 10, " ".join(edited).upper() if c % 3 == 2 else " ".join(edited)))
    rows += [(5000 + i, "hot copy of one text") for i in range(300)] + [(5000, "hot copy of one text"), (None, "hot copy of one text"), (7000, "one")]
    return rows


def test_fingerprint_by_definition():
    def slow(text):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    for _, text in corpus():
        assert simhash.fingerprint(text) == slow(text)


def test_near_duplicates(spark):
    rows = corpus()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(make(spark, rows)).collect()}
    fps = {}
    for i, t in rows:
        fps.setdefault(simhash.fingerprint(t), []).append(i)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for f, ids in fps.items():
        least[find(f)] = min([*(i for i in ids if i is not None), least.get(find(f), 1 << 60)])
    assert got == {(i, "%016x" % f): least[find(f)] for f, ids in fps.items() for i in ids}
    assert len({*got.values()}) < len(fps)


@pytest.mark.parametrize("part", [2, 16, simhash.PART])
def test_links_of_a_dense_group(spark, part):
    rng = np.random.default_rng(2)
    fps = {int(rng.integers(0, 1 << 63)) for _ in range(300)}
    for c in list(fps)[:4]:
        for _ in range(80):
            x = c
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = components.connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), part=part)).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a > b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    alone = {x for x in signed if all(find(y) != find(x) for y in signed if y != x)}
    assert {r.node: r.root for r in got} == {x: find(x) for x in signed if x not in alone}


def test_cells_meet_every_pair_once(spark):
    """Whatever the grid, members of a key meet as often as without one, but for those of its most frequent leader."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    fps = sorted({centre ^ (1 << int(b)) ^ (1 << int(c)) for b in range(0, 40, 3) for c in range(1, 40, 5)} | {int(x) for x in rng.integers(0, 1 << 63, 50)})
    labelled = spark.createDataFrame([(x, centre if k % 3 else x) for k, x in enumerate(fps)], "fp long, leader long")
    dense, single = ([tuple(r) for r in simhash._meetings(labelled, p).where("leader_a <> leader_b").select("key", "a", "b").collect()] for p in (3, 1 << 20))
    assert sorted(dense) == sorted(single) and len(single) > 5000


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_duplicates(spark, counters):
    rows = corpus()
    got = exact_dedup.exact_duplicates(make(spark, rows), counters).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode().lower()).hexdigest(), []).append(i)
    assert len(got) == len(rows)
    for sha, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted((r.doc_id or -1) for r in mine) == sorted((i or -1) for i in ids)
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [best]
    kept = exact_dedup.keep_largest(make(spark, rows), counters)
    assert kept.schema == make(spark, []).schema
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r.doc_id or -1) for r in got if r.kept)


def test_misra_gries_keeps_every_frequent_item():
    rnd = random.Random(9)
    for _ in range(50):
        items = [rnd.choice("aaaabbbcdefghij") for _ in range(300)]
        at = [0, *sorted(rnd.sample(range(1, 300), 4)), 300]
        batches = [pa.record_batch([pa.array([x.encode() for x in items[a:b]])], names=["sha"]) for a, b in zip(at, at[1:])]
        (found,) = exact_dedup._summaries(3, 0)(iter(batches))
        held = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
        assert len(held) <= 3 and all(x.encode() in held for x in set(items) if items.count(x) > 300 / 4)
        assert all(items.count(x.decode()) - 300 / 4 <= n <= items.count(x.decode()) for x, n in held.items())


def test_empty_tables(spark):
    empty = make(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []
    assert exact_dedup.exact_duplicates(empty).collect() == [] and exact_dedup.keep_largest(empty).collect() == []
    assert line_dedup.deduplicate_lines(empty).collect() == []
    assert quality.fit(empty, labels) is None and quality.apply_rules(empty, None).collect() == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def classes(members, links):
    """The members that links reach, as a set of sets."""
    root = {x: x for x in members}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    out = {}
    for x in members:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(x) for x in out.values()}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rnd, rows = random.Random(edits), []
    for _ in range(400):
        a = "".join(rnd.choice("abé 漢") for _ in range(rnd.randint(0, 30)))
        b = list(a)
        for _ in range(rnd.randint(0, edits + 2)):
            k = rnd.randint(0, 2)
            at = rnd.randrange(len(b) + 1)
            b[at : at + (k != 1)] = [] if k == 0 else [rnd.choice("abé")]
        rows.append((a, "".join(b)))
    got = sorted((r.line_a, r.line_b) for r in line_dedup.verified(spark.createDataFrame(rows, "line_a string, line_b string"), edits).collect())
    assert got == sorted(r for r in rows if levenshtein(*r) <= edits)


def test_lines(spark):
    rnd = random.Random(8)
    base = [words(rnd, 9) for _ in range(8)] + ["short one", "short two", "a line of just twenty", "é" * 25, "z" * 3000]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                at = rnd.randrange(len(line))
                line[at : at + 1] = rnd.choice([[], ["x"], ["y"], [line[at], "z"]])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines + [""] * (i % 3))))
    rows += [(50, None), (51, " \n\t\n")]
    distinct = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip()})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in distinct:
        for b in distinct:
            if a < b and min(len(a), len(b)) >= line_dedup.MIN_CHARS and abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2:
                root[find(a)] = find(b)
    seen, want = set(), {}
    for i, t in rows:
        want[i] = []
        for n, x in enumerate((t or "").split("\n")):
            if x.strip():
                if find(x) in seen:
                    want[i].append(n)
                seen.add(find(x))
    docs = make(spark, rows)
    decided = line_dedup.deduplicate_lines(docs)
    got = {r.doc_id: r for r in decided.collect()}
    assert {i: r.removed for i, r in got.items()} == want
    assert all(r.n_lines == r.n_kept + r.n_exact + r.n_near and len(r.removed) == r.n_exact + r.n_near for r in got.values())
    assert sum(r.n_near for r in got.values()) > 0
    cut = {r.doc_id: r.text for r in line_dedup.apply_removal(docs, decided).collect()}
    assert cut == {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) for i, t in rows}


def test_short_lines_are_near_at_one_edit(spark):
    rnd = random.Random(11)
    lines = ["Heti eror anesti.", "Heti, eror anesti.", "Read more", "Read mure", "Read more >", "Read more >>"]
    for n in (8, 9, 10, 11, 15, 18, 19, 20, 21, 22):
        for _ in range(4):
            line = "".join(rnd.choice("abcdefgh ") for _ in range(n - 1)) + "."
            lines.append(line)
            for _ in range(5):
                near = list(line)
                for _ in range(rnd.choice([1, 1, 2])):
                    at = rnd.randrange(len(near))
                    near[at : at + 1] = rnd.choice([[], ["x"], [near[at], "y"]])
                lines.append("".join(near))
    many = ["menu entry %s%s" % (a, b) for a in "abcdefgh" for b in "abcdefgh"]  # hot keys
    lines = sorted({x for x in lines + many if x.strip()})

    def bound(a, b):
        shorter = min(len(a), len(b))
        return 2 if shorter >= 20 else 1 if shorter >= 10 else 0

    want = {(a, b) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= bound(a, b)}
    docs = make(spark, list(enumerate(lines)))
    digests = {hashlib.md5(x.encode()).digest(): x for x in lines}
    got = [tuple(sorted((digests[bytes(r.a)], digests[bytes(r.b)]))) for r in line_dedup.line_links(docs).collect()]
    assert set(got) <= want and ("Heti eror anesti.", "Heti, eror anesti.") in want
    assert classes(lines, got) == classes(lines, want)
    assert any(len(a) < 20 <= len(b) or len(b) < 20 <= len(a) for a, b in want)


def test_lines_under_hot_keys(spark):
    """Keys of over a thousand lines: near copies of one line, lines of one template that aren't near, and edits of all kinds."""
    rnd, lines = random.Random(12), set()
    head = "all of these lines begin with the same two parts "
    for _ in range(900):
        lines.add(head + "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(16, 18))))
    for base in (head + "and end alike, too", head + "but end otherwise."):
        for _ in range(150):
            near = list(base)
            for _ in range(rnd.choice([1, 1, 2])):
                at = rnd.randrange(30, len(near))
                near[at : at + 1] = rnd.choice([[], ["x"], [near[at], rnd.choice("yz")]])
            lines.add("".join(near))
    lines |= {x[:-1] for x in list(lines)[:60]} | {x[:50] + "q" + x[50:] for x in list(lines)[60:120]}
    lines = sorted(lines)
    want = duckdb.sql("with t as (select unnest(?) as x) select a.x, b.x from t a join t b on a.x < b.x and abs(length(a.x) - length(b.x)) <= 2 and levenshtein(a.x, b.x) <= 2", params=[lines]).fetchall()
    digests = {hashlib.md5(x.encode()).digest(): x for x in lines}
    got = [tuple(sorted((digests[bytes(r.a)], digests[bytes(r.b)]))) for r in line_dedup.line_links(make(spark, list(enumerate(lines)))).collect()]
    assert set(got) <= set(want) and len(set(got)) < len(set(want))
    assert classes(lines, got) == classes(lines, want)


def test_lines_of_one_template_meet_where_their_letters_agree(spark, monkeypatch):
    """Under a template's key lines are filed again: few comparisons a line, and no exploded side is broadcast."""
    rnd, letters = random.Random(14), "abcdefghijklmnopqrstuvwxyz0123456789"
    lines = ["Posted on the board by user " + "".join(rnd.choice(letters) for _ in range(50)) for _ in range(1700)]
    lines += ["The count of this week's visitors is %06d in all of them" % rnd.randrange(10**6) for _ in range(250)]  # near by chance, too
    for i in range(0, 150, 3):
        near = list(lines[i])
        for _ in range(rnd.choice([1, 2])):
            at = rnd.randrange(0, len(near))
            near[at : at + 1] = rnd.choice([[], ["#"], [near[at], "#"]])
        lines.append("".join(near))
    lines = sorted(set(lines))
    want = duckdb.sql("with t as (select unnest(?) as x) select a.x, b.x from t a join t b on a.x < b.x and abs(length(a.x) - length(b.x)) <= 2 and levenshtein(a.x, b.x) <= 2", params=[lines]).fetchall()
    compared, plans, plain = [], [], line_dedup._near

    def counted(pairs, *more):
        plans.append(pairs._jdf.queryExecution().toString())
        compared.append(pairs.count())
        return plain(pairs, *more)

    def by_letters(search, rows, plain=line_dedup._Search._letter_pairs):
        pairs = plain(search, rows)
        plans.append(pairs._jdf.queryExecution().toString())
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_dedup, "_near", counted)
    monkeypatch.setattr(line_dedup._Search, "_letter_pairs", by_letters)
    digests = {hashlib.md5(x.encode()).digest(): x for x in lines}
    got = [tuple(sorted((digests[bytes(r.a)], digests[bytes(r.b)]))) for r in line_dedup.line_links(make(spark, list(enumerate(lines)))).collect()]
    assert set(got) <= set(want) and classes(lines, got) == classes(lines, want)
    assert len(want) > 100 and compared[-1] > 0 and sum(compared) < 50 * len(lines)
    salted = [x.split("== Physical Plan ==")[1] for x in plans if "salt" in x]
    assert salted and all("SortMergeJoin" in x for x in salted)


@pytest.mark.parametrize("direct", [2, 64])
def test_lines_of_one_template_are_filed_by_a_second_part_only_where_many_agree_on_one(spark, monkeypatch, direct):
    """Each row under a hot key is filed by five parts, not by fifteen pairs of them, and no link is lost, however few lines may meet by one part."""
    rnd, letters = random.Random(15), "abcdefghijklmnopqrstuvwxyz0123456789"
    lines = ["Posted on the board by user " + "".join(rnd.choice(letters) for _ in range(50)) for _ in range(600)]
    base = "Posted on the board by user who has many near copies, and whose name is long."
    lines += ["".join("#" if j in at else c for j, c in enumerate(base)) for at in (rnd.sample(range(30, len(base)), rnd.choice([1, 2, 3, 4])) for _ in range(150))]
    for i in range(0, 90, 3):
        at = rnd.randrange(30, 78)
        lines.append(lines[i][:at] + rnd.choice(["", "#", "##"]) + lines[i][at + 1 :])
    lines = sorted(set(lines))
    want = duckdb.sql("with t as (select unnest(?) as x) select a.x, b.x from t a join t b on a.x < b.x and abs(length(a.x) - length(b.x)) <= 2 and levenshtein(a.x, b.x) <= 2", params=[lines]).fetchall()
    written, pairs, write = {}, [], line_dedup.materialize

    def counted(frame, label, *more):
        out = write(frame, label, *more)
        written[label] = max(written.get(label, 0), out.count())
        return out

    def by_letters(search, rows, plain=line_dedup._Search._letter_pairs):
        out = plain(search, rows)
        pairs.extend(out.select("h_a", "h_b", "id_a").collect())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    monkeypatch.setattr(line_dedup._Search, "_letter_pairs", by_letters)
    monkeypatch.setattr(line_dedup, "DIRECT", direct, raising=False)
    digests = {hashlib.md5(x.encode()).digest(): x for x in lines}
    got = [tuple(sorted((digests[bytes(r.a)], digests[bytes(r.b)]))) for r in line_dedup.line_links(make(spark, list(enumerate(lines)))).collect()]
    assert set(got) <= set(want) and classes(lines, got) == classes(lines, want) and len(want) > 100
    assert max(n for label, n in written.items() if label != "texts") <= 5 * written["shared-rows"]
    # A pair meets once under each key that it shares, of which there are few.
    assert pairs and max(Counter((r.h_a, r.h_b) for r in pairs).values()) <= len(line_dedup.places(2))


def test_keys_that_nothing_meets_are_not_written(spark, monkeypatch):
    """What unlike lines look under is joined as it is made; tables hold at most the keys they are filed under."""
    rnd = random.Random(12)
    lines = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(200)]
    wide = lines[0][:30] + "\u00e9" + lines[0][31:]  # its first and last segments are those of a line without wider characters
    written, write = {}, line_dedup.materialize

    def counted(frame, label, *more):
        out = write(frame, label, *more)
        written[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    links = {frozenset(map(bytes, r)) for r in line_dedup.line_links(make(spark, [(0, "\n".join([*lines, wide]))])).collect()}
    assert links == {frozenset(hashlib.md5(x.encode()).digest() for x in (lines[0], wide))}
    assert max(written.values()) <= (line_dedup.MAX_EDITS + 1) * (len(lines) + 1)


def test_few_links_make_few_files(spark, monkeypatch):
    """Lines are looked up once, what one step reads is no table, and few rows are one file, however many partitions a shuffle has."""
    rnd = random.Random(13)
    lines = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(60)]
    chain = ["".join("z" * (j < k) + lines[0][j] * (j >= k) for j in range(60)) for k in range(20)]
    lines += chain + [x[:-1] for x in lines[:40]]
    files: dict[str, list[int]] = {}
    for module in (line_dedup, components):

        def counted(frame, label, *more, write=module.materialize):
            out = write(frame, label, *more)
            files.setdefault(label, []).append(len(out.inputFiles()))
            return out

        monkeypatch.setattr(module, "materialize", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        decided = line_dedup.deduplicate_lines(make(spark, list(enumerate(lines)))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = duckdb.sql("with t as (select unnest(?) as x) select a.x, b.x from t a join t b on a.x < b.x and abs(length(a.x) - length(b.x)) <= 2 and levenshtein(a.x, b.x) <= 2", params=[list(set(lines))]).fetchall()
    assert len(want) > 60 and sum(r.n_kept for r in decided) == len(classes(sorted(set(lines)), want))
    assert {x: n for x, n in files.items() if x not in ("links", "occurrences", "lines-once", "described", "stars")} == {x: [1] for x in ("filed-keys", "hits", "texts", "tied", "shared-rows")} | {"edges": [1] * len(files["edges"])}


def test_lines_of_rows_with_one_id(spark):
    rows = [(1, "the very first line of them all\nand this other unrelated line too"), (1, "a line that stands nowhere else\nthe very first line of them all"), (None, "the very first line of them all\nwhat a null id holds"), (2, "what a null id holds!"), (2, "what a null id holds!")]
    docs = make(spark, rows)
    decided = line_dedup.deduplicate_lines(docs)
    assert sorted((r.doc_id or 0, r.n_lines, r.n_exact, r.n_near, tuple(r.removed)) for r in decided.collect()) == [(0, 2, 0, 0, ()), (1, 2, 1, 0, (0,)), (1, 2, 1, 0, (1,)), (2, 1, 0, 1, (0,)), (2, 1, 0, 1, (0,))]
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.apply_removal(docs, decided).collect()) == [
        (0, rows[2][1]), (1, "a line that stands nowhere else"), (1, "and this other unrelated line too"), (2, ""), (2, ""),
    ]


def test_rule_statistics():
    text = "a b c d e f g\na b c d e x # $\n\na b c d e x # $"
    base, _ = quality.rule_statistics(text)
    w = text.split()
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    assert base == (len(w), sum(map(len, w)), 4, 1, len(covered))
    assert quality.rule_statistics(None)[0] == quality.rule_statistics(" \n ")[0] == (0, 0, 0, 0, 0)
    # A no-break space is part of a word; a vertical tab is not.
    assert quality.rule_statistics("a\xa0b\x0bc")[0][0] == 2
    assert quality.base_failed(9, 0) and not quality.base_failed(10, 2) and quality.base_failed(10, 3)


def test_forest_by_definition():
    """Scores by walking each tree row by row, and the threshold by trying all."""
    rng = np.random.default_rng(3)
    rows = rng.random((120, 3)) ** 2
    forest = quality.IsolationForest.grow(rows, rows.min(axis=0), rows.max(axis=0), 9, 32, 1)

    def average(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def path(row, at):
        depth = 0
        while forest.feature[at] >= 0:
            at = forest.left[at] if row[forest.feature[at]] <= forest.value[at] else forest.right[at]
            depth += 1
        left = forest.depth[at] - depth  # what a leaf of several rows adds
        assert any(abs(left - average(n)) < 1e-9 for n in range(33))
        return forest.depth[at]

    probes = np.vstack([rows[:20], [[5.0, 5.0, 5.0], [-1.0, 0.5, 0.5]]])
    want = [2.0 ** -(np.mean([path(r, root) for root in forest.roots]) / average(32)) for r in probes]
    assert np.allclose(forest.score(probes), want)
    for seed in range(20):
        r = random.Random(seed)
        scores = np.array([r.choice([0.3, 0.4, 0.5, 0.6, r.random()]) for _ in range(80)])
        bad = np.array([r.random() < 0.3 for _ in range(80)])
        for loss in (0.0, 0.02, 0.2):
            got = quality.calibrate(scores, bad, loss)
            spare = int(loss * (~bad).sum())
            fits = [t for t in np.unique(np.concatenate([scores, [1.0]])) if (scores[~bad] > t).sum() <= spare]
            assert (scores[~bad] > got).sum() <= spare
            assert (scores[bad] > got).sum() == max((scores[bad] > t).sum() for t in fits)


def test_repeated_ids_are_one_row_of_the_sample(spark):
    rnd = random.Random(5)
    rows = [(i, words(rnd, 40, 5000) if i % 3 else " ".join(f"x{k}###" for k in range(40))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    one, many = (quality.fit(make(spark, x), labels) for x in (rows, rows * 5))
    assert np.array_equal(one.value, many.value) and one.threshold == many.threshold


def test_forest_counts_every_labelled_row(spark):
    """Leaves, box and threshold are those of all labelled rows, by brute force; none is sampled."""
    rnd = random.Random(8)
    rows = [(i, " ".join(x + "#" * (i % 7 == 0) * rnd.randint(0, 3) for x in words(rnd, rnd.randint(12, 40), 300).split())) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    forest = quality.fit(make(spark, rows), labels)
    found = [quality.rule_statistics(x) for _, x in rows]
    passed = np.array([not quality.base_failed(b[0], b[4]) for b, _ in found])
    table, bad = np.array([f for _, f in found])[passed], np.array([i % 7 == 0 for i, _ in rows])[passed]
    good = table[~bad]
    average = quality._average_path
    assert forest.normal == average(len(good))
    for root in forest.roots[:8]:
        at, level = [int(root)], {int(root): 0}
        while at:
            x = at.pop()
            if forest.feature[x] >= 0:
                for child in (int(forest.left[x]), int(forest.right[x])):
                    level[child] = level[x] + 1
                    at.append(child)
        ends = forest.leaves(root, good)
        for x in level:
            if forest.feature[x] < 0:
                assert abs(forest.depth[x] - level[x] - average(int((ends == x).sum()))) < 1e-9
    assert forest.threshold == quality.calibrate(forest.score(table), bad, 0.005)


def test_nth_largest(spark):
    rnd = random.Random(4)
    for values in ([0.25], [0.5] * 7, [rnd.choice([0.1, 0.1 + 2**-56, 0.7, rnd.random()]) for _ in range(400)]):
        frame = spark.createDataFrame([(x,) for x in values], "x double")
        for n in {0, len(values) // 3, len(values) - 1}:
            assert quality.nth_largest(frame, n) == sorted(values, reverse=True)[n]


def test_forest_rejects_what_is_labelled_bad_and_keeps_the_rest(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        text = words(rnd, rnd.randint(30, 80), 500)
        if bad:
            text = " ".join(x + "###" if k % 2 else x for k, x in enumerate(text.split()))
        rows.append((i, text))
        if i < 700:
            labels.append((i, 0 if bad else 1, 0))
    labels += [(3, None, 0), (None, 1, 1), (5, 1, 0)]
    docs = make(spark, rows + [(2000, None), (2001, "few words")])
    forest = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.apply_rules(docs, forest).collect()}
    held_out = [i for i in range(700, 1200)]
    assert sum(got[i].kept for i in held_out if i % 8) >= 0.98 * sum(1 for i in held_out if i % 8)
    assert sum(not got[i].kept for i in held_out if not i % 8) >= 0.9 * sum(1 for i in held_out if not i % 8)
    assert not got[2000].kept and not got[2001].kept
    good = quality.keep_good(docs, forest)
    assert good.schema == docs.schema and sorted(r.doc_id for r in good.collect()) == sorted(i for i, r in got.items() if r.kept)
