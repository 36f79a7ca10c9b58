"""Token files, packing, counts, URL verdicts and the pipeline on small tables."""

import random
import zlib

import numpy as np
import pytest

from archgraph.llm import packing, spm_stream, token_counts, token_output, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ROWS = [(5, "The quick brown fox"), (3, None), (4, ""), (3, "again three"), (None, "no id"), (9, "long text, " * 3000), (10, "The quick brown fox"), (11, "tab\tand  two<|endoftext|> spaces ")]
SCHEMA = "doc_id long, text string, ids string, start int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_token_files(spark, docs, ids):
    got = token_output.tokens_round(docs).collect()
    want, at = [], 0
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r[0] is not None, r[0] or 0) for r in ordered]
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r[0] for r in ordered]
    want = sorted((len(x) + 1, crc(x + [2])) for x in (ids(t) for _, t in ROWS))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == want


def test_packing(spark, docs, ids):
    pieces = packing.pack(docs, length=256).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    whole = {}
    for i, t in ROWS:
        whole.setdefault((i, len(ids(t)) + 1), []).append(ids(t) + [1])
    assert set(by_doc) == set(whole)
    for key, texts in whole.items():
        found = sorted((p.start, p.length, p.ids_crc32) for p in by_doc[key])
        if len(texts) == 1:
            at = 0
            for start, length, check in found:
                assert start == at and check == crc(texts[0][start : start + length])
                at += length
            assert at == key[1]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0), "no padding is needed"
    assert packing.pack(docs.where("false")).collect() == []


def test_counts_use_and_extend_the_cache(spark, docs, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    cache = f"file://{tmp_path}/cache"
    want = sorted((i or -1, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in ROWS)
    for _ in range(2):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, cache).collect())
        assert got == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in ROWS}), "each text is encoded once"
    other = token_counts.count_tokens(docs, cache, "byte_bpe_50k.json")
    assert other.count() == len(ROWS) and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_spm_documents(docs):
    got = spm_stream.encode_documents(docs).collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 4} == {0}


URLS = [
    (1, "https://EXAMPLE.com/en/5?x", "example.com", "/en/5", "com/en/", "block"), (2, "http://a.example.com/en/71#t", "a.example.com", "/en/71", "example.com/en/7", "allow"),
    (3, "x://b.net/de/1", "b.net", "/de/1", "net/de/", "allow"), (4, "x://example.net/de/88/", "example.net", "/de/88/", "example.net/de/8", "block"),
    (5, "x://q.org/es/", "q.org", "/es/", "org/es/", "block"), (6, "x://q.org?/es/", "q.org", "", None, "allow"), (7, None, "", "", None, "allow"),
    (8, "no scheme", "", "", None, "allow"), (9, "a://b://c/d", "b:", "//c/d", None, "allow"), (10, "x://notcom/en/1", "notcom", "/en/1", None, "allow"),
    (11, "x://com/EN/1", "com", "/EN/1", None, "allow"), (12, "x://É.COM/en/é", "É.com", "/en/é", "com/en/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u, *_ in URLS], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, labels).collect()}
    assert got == {i: tuple(x) for i, _, *x in URLS}


def test_reputation_shrinks(spark):
    pages, labels, n = [], [], 0
    for host, good, bad in (("bad.spam.test", 5, 95), ("new.spam.test", 0, 0), ("one.spam.test", 0, 2), ("good.fine.test", 200, 4), ("once.fine.test", 0, 1)):
        for k in range(good + bad + (good + bad == 0)):
            pages.append((n, f"http://{host}/en/{n}"))
            if good + bad:
                labels.append((n, int(k < good), 0))
            n += 1
    rules = ()
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules)
    rows = {r.host: r for r in got.select("host", "verdict", "bad_rate", "bad_lower").distinct().collect()}
    assert rows["bad.spam.test"].verdict == "block" and rows["good.fine.test"].verdict == rows["once.fine.test"].verdict == "allow"
    assert rows["once.fine.test"].bad_rate < rows["one.spam.test"].bad_rate < 1
    assert rows["new.spam.test"].bad_rate > rows["good.fine.test"].bad_rate
    assert all(r.bad_lower < r.bad_rate for r in rows.values())


def test_beta_quantile(spark):
    rng = np.random.default_rng(1)
    for a, b in ((0.8, 3.0), (2.0, 2.0), (5.0, 40.0), (90.0, 10.0), (400.0, 1200.0)):
        got = spark.sql(f"select {url_filter.beta_quantile(f'{a}D', f'{b}D')} as q").first().q
        assert abs(got - np.quantile(rng.beta(a, b, 200_000), 0.05)) < 0.012


def test_reputation_on_held_out_labels(spark):
    """Hosts of two kinds; labels of every other page are held out."""
    rnd, pages, labels, bad = random.Random(2), [], [], {}
    for h in range(40):
        for _ in range(60):
            n = len(pages)
            bad[n] = rnd.random() < (0.7 if h % 4 == 0 else 0.05)
            pages.append((n, f"https://h{h}.site{h % 8}.test/en/{n}"))
            if n % 2:
                labels.append((n, int(not bad[n]), 0))
    found = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ()).collect()
    held_out = [r for r in found if r.page_id % 2 == 0]
    blocked = {r.page_id for r in held_out if r.verdict == "block"}
    wrong = [r.page_id for r in held_out if bad[r.page_id]]
    assert sum(x in blocked for x in wrong) >= 0.75 * len(wrong), "bad pages of bad hosts go"
    assert all(int(r.host[1:].split(".")[0]) % 4 == 0 for r in held_out if r.page_id in blocked), "no other host is blocked"


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, start long, host string")
    assert token_output.tokens_round(docs).collect() == [] and token_counts.count_tokens(docs, f"file://{tmp_path}/cache").collect() == [] and packing.pack(docs).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, host string, rule string")
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from archgraph.llm import exact_dedup, quality, simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {r.doc_id: docs_text for r, docs_text in ((r, None) for r in quality.apply_rules(docs, forest).collect()) if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in left}
    best = {}
    for i, t in texts.items():
        key = exact_dedup.text_digest(t)
        best[key] = max(best.get(key, -1), i)
    texts = {i: texts[i] for i in best.values()}
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert {r.doc_id for r in got} == {i for i in fps if find(i) == i}
    assert 0 < len({r.doc_id for r in got}) < docs.count()
