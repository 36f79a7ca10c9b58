"""The pipeline's defined cases, and those of URLs."""

import random

import pytest

import corpus_pipeline
from archgraph.llm import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int, Root string"
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def prose(rnd, n):
    return " ".join(" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(rnd.randint(6, 14))).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and labels by name, written as the driver's tables are."""
    made = tmp_path_factory.mktemp("tables")

    def write(name, docs, labels=()):
        rows = [(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in docs]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{made}/{name}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{made}/{name}/labels.parquet")
        return f"{made}/{name}"

    return write


def test_nulls_copies_and_clashing_names(spark, folder):
    rnd = random.Random(8)
    base = {i: prose(rnd, 40) for i in range(1, 31)}
    long_ = prose(rnd, 12_000)
    near = base[5].split()
    near[7] = "changed"
    docs = list(base.items()) + [
        (100, base[3]), (101, base[3].upper()),  # equal texts, after lower-casing
        (102, " ".join(near)), (None, prose(rnd, 40)), (103, None), (104, ""), (105, long_),
        (7, base[7]), (8, prose(rnd, 40)),  # a repeated row, and another text of the same id
    ]
    sf = folder("cases", docs)
    pieces = corpus_pipeline.run(spark, sf).collect()
    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = lambda t: len(encoder.encode(t, add_special_tokens=False).ids) + 1
    kept = {(i, base[i]) for i in base if i != 3} | {(101, base[3].upper()), (105, long_)} | {(i, t) for i, t in docs if i is None or (i == 8 and t != base[8])}
    assert sorted((i or 0, tokens(t)) for i, t in kept) == sorted({(r.doc_id or 0, r.doc_tokens) for r in pieces})
    whole = {}
    for r in pieces:
        whole[r.doc_id, r.doc_tokens] = whole.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert all(n == size for (_, size), n in whole.items())


def test_an_empty_table_gives_no_pieces(spark, folder):
    assert corpus_pipeline.run(spark, folder("empty", [])).collect() == []


def test_stages_keep_the_columns_of_documents(spark, folder):
    rnd = random.Random(9)
    docs = spark.read.parquet(folder("columns", [(i, prose(rnd, 30)) for i in range(10)]) + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder(f"labels{id(stage)}", []))
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")] and docs.count() == 10


def test_url_cases(spark):
    long_ = "http://host.example.net/de/8/" + "a" * 200_000
    rows = [(1, long_, "x"), (None, "http://com/en/1", "x"), (2, "http://a.org/es/", "x"), (2, "http://a.org/es/", "x"), (3, None, "x")]
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), labels).collect()
    got = sorted((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict) for r in found)
    assert got == [(0, "com", 5, "com/en/", "block"), (1, "host.example.net", 6 + 200_000, "example.net/de/8", "block"), (2, "a.org", 4, "org/es/", "block"), (2, "a.org", 4, "org/es/", "block"), (3, "", 0, None, "allow")]
