"""The trie of words against the library, plain merging and its own shared prefixes."""

import hashlib
import random

import pytest

from archgraph.llm import trie_bpe
from archgraph.llm.trie_bpe import Merges, Trie

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
ODD = [
    "", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>\n c", "  x  y ", "　 hé​ llo\u0085x", "'s 're don't DON'T", "a" * 3000, "\n\n\n a\n", "漢字テキスト 12345678 ²³½",
    "\U0001f600\U0001f468‍\U0001f469", "ÃÂÃÂ" * 80, "<|endoftext", "-" * 200, "\x00\x01 \x7f", "x" * 70_000, "word " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def coder():
    return trie_bpe.encoder("byte_bpe_50k.json")


def test_equals_the_library(library, coder, sf_dir):
    pq = pytest.importorskip("pyarrow.parquet")
    rnd = random.Random(1)
    texts = ODD + pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    texts += ["".join(rnd.choice("ab  \n't.éÃÂ<|endoftext|>1_-=漢") for _ in range(rnd.randrange(60))) for _ in range(2000)]
    for text, ids in zip(texts, coder.encode(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_ids_that_are_no_text_decode_as_the_library_does(library, coder):
    rnd = random.Random(2)
    for _ in range(500):
        ids = [rnd.randrange(50_257) for _ in range(rnd.randrange(20))]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merged(ranks, word):
    """Plain byte pair encoding: the lowest rank first, of equal ones the leftmost."""
    parts = list(word)
    while len(parts) > 1:
        rank, i = min((ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_any_merges():
    rnd = random.Random(3)
    for _ in range(300):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(rnd.randint(0, 14)):
            pair = rnd.choice(tokens), rnd.choice(tokens)
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        made = Merges({t: i for i, t in enumerate(tokens)}, merges)
        ranks = {p: k for k, p in enumerate(merges)}
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(40)]
        got = Trie(made).encode(list(set(words)))
        for word in words:
            assert got[word] == [made.ids[x] for x in merged(ranks, word)], (word, merges)


def test_shared_prefixes_are_worked_out_once(coder):
    trie = Trie(coder.tokenizer.merges)
    words = ["inter", "international", "internationally", "interned", "in", "zebra"]
    trie.encode(words)
    nodes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert trie.steps == len(nodes) < sum(map(len, words))


def test_every_word_of_the_query_goes_through_the_trie(library, monkeypatch):
    fresh = trie_bpe.TrieEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    seen = []
    plain = Trie.encode
    monkeypatch.setattr(Trie, "encode", lambda self, words: seen.extend(words) or plain(self, words))
    text = "alpha beta gamma's delta epsilon<|endoftext|>zeta"
    fresh.encode([text])
    assert {"Ġbeta", "Ġgamma", "'s", "zeta"} <= set(seen)


def test_rows(spark, library):
    schema = "doc_id long, text string, ids string, N_TOKENS int"
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, "no id", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "tail \n", "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in trie_bpe.digests(docs).collect()), key=key) == sorted(want, key=key)
    back = trie_bpe.decode_documents(trie_bpe.encode_documents(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, *_ in rows)
    assert trie_bpe.digests(spark.createDataFrame([], schema)).collect() == []
