"""The streaming search against plain dynamic programming, the library's unigram search, and round trips."""

import random

import pytest

from archgraph.llm.spm_stream import SPACE, Encoder, StreamingViterbi, Vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def plain(vocabulary, text):
    best = [(0.0, 0, [])] + [(float("-inf"), 0, [])] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + vocabulary.max_len) + 1):
            if (found := vocabulary.pieces.get(text[i:j])) and best[i][0] + found[1] > best[j][0]:
                best[j] = (best[i][0] + found[1], i, [found[0]])
        if text[i] not in vocabulary.pieces and best[i][0] + vocabulary.unknown_score > best[i + 1][0]:
            best[i + 1] = (best[i][0] + vocabulary.unknown_score, i, vocabulary.unknown(text[i]))
    out, at = [], len(text)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [x for ids in reversed(out) for x in ids]


def test_stream_equals_plain_search_and_window_is_bounded():
    rnd = random.Random(5)
    pieces = {p: (i, -float(rnd.randint(1, 9))) for i, p in enumerate(["a", "b", "ab", "aba", "bab", "aab", "bb", "abab", "ba"])}
    vocabulary = Vocabulary(pieces, list(range(100, 356)), [])
    for _ in range(300):
        text = "".join(rnd.choice("abbax") for _ in range(rnd.randint(0, 400)))
        stream, got, at = StreamingViterbi(vocabulary), [], 0
        while at < len(text):
            n = rnd.randint(1, 7)
            got += stream.feed(text[at : at + n])
            at += n
        widest = stream.widest
        assert got + stream.finish() == plain(vocabulary, text)
        assert widest <= 120, "open text is committed long before the end"


def test_words_apart_equals_one_stream_and_round_trips(vocabulary):
    coder, rnd = Encoder(vocabulary), random.Random(1)
    assert vocabulary.words_apart
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", " ", "th", "e", "é", "\n", "漢", "😀", "  ", "aaaa", "tion"]) for _ in range(rnd.randint(0, 40)))
        ids = coder.encode(text)
        assert coder.decode(ids) == text
        if text:
            assert ids.tolist() == plain(vocabulary, SPACE + text.replace(" ", SPACE))
    assert coder.encode(None).tolist() == []


def test_equals_the_library_on_words(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1  # the unigram search over the same scores
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000.0)  # the library adds in 32 bits
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    coder = Encoder(vocabulary)
    for word in "the then there information streaming Viterbi boundary converge unbelievable sentence piece Überraschung été".split():
        assert coder.encode(word).tolist() == library.encode(word)


def test_query_gives_the_library_s_ids_of_a_bpe_model():
    sentencepiece = pytest.importorskip("sentencepiece")
    from archgraph.llm.spm_stream import encoder

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coder, rnd = encoder("piece_bpe_32k.model"), random.Random(3)
    assert coder.encode("und").tolist() == library.encode("und")
    words = ["a", "b", " ", "th", "e", "é", "\n", "漢", "😀", "  ", "aaaa", "tion", "und", " the", "     ", "Überraschung", "\t", "1999", "ing"]
    for _ in range(600):
        text = "".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))
        assert coder.encode(text).tolist() == library.encode(text)
        assert coder.decode(coder.encode(text)) == text
    for length in (65, 300, 3000):
        for letters in ("ab", "etaoinsr", "the", " ", "ißé漢x", "etaoinsrhdlu"):
            text = "".join(rnd.choice(letters) for _ in range(length))
            assert coder.encode(text).tolist() == library.encode(text)


def test_long_texts_without_spaces_take_a_window_and_linear_time(vocabulary):
    import time

    from archgraph.llm.spm_stream import StreamingMerges, encoder

    rnd = random.Random(4)
    text = "".join(rnd.choice("etaoinsrhdlu") for _ in range(160_000))
    stream, got = StreamingMerges(vocabulary), []
    for at in range(0, 20_000, 100):
        got += stream.feed(text[at : at + 100])
        assert len(stream.text) <= 100 + 8 * vocabulary.max_len
    widest = stream.widest
    got += stream.finish()
    assert widest <= 8 * vocabulary.max_len
    coder = encoder("piece_bpe_32k.model")
    seconds = []
    for n in (20_000, 160_000):
        began = time.process_time()
        ids = coder.encode(text[:n])
        seconds.append(time.process_time() - began)
        assert coder.decode(ids) == text[:n]
    assert seconds[1] < 20 * seconds[0], seconds


def test_empty_table_and_repeated_rows(spark):
    from archgraph.llm.spm_stream import encode_documents

    schema = "doc_id long, text string, n_tokens string"
    assert encode_documents(spark.createDataFrame([], schema)).collect() == []
    got = sorted((r.doc_id or 0, r.n_chars, r.n_tokens > 0, r.round_trip) for r in encode_documents(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "x")], schema)).collect())
    assert got == [(0, 0, False, True), (1, 3, True, True), (1, 3, True, True)]


def merged(scores, text):
    """Plain merging: the best scored neighbours first, of equal ones the leftmost."""
    parts = list(text)
    while True:
        best, at = max(((scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(float("-inf"), 0))
        if best == float("-inf"):
            return parts
        parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]


def test_every_chunk_is_searched_and_committed_on_the_way(sf_dir, monkeypatch):
    """All different chunks of given documents go through the search itself, whose window stays small."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pq = pytest.importorskip("pyarrow.parquet")
    from archgraph.llm import spm_stream

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    coder = Encoder(Vocabulary.load(path), merges=True)
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    streamed, widest, commits = [], [], []
    plain_stream, plain_end = Encoder._stream, spm_stream.StreamingMerges._reset
    monkeypatch.setattr(Encoder, "_stream", lambda self, text: streamed.append(text) or plain_stream(self, text))
    monkeypatch.setattr(spm_stream.StreamingMerges, "_reset", lambda self, last: (widest.append(self.widest), commits.append(self.commits), plain_end(self, last))[2])
    for text in texts:
        assert coder.encode(text).tolist() == library.encode(text)
    chunks = {c for t in texts if t for c in spm_stream.CHUNK.findall(SPACE + t.replace(" ", SPACE))}
    assert coder.search.started == sum(map(len, streamed)) == sum(map(len, chunks))
    assert sum(commits) > len(chunks) and max(widest) <= 6 * coder.vocabulary.max_len


def test_one_path_is_left_at_each_place():
    """Of the pieces that end at a place exactly one stays apart from what is before it."""
    from archgraph.llm.spm_stream import MergeOrder

    rnd = random.Random(9)
    names = ["ab", "aba", "bab", "aab", "bb", "abab", "ba", "aa", "bbb"]
    for _ in range(200):
        scores = dict(zip(names, (-float(x) for x in rnd.sample(range(20), len(names)))))
        order = MergeOrder(scores)
        text = "".join(rnd.choice("ab") for _ in range(40))
        last = {0: ""}
        for end in range(1, len(text) + 1):
            found = [p for p in ["a", "b", *names] if text.endswith(p, 0, end) and order.apart(last[end - len(p)], p)]
            assert len(found) == 1
            last[end] = found[0]
            assert merged(scores, text[:end])[-1] == found[0]


def test_streaming_merges_equal_direct_ones_and_commit():
    from archgraph.llm.spm_stream import StreamingMerges

    rnd = random.Random(7)
    names = ["ab", "aba", "bab", "aab", "bb", "abab", "ba", "aa", "bbb"]
    for _ in range(200):
        scores = dict(zip(names, (-float(x) for x in rnd.sample(range(20), len(names)))))
        vocabulary = Vocabulary({p: (i, scores.get(p, -99.0)) for i, p in enumerate(["a", "b", *names])}, list(range(100, 356)), [])
        text = "".join(rnd.choice("abbax" if rnd.random() < 0.1 else "ab") for _ in range(rnd.randint(0, 300)))
        stream, got, at = StreamingMerges(vocabulary), [], 0
        while at < len(text):
            n = rnd.randint(1, 7)
            got += stream.feed(text[at : at + n])
            at += n
        got += stream.finish()
        expected = [i for p in merged(scores, text) for i in ([vocabulary.pieces[p][0]] if p in vocabulary.pieces else vocabulary.unknown(p))]
        assert got == expected
