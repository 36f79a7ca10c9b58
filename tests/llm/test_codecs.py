"""Codecs and searches that need no session: round trips and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archgraph.llm import golay, simple8b
from archgraph.llm.bpe import ChunkEncoder
from archgraph.llm.hilbert import hilbert_key
from archgraph.llm.packing import powers

public_tokenizers = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 9000), st.sampled_from([1, 2, 300, 50_257, 1 << 20, 1 << 32, 1 << 62, (1 << 64) - 1]), st.integers(0, 9))
def test_simple8b_round_trip(n, top, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, top, n, dtype=np.uint64)
    ids[rng.random(n) < 0.4] %= 5
    words, offsets, escapes = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, escapes, n) == ids).all()
    for k in range(-(-n // simple8b.BLOCK)):
        assert (simple8b.decode_block(words, offsets, escapes, n, k) == ids[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


def test_image_round_trip():
    docs = [np.array(x, dtype=np.uint32) for x in ([1, 2, 3], [], [70_000] * 5000)]
    ids, lengths, tokens = simple8b.from_image(simple8b.to_image([7, None, 9], docs))
    assert ids == [7, None, 9] and lengths.tolist() == [3, 0, 5000] and tokens.tolist() == [1, 2, 3] + [70_000] * 5000
    with pytest.raises(ValueError):
        simple8b.from_image(b"x" * 80)


def test_golay_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    parity, _ = golay._tables()
    index = golay.codeword_index(words)
    codewords = index << 11 | parity[index]
    assert (np.bitwise_count((codewords ^ words).astype(np.uint32)) <= 3).all()
    for bit in range(22):  # any neighbour's codeword is among the near indices
        rows, near = golay.near_indices(words & ((1 << 22) - 1), 22)
        flipped = golay.codeword_index((words & ((1 << 22) - 1)) ^ (1 << bit))
        pairs = set(zip(rows.tolist(), near.tolist()))
        assert all((i, x) in pairs for i, x in enumerate(flipped.tolist()))
    assert np.bincount(rows).max() <= 6


def test_hilbert_curve_steps_by_one():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    key = hilbert_key(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_powers():
    assert powers(0) == [] and powers(2047) == [1 << k for k in range(10, -1, -1)] and powers(512) == [512]


ALPHABET = ["a", "b", " ", "  ", "\n", "\t", " \n", "'s", "don't", "12", "é", "ü", "<|endoftext|>", "\r\n", "\x1f", "\u3000", "\xa0", "!!", "...", "漢字", "😀", ' "', " x", "\x85", "\u200b", "word,", "Ġ"]


@pytest.mark.parametrize("memo", [50, 100_000])
def test_chunked_bpe_equals_the_library(memo):
    coder = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), memo)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += [" ".join("".join(rnd.choice("abcé,.!\n'") for _ in range(rnd.randint(1, 6))).strip() or "q" for _ in range(9)) for _ in range(2000)] + [None]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, ids in zip(part, coder.encode(part)):
            assert ids.tolist() == (coder.tokenizer.encode(text, add_special_tokens=False).ids if text else []), text
