"""Byte-level BPE by a prefix-sharing trie of words, and its decoding.

Byte pair encoding leaves one segmentation of a word, and of each of its prefixes. The last
token of a prefix's segmentation is the prefix's *state*: the rest is the segmentation of
what stands before that token, so the states along a word spell out its tokens backwards.
A state follows from earlier ones: of the tokens that end at a place, exactly one is
neither merged with, nor cut by, what the state at its start puts before it.

1. Texts are cut into chunks (white space and the word after it), numbered by a dictionary
   over a slice, so that each different one is looked at once; the vocabulary's own pre-tokenizer cuts
   those into words.
2. The different words of chunks that this worker hasn't met are inserted into a trie: sorted, each word hangs below what it shares with
   the one before. A depth-first walk carries the states of the path on a stack and works
   out those of a shared prefix once.
3. Ids of chunks are remembered, in a bounded memo that only saves time.
4. Ids are decoded from a table of the tokens' bytes.

Two neighbouring tokens stay apart if no merge across their boundary comes before the
merges that build either side: the right edge of the left token and the left edge of the
right one grow in the order of their merges, and at each step the two tokens at the edges
must not be the next merge themselves.

Defined cases: a null text is empty and has no ids; an added token's string in a text is that
token, as the library takes it; ids decode to the text's bytes, and broken UTF-8 to U+FFFD;
rows that repeat are encoded each; a null doc_id stays null; an empty table gives no rows; very long texts
and words take time in proportion to their length; other columns pass through no further, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import TOKEN_SLICE_BYTES, slices, tokenizer_path
from .bpe import MARKS, ChunkEncoder

VOCABULARY = "byte_bpe_50k.json"
#: Pairs of tokens that a worker remembers.
MEMO_PAIRS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable Latin-1 ones for themselves, the others from U+0100 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Merges:
    """Tokens with the merge that makes each, and which two neighbours stay apart."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.ids = vocabulary
        self.rank = {pair: k for k, pair in enumerate(merges)}
        made = {a + b: (a, b) for a, b in reversed(merges)}
        self.never = len(merges)
        #: From a token's edge character to the token itself: (what stands at the edge, rank of the merge that ends it).
        self.left: dict[str, list[tuple[str, int]]] = {}
        self.right: dict[str, list[tuple[str, int]]] = {}
        #: For each token that has been met, whether others stay apart after it.
        self.after: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        #: Tokens that are their own segmentation; no other one ever stands in a text.
        self.whole: set[str] = set()
        for token in sorted(vocabulary, key=len):
            if len(token) == 1:
                self.whole.add(token)
                self.left[token] = self.right[token] = [(token, self.never)]
            elif (parts := made.get(token)) is not None and all(x in self.whole for x in parts):
                a, b = parts
                if self.first_crossing(a, b) != parts:
                    continue
                self.whole.add(token)
                rank = self.rank[parts]
                self.left[token] = [*self.left[a][:-1], (a, rank), (token, self.never)]
                self.right[token] = [*self.right[b][:-1], (b, rank), (token, self.never)]
        self.longest = max(map(len, self.whole), default=1)
        self.endings = {x[k:] for x in self.whole for k in range(len(x))}

    def first_crossing(self, a: str, b: str) -> tuple[str, str] | None:
        """The first merge across the boundary of two tokens side by side, if any."""
        left, right = self.right[a], self.left[b]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get((x, y))
            # Of merges with one rank the leftmost comes first.
            if rank is not None and rank < x_ends and rank <= y_ends:
                return x, y
            if x_ends == y_ends == self.never:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def learn(self, a: str, b: str) -> bool:
        """Whether ``b`` stays apart after ``a``; remembered."""
        if self.pairs >= MEMO_PAIRS:
            for known in self.after.values():
                known.clear()
            self.pairs = 0
        self.pairs += 1
        found = self.after[a][b] = self.first_crossing(a, b) is None
        return found


class Trie:
    """The walk over a trie of words. ``steps`` counts the states that were worked out."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.steps = 0

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of each word. Sorted, the words are the trie's paths in depth-first order; the stacks hold the path's states."""
        merges = self.merges
        whole, endings, after, learn, ids = merges.whole, merges.endings, merges.after, merges.learn, merges.ids
        out: dict[str, list[int]] = {}
        #: For each depth of the path: where the last token starts, that token, and what is known to stay apart after it.
        starts, last, known = [0], [""], [{}]
        before = ""
        for word in sorted(words):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del starts[depth + 1 :], last[depth + 1 :], known[depth + 1 :]
            self.steps += len(word) - depth
            for end in range(depth + 1, len(word) + 1):
                start = end - 1
                while True:
                    token = word[start:end]
                    if token in whole:
                        if not start:
                            break
                        apart = known[start].get(token)
                        if apart or (apart is None and learn(last[start], token)):
                            break
                    start -= 1
                    if start < 0 or token not in endings:
                        raise ValueError(f"no token of the vocabulary ends {word[:end]!r}")
                starts.append(start)
                last.append(token)
                beside = after.get(token)
                if beside is None:
                    beside = after[token] = {}
                known.append(beside)
            tokens, end = [], len(word)
            while end:
                tokens.append(ids[last[end]])
                end = starts[end]
            tokens.reverse()
            out[word] = tokens
            before = word
        return out


class _Encoded:
    __slots__ = ("ids",)

    def __init__(self, ids: list[int]) -> None:
        self.ids = ids


class TrieTokenizer:
    """Encoding of strings: added tokens, the vocabulary's pre-tokenizer, then the trie."""

    def __init__(self, library) -> None:
        model = json.loads(library.to_str())
        if model["model"]["type"] != "BPE" or model["normalizer"] is not None or model["model"].get("ignore_merges"):
            raise ValueError("not a byte-level BPE vocabulary")
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["model"]["merges"]]
        self.library = library
        self.merges = Merges(model["model"]["vocab"], pairs)
        self.trie = Trie(self.merges)
        self.added = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def _pieces(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut is not None and any(x in text for x in self.added) else [text]

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[_Encoded]:
        """The ids of each text; their different words go into one trie."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        cut = [[piece if piece in self.added else [w for w, _ in split(piece)] for piece in self._pieces(text) if piece] for text in texts]
        words = self.trie.encode(list({w for pieces in cut for piece in pieces if not isinstance(piece, str) for w in piece}))
        out = []
        for pieces in cut:
            ids: list[int] = []
            for piece in pieces:
                if isinstance(piece, str):
                    ids.append(self.added[piece])
                else:
                    for word in piece:
                        ids += words[word]
            out.append(_Encoded(ids))
        return out

    def encode(self, text: str, add_special_tokens: bool = False) -> _Encoded:
        return self.encode_batch_fast([text])[0]


class TrieEncoder(ChunkEncoder):
    """Whole texts by their chunks, each different one encoded by the trie."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        library = self.tokenizer
        self.tokenizer = TrieTokenizer(library)
        self.marks = {x: self._pack(self.tokenizer.encode(x).ids) for x in MARKS}
        self.line_feed = self._pack(self.tokenizer.encode("\n").ids)
        alphabet = byte_alphabet()
        size = len(self.starts)
        surfaces = [b""] * size
        for token, i in library.get_vocab(with_added_tokens=True).items():
            known = all(x in alphabet for x in token)
            surfaces[i] = bytes(alphabet[x] for x in token) if known else token.encode()
        self.surface = surfaces.__getitem__
        self.decimal = [str(i).encode() for i in range(size)].__getitem__

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(name: str) -> TrieEncoder:
    """This worker's encoder for a vocabulary file."""
    return TrieEncoder(tokenizer_path(name))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(name: str):
    def run(batches):
        coder = encoder(name)
        for batch in slices(batches, rows=1 << 14, size=TOKEN_SLICE_BYTES, remember=True):
            counts, coded, decoded = [], [], []
            for ids in coder.encode(batch.column(1).to_pylist()):
                numbers = ids.tolist()
                counts.append(len(numbers))
                coded.append(hashlib.sha256(b",".join(map(coder.decimal, numbers))).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(numbers).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], schema=RESULT)

    return run


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: its text encoded, and its ids decoded."""
    return _picked(docs).mapInArrow(_digest(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of each row."""

    def run(batches):
        coder = encoder(vocabulary)
        for batch in slices(batches, rows=1 << 14, size=TOKEN_SLICE_BYTES, remember=True):
            ids = [x.astype(np.int32) for x in coder.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _picked(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; null ids give a null text."""

    def run(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
