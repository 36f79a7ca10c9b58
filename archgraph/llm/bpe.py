"""Byte-level BPE of whole texts with the tokenizers library, through a memo of text chunks.

The pre-tokenizer of byte-level BPE never joins what stands before white space with the
white space itself, so a text's ids are those of its chunks (white space and the word
that follows) one after another; a single line feed between words is a chunk of its own.
Chunks recur, so each worker encodes a chunk once, with the library, and looks it up from
then on. The memo is bounded and only saves time: results don't depend on it.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import MEMOS, tokenizer_path

_SPACE = r" \t\n\x0b\x0c\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Characters that some classes of white space hold and others don't: such a text is encoded as a whole.
UNSURE = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: Those, and white space other than spaces and line feeds.
OTHER = re.compile(r"[\t\x0b\x0c\r\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85\u180e\ufeff]")
MARKS = ".,;:?!"
MEMO_ENTRIES = 800_000


def _strings(array_: pa.Array) -> list[str]:
    """The array's strings; far quicker than one scalar at a time."""
    return array_.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library's own cache never helps: it sees each chunk once.
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        #: Ids are held in two bytes where the vocabulary allows it.
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memo_entries = memo_entries
        #: Packed ids of chunks as they are, and of words that a space comes before.
        self.memo: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        MEMOS.extend((self.memo, self.spaced))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Which ids start with a space, and which are a line feed.
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.feeds = self.starts.copy()
        for token, i in vocabulary.items():
            self.starts[i] = token.startswith("\u0120")
            self.feeds[i] = token == "\u010a"
        #: The ids of marks that stand alone after a letter.
        self.marks = {x: self._pack(self.tokenizer.encode(x, add_special_tokens=False).ids) for x in MARKS}
        self.line_feed = self._pack(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, memo: dict[str, bytes], new: list[str], before: str) -> dict[str, bytes]:
        """Encode chunks that come after ``before`` (a space, a line feed or nothing), many in one call, and remember them."""
        learned: dict[str, bytes] = {}
        for at in range(0, len(new), 16_384):
            part = new[at : at + 16_384]
            packed = None
            if before:
                # No chunk has white space inside, so each starts at a token that starts with ``before``.
                (whole,) = self.tokenizer.encode_batch_fast([before + before.join(part)], add_special_tokens=False)
                ids = np.array(whole.ids, dtype=self.dtype)
                starts = np.flatnonzero((self.starts if before == " " else self.feeds)[ids])
                if len(starts) == len(part):
                    size, raw = self.dtype.itemsize, ids.tobytes()
                    # The line feed is a token of its own, and not the chunk's.
                    skip = 0 if before == " " else 1
                    ends = [*(starts[1:] * size).tolist(), len(raw)]
                    packed = [raw[a:b] for a, b in zip(((starts + skip) * size).tolist(), ends)]
            if packed is None:
                lead = before if before == " " else ""
                encoded = self.tokenizer.encode_batch_fast([lead + x for x in part], add_special_tokens=False)
                packed = [array(self.code, x.ids).tobytes() for x in encoded]
            learned.update(zip(part, packed))
        if len(memo) + len(learned) > self.memo_entries:
            memo.clear()
        memo.update(learned)
        return learned

    def _find(self, memo: dict[str, bytes], chunks: list[str], before: str = "") -> list[bytes]:
        """The packed ids of the chunks; those that the memo lacks are encoded together."""
        found = list(map(memo.get, chunks))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            learned = self._learn(memo, list({chunks[i] for i in missing}), before)
            for i in missing:
                found[i] = learned[chunks[i]]
        return found

    def _spaced(self, words: pa.Array) -> list[bytes]:
        """The packed ids of different words, each after a space.

        A mark after a letter is a token of its own, so such words share the ids of their stems.
        """
        stems = pc.ascii_rtrim(words, characters=MARKS)
        last = pc.utf8_slice_codeunits(stems, start=-1)
        apart = pc.and_(pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(stems)), 1), pc.utf8_is_alpha(last))
        coded = pc.if_else(apart, stems, words).dictionary_encode()
        ids = self._find(self.spaced, _strings(coded.dictionary), " ")
        packed = [ids[c] for c in coded.indices.to_numpy().tolist()]
        which = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        marks = _strings(pc.utf8_slice_codeunits(words.take(pa.array(which)), start=-1))
        for i, mark in zip(which.tolist(), marks):
            packed[i] += self.marks[mark]
        return packed

    def _even(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose words are apart by single spaces or line feeds.

        Words are numbered by a dictionary over the slice, so Python sees each different one once.
        """
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), pattern=" ")
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        # Words that hold line feeds are looked up by their pieces: the first after a space, the others at a line's start.
        at = np.flatnonzero(pc.match_substring(words, "\n").to_numpy(zero_copy_only=False))
        broken = [x.split("\n") for x in _strings(words.take(pa.array(at)))]
        firsts = [x.split("\n") for x in _strings(words.take(pa.array(codes[offsets[:-1]])))]
        whole = np.ones(len(words), dtype=bool)
        whole[at] = False
        packed: list = [None] * len(words)
        for i, ids in zip(np.flatnonzero(whole).tolist(), self._spaced(words.filter(pa.array(whole)))):
            packed[i] = ids
        heads = self._find(self.spaced, [x[0] for x in broken], " ")
        rest = iter(self._find(self.memo, [y for x in broken for y in x[1:]] + [y for x in firsts for y in x], "\n"))
        for i, head, pieces in zip(at.tolist(), heads, broken):
            packed[i] = self.line_feed.join([head, *(next(rest) for _ in pieces[1:])])
        packed += [self.line_feed.join([next(rest) for _ in pieces]) for pieces in firsts]
        codes[offsets[:-1]] = len(words) + np.arange(len(texts))
        size = self.dtype.itemsize
        lengths = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // size
        starts = np.cumsum(lengths) - lengths
        pool = np.frombuffer(b"".join(packed), dtype=self.dtype)
        each = lengths[codes]
        ends = np.cumsum(each)
        ids = pool[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[offsets]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        out: list = [None] * len(texts)
        even: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, dtype=self.dtype)
            elif (other := OTHER.search(text)) and UNSURE.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
            elif other or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
                out[i] = np.frombuffer(b"".join(self._find(self.memo, CHUNK.findall(text))), dtype=self.dtype)
            else:
                even.append(i)
        for i, ids in zip(even, self._even([texts[i] for i in even]) if even else ()):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(name: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    return ChunkEncoder(tokenizer_path(name))
