"""SentencePiece encoding and decoding by a streaming Viterbi search.

For a unigram model, the best segmentation of a text under a vocabulary's piece scores (the unigram objective)
is found from left to right. A piece has at most ``max_len`` characters, so only the last
``max_len`` places can still be extended; they and their backpointer paths are the window.
As soon as the paths of all of them run through one boundary, what lies before it can
never change: its ids are committed and forgotten.

For a BPE model, whose scores order merges, the search has the same window, backpointers and
commits, and a state that is checked at each boundary: the piece that ends there. Two
neighbours stay apart if no merge across their boundary comes before the merges that build
either of them; each piece's own merges are worked out once for the vocabulary, as the sequence of what
stands at its left and right edge and the score of the merge that comes next. A path whose
neighbours all stay apart is the library's segmentation, so of the paths to a place one is
left, and which it is comes from the merges' scores.

Text is normalised as the vocabulary says: a space in front, spaces as U+2581. Characters
that no piece holds become the pieces of their UTF-8 bytes.

A piece holds U+2581 in front only, and no piece holds a line feed; so all paths converge
before each word and around each line feed, where what the search commits is a word's ids. Words
recur, so those that a worker has searched are looked up from a bounded memo, and only the others
are streamed; a vocabulary with other pieces is searched as one stream.

Defined cases: a null text is empty, and has no ids; any other text has a space in front;
of merges with equal scores the leftmost comes first, and of unigram paths the one whose last piece starts first;
U+2581 in a text is a space, so such a text decodes to one with spaces instead; rows that
repeat are encoded each; an empty table gives no rows; very long texts without a space take
time in proportion, as a search holds its window and a bounded piece; other columns pass
through no further.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MEMOS, slices, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
MEMO_ENTRIES = 500_000
#: How much worse than the worst piece a character without pieces is.
UNKNOWN_PENALTY = 10.0
#: A search is fed so many characters at a time.
PIECE = 1024
#: Pairs of pieces that a worker remembers.
MEMO_PAIRS = 1_000_000
NEVER = float("-inf")


def _fields(data: bytes):
    """``number, value`` of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def is_bpe(path: str) -> bool:
    """Whether a .model file is a BPE model (unigram is the format's default)."""
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    kind = next((v for spec in (v for k, v in message if k == 2) for k, v in _fields(spec) if k == 3), 1)
    if kind not in (1, 2):
        raise ValueError("neither a unigram nor a BPE model")
    if kind == 2 and any(k == 3 and v in (4, 5) for piece in (v for k, v in message if k == 1) for k, v in _fields(piece)):
        raise ValueError("user-defined and unused pieces of a BPE model are not searched")
    return kind == 2


class Vocabulary:
    """Pieces, scores and byte pieces of a .model file."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], surfaces: list[bytes], unknown_id: int = 0) -> None:
        self.pieces, self.byte_ids, self.surfaces, self.unknown_id = pieces, byte_ids, surfaces, unknown_id
        self.max_len = max(map(len, pieces), default=1)
        self.unknown_score = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.words_apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, surfaces = {}, [-1] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surfaces.append(b"")
            else:
                pieces[piece] = (i, model.get_score(i))
                surfaces.append(piece.replace(SPACE, " ").encode())
        return cls(pieces, byte_ids, surfaces)

    def unknown(self, char: str) -> list[int]:
        found = [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return found if min(found) >= 0 else [self.unknown_id]


class StreamingViterbi:
    """Feed characters, get ids as soon as they are certain."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.base = 0  # everything before it is committed
        self.text = ""  # what follows base
        #: For each place from base on: score, start of the last piece, its ids.
        self.best: list[tuple[float, int, list[int] | None]] = [(0.0, 0, None)]
        self.scanned = 0  # places that pieces have been started from
        self.widest = 0
        self.commits = 0  # before the end

    def feed(self, chars: str) -> list[int]:
        return [i for _, ids in self.pieces(chars) for i in ids]

    def finish(self) -> list[int]:
        return [i for _, ids in self.last_pieces() for i in ids]

    def pieces(self, chars: str) -> list[tuple[int, list[int]]]:
        """(where it ends, ids) of each piece that is certain once these characters have come."""
        self.text += chars
        out = []
        while len(self.text) - self.scanned >= self.vocabulary.max_len:
            # With no place reached beyond this one, all paths meet in it.
            if (self.scanned and len(self.best) == self.scanned + 1) or self.scanned % 8 == 7:
                out += self._commit()
            self._start(self.scanned)
        return out

    def last_pieces(self) -> list[tuple[int, list[int]]]:
        """The pieces that are left, as no more characters come."""
        while self.scanned < len(self.text):
            self._start(self.scanned)
        out = self._path(len(self.text))
        self._reset()
        return out

    def _start(self, at: int) -> None:
        """Try each piece that starts at a place."""
        v, text, best = self.vocabulary, self.text, self.best
        score = best[at][0]
        single = False
        end = at + 1
        while end <= len(text):
            piece = text[at:end]
            if piece not in v.prefixes:
                break
            if (found := v.pieces.get(piece)) is not None:
                single = single or end == at + 1
                self._reach(end, score + found[1], at, [found[0]])
            end += 1
        if not single:
            self._reach(at + 1, score + v.unknown_score, at, v.unknown(text[at]))
        self.scanned = at + 1

    def _reach(self, end: int, score: float, start: int, ids: list[int]) -> None:
        while len(self.best) <= end:
            self.best.append((NEVER, -1, None))
        if score > self.best[end][0]:
            self.best[end] = (score, start, ids)

    def _path(self, end: int) -> list[tuple[int, list[int]]]:
        out = []
        while end > 0:
            _, start, ids = self.best[end]
            out.append((self.base + end, ids))
            end = start
        out.reverse()
        return out

    def _commit(self) -> list[tuple[int, list[int]]]:
        """Commit up to the one boundary that the paths of all open places share."""
        self.widest = max(self.widest, len(self.best) - 1)
        # A piece yet to start begins at `scanned` or after; so the open places are these.
        open_ = {p for p in range(self.scanned, len(self.best)) if self.best[p][1] >= 0}
        if not open_:
            return []
        while len(open_) > 1:
            last = max(open_)
            open_.remove(last)
            open_.add(self.best[last][1])
        shared = open_.pop()
        if shared == 0:
            return []
        out = self._path(shared)
        self._rebase(shared)
        self.commits += 1
        return out

    def _rebase(self, shared: int) -> None:
        score = self.best[shared][0]
        self.text = self.text[shared:]
        self.best = [(s - score, max(0, start - shared) if start >= 0 else -1, ids) for s, start, ids in self.best[shared:]]
        self.best[0] = (0.0, 0, None)
        self.base += shared
        self.scanned -= shared


class MergeOrder:
    """Which two pieces stay apart where merges go by the scores of what they make, of equal ones the leftmost first."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        #: For each piece, while it is built: what stands at its left or right edge, and the score of its next merge.
        self._edges: dict[str, tuple[list, list] | None] = {}

    def edges(self, piece: str) -> tuple[list, list] | None:
        """The steps of a vocabulary piece's left and right edge; none if its own characters don't merge to it."""
        if piece not in self._edges:
            parts, left, right = list(piece), [], []
            while True:
                score, at = max(((self.scores.get(a + b, NEVER), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
                left.append((parts[0], score))
                right.append((parts[-1], score))
                if score == NEVER:
                    break
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            self._edges[piece] = (left, right) if len(parts) == 1 else None
        return self._edges[piece]

    def apart(self, a: str, b: str) -> bool:
        """Whether ``b`` stays apart after ``a``, which is empty at the start of a text."""
        if self.edges(b) is None:
            return False
        if not a:
            return True
        ends, begins = self.edges(a)[1], self.edges(b)[0]
        i = j = 0
        while True:
            (x, next_a), (y, next_b) = ends[i], begins[j]
            across = self.scores.get(x + y, NEVER)
            if across > next_a and across >= next_b and across > NEVER:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1


#: In a node of a trie of pieces, the key of the piece that ends there.
ID = ""


class StreamingMerges:
    """The same for a BPE model: a path goes on by a piece only if that stays apart from the path's last one.

    Places are counted from the buffer's start; ``done`` is the last boundary that was committed, and ``started``
    counts the places that pieces were started from.
    """

    def __init__(self, vocabulary: Vocabulary, scores: dict[str, float] | None = None) -> None:
        self.vocabulary = vocabulary
        self.order = MergeOrder(scores if scores is not None else {p: s for p, (_, s) in vocabulary.pieces.items()})
        self.trie: dict = {}
        #: Pieces by number; characters without a piece get negative ones as they come.
        self.names: dict[int, str] = {}
        self.unknown: dict[str, int] = {}
        for piece, (i, _) in vocabulary.pieces.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[ID] = i
            self.names[i] = piece
        #: For each piece, which ones are known to stay apart after it, by number; the start of a text is ``None``.
        self.after: dict[int | None, dict[int, bool]] = {}
        self.pairs = self.started = 0
        self._reset(None)

    def _reset(self, last: int | None) -> None:
        self.text, self.base, self.done, self.scanned = "", 0, 0, 0
        #: For each place: where the last piece starts, its number.
        self.starts, self.last = [-1], [last]
        self.widest = self.commits = 0

    def feed(self, chars: str) -> list[int]:
        return [i for _, ids in self.pieces(chars) for i in ids]

    def finish(self) -> list[int]:
        return [i for _, ids in self.last_pieces() for i in ids]

    def pieces(self, chars: str) -> list[tuple[int, list[int]]]:
        """(where it ends, ids) of each piece that is certain once these characters have come."""
        self.text += chars
        out: list[tuple[int, list[int]]] = []
        self._start(len(self.text) - self.vocabulary.max_len + 1, out)
        if cut := self.done:
            self.text = self.text[cut:]
            self.starts, self.last = [x - cut for x in self.starts[cut:]], self.last[cut:]
            self.base, self.scanned, self.done = self.base + cut, self.scanned - cut, 0
        return out

    def last_pieces(self) -> list[tuple[int, list[int]]]:
        """The pieces that are left, as no more characters come."""
        out: list[tuple[int, list[int]]] = []
        self._start(len(self.text), out)
        self._commit(len(self.text), out)
        self._reset(None)
        return out

    def _learn(self, before: int | None, number: int) -> bool:
        if self.pairs >= MEMO_PAIRS:
            for known in self.after.values():
                known.clear()
            self.pairs = 0
        self.pairs += 1
        found = self.after[before][number] = self.order.apart("" if before is None else self.names[before], self.names[number])
        return found

    def _alone(self, char: str) -> int:
        """The number of a character without a piece."""
        number = self.unknown.get(char)
        if number is None:
            number = self.unknown[char] = -1 - len(self.unknown)
            self.names[number] = char
        return number

    def _start(self, until: int, out: list[tuple[int, list[int]]]) -> None:
        """Start pieces from each place before ``until``; what is certain by then goes to ``out``."""
        text, trie, after, starts, last, most = self.text, self.trie, self.after, self.starts, self.last, len(self.text)
        wide = 4 * self.vocabulary.max_len
        for at in range(self.scanned, until):
            if at > self.done:
                # With no place reached beyond this one, all paths meet in it.
                if len(starts) == at + 1:
                    self._commit(at, out)
                elif at - self.done >= wide and at % 16 == 0:
                    self._commit(self._shared(at), out)
            before = last[at]
            known = after.get(before)
            if known is None:
                known = after[before] = {}
            node, end, single = trie, at, False
            while end < most:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                number = node.get(ID)
                if number is not None:
                    single = single or end == at + 1
                    apart = known.get(number)
                    if apart or (apart is None and self._learn(before, number)):
                        while len(starts) <= end:
                            starts.append(-1)
                            last.append(None)
                        starts[end], last[end] = at, number
            if not single:
                number = self._alone(text[at])
                if known.get(number) or self._learn(before, number):
                    while len(starts) <= at + 1:
                        starts.append(-1)
                        last.append(None)
                    starts[at + 1], last[at + 1] = at, number
        self.started += max(0, until - self.scanned)
        self.scanned = max(self.scanned, until)

    def _shared(self, at: int) -> int:
        """The last boundary that the paths to all open places share; places from ``at`` on are open."""
        starts = self.starts
        open_ = {p for p in range(at, len(starts)) if starts[p] >= 0}
        while len(open_) > 1:
            latest = max(open_)
            open_.remove(latest)
            open_.add(starts[latest])
        return max(self.done, *open_)

    def _commit(self, end: int, out: list[tuple[int, list[int]]]) -> None:
        """What the path to ``end`` holds since the last commit is certain."""
        starts, last, done = self.starts, self.last, self.done
        self.widest = max(self.widest, len(starts) - 1 - done)
        if end == done:
            return
        at, found = end, []
        while at > done:
            number = last[at]
            found.append((self.base + at, [number] if number >= 0 else self.vocabulary.unknown(self.names[number])))
            at = starts[at]
        found.reverse()
        out += found
        self.done = end
        self.commits += 1


class Encoder:
    """Encoding with a bounded memo of words."""

    def __init__(self, vocabulary: Vocabulary, memo_entries: int = MEMO_ENTRIES, merges: bool = False) -> None:
        self.vocabulary = vocabulary
        self.memo: dict[str, bytes] = {}
        MEMOS.append(self.memo)
        self.memo_entries = memo_entries
        self.search = StreamingMerges(vocabulary) if merges else StreamingViterbi(vocabulary)
        self.surface = vocabulary.surfaces.__getitem__

    def _stream(self, text: str):
        """The search's pieces, fed with a bounded number of characters at a time."""
        for at in range(0, len(text), PIECE):
            yield from self.search.pieces(text[at : at + PIECE])
        yield from self.search.last_pieces()

    def _search(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of different chunks. Words behind spaces go through one stream, whose paths converge between them."""
        words, alone = [], []
        for c in chunks:
            if c[0] == SPACE != c[-1]:
                words.append(c)
            else:
                alone.append([c])
        out: dict[str, bytes] = {}
        for part in [words, *alone] if words else alone:
            at, ids = 0, array("i")
            end = len(part[0])
            for place, found in self._stream("".join(part)):
                while place > end:
                    out[part[at]] = ids.tobytes()
                    ids, at = array("i"), at + 1
                    end += len(part[at])
                ids.extend(found)
            out[part[at]] = ids.tobytes()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        escaped = SPACE + text.replace(" ", SPACE)
        chunks = CHUNK.findall(escaped) if self.vocabulary.words_apart else [escaped]
        memo = self.memo
        found = list(map(memo.get, chunks))
        if None in found:
            new = list(dict.fromkeys(chunks[i] for i, x in enumerate(found) if x is None))
            learned = self._search(new)
            found = [learned[c] if x is None else x for c, x in zip(chunks, found)]
            if len(memo) + len(learned) > self.memo_entries:
                memo.clear()
            memo.update((c, x) for c, x in learned.items() if len(c) <= 64)
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surface, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    path = tokenizer_path(name)
    return Encoder(Vocabulary.load(path), merges=is_bpe(path))


def _encode_decode(name: str):
    def run(batches):
        coder = encoder(name)
        for batch in slices(batches, remember=True):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text)
                rows.append((len(text or ""), len(ids), zlib.crc32(ids.astype("<u4")), coder.decode(ids) == (text or "")))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_chars", "n_tokens", "ids_crc32", "round_trip"])

    return run


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_chars, n_tokens, ids_crc32, round_trip`` for each row: the text is encoded, and decoded again."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(_encode_decode(vocabulary), "doc_id long, n_chars long, n_tokens long, ids_crc32 long, round_trip boolean")
