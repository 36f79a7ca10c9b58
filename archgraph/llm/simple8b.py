"""Simple-8b word-aligned coding of token ids, for whole documents, in self-describing images.

A 64-bit word is a 4-bit selector (its top bits) and 60 bits of payload that hold as many
ids as the selector says, lowest first. Selector 0 is an escape: an id of over 60 bits,
kept in full in the escape list. Ids are coded in blocks of 4096, each starting on a new
word; the offset of each block's first word is stored, so that blocks can be decoded alone
or all at once with array operations.

Image: magic, six counts, then document ids, their null flags, lengths, block offsets,
escapes and words, all little-endian.
"""

from __future__ import annotations

import numpy as np

#: (ids, bits of each) by selector. Fixed values of the format.
SELECTORS = (
    (1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int64)
BLOCK = 4096
MAGIC = b"AGS8\x01\x00\x00\x00"


#: The bits of a 16-bit number.
_SMALL = np.array([x.bit_length() for x in range(1 << 16)], dtype=np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """The bits of each id."""
    if ids.dtype == np.uint16:
        return _SMALL[ids]
    out = np.zeros(len(ids), dtype=np.uint8)
    rest = ids
    for shift in range(0, 8 * ids.dtype.itemsize, 16):
        part = _SMALL[rest & ids.dtype.type(0xFFFF)]
        out = np.where(part > 0, part + np.uint8(shift), out)
        rest = rest >> ids.dtype.type(16)
        if not rest.any():
            break
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets, escapes) of unsigned ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(1, dtype="<u8"), np.zeros(0, dtype="<u8")
    kind = ids.dtype.type if ids.dtype in (np.uint16, np.uint32) else np.uint64
    padded = np.zeros(blocks * BLOCK + 128, dtype=kind)
    padded[:n] = ids
    # Bits of each id; what follows a block's end is padding, and fits.
    widths = np.zeros((blocks, BLOCK + 128), dtype=np.uint8)
    widths[:, :BLOCK] = _widths(padded[: blocks * BLOCK]).reshape(blocks, BLOCK)
    # The selectors that fit from each place on: from few ids to many, the last that fits wins.
    selector = np.full((blocks, BLOCK), 15, dtype=np.uint8)
    selector[widths[:, :BLOCK] > 60] = 0
    for s in range(14, 0, -1):
        count, bits = SELECTORS[s]
        # Whether all of the next ``count`` ids are narrow, by windows that double.
        fits, size = widths <= bits, 1
        while size < count and fits[:, :BLOCK].any():
            more = min(size, count - size)
            fits = fits[:, : fits.shape[1] - more] & fits[:, more:]
            size += more
        if size == count:
            np.copyto(selector, s, where=fits[:, :BLOCK])
    starts = []
    flat, counts = selector.tobytes(), COUNTS.tolist()
    add = starts.append
    for block in range(blocks):
        at, end = block * BLOCK, min((block + 1) * BLOCK, n)
        while at < end:
            add(at)
            at += counts[flat[at]]
    starts = np.array(starts, dtype=np.int64)
    chosen = selector.ravel()[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    limit = (starts // BLOCK + 1) * BLOCK
    for s in range(2, 16):
        which = np.flatnonzero(chosen == s)
        count, bits = SELECTORS[s]
        if not len(which):
            continue
        begin = starts[which]
        word = padded[begin].astype(np.uint64)
        for k in range(1, count):
            word |= padded[begin + k].astype(np.uint64) << np.uint64(bits * k)
        # A block's last word may reach into the next block's ids: it holds its own only.
        for i in np.flatnonzero(begin + count > limit[which]).tolist():
            own = padded[begin[i] : limit[which[i]]].tolist()
            word[i] = sum(x << (bits * k) for k, x in enumerate(own))
        words[which] |= word
    escapes = padded[starts[chosen == 0]]
    offsets = np.searchsorted(starts, np.arange(blocks + 1) * BLOCK)
    return words.astype("<u8"), offsets.astype("<u8"), escapes.astype("<u8")


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """All ids of all blocks at once, as uint64."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    before = np.cumsum(counts) - counts
    blocks = len(offsets) - 1
    block = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    first = block * BLOCK + before - before[offsets[:-1].astype(np.int64)][block]
    out = np.zeros(blocks * BLOCK, dtype=np.uint64)
    end = (block + 1) * BLOCK
    for s in range(2, 16):
        which = np.flatnonzero(chosen == s)
        if not len(which):
            continue
        count, bits = SELECTORS[s]
        values = (words[which][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        at = first[which][:, None] + np.arange(count)
        inside = at < end[which][:, None]
        out[at[inside]] = values[inside]
    out[first[chosen == 0]] = escapes
    return out[:n]


def decode_block(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ids of block ``k`` alone, by its offset."""
    a, b = int(offsets[k]), int(offsets[k + 1])
    skipped = int((words[:a] >> np.uint64(60) == 0).sum()) if len(escapes) else 0
    return decode(words[a:b], np.array([0, b - a], dtype="<u8"), escapes[skipped : skipped + int((words[a:b] >> np.uint64(60) == 0).sum())], min(BLOCK, n - k * BLOCK))


def to_image(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """The image of these documents' ids."""
    lengths = np.array([len(x) for x in documents], dtype="<u8")
    ids = np.concatenate(documents) if documents else np.zeros(0, dtype=np.uint64)
    words, offsets, escapes = encode(ids)
    nulls = np.array([x is None for x in doc_ids], dtype=np.uint8)
    header = np.array([len(documents), len(ids), len(offsets), len(escapes), len(words), 0], dtype="<u8")
    parts = (header, np.array([x or 0 for x in doc_ids], dtype="<i8"), nulls, lengths, offsets, escapes, words)
    return MAGIC + b"".join(x.tobytes() for x in parts)


def from_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, all token ids) of an image."""
    if image[:8] != MAGIC:
        raise ValueError("not a token image")
    docs, n, blocks, escaped, coded, _ = (int(x) for x in np.frombuffer(image, "<u8", 6, 8))
    at, found = 56, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks), ("<u8", escaped), ("<u8", coded)):
        found.append(np.frombuffer(image, kind, count, at))
        at += count * np.dtype(kind).itemsize
    doc_ids, nulls, lengths, offsets, escapes, words = found
    return [None if z else int(x) for x, z in zip(doc_ids, nulls)], lengths.astype(np.int64), decode(words, offsets, escapes, n)
