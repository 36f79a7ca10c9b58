"""The perfect binary Golay code (23, 12, 7), vectorised: nearest-codeword decoding of 23-bit words.

Every 23-bit word lies within 3 bits of exactly one of 4096 codewords. Tables follow from
the generator polynomial: parities of the data words, and the error pattern of each of
the 2048 syndromes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
LENGTH, DATA, PARITY = 23, 12, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - PARITY)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    parity = np.array([_remainder(d << PARITY) for d in range(1 << DATA)], dtype=np.uint32)
    error = np.zeros(1 << PARITY, dtype=np.uint32)
    for weight in range(1, 4):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            error[_remainder(pattern)] = pattern
    return parity, error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within 3 bits of each 23-bit word."""
    parity, error = _tables()
    words = words.astype(np.uint32)
    syndrome = parity[words >> PARITY] ^ (words & ((1 << PARITY) - 1))
    return (words ^ error[syndrome]) >> PARITY


def near_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the codewords of all words within one bit, on the lowest ``bits``, of each word.

    That is one index for most words near a codeword, and at most six for the others.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = codeword_index(words.astype(np.uint32)[:, None] ^ flips[None, :])
    found.sort(axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, columns = np.nonzero(new)
    return rows, found[rows, columns]
