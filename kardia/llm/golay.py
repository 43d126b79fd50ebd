"""The perfect binary Golay code (23, 12, 7), decoded by syndrome, on NumPy arrays.

FIXED VALUES: the generator polynomial x^11+x^9+x^7+x^6+x^5+x+1.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for shift in range(11, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the one error of weight 0 to 3 of each syndrome."""
    bit = [_remainder(1 << i) for i in range(BITS)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= bit[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= bit[12 + i]
    error = np.full(1 << 11, -1, np.int64)
    for weight in range(4):
        for places in combinations(range(BITS), weight):
            s = 0
            for p in places:
                s ^= bit[p]
            error[s] = sum(1 << p for p in places)
    assert (error >= 0).all()  # the code is perfect: every syndrome has its error
    return low, high, error


LOW, HIGH, ERROR = _tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word (at most 3 bits away)."""
    return (words ^ ERROR[LOW[words & 0xFFF] ^ HIGH[words >> 12]]) >> 11


def near_indices(words: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """For each word, the distinct indices of the codewords nearest to it or to a word one bit away.

    One index where the word lies within two bits of its codeword, up to six
    otherwise. Whatever differs from the word in at most one of its ``bits``
    lowest bits decodes to one of them.
    """
    ball = words[:, None] ^ np.array([0] + [1 << i for i in range(bits)], np.int64)[None, :]
    found = np.sort(codeword_index(ball), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return [row[keep] for row, keep in zip(found, first)]
