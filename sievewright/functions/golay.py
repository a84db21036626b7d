"""The binary Golay code [23, 12, 7]: every word of 23 bits lies within 3 bits of exactly one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
KEYS = 6


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of the upper 12 bits; by syndrome the error of at most 3 bits, and the five of 4 bits (0: none)."""
    upper = np.zeros(1 << 12, dtype=np.int64)
    for i in range(1 << 12):
        word = i << CHECK
        for bit in range(LENGTH - 1, CHECK - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - CHECK)
        upper[i] = word
    leader, fours = np.zeros(1 << CHECK, dtype=np.int64), np.zeros((1 << CHECK, KEYS - 1), dtype=np.int64)
    filled = np.zeros(1 << CHECK, dtype=np.int64)
    for weight in range(1, 5):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            syndrome = upper[error >> CHECK] ^ (error & 2047)
            if weight <= 3:
                leader[syndrome] = error
            elif bin(leader[syndrome]).count("1") == 3:
                fours[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return upper, leader, fours


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of all codewords within 4 bits of each word, padded with -1: one or six of them.

    Two words that differ in at most 2 bits have an index in common.
    """
    upper, leader, fours = _tables()
    syndrome = upper[words >> CHECK] ^ (words & 2047)
    out = np.full((len(words), KEYS), -1, dtype=np.int64)
    out[:, 0] = (words ^ leader[syndrome]) >> CHECK
    errors = fours[syndrome]
    out[:, 1:] = np.where(errors > 0, (words[:, None] ^ errors) >> CHECK, -1)
    return out
