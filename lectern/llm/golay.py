"""The perfect binary Golay code of 23 bits: 4096 codewords, each 23-bit word within 3 bits of one."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, CHECK = 23, 11
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits by the generator, and the error of each remainder."""
    column = []
    r = 1
    for _ in range(BITS):
        column.append(r)
        r <<= 1
        if r >> CHECK:
            r ^= GENERATOR
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for table, shift in ((low, 0), (high, 12)):
        for bit in range(len(table).bit_length() - 1):
            table[np.arange(len(table)) >> bit & 1 == 1] ^= column[bit + shift]
    error = np.zeros(1 << CHECK, np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            s = 0
            for b in bits:
                s ^= column[b]
            error[s] = sum(1 << b for b in bits)
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each word."""
    low, high, error = _tables()
    words = words.astype(np.int32)
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECK


def near(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each word the indices of the codewords nearest to it and to every word one of its first ``bits`` bits away.

    One row of bits + 1 numbers per word, sorted, with -1 in place of repeated ones: 1 or 6 are left.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
    out = np.sort(decode(words.astype(np.int32)[:, None] ^ flips), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out
