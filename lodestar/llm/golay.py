"""The perfect binary Golay code of length 23 as a source of fuzzy hash keys.

Every 23-bit word lies within 3 bits of exactly one of 4096 codewords. Two words one bit apart
need not decode to the same codeword, but the codeword that one decodes to is never more than
4 bits from the other. So ``decode(x)`` is always among ``near(y)``: one codeword if y is
within 2 bits of its own, else that one and the five others at distance 4.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: The code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK = 23, 11


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of weight 3 or less, its weight, and the 5 errors of weight 4 (or none)."""
    unit = []
    for bit in range(LENGTH):
        rest = 1 << bit
        for top in range(LENGTH - 1, CHECK - 1, -1):
            if rest >> top & 1:
                rest ^= GENERATOR << (top - CHECK)
        unit.append(rest)
    error, weight, four = np.zeros(2048, np.int64), np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for size in range(5):
        for bits in combinations(range(LENGTH), size):
            s = 0
            for b in bits:
                s ^= unit[b]
            word = sum(1 << b for b in bits)
            if size < 4:
                error[s], weight[s] = word, size
            else:
                four[s].append(word)
    return error, weight, np.array([x or [0] * 5 for x in four], np.int64)


def syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64).copy()
    for top in range(LENGTH - 1, CHECK - 1, -1):
        rest ^= (rest >> top & 1) * (GENERATOR << (top - CHECK))
    return rest


def decode(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword within 3 bits of each word."""
    return (words ^ tables()[0][syndrome(words)]) >> CHECK


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits of each word, as 6 columns, and which columns hold."""
    error, weight, four = tables()
    s = syndrome(words)
    keys = np.concatenate([error[s][:, None], four[s]], axis=1) ^ words[:, None]
    holds = np.repeat((weight[s] == 3)[:, None], 6, axis=1)
    holds[:, 0] = True
    return keys >> CHECK, holds
