"""The binary Golay code of 23 bits: keys that near bit strings share."""

from __future__ import annotations

from functools import cache

import numpy as np

BITS, INFO = 23, 12
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
KEYS = 6


def _syndrome(v: int) -> int:
    for shift in range(BITS - 1, BITS - INFO - 1 + 0, -1):
        if v >> shift & 1:
            v ^= _GENERATOR << (shift - 11)
    return v


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11; for each syndrome, the error patterns of weight up to 4.

    The code is perfect: each syndrome has one pattern of weight up to 3 (the first), and five
    more of weight 4 where that weight is 3; else the row repeats the first pattern.
    """
    low = np.array([_syndrome(v) for v in range(1 << 12)], dtype=np.int32)
    high = np.array([_syndrome(v << 12) for v in range(1 << 11)], dtype=np.int32)
    one = [_syndrome(1 << i) for i in range(BITS)]
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    patterns[0].append(0)
    for a in range(BITS):
        patterns[one[a]].append(1 << a)
        for b in range(a):
            patterns[one[a] ^ one[b]].append(1 << a | 1 << b)
            for c in range(b):
                patterns[one[a] ^ one[b] ^ one[c]].append(1 << a | 1 << b | 1 << c)
    for a in range(BITS):
        for b in range(a):
            for c in range(b):
                for d in range(c):
                    s = one[a] ^ one[b] ^ one[c] ^ one[d]
                    if bin(patterns[s][0]).count("1") == 3:
                        patterns[s].append(1 << a | 1 << b | 1 << c | 1 << d)
    out = np.array([p + [p[0]] * (KEYS - len(p)) for p in patterns], dtype=np.int32)
    return low, high, out


def near_codewords(v: np.ndarray) -> np.ndarray:
    """For each 23-bit value the indices (12 bits) of the codewords within distance 4: the nearest first, then five more or repeats of it.

    If two values differ in one bit at most, the nearest codeword of either is among those of the other.
    """
    low, high, patterns = tables()
    v = v.astype(np.int32)
    syndrome = low[v & 0xFFF] ^ high[v >> 12]
    return (v[:, None] ^ patterns[syndrome]) >> 11
