"""The perfect binary Golay code [23, 12, 7]: every 23-bit word lies within three bits of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Fixed value: the code's generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


_HIGH = np.array([_remainder(x << 11) for x in range(1 << 12)], dtype=np.int64)
_ERROR = np.zeros(1 << 11, dtype=np.int64)
for _weight in (1, 2, 3):
    for _bits in combinations(range(23), _weight):
        _pattern = sum(1 << b for b in _bits)
        _ERROR[_remainder(_pattern)] = _pattern


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ _ERROR[(words & 0x7FF) ^ _HIGH[words >> 11]]) >> 11


def near(words: np.ndarray, width: int) -> np.ndarray:
    """Per word its own codeword index and those *greater* ones reached by flipping one of its ``width`` bits; -1 fills up.

    Two words at most one bit apart share an entry: with unequal indices, the greater of both is one word's own and among
    the other's neighbours.
    """
    own = decode(words)
    found = np.stack([own] + [decode(words ^ (1 << b)) for b in range(width)], axis=1)
    found[found < own[:, None]] = -1
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found.sort(axis=1)
    return found[:, -6:]  # a word three bits off its codeword has five more at distance four; others have fewer
