"""Words of many texts at once, straight from Arrow's string buffers: no Python object per word.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Each gets a 64-bit hash: a polynomial over random byte values, read off prefix sums
(the multiplier is odd, hence invertible modulo 2**64), then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _VALUE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_P = 0x9E3779B97F4A7C15 | 5
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Every ASCII byte but letters and digits parts tokens; bytes of other characters belong to them.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes hashed at a time, which changes no hash; a worker holds some six arrays of 8 bytes for each.
_PIECE = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _PIECE if n <= _PIECE else n
    if size not in _powers:
        one = np.full(size, _P, dtype=np.uint64)
        inv = np.full(size, _P_INVERSE, dtype=np.uint64)
        one[0] = inv[0] = 1
        made = (np.multiply.accumulate(one), np.multiply.accumulate(inv))
        if size > _PIECE:
            return made
        _powers[size] = made
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """starts, ends: byte positions of all words in ``data``; document i has words bounds[i] to bounds[i+1]."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = _SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("") if texts.null_count else texts
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        raw = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        body = texts.buffers()[2]
        whole = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data = whole[raw[0] : raw[-1]]
        self.offsets = raw - raw[0]
        n = len(self.data)
        space = separators[self.data]
        edges = np.ones(n + 1, dtype=bool)
        edges[1:n] = space[: n - 1] if n else False
        begin = edges[:n].copy()
        after = np.ones(n, dtype=bool)
        after[: n - 1] = space[1:] if n else False
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begin[inner] = True
        after[inner - 1] = True
        word = ~space
        self.inside = word
        self.starts = np.flatnonzero(word & begin)
        self.ends = np.flatnonzero(word & after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A hash for each word; fold: A-Z count as a-z."""
        table, out, a = (_FOLDED if fold else _VALUE), np.empty(len(self), dtype=np.uint64), 0
        while a < len(self):
            base = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, base + _PIECE, "right")))
            size = int(self.ends[b - 1] - base)
            power, inverse = _power(size)
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(table[self.data[base : base + size]] * power[:size], out=sums[1:])
            lo, hi = self.starts[a:b] - base, self.ends[a:b] - base
            out[a:b] = (sums[hi] - sums[lo]) * inverse[lo]
            a = b
        return mix(out)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def joined(self, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, one blank after each: bytes, starts, ends."""
        lengths = self.ends - self.starts
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        out = np.full(int((lengths + 1).sum()), 32, dtype=np.uint8)
        ramp = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        body = self.data[ramp + np.repeat(self.starts, lengths)]
        out[ramp + np.repeat(starts, lengths)] = LOWER[body] if fold else body
        return out, starts, starts + lengths


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for the k words from each position; the last k-1 positions of a text reach beyond it and are the caller's to mask."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(_P)
        out += hashes[j : j + n]
    return mix(out)


def long_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """As :func:`grams` (with other values), by prefix sums: the cost doesn't depend on k."""
    n = max(0, len(hashes) - k + 1)
    power, inverse = _power(max(len(hashes), 1))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[: len(sums) - k])[:n] * inverse[:n])
