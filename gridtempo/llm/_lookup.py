"""Positions of 64-bit hashes in a list, whole arrays at a time."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Positions of hashes in a list, by a table on their upper bits; the few that share an entry are searched for."""

    def __init__(self, listed: np.ndarray):
        bits = max(8, min(20, 3 + len(listed).bit_length()))
        self.shift = np.uint64(64 - bits)
        slot = (listed >> self.shift).astype(np.int64)
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.at = np.full(1 << bits, -1, dtype=np.int32)
        first = np.unique(slot, return_index=True)[1]
        self.key[slot[first]] = listed[first]
        self.at[slot[first]] = first
        rest = np.setdiff1d(np.arange(len(listed)), first)
        order = np.argsort(listed[rest], kind="stable")
        self.more, self.more_at = listed[rest][order], rest[order].astype(np.int32)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        slot = (asked >> self.shift).astype(np.int64)
        out = np.where(self.key[slot] == asked, self.at[slot], np.int32(-1))
        if len(self.more):
            miss = np.flatnonzero(out < 0)
            near = np.minimum(np.searchsorted(self.more, asked[miss]), len(self.more) - 1)
            out[miss] = np.where(self.more[near] == asked[miss], self.more_at[near], -1)
        return out
