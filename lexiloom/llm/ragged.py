"""Ragged numpy arrays of symbols, and pair merging over all sequences at once."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class PairTable:
    """(left symbol, right symbol) -> (rank, merged symbol), looked up for whole arrays.

    ``together[s]`` says that all occurrences of the pair that makes ``s`` may be merged in one round:
    its rank is its own, and no pair with ``s`` in it ranks before it.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, size: int):
        self.size = np.int64(size)
        keys = left.astype(np.int64) * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], rank[order].astype(np.int64), merged[order].astype(np.int64)
        made = np.full(size, NONE)
        np.minimum.at(made, merged, rank)
        inside = np.full(size, NONE)
        np.minimum.at(inside, left, rank)
        np.minimum.at(inside, right, rank)
        ranks = made[made < NONE]
        values, times = np.unique(ranks, return_counts=True)
        shared = np.isin(made, values[times > 1])
        self.together = (inside > made) & ~shared
        # A small direct-mapped filter: most pairs of neighbours are no key, and this says so cheaply.
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, dtype=bool)
        self.maybe[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(64 - self.bits)) & np.int64((1 << self.bits) - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(left), NONE)
        merged = np.zeros(len(left), dtype=np.int64)
        keys = left * self.size + right
        at = np.flatnonzero(self.maybe[self._slot(keys)])
        if len(at) and len(self.keys):
            k = keys[at]
            i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            same = self.keys[i] == k
            rank[at[same]], merged[at[same]] = self.rank[i[same]], self.merged[i[same]]
        return rank, merged


class SmallPairTable(PairTable):
    """The same for few symbols: a place for every pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, size: int):
        super().__init__(left, right, rank, merged, size)
        self.place = np.zeros(size * size, dtype=np.int16)
        self.place[self.keys] = np.arange(1, len(self.keys) + 1)
        self.rank_at, self.merged_at = np.concatenate(([NONE], self.rank)), np.concatenate(([0], self.merged))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.place[left * self.size + right]
        return self.rank_at[at], self.merged_at[at]


def merge_lowest(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no pair of neighbours is in ``table``; returns the symbols left and their number by sequence.

    In each round every sequence merges its pair of lowest rank, ties from the left.  Sequences that have no
    pair left leave the arrays.
    """
    n = len(lengths)
    out_len = np.zeros(n, dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # (sequence of each symbol, symbol)
    sym = symbols.astype(np.int64)
    seq = np.repeat(np.arange(n, dtype=np.int64), lengths)
    rank = np.full(len(sym), NONE)
    made = np.zeros(len(sym), dtype=np.int64)
    inside = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inside], made[inside] = table.lookup(sym[inside], sym[inside + 1])
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        best = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(seq)))
        over = best == NONE
        if over.any():
            gone = np.repeat(over, size)
            done.append((seq[gone], sym[gone]))
            out_len[seq[starts[over]]] = size[over]
            stay = ~gone
            sym, seq, rank, made = sym[stay], seq[stay], rank[stay], made[stay]
            best, size = best[~over], size[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        # From a run of overlapping hits every second one; only the first of a sequence where one merge can
        # bring a pair that goes before the next occurrence.
        run = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
        at = np.arange(len(hit))
        odd = (at - np.maximum.accumulate(np.where(run, at, 0))) & 1
        first = np.concatenate(([True], seq[hit[1:]] != seq[hit[:-1]]))
        hit = hit[first | ((odd == 0) & table.together[made[hit]])]
        sym[hit] = made[hit]
        stay = np.ones(len(sym), dtype=bool)
        stay[hit + 1] = False
        at = np.cumsum(stay)[hit] - 1  # where the merged symbols are afterwards
        sym, seq, rank, made = sym[stay], seq[stay], rank[stay], made[stay]
        beside = np.zeros(len(sym), dtype=bool)
        beside[at] = True
        beside[at[at > 0] - 1] = True
        near = np.flatnonzero(beside)
        rank[near] = NONE
        near = near[near < len(sym) - 1]
        near = near[seq[near] == seq[near + 1]]
        rank[near], made[near] = table.lookup(sym[near], sym[near + 1])
    if not done:
        return np.zeros(0, dtype=np.int64), out_len
    where, what = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
    return what[np.argsort(where, kind="stable")], out_len
