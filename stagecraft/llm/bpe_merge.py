"""Rank-synchronous merging of many short sequences held as ragged numpy arrays.

All sequences lie end to end in one array of symbol ids.  Each round finds every
sequence's lowest-rank pair (the leftmost of equals), merges that pair in all sequences
at once, and looks up the two pairs that each merge creates.  Sequences without a pair
that can merge leave the working arrays.  The result equals merging each sequence on its
own by a priority queue; :func:`merge_long` does just that for a long sequence, whose
number of rounds would be as large as its length.
"""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.iinfo(np.int64).max
LONG = 256


class PairTable:
    """(left, right) -> (rank, merged id), by binary search over packed pairs."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.rank = np.asarray(rank, np.int64)[order]
        self.merged = np.asarray(merged, np.int64)[order]
        # most pairs of symbols are no pair of the table: a bit set answers those at once
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self._slot(self.key)] = True
        self.by_pair: dict | None = None

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(42)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NO_RANK`` if none) and merged id of each pair."""
        key = left.astype(np.int64) << 32 | right
        rank = np.full(len(key), NO_RANK)
        merged = np.zeros(len(key), dtype=np.int64)
        maybe = np.flatnonzero(self.bits[self._slot(key)])
        if len(maybe):
            wanted = key[maybe]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[at] == wanted
            rank[maybe[hit]] = self.rank[at[hit]]
            merged[maybe[hit]] = self.merged[at[hit]]
        return rank, merged

    def pairs(self) -> dict:
        if self.by_pair is None:
            self.by_pair = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        return self.by_pair


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences; returns the surviving symbols (end to end) and their counts."""
    n = len(lengths)
    lengths = np.asarray(lengths, np.int64)
    owner = np.repeat(np.arange(n), lengths)
    sym = np.asarray(symbols, np.int64).copy()
    long = lengths > LONG
    done_sym, done_owner = [], []
    if long.any():
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(long).tolist():
            out = merge_long(sym[ends[i] - lengths[i]:ends[i]].tolist(), table)
            done_sym.append(np.array(out, np.int64))
            done_owner.append(np.full(len(out), i))
        keep = ~long[owner]
        sym, owner = sym[keep], owner[keep]
    rank, merged = _pair_ranks(sym, owner, table)
    while len(sym):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.r_[first, len(sym)])
        low_each = np.repeat(low, size)
        idle = low_each == NO_RANK
        if idle.any():
            done_sym.append(sym[idle])
            done_owner.append(owner[idle])
            go = ~idle
            sym, owner, rank, merged = sym[go], owner[go], rank[go], merged[go]
            if not len(sym):
                break
            low_each = low_each[go]
        hits = np.flatnonzero(rank == low_each)
        hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]  # leftmost of each sequence
        sym[hits] = merged[hits]
        keep = np.ones(len(sym), dtype=bool)
        keep[hits + 1] = False
        at = hits - np.arange(len(hits))  # positions after the merged-away symbols are gone
        sym, owner, rank, merged = sym[keep], owner[keep], rank[keep], merged[keep]
        touched = np.r_[at, at[(at > 0)] - 1]
        touched = touched[(touched >= 0)]
        last = touched == len(sym) - 1
        inner = touched[~last]
        rank[touched] = NO_RANK
        same = inner[owner[inner] == owner[inner + 1]]
        rank[same], merged[same] = table.find(sym[same], sym[same + 1])
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return sym[order], np.bincount(owner, minlength=n)


def _pair_ranks(sym: np.ndarray, owner: np.ndarray, table: PairTable):
    rank = np.full(len(sym), NO_RANK)
    merged = np.zeros(len(sym), dtype=np.int64)
    if len(sym) > 1:
        r, m = table.find(sym[:-1], sym[1:])
        inside = owner[:-1] == owner[1:]
        rank[:-1] = np.where(inside, r, NO_RANK)
        merged[:-1] = m
    return rank, merged


def merge_long(symbols: list[int], table: PairTable) -> list[int]:
    """One sequence by a priority queue over a linked list: lowest rank first, then leftmost."""
    pairs = table.pairs()
    n = len(symbols)
    sym: list = list(symbols)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i):
        j = nxt[i]
        if j < n:
            found = pairs.get(sym[i] << 32 | sym[j])
            if found:
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = nxt[i] if sym[i] is not None else n
        if j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], sym[j] = m, None
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        if prv[i] >= 0:
            push(prv[i])
        push(i)
    return [s for s in sym if s is not None]
