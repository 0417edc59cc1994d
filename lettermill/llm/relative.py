"""Relative Lempel-Ziv factors of a block's texts against the block's index."""

from __future__ import annotations

import numpy as np


def suffix_ranks(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of non-negative numbers, and for 1, 2, 4, ... symbols
    the rank of every position by its next so many."""
    n = len(x)
    sa = np.argsort(x, kind="stable")
    new = np.r_[True, x[sa][1:] != x[sa][:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, size = [rank[:n].astype(np.int32)], 1
    while not new.all():
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        at = sa[open_]
        pair = (rank[at] << 32) | (rank[np.minimum(at + size, n)] + 1)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        sa[open_] = at[order]
        first = np.r_[True, pair[1:] != pair[:-1]]
        new[open_] = first
        rank[at[order]] = open_[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        size *= 2
        levels.append(rank[:n].astype(np.int32))
    return sa, levels


def nearest_smaller(key: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller key (-1: none)."""
    near = np.arange(-1, len(key) - 1)
    open_ = np.flatnonzero(near >= 0)
    while len(open_):
        open_ = open_[key[near[open_]] >= key[open_]]
        near[open_] = near[near[open_]]  # all between are no smaller either
        open_ = open_[near[open_] >= 0]
    return near


class Reference:
    """Index of all texts of a block, in which each text sees those of smaller
    owners as its reference: the suffixes of smaller owners next to its own in
    the suffix array hold its longest match."""

    def __init__(self, symbols: np.ndarray, edge: np.ndarray, owner: np.ndarray):
        n_texts = len(edge) - 1
        words, place = np.unique(symbols, return_inverse=True)
        text = np.repeat(np.arange(n_texts), np.diff(edge))
        self.begin = edge[:-1] + np.arange(n_texts)
        self.end = edge[1:] + np.arange(n_texts)
        x = np.empty(len(symbols) + n_texts, np.int64)
        x[np.arange(len(symbols)) + text] = place
        x[self.end] = len(words) + np.arange(n_texts)  # every text ends in a symbol of its own, which no match passes
        sa, self.levels = suffix_ranks(x)
        self.n = len(x)
        key = np.full(self.n, n_texts)
        key[np.arange(len(symbols)) + text] = np.unique(owner, return_inverse=True)[1][text]
        key = key[sa]
        above, below = nearest_smaller(key), self.n - 1 - nearest_smaller(key[::-1])[::-1]
        sa = np.r_[sa, -1]  # at -1 and n: none
        self.source = np.empty((2, self.n), np.int64)
        self.source[:, sa[:-1]] = sa[above], sa[below]

    def longest(self, at: np.ndarray) -> np.ndarray:
        """Length of the longest match of each position in its reference."""
        return np.maximum(*(self._common(at, source[at]) for source in self.source)) if len(at) else at

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, here = np.zeros(len(a), np.int64), np.flatnonzero(b >= 0)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, size = self.levels[k], 1 << k
            x, y = a[here] + out[here], b[here] + out[here]
            ok = np.maximum(x, y) < self.n
            ok[ok] = rank[x[ok]] == rank[y[ok]]
            out[here[ok]] += size
        return out

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The greedy parse of all texts, all a step on at a time: text, start
        and length of each factor, in order. A symbol without a match is a
        factor by itself, of length zero."""
        cursor, live = self.begin.copy(), np.flatnonzero(self.begin < self.end)
        out = []
        while len(live):
            at = cursor[live]
            size = self.longest(at)
            out.append((live, at, size))
            cursor[live] = at + np.maximum(size, 1)
            live = live[cursor[live] < self.end[live]]
        text, at, size = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (self.begin[:0],) * 3
        order = np.argsort(at, kind="stable")
        return text[order], at[order], size[order]


def repeated_starts(symbols: np.ndarray, edge: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each symbol whether the window of ``length`` from it also stands in
    a text of a smaller owner.

    Such a window lies in one factor or two that follow each other: a factor
    that begins before the window's end reaches that end. So windows inside
    long factors are repeated, and windows over the boundary of two factors
    that together are long enough are checked one by one.
    """
    ref = Reference(symbols, edge, owner)
    text, at, size = ref.factors()
    hit = np.zeros(ref.n + 1, np.int64)
    long_ = size >= length
    np.add.at(hit, at[long_], 1)
    np.add.at(hit, at[long_] + size[long_] - length + 1, -1)
    hit = np.cumsum(hit[:-1]) > 0
    pair = np.flatnonzero((text[1:] == text[:-1]) & (size[1:] > 0) & (size[1:] + size[:-1] >= length))
    lo = np.maximum(at[pair], at[pair + 1] - length + 1)
    hi = np.minimum(at[pair + 1] - 1, at[pair + 1] + size[pair + 1] - length)  # the last start to check
    n = np.maximum(hi - lo + 1, 0)
    check = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    check = check[~hit[check]]
    hit[check[ref.longest(check) >= length]] = True
    return hit[np.arange(len(symbols)) + np.repeat(np.arange(len(edge) - 1), np.diff(edge))]
