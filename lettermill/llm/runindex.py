"""A run-length index: the Burrows-Wheeler transform of a block as runs, with
the suffix array sampled at the ends of every run."""

from __future__ import annotations

import numpy as np

#: Symbols of a text: 0 ends the block, 1 ends a segment, byte b is b + 2; seven fit a key.
BITS, PACKED = 9, 7
EDGES = np.int64(1) << np.arange(BITS, BITS * PACKED, BITS)  # between the symbols of a key


def joined(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All segments as symbols, each with its end; and their n+1 places."""
    n = len(edge) - 1
    out = np.ones(len(data) + n + 1, np.int64)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(edge))] = data.astype(np.int64) + 2
    out[-1] = 0
    return out, edge + np.arange(n + 1)


def packed(x: np.ndarray) -> np.ndarray:
    """From every place the next seven symbols as one number."""
    n, x = len(x), np.r_[x, np.zeros(PACKED, np.int64)]
    key = np.zeros(n, np.int64)
    for k in range(PACKED):
        key = key << BITS | x[k : k + n]
    return key


def suffix_array(key: np.ndarray) -> np.ndarray:
    """By prefix doubling from seven symbols on; ``key`` is ``packed``."""
    n = len(key)
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = PACKED
    while not new.all():
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        at = sa[open_]
        pair = (rank[at] << 32) | (rank[np.minimum(at + size, n)] + 1)
        order = np.argsort(pair)
        pair = pair[order]
        sa[open_] = at[order]
        first = np.r_[True, pair[1:] != pair[:-1]]
        new[open_] = first
        rank[at[order]] = open_[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        size *= 2
    return sa


class RunLengthIndex:
    """What is kept of a block: for every run of its transform the place of
    its first letter, where LF takes that, and the samples' common prefixes;
    and for every segment the rank of its end."""

    def __init__(self, data: np.ndarray, edge: np.ndarray, length: int):
        x, self.edge = joined(data, edge)
        key = packed(x)
        sa = suffix_array(key)
        letters = x[sa - 1]
        self.head = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]])
        tail = np.r_[self.head[1:], len(x)] - 1
        run_letter, size = letters[self.head], tail - self.head + 1
        # LF keeps the order of equal letters: runs by letter, one behind the other
        order = np.argsort(run_letter, kind="stable")
        self.image = np.empty(len(order), np.int64)
        self.image[order] = np.cumsum(size[order]) - size[order]
        # beside the image of a run's first letter lies that of the last letter of the run before it in this order
        first, last = sa[self.head] - 1, sa[tail] - 1
        before = np.zeros(len(order), np.int64)
        before[order[1:]] = self._common(x, key, first[order[1:]], last[order[:-1]], length)
        after = np.zeros(len(order), np.int64)
        after[order[:-1]] = before[order[1:]]
        self.before, self.after, self.tail = before, after, tail
        rank = np.empty(len(x), np.int32)
        rank[sa] = np.arange(len(x))
        self.ends = rank[self.edge[1:] - 1].astype(np.int64)

    @staticmethod
    def _common(x: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of suffixes, as far as ``most``. A
        sample before the block's first letter (-1) has none."""
        out = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        while len(open_):
            p, q = a[open_] + out[open_], b[open_] + out[open_]
            ok = np.maximum(p, q) < len(key)
            open_, p, q = open_[ok], p[ok], q[ok]
            same = key[p] == key[q]
            rest, differ = open_[~same], key[p[~same]] ^ key[q[~same]]
            out[rest] += PACKED - 1 - np.searchsorted(EDGES, differ, "right")
            open_ = open_[same]
            out[open_] += PACKED
            open_ = open_[out[open_] < most]
        return np.minimum(out, most)

    def stream(self, length: int) -> np.ndarray:
        """For each symbol of the segments whether the ``length`` from it also
        start elsewhere in the block.

        All segments go through the index from their ends to their beginnings,
        a letter at a time. Their matching statistics against everything else
        are the common prefixes with the two neighbours in suffix order: inside
        a run LF takes the neighbours along and the match grows by a letter,
        and at a run's ends the neighbour's is the sampled one.
        """
        size = np.diff(self.edge) - 1
        by = np.argsort(-size, kind="stable")
        at, low, high = self.ends[by], np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        size, stop = size[by], self.edge[1:][by] - 1
        hit = np.zeros(int(self.edge[-1]), bool)
        live = len(by)
        for step in range(1, int(size.max(initial=0)) + 1):
            live = int(np.searchsorted(-size, -step, "right"))  # segments of so many letters
            k = at[:live]
            run = np.searchsorted(self.head, k, "right") - 1
            low = np.where(k == self.head[run], self.before[run], low[:live] + 1)
            high = np.where(k == self.tail[run], self.after[run], high[:live] + 1)
            at = self.image[run] + k - self.head[run]
            if step >= length:
                hit[(stop[:live] - step)[np.maximum(low, high) >= length]] = True
        return np.delete(hit, self.edge[1:] - 1)
