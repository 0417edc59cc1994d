"""Minimal acyclic automata of sorted words, whose arcs carry word numbers."""

from __future__ import annotations

import numpy as np

from lettermill.llm.textbytes import mix64


class Automaton:
    """Accepts ``words`` (distinct, sorted, a byte for each character) and gives
    each its number, its place in their order: the sum of what the arcs on its
    path add (a minimal perfect hash).

    The words' prefixes are numbered depth by depth, and prefixes with equal
    continuations are merged from the words' ends on, height by height. They
    are compared by a 64-bit hash of their arcs, and then arc by arc.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        parent, char, child, final, count, levels = _trie(data, off)
        seed = 1
        while (merged := _merge(parent, char, child, final, levels, seed)) is None:
            seed += 1
        state, first = merged
        kept = np.zeros(len(final), bool)
        kept[first] = True
        own = np.flatnonzero(kept[parent])
        own = own[np.argsort(state[parent[own]], kind="stable")]
        source = state[parent[own]]
        self.key = source * 256 + char[own]
        self.to = state[child[own]]
        self.final = final[first]
        self.first = np.searchsorted(source, np.arange(len(first) + 1))
        before = np.r_[0, np.cumsum(count[child[own]])]
        self.add = before[:-1] - before[self.first[source]] + self.final[source]
        self.start = int(state[0])

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair: whether there is an arc, and which."""
        want = state * 256 + char
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return self.key[at] == want, at

    def number(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The numbers of words; -1 for others."""
        out = np.full(len(off) - 1, -1)
        at = np.arange(len(off) - 1)
        if len(self.key) and len(at):
            self._complete(data, off, at, np.full(len(at), self.start), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64),
                lambda q, n: out.__setitem__(q, n))
        return out

    def near(self, data: np.ndarray, off: np.ndarray, exact: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, number)`` of the words that differ from a query by exactly
        one inserted, deleted or replaced character between its first ``exact``
        and its last ``tail`` characters, which must be equal; each once.

        The first characters are walked. At every place behind them the arcs are
        tried that an error allows, and the rest is completed exactly. A
        character in a run is deleted at the run's end only, and inserted behind
        equal ones only, so no word is found twice.
        """
        queries: list[np.ndarray] = []
        numbers: list[np.ndarray] = []

        def take(q: np.ndarray, n: np.ndarray) -> None:
            queries.append(q)
            numbers.append(n)

        n = len(off) - 1
        lens = np.diff(off)
        stop = lens - tail
        at, state, sum_ = np.arange(n), np.full(n, self.start), np.zeros(n, np.int64)
        d = 0
        while len(at) and len(self.key):
            here = np.flatnonzero(exact[at] <= d)
            if len(here):
                self._errors(data, off, at[here], state[here], sum_[here], d, stop, take)
            go = np.flatnonzero(stop[at] > d)
            at, state, sum_ = at[go], state[go], sum_[go]
            ok, arc = self.step(state, data[off[at] + d].astype(np.int64))
            arc = arc[ok]
            at, state, sum_ = at[ok], self.to[arc], sum_[ok] + self.add[arc]
            d += 1
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(queries or empty), np.concatenate(numbers or empty)

    def _errors(self, data: np.ndarray, off: np.ndarray, at: np.ndarray, state: np.ndarray, sum_: np.ndarray, d: int, stop: np.ndarray, take) -> None:
        inside = stop[at] > d
        place = np.minimum(off[at] + d, len(data) - 1)
        mine = np.where(inside, data[place], 0).astype(np.int64)
        after = data[np.minimum(place + 1, len(data) - 1)]
        gone = np.flatnonzero(inside & ((stop[at] == d + 1) | (after != mine)))
        n_arcs = self.first[state + 1] - self.first[state]
        from_ = np.repeat(np.arange(len(at)), n_arcs)
        arc = np.arange(len(from_)) - np.repeat(np.cumsum(n_arcs) - n_arcs, n_arcs) + self.first[state][from_]
        other = self.key[arc] % 256 != mine[from_]
        more = np.flatnonzero(other | ~inside[from_])
        swap = np.flatnonzero(other & inside[from_])
        q = np.concatenate([at[gone], at[from_[more]], at[from_[swap]]])
        s = np.concatenate([state[gone], self.to[arc[more]], self.to[arc[swap]]])
        n = np.concatenate([sum_[gone], sum_[from_[more]] + self.add[arc[more]], sum_[from_[swap]] + self.add[arc[swap]]])
        pos = np.concatenate([np.full(len(gone), d + 1), np.full(len(more), d), np.full(len(swap), d + 1)])
        self._complete(data, off, q, s, pos, n, take)

    def _complete(self, data: np.ndarray, off: np.ndarray, q: np.ndarray, s: np.ndarray, pos: np.ndarray, n: np.ndarray, take) -> None:
        while len(q):
            left = off[q] + pos < off[q + 1]
            done = np.flatnonzero(~left & self.final[s])
            if len(done):
                take(q[done], n[done])
            q, s, pos, n = q[left], s[left], pos[left], n[left]
            ok, arc = self.step(s, data[off[q] + pos].astype(np.int64))
            arc = arc[ok]
            q, s, pos, n = q[ok], self.to[arc], pos[ok] + 1, n[ok] + self.add[arc]


def _trie(data: np.ndarray, off: np.ndarray) -> tuple:
    """Arcs ``(parent, char, child)`` between prefixes, whether each is a word
    and of how many words it is a prefix, and the arcs' bounds by depth."""
    n, lens = len(off) - 1, np.diff(off)
    node = np.zeros(n, np.int64)
    parents, chars, children, levels = [], [], [], [0]
    finals, counts = [np.array([n > 0 and lens[0] == 0])], [np.array([n])]
    total, d = 1, 0
    at = np.flatnonzero(lens > 0)
    while len(at):
        c, p = data[off[at] + d], node[at]
        start = np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])]
        begin = np.flatnonzero(start)
        node[at] = total + np.cumsum(start) - 1
        parents.append(p[begin])
        chars.append(c[begin].astype(np.int64))
        children.append(total + np.arange(len(begin)))
        finals.append(lens[at[begin]] == d + 1)
        counts.append(np.diff(np.r_[begin, len(at)]))
        levels.append(levels[-1] + len(begin))
        total += len(begin)
        d += 1
        at = at[lens[at] > d]
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return flat(parents), flat(chars), flat(children), flat(finals), flat(counts), levels


def _merge(parent: np.ndarray, char: np.ndarray, child: np.ndarray, final: np.ndarray, levels: list[int], seed: int) -> tuple | None:
    """The state of every prefix and one prefix of every state; None if two
    prefixes with different arcs have one hash."""
    height = np.zeros(len(final), np.int64)
    for a, b in zip(levels[-2::-1], levels[:0:-1], strict=True):
        np.maximum.at(height, parent[a:b], height[child[a:b]] + 1)
    by_node = np.argsort(height, kind="stable")
    node_edge = np.searchsorted(height[by_node], np.arange(int(height.max()) + 2))
    by_arc = np.argsort(height[parent], kind="stable")
    arc_edge = np.searchsorted(height[parent][by_arc], np.arange(int(height.max()) + 2))
    state, firsts, total = np.zeros(len(final), np.int64), [], 0
    n_arcs = np.bincount(parent, minlength=len(final))
    for h in range(int(height.max()) + 1):
        nodes, arcs = by_node[node_edge[h] : node_edge[h + 1]], by_arc[arc_edge[h] : arc_edge[h + 1]]
        if not h:  # words that no other word continues (and the root of no words)
            state[nodes] = 0
            firsts.append(nodes[:1])
            total = 1
            continue
        nodes = nodes[np.argsort(nodes, kind="stable")]
        code = state[child[arcs]] * 256 + char[arcs]
        begin = np.cumsum(n_arcs[nodes]) - n_arcs[nodes]
        mixed = mix64((code + 1).astype(np.uint64) * np.uint64(2 * seed + 0x9E3779B97F4A7C15 - 1) + np.uint64(seed))
        sig = np.add.reduceat(mixed, begin) * np.uint64(2) + final[nodes].astype(np.uint64)
        _, first, which = np.unique(sig, return_index=True, return_inverse=True)
        like = first[which]
        if (n_arcs[nodes] != n_arcs[nodes[like]]).any() or (final[nodes] != final[nodes[like]]).any():
            return None
        other = np.repeat(begin[like] - begin, n_arcs[nodes]) + np.arange(len(arcs))
        if (code != code[other]).any():
            return None
        state[nodes] = total + which
        firsts.append(nodes[first])
        total += len(first)
    return state, np.concatenate(firsts)
