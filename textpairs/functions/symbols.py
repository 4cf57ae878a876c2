"""Symbol sequences of many words in flat arrays, merged pair by pair.

A small per-block helper of BPE learning: words stand one after the other with
a separator between them and are linked lists of positions, so a merge touches the positions of
its pair only, and reports by how much it changes the count of every pair.
"""

from __future__ import annotations

import numpy as np

#: A pair of symbols is one integer: first * PAIR + second.
PAIR = 1 << 24
_GONE, _END = -2, -1


class SymbolRuns:
    def __init__(self, flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
        """Words of ``lengths`` symbols each, one after the other in ``flat``; ``counts`` says how often each occurs."""
        n = len(lengths)
        self.counts = counts.astype(np.int64)
        stops = np.cumsum(lengths + 1, dtype=np.int64)  # position of the separator behind each word
        self.sym = np.full(len(flat) + n + 1, _END, dtype=np.int32)
        inner = np.ones(len(self.sym), dtype=bool)
        inner[0] = False
        inner[stops] = False
        self.sym[inner] = flat
        self.word = np.zeros(len(self.sym), dtype=np.int32)
        self.word[inner] = np.repeat(np.arange(n, dtype=np.int32), lengths)
        self.next = np.arange(1, len(self.sym) + 1, dtype=np.int32)
        self.prev = np.arange(-1, len(self.sym) - 1, dtype=np.int32)
        self.mark = np.zeros(len(self.sym), dtype=bool)
        self.index(None, 0)

    def copy(self) -> SymbolRuns:
        out = object.__new__(SymbolRuns)
        out.counts, out.word = self.counts, self.word
        out.sym, out.next, out.prev, out.mark = self.sym.copy(), self.next.copy(), self.prev.copy(), self.mark.copy()
        out.keys, out.at, out.known, out.made = self.keys, self.at, self.known, dict(self.made)
        return out

    def index(self, wanted: np.ndarray | None, symbols: int) -> None:
        """Index the places of pairs, of those in ``wanted`` (sorted) or of all; symbols from
        ``symbols`` on are found through the places where they were made."""
        first = np.flatnonzero(self.sym[:-1] >= 0).astype(np.int32)
        second = self.sym[self.next[first]]
        keys = self.sym[first].astype(np.int64) * PAIR + second
        keep = second >= 0
        if wanted is not None and len(wanted):
            spot = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            keep &= wanted[spot] == keys
        elif wanted is not None:
            keep[:] = False
        keys, first = keys[keep], first[keep]
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], first[order]
        self.known, self.made = symbols, {}

    def _places(self, a: int, b: int) -> np.ndarray:
        if a in self.made:
            at = self.made[a]
        elif b in self.made:
            second = self.made[b]
            at = self.prev[second[self.sym[second] == b]]
        elif max(a, b) >= self.known > 0:
            return np.zeros(0, dtype=np.int32)  # made in this round, but not in this block
        else:
            lo, hi = np.searchsorted(self.keys, [a * PAIR + b, a * PAIR + b + 1])
            at = self.at[lo:hi]
        at = at[self.sym[at] == a]
        at = at[self.sym[self.next[at]] == b]
        if a == b and len(at) > 1:  # in a run of one symbol every other place counts, from the left
            starts = np.flatnonzero(np.concatenate([[True], self.next[at[:-1]] != at[1:]]))
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            at = at[rank % 2 == 0]
        return at

    def merge(self, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge every ``a b`` into ``new``: (pairs, change of their counts)."""
        first = self._places(a, b)
        self.made[new] = first
        if not len(first):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        second = self.next[first]
        left, right = self.prev[first], self.next[second]
        weight = self.counts[self.word[first]]
        before, after = self.sym[left].astype(np.int64), self.sym[right].astype(np.int64)
        self.mark[second] = True
        own_left = (before >= 0) & ~self.mark[left]  # else the match before has it as its right pair
        self.mark[second] = False
        self.mark[first] = True
        then = np.where(self.mark[right], new, after)
        self.mark[first] = False
        has_right = after >= 0
        keys = np.concatenate([np.full(len(first), a * PAIR + b), before[own_left] * PAIR + a, b * PAIR + after[has_right],
                               before[own_left] * PAIR + new, new * PAIR + then[has_right]])
        change = np.concatenate([-weight, -weight[own_left], -weight[has_right], weight[own_left], weight[has_right]])
        self.sym[first], self.sym[second] = new, _GONE
        self.next[first] = right
        self.prev[right] = first
        return added_up(keys, change)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(flat symbols, lengths) as they are now."""
        alive = self.sym >= 0
        return self.sym[alive], np.bincount(self.word[alive], minlength=len(self.counts))


def added_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.add.reduceat(values, starts) if len(keys) else values
