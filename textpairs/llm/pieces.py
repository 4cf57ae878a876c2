"""A bounded per-worker memory of encoded text pieces.

Tokenisers here encode a text piece by piece, and texts repeat pieces. Each
Python worker remembers the ids of pieces it has met in one flat array; a batch
is then looked up and gathered with numpy, and only new pieces are encoded.
The memory holds at most ``limit`` pieces and starts anew beyond that, which
changes speed and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from itertools import chain

import numpy as np


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length of every range, concatenated."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


class _Index(dict):
    """Piece -> number; a piece met first gets the next number and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, piece: Hashable) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class PieceCache:
    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 700_000):
        """``encode`` maps new pieces to (flat ids, number of ids of each piece)."""
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    @staticmethod
    def _fit(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        ids, counts = self.encode(new)
        n = len(new)
        first = len(self.index) - n
        self.flat = self._fit(self.flat, self.used + len(ids))
        self.starts, self.lengths = self._fit(self.starts, first + n), self._fit(self.lengths, first + n)
        self.flat[self.used:self.used + len(ids)] = ids
        self.lengths[first:first + n] = counts
        self.starts[first:first + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def ids_of(self, documents: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each document) of documents given as lists of pieces."""
        documents = list(documents)
        pieces = list(chain.from_iterable(documents))
        if len(self.index) > self.limit:
            self._clear()
        at = np.fromiter(map(self.index.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if self.index.new:
            self._learn()
        lengths = self.lengths[at]
        ids = self.flat[ragged(self.starts[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in documents], dtype=np.int64)]).astype(np.int64)
        return ids, np.diff(ends[bounds])


def by_size(texts: list[str], most: int = 1 << 20) -> Iterable[list[str]]:
    """Consecutive texts of about ``most`` characters together (one text is never cut)."""
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group
