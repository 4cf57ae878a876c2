"""Tokens of several list columns counted in their own row, by Arrow kernels.

The lists of some rows are flattened and dictionary-encoded together, so that what follows works on integer
arrays. Rows are taken about a million tokens at a time, however large the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that a task counts together.
_SLICE = 1 << 20


def lengths(lists: pa.Array) -> np.ndarray:
    """Tokens of every row; a null list has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def token_slices(sides: Sequence[pa.Array]) -> Iterator[tuple[int, int]]:
    """Consecutive rows ``a, b`` of about ``_SLICE`` tokens together (a row is never cut)."""
    size = sum(lengths(side) for side in sides)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // _SLICE, prepend=-1))  # a first row always begins a slice
    return zip(cuts.tolist(), [*cuts[1:].tolist(), len(size)], strict=True)


def codes(sides: Sequence[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct tokens of all sides, and for each side the place of every token in them."""
    flat = [side.flatten() for side in sides]
    coded = pa.concat_arrays(flat).dictionary_encode()
    ends = np.cumsum([len(x) for x in flat])[:-1]
    return coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends)


def clipped_overlap(cand: pa.Array, ref: pa.Array, ns: Sequence[int]) -> pa.Array:
    """For every row and each ``n``: n-grams both sides hold, each as often as the side that has fewer of it."""
    out = np.zeros((len(cand), len(ns)), dtype=np.int64)
    for a, b in token_slices([cand, ref]):
        sides = [cand.slice(a, b - a), ref.slice(a, b - a)]
        sizes = [lengths(side) for side in sides]
        owners = [np.repeat(np.arange(b - a), size) for size in sizes]
        left = [np.repeat(np.cumsum(size), size) - np.arange(size.sum()) for size in sizes]  # tokens to the end of the row
        _tokens, single = codes(sides)
        grams, built = single, 1
        for k in sorted(set(ns)):
            while built < k:  # a run one longer: number of the run and of the token after it
                nexts = [np.append(s[built:], np.zeros(min(built, len(s)), dtype=np.int64)) for s in single]
                many = np.int64(max((s.max(initial=0) for s in single), default=0) + 1)
                numbered = np.unique(np.concatenate([g * many + x for g, x in zip(grams, nexts, strict=True)]), return_inverse=True)[1]
                grams, built = np.split(numbered.astype(np.int64), [len(single[0])]), built + 1
            many = np.int64(max((g.max(initial=0) for g in grams), default=0) + 1)
            keys, times = zip(*[np.unique((o * many + g)[rest >= k], return_counts=True)
                                for o, g, rest in zip(owners, grams, left, strict=True)], strict=True)
            _both, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
            hits = np.bincount(keys[0][i] // many, weights=np.minimum(times[0][i], times[1][j]), minlength=b - a)
            out[a:b, [p for p, n in enumerate(ns) if n == k]] = hits.astype(np.int64)[:, None]
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(ns)).cast(pa.list_(pa.int64()))
