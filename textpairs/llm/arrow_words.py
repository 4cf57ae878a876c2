"""Words of whole texts as dictionary indices, by Arrow kernels.

A batch of texts is lower-cased, split, flattened and dictionary-encoded by
Arrow; what follows works on integer arrays. Texts are taken a few MB at a
time, so the arrays of a slice stay small however large the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """``ids[starts[d]:starts[d + 1]]`` are the words of text ``d`` in ``dictionary``."""

    dictionary: pa.Array
    ids: np.ndarray
    starts: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts())

    def runs(self, n: int) -> np.ndarray:
        """Word positions at which a run of ``n`` words of one text starts."""
        left = self.starts[1:].repeat(self.counts()) - np.arange(len(self.ids))
        return np.flatnonzero(left >= n)


def split_words(texts: pa.Array, separators: str) -> Words:
    """Words between runs of ``separators`` (a pattern), A-Z lower-cased; a null text has none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), separators)
    flat = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    encoded = pc.dictionary_encode(flat.filter(full))
    ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(encoded.dictionary, ids, upto[offsets - offsets[0]])


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``most`` bytes of text together (one text is never cut)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]]) if len(sizes) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
