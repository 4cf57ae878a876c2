"""Byte-level BPE encoding and decoding with batched numpy merge rounds (operator 8).

The vocabulary is a public tokenizer file (its path is a parameter). Words of
many texts are laid out as one flat array of symbols. In each round every
adjacent pair inside a word is looked up by binary search over the sorted pair
keys, each word merges all occurrences of its lowest-rank pair from left to
right, and the array is compacted; words without a pair left drop out. Pieces
already met by the worker are not encoded again (see ``pieces``).

Ids and decoded text equal those of the public tokenizers library for the same
file with ``add_special_tokens=False``, without truncation and padding: strings
of the file's added tokens in a text become their single ids.

Defined results: a null text is an empty text (no ids, decoded ''); texts are
encoded whole, whatever their length; an empty table gives an empty result; all
columns pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from textpairs.llm.pieces import PieceCache, by_size

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NO_RANK = np.int64(1) << 40
# white space other than a lone blank or line end between two words
_IRREGULAR = ["  ", " \n", "\n ", "\n\n", *map(chr, [9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680,
                                                       *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in symbols.items():
            self.byte_ids[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        pairs_of_bytes = np.arange(1 << 16)
        self.byte_ranks = self._rank(self.byte_ids[pairs_of_bytes >> 8], self.byte_ids[pairs_of_bytes & 255])
        self.words = regex.compile(PATTERN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.cache = PieceCache(self._encode_pieces)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, by binary search over the sorted pair keys."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word): the merge rounds.

        Only the pairs beside a merge are looked up again; those of the first
        round are pairs of bytes, looked up once per vocabulary."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        sym, word = self.byte_ids[data], np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(sym), _NO_RANK, dtype=np.int64)
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.byte_ranks[data[:-1] * 256 + data[1:]], _NO_RANK)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(first, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, first), lengths)
            over = best == _NO_RANK
            if over.any():
                done.append((sym[over], word[over]))
                left = ~over
                sym, word, rank, best = sym[left], word[left], rank[left], best[left]
                if not len(sym):
                    break
            # overlapping occurrences (as in "aaa") merge from the left: every other one of a run
            at = np.flatnonzero(rank == best)
            run_start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, at, 0))
            at = at[(at - run_start) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # where the merged symbols stand after the removal
            sym, word, rank = sym[keep], word[keep], rank[keep]
            beside = np.zeros(len(sym), dtype=bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            changed = np.flatnonzero(beside)
            after = np.minimum(changed + 1, len(sym) - 1)
            rank[changed] = np.where((word[changed] == word[after]) & (changed < after), self._rank(sym[changed], sym[after]), _NO_RANK)
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        ids, owner = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def _split(self, text: str) -> list[str]:
        """Pre-tokens of a text; a blank and letters, and one mark behind, need no pattern."""
        if len(text) > 1 and text[0] == " ":
            if text[1:].isalpha():
                return [text]
            if len(text) > 2 and text[-1] in ".,!?;:" and text[1:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.words.findall(text)

    def _encode_pieces(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """A piece is a string after a lone blank or starting with its line end, a
        one-tuple of a string as it stands, or the id of an added token."""
        words: list[str] = []
        ends, given = [], []
        for i, p in enumerate(pieces):
            kind = type(p)
            if kind is str:
                words += self._split(p if p[:1] == "\n" else " " + p)
            elif kind is tuple:
                words += self._split(p[0])
            else:
                given.append((i, p))
            ends.append(len(words))
        counts = np.diff(np.array(ends), prepend=0)
        ids, sizes = self.merge_words([w.encode() for w in words])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.array(ends)
        n_ids = bounds[ends] - bounds[ends - counts]
        if given:
            where = bounds[ends][[i for i, _ in given]]
            ids = np.insert(ids, where, [p for _, p in given])
            n_ids[[i for i, _ in given]] = 1
        return ids, n_ids

    def _pieces(self, text: str) -> list:
        if not text:
            return []
        special = self.special_pattern is not None and self.special_pattern.search(text)
        if not special and not any(w in text for w in _IRREGULAR) and text[0] not in " \n" and text[-1] not in " \n":
            # a lone blank or line end before a word always starts a match of PATTERN
            out: list = text.replace("\n", " \n").split(" ")
            out[0] = (out[0],)
            return out
        out, at = [], 0
        for m in self.special_pattern.finditer(text) if special else ():
            out += [(w,) for w in self.words.findall(text[at:m.start()])]
            out.append(self.special[m.group()])
            at = m.end()
        return out + [(w,) for w in self.words.findall(text[at:])]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat int32 ids, number of ids of each text)."""
        parts = [self.cache.ids_of(map(self._pieces, group)) for group in by_size(texts)]
        if not parts:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def decode(self, ids: list[int]) -> str:
        """Bytes of the tokens as UTF-8, with U+FFFD for what is not."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = ByteBPE(path)
    return _CODECS[path]


def _mapped(df: DataFrame, text_col: str, added: list[tuple[str, DataType]],
            make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with added columns made from one column, a few MB of it at a time, in one worker per task."""
    base = df.drop(*[name for name, _ in added if name != text_col])
    if any(name == text_col for name, _ in added):
        raise ValueError("a result may not replace its own input")
    columns = base.columns
    schema = StructType([*base.schema.fields, *[StructField(n, t) for n, t in added]])
    at = columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for group in slices(batch.column(at)):
                part = batch.slice(first, group)
                first += group
                yield pa.record_batch([*part.columns, *make(part.column(at))], names=[*columns, *[n for n, _ in added]])

    return base.mapInArrow(rows, schema)


_PART_BYTES = 4 << 20


def slices(column: pa.Array) -> Iterator[int]:
    """Numbers of consecutive rows that hold about _PART_BYTES together (at least one row)."""
    sizes = np.diff(column.offsets.to_numpy()) if pa.types.is_list(column.type) else np.diff(
        np.frombuffer(column.buffers()[1], dtype=np.int32, count=column.offset + len(column) + 1)[column.offset:])
    n = held = 0
    for size in sizes.tolist():
        n, held = n + 1, held + size
        if held >= _PART_BYTES:
            yield n
            n = held = 0
    if n:
        yield n


def _ids_of(bpe: ByteBPE, texts: pa.Array) -> pa.ListArray:
    ids, counts = bpe.encode_many([t or "" for t in texts.to_pylist()])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, type=pa.int32()))


def _texts_of(bpe: ByteBPE, ids: pa.ListArray) -> pa.Array:
    # one row's ids at a time become Python numbers: a batch of long texts has millions
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array([bpe.decode(values[a:b].tolist()) if known else None
                     for a, b, known in zip(ends[:-1].tolist(), ends[1:].tolist(), ids.is_valid().to_pylist(), strict=True)], type=pa.string())


_IDS = ArrayType(IntegerType())


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text (array of int)."""
    return _mapped(df, text_col, [(ids_col, _IDS)], lambda texts: [_ids_of(codec(path), texts)])


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids (null for a null array)."""
    return _mapped(df, ids_col, [(text_col, StringType())], lambda ids: [_texts_of(codec(path), ids)])


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one worker per task: both columns, half the processes."""

    def make(texts: pa.Array) -> list[pa.Array]:
        ids = _ids_of(codec(path), texts)
        return [ids, _texts_of(codec(path), ids)]

    return _mapped(df, text_col, [(ids_col, _IDS), (decoded_col, StringType())], make)
