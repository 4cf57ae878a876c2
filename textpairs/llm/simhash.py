"""SimHash near-duplicate groups (operator 1).

A document's fingerprint is the bitwise majority of the XXH64 hashes (seed 42)
of its word shingles. Two fingerprints link when at most ``max_bits`` bits
differ; a group is a connected component of links.

Links are found with deletion variants. The 64 bits are cut into
``max_bits // 2 + 1`` segments, so two linked fingerprints differ by at most
one bit in at least one segment. Every distinct fingerprint is indexed under
each segment as it is and under each segment with one bit made a wildcard. Two
fingerprints meet in an equality join on (segment, wildcard, remaining bits):
on the exact variant when the segment agrees, and on exactly one wildcard
variant when it differs by one bit, where one side has that bit 0 and the
other 1. The join verifies the bit distance before it emits a pair.

Exact copies share a fingerprint and are joined as one row, so a group of
copies never makes pairs. Buckets are join keys of a shuffle join, which AQE
splits when one is hot; nothing is capped and nothing is broadcast.

Defined results: a null text is an empty text; a text without words has
fingerprint 0 and links like any other; a text shorter than the shingle is one
shingle; null or repeated ids stay rows of their own (a group's id is its
smallest non-null id, null when it has none); an empty table gives an empty
result; further columns of the input pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.components import connected_components
from textpairs.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER_AZ = {c: c + 32 for c in range(65, 91)}
_BYTE_ONES = np.uint64(0x0101010101010101)
_HASH_CHUNK = 1 << 16


def majority_bits(hashes: np.ndarray) -> int:
    """64-bit fingerprint of an array of uint64 hashes, as a signed integer.

    Counts are summed eight bit positions at a time: 255 rows of
    ``(h >> k) & 0x01..01`` fit into the eight byte lanes of one word."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros((8, 8), dtype=np.int64)  # [k][byte lane]
    pad = (-n) % 255
    rows = np.concatenate([hashes, np.zeros(pad, dtype=np.uint64)]).reshape(-1, 255)
    for k in range(8):
        lanes = ((rows >> np.uint64(k)) & _BYTE_ONES).sum(axis=1, dtype=np.uint64)
        counts[k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    out = 0
    for k in range(8):
        for lane in range(8):
            if 2 * counts[k][lane] > n:
                out |= 1 << (8 * lane + k)
    return out - (1 << 64) if out >> 63 else out


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included."""
    words = [w.encode() for w in WORD.findall(text.translate(LOWER_AZ))]
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(words) - shingle + 1, dtype=np.uint64)
    for a in range(0, len(out), _HASH_CHUNK):
        b = min(a + _HASH_CHUNK, len(out))
        out[a:b] = [digest(joined[i:j], 42) for i, j in
                    zip(starts[a:b].tolist(), ends[a + shingle - 1:b + shingle - 1].tolist(), strict=True)]
    return out


def fingerprint(text: Column, shingle: int) -> Column:
    """Column expression: the signed 64-bit SimHash of a text."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([majority_bits(shingle_hashes(t or "", shingle)) for t in batch], dtype="int64")

    return simhash(F.coalesce(text, F.lit("")))


def segment_masks(max_bits: int) -> list[int]:
    """Bit masks of the segments: one more than half the distance."""
    n = max_bits // 2 + 1
    if n > 64:
        raise ValueError("max_bits must be below 128")
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(max_bits: int) -> list[tuple[int, int, int]]:
    """(tag, mask of the bits compared, wildcard bit or 0) of each variant."""
    out = []
    for s, mask in enumerate(segment_masks(max_bits)):
        out.append((s * 65, _signed(mask), 0))
        for b in range(64):
            if mask >> b & 1:
                out.append((s * 65 + 1 + b, _signed(mask & ~(1 << b)), _signed(1 << b)))
    return out


def links(fingerprints: DataFrame, max_bits: int, col: str = "fp") -> DataFrame:
    """Verified links (src, dst) between distinct fingerprints within ``max_bits`` bits.

    A pair that agrees in several segments appears once for each of them."""
    table = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(m).cast("long").alias("mask"),
                               F.lit(w).cast("long").alias("wild")) for t, m, w in _variants(max_bits)])
    indexed = (fingerprints.select(F.col(col).alias("fp"), F.explode(table).alias("v"))
               .select("fp", "v.tag", "v.wild", F.col("fp").bitwiseAND(F.col("v.mask")).alias("key"),
                       (F.col("fp").bitwiseAND(F.col("v.wild")) != 0).alias("one")))
    left = indexed.filter(~F.col("one")).select("tag", "key", "wild", F.col("fp").alias("a"))
    right = indexed.filter(F.col("one") | (F.col("wild") == 0)).select("tag", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # exact variants hold every fingerprint on both sides: take each pair once
    once = (F.col("wild") != 0) | (F.col("a") < F.col("b"))
    joined = left.join(right, (left.tag == right.tag) & (left.key == right.key) & once & near)
    return joined.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row: the SimHash and the smallest id of its group."""
    fps = cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = connected_components(links(distinct, max_bits))
    member = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    ids = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = member.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each group: the row with the group's smallest id
    (a group without any id keeps the row with the smallest hash of its text).

    Rows that share that id and text keep the smallest of the rows by their
    other columns, compared in order. All columns pass through."""
    fps = cut_lineage(docs.select(*_identity(id_col, text_col), F.col(id_col).alias("id"),
                                  fingerprint(F.col(text_col), shingle).alias("fp")))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "_text", "_id")
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min(first).alias("first")))
    roots = connected_components(links(distinct, max_bits))
    kept = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
            .select("first._id", "first._text"))
    keyed = docs.select(*_identity(id_col, text_col), F.struct(*docs.columns).alias("_row"))
    one = keyed.join(kept, ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(F.min("_row").alias("_row"))
    return one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def _identity(id_col: str, text_col: str) -> list[Column]:
    """A row's id (null spelt out) and the hash of its text."""
    return [F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null")).alias("_id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text")]
