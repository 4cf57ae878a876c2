"""Importance resampling towards a target distribution (operator 11).

Features are all runs of 1 to ``longest`` words of a text, hashed (CRC-32) into
buckets. A bucket's gain is the smoothed log-ratio of its share in the target
texts and in the corpus; a document's weight is the sum of gains over its
features. Gumbel noise keyed by the document's id turns the top of weight plus
noise into a draw without replacement.

The texts are read once. Inside a task Arrow kernels lower-case, split, flatten
and dictionary-encode the words of a slice. A run of n words is the pair (run
of n-1 words, next word) of shifted dictionary indices; the pairs are
dictionary-encoded in turn and each distinct pair gets its CRC from the CRCs of
its two parts (``crc32(a + b)`` follows from ``crc32(a)``, ``crc32(b)`` and the
length of ``b``). Each document's bucket numbers are written beside its id as one
binary value. Bucket counts and, once the gains are known, weights (take and
segment-reduce) come from that table.

What reaches the driver is bounded by parameters: ``buckets`` counts of either
side and the cut points of the draw. The draw ranks only the rows in the score
bins that can hold a drawn row, each bin in its own task.

Defined results: a null or empty text has no features (weight 0); null or
repeated ids stay rows of their own and a null id draws noise as the text
``null``; rows equal in score are ordered by id (null last) and then by number
of features; without target texts every bucket is compared with the smoothed
uniform distribution; an empty corpus gives an empty result. Further columns of
the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.llm.arrow_words import Words, slices, split_words
from textpairs.session import scratch_path

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32
_DIRECT = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRCs moved on by the step that four tables of 256 entries describe."""
    low = np.uint32(255)
    return (tables[..., 0, :][crc & low] ^ tables[..., 1, :][(crc >> np.uint32(8)) & low]
            ^ tables[..., 2, :][(crc >> np.uint32(16)) & low] ^ tables[..., 3, :][crc >> np.uint32(24)])


class _Shift:
    """``crc32(a + b) = shift(crc32(a), len(b)) ^ crc32(b)``, for arrays."""

    def __init__(self) -> None:
        one = _byte_table()
        identity = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        step = (one[identity & np.uint32(255)] ^ (identity >> np.uint32(8))).astype(np.uint32)
        direct = [identity]
        for _ in range(_DIRECT):
            direct.append(_apply(step, direct[-1]))
        self.direct = np.stack(direct[:_DIRECT])  # by 0.._DIRECT-1 bytes
        self.doubled = [direct[_DIRECT]]  # by _DIRECT * 2**k bytes

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        low, t = length % _DIRECT, self.direct
        c = crc.astype(np.uint32)
        byte = np.uint32(255)
        out = (t[low, 0, c & byte] ^ t[low, 1, (c >> np.uint32(8)) & byte]
               ^ t[low, 2, (c >> np.uint32(16)) & byte] ^ t[low, 3, c >> np.uint32(24)])
        high, k = length // _DIRECT, 0
        while high.any():
            if k == len(self.doubled):
                self.doubled.append(_apply(self.doubled[-1], self.doubled[-1]))
            some = (high & 1).astype(bool)
            out[some] = _apply(self.doubled[k], out[some])
            high, k = high >> 1, k + 1
        return out


_SHIFT = _Shift()


def run_buckets(words: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, offsets of the texts): the features of each text together."""
    plain = words.dictionary.cast(pa.binary()).to_pylist()
    size = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    crc = np.fromiter(map(zlib.crc32, plain), dtype=np.uint32, count=len(plain))
    spaced = _SHIFT(np.full(len(plain), zlib.crc32(b" "), dtype=np.uint32), size) ^ crc  # of " " + word
    n = words.counts()
    per_run = [np.maximum(n - k, 0) for k in range(longest)]
    offsets = np.concatenate([[0], np.cumsum(sum(per_run))]).astype(np.int64)
    out = np.empty(offsets[-1], dtype=np.int64)
    owner, rank = words.owners(), np.arange(len(words.ids)) - words.starts[:-1].repeat(n)
    first = offsets[:-1].copy()
    run, run_crc = words.ids, crc  # index of the run that starts at each position; CRC of each distinct run
    at = np.arange(len(words.ids))
    for k in range(longest):
        if k:
            at = words.runs(k + 1)
            pair = run[at] * max(len(plain), 1) + words.ids[at + k]
            encoded = pc.dictionary_encode(pa.array(pair))
            distinct = encoded.dictionary.to_numpy()
            head, last = distinct // max(len(plain), 1), distinct % max(len(plain), 1)
            run_crc = _SHIFT(run_crc[head], size[last] + 1) ^ spaced[last]
            run = np.zeros(len(words.ids), dtype=np.int64)
            run[at] = encoded.indices.to_numpy()
        out[first[owner[at]] + rank[at]] = (run_crc.astype(np.int64) % buckets)[run[at]]
        first += per_run[k]
    return out, offsets


def hashed_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """(id, n_words, features): the bucket of every feature as little-endian uint32, one binary a row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), SEPARATORS)
                values, offsets = run_buckets(words, longest, buckets)
                packed = values.astype("<u4")
                features = pa.Array.from_buffers(pa.large_binary(), len(part), [
                    None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(words.counts(), pa.int64()), features], ["id", "n_words", "features"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"id {id_type}, n_words long, features binary")


def _feature_ids(features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows, offsets of the rows) of a binary column."""
    features = features.cast(pa.large_binary())
    ends = np.frombuffer(features.buffers()[1], dtype=np.int64)[features.offset:features.offset + len(features) + 1]
    data = features.buffers()[2]
    values = np.frombuffer(data, dtype="<u4")[ends[0] // 4:ends[-1] // 4] if data is not None else np.zeros(0, "<u4")
    return values, (ends - ends[0]) // 4


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows; each task adds up its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            values, _ = _feature_ids(batch.column("features"))
            total += np.bincount(values, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    partial = features.select("features").mapInArrow(count, "bucket long, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket in thousandths, rounded down, from two count tables."""
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for counts, table in ((s, corpus), (t, target)):
        for row in table.collect():  # at most ``buckets`` rows
            counts[row["bucket"]] = row["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * all_s) / ((a + 1.0) * all_t)))
                     for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    id_type = features.schema["id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _feature_ids(batch.column("features"))
            n = np.diff(offsets)
            taken = pc.take(pa.array(gain), pa.array(values)).to_numpy()
            weight = np.zeros(len(n), dtype=np.int64)
            some = np.flatnonzero(n)
            if len(some):
                weight[some] = np.add.reduceat(taken, offsets[:-1][some])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n.astype(np.int64)),
                                              pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return features.mapInArrow(weigh, f"id {id_type}, n_words long, n_features long, weight long")


def gumbel_noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down: a function of the seed and the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked_draw(scored: DataFrame, percent: int, bins: int = 1024) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the drawn rows, null for the others.

    Of the N rows with ``eligible``, the floor(percent * N / 100) first by score
    (descending), id and number of features are drawn. Equal rows are counted
    first, so one row repeated without end is one row here. The rows' scores are
    cut into bins between quantiles; a bin behind the last drawn row needs no
    order, every other one is ranked by itself and shifted by the bins before."""
    cols = [c for c in scored.columns if c != "eligible"]
    rows = scored.groupBy(*scored.columns).agg(F.count("*").alias("_n"))
    some = rows.filter("eligible")
    probe = some.agg(F.sum("_n").alias("n"),
                     F.percentile_approx("score", [i / bins for i in range(1, bins)], 10 * bins).alias("cuts")).first()
    drawn = percent * (probe["n"] or 0) // 100
    cuts = sorted(set(probe["cuts"] or []), reverse=True)
    nothing = F.lit(None).cast("long").alias("rank")
    expanded = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k")
    if not drawn:
        return rows.select(*cols, expanded).select(*cols, nothing)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    # number of cuts at or above the score: 0 holds the highest scores
    binned = some.withColumn("_bin", F.size(F.filter(bounds, lambda c: c >= F.col("score"))))
    before, open_bins, offsets = 0, [], []
    for row in sorted(binned.groupBy("_bin").agg(F.sum("_n").alias("n")).collect()):  # at most ``bins`` rows
        if before < drawn:
            open_bins.append(row["_bin"])
            offsets += [F.lit(row["_bin"]), F.lit(before).cast("long")]
        before += row["n"]
    last = max(open_bins)
    order = Window.partitionBy("_bin").orderBy(F.desc("score"), F.asc_nulls_last("id"), "n_features", *cols)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (binned.filter(F.col("_bin") <= last)
              .withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)) + F.create_map(*offsets)[F.col("_bin")])
              .select(*cols, "_ahead", expanded)
              .select(*cols, F.expr(f"if(_ahead + _k <= {drawn}, _ahead + _k, null)").alias("rank")))
    rest = (binned.filter(F.col("_bin") > last).select(*cols, "_n")
            .union(rows.filter(~F.col("eligible")).select(*cols, "_n"))
            .select(*cols, expanded).select(*cols, nothing))
    return ranked.union(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", longest: int = 3, buckets: int = 10_000, percent: int = 5,
             least_words: int = 20, seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``; rank is null for rows not drawn."""
    spark = docs.sparkSession
    path = scratch_path(spark, "features")
    hashed_features(docs, id_col, text_col, longest, buckets).write.parquet(path)
    features = spark.read.parquet(path)
    aim = hashed_features(target, target.columns[0], target_text, longest, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(aim, buckets), buckets)
    table = scratch_path(spark, "weights")
    (weights(features, gain)
     .select("id", "n_features", "weight", (F.col("weight") + gumbel_noise(F.col("id"), seed)).alias("score"),
             (F.col("n_words") >= least_words).alias("eligible")).write.parquet(table))
    return ranked_draw(spark.read.parquet(table), percent).select("id", "n_features", "weight", "score", "rank")
