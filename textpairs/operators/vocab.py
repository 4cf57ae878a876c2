"""Vocabulary (T1), encoding with truncation (T3, T4), decoding (T5),
truncation report (T6) and id audit (T7), in word mode.

The vocabulary is bounded by its ``size`` parameter, which is the proof that it may go to
every task. Encoding looks words up in their own row; decoding joins ids with the vocabulary
and collects them again by the caller's key columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from textpairs.functions.text import BOS_ID, EOS_ID, SPECIAL_TOKENS, UNK_ID, words
from textpairs.session import broadcast_bounded, cut_lineage

# fixed values: token limits of the reference (inputs, targets)
MAX_INPUT_LENGTH = 1024
MAX_TARGET_LENGTH = 128


def build_vocab(df: DataFrame, col: str = "text", size: int = 8000, min_freq: int = 2,
                specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """``token, id, cnt``. Specials first (ids 0..k-1), then words by count
    desc, token asc; count >= ``min_freq``; at most ``size`` entries in all."""
    spark = df.sparkSession
    # counted once: the threshold and the top list both read the written counts
    counts = cut_lineage(df.select(F.explode(words(col)).alias("token"))
                         .groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
                         .filter((F.col("cnt") >= F.lit(min_freq)) & ~F.col("token").isin(list(specials))))
    n_words = max(size - len(specials), 0)
    top = counts.filter(F.col("cnt") >= F.lit(_count_threshold(counts, n_words)))
    # top-k over the tokens at or above the k-th count only
    top = top.orderBy(F.desc("cnt"), F.asc("token")).limit(n_words)
    ranked = top.select("token", "cnt", (F.row_number().over(
        Window.orderBy(F.desc("cnt"), F.asc("token"))) + F.lit(len(specials) - 1)).alias("id"))
    sp = spark.createDataFrame([(t, i, None) for i, t in enumerate(specials)],
                               "token string, id int, cnt bigint")
    return sp.unionByName(ranked.select("token", F.col("id").cast("int").alias("id"), "cnt"))


def _count_threshold(counts: DataFrame, k: int) -> int:
    """The count of the k-th most frequent token (exact), from the histogram of
    count values: one row per distinct count, far fewer than tokens. Tokens
    below it can never enter the top k, so they are dropped before the final
    ordered merge. One number comes back to the driver."""
    if k <= 0:
        return 1 << 62
    hist = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n_tok"))
    w = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)
    row = (hist.withColumn("at_least", F.sum("n_tok").over(w))
           .filter(F.col("at_least") >= F.lit(k)).agg(F.max("cnt").alias("t")).first())
    return int(row["t"]) if row and row["t"] is not None else 0


#: Bytes of text that a task looks up together.
_SLICE = 1 << 22


def _ids_of(texts: pa.Array, limit: int, tokens: pa.Array, ids: np.ndarray) -> pa.ListArray:
    """``<s> ids </s>`` of the first ``limit`` words of every text; ``ids[k]`` belongs to ``tokens[k]``."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # splits at the characters of ``words``
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    starts = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    n = np.diff(starts)
    full[full] = np.arange(len(full[full])) - np.repeat(starts[:-1], n) < limit
    found = pc.fill_null(pc.index_in(flat.filter(pa.array(full)), value_set=tokens), len(ids)).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.minimum(n, limit) + 2)]).astype(np.int32)
    out = np.empty(ends[-1], dtype=np.int32)
    inner = np.ones(len(out), dtype=bool)
    inner[ends[:-1]] = inner[ends[1:] - 1] = False
    out[ends[:-1]], out[ends[1:] - 1], out[inner] = BOS_ID, EOS_ID, np.append(ids, np.int32(UNK_ID))[found]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out))


def encode(df: DataFrame, vocab: DataFrame, fields: Sequence[tuple[str, str, int]],
           key_cols: Sequence[str], carry_cols: Sequence[str] = (), vocab_size: int = 8000,
           prefix: dict[str, str] | None = None) -> DataFrame:
    """T3 + T4 in one pass: for each (text column, output column, max length)
    emit ``<s> ids </s>``, truncated so the whole array fits ``max length``.

    Unknown words map to ``<unk>``, a null side has no words. Every row is looked up where it stands, by Arrow
    kernels over a few MB of text: nothing is exploded or shuffled. The vocabulary, at most
    ``vocab_size`` rows, goes to the tasks with the function."""
    prefix = prefix or {}
    kept = [*key_cols, *carry_cols]
    texts = [F.concat(F.lit(prefix[c]), F.col(c)) if c in prefix else F.col(c) for c, _out, _n in fields]
    rows = df.select(*kept, *[t.alias(f"_text{i}") for i, t in enumerate(texts)])
    # (one row more than the bound, so that a larger vocabulary is an error and not cut)
    table = vocab.select("token", "id").filter("token is not null").limit(vocab_size + 1).toArrow()
    if table.num_rows > vocab_size:
        raise ValueError(f"the vocabulary has more than {vocab_size} rows")
    tokens, ids = table.column("token").combine_chunks().cast(pa.string()), table.column("id").to_numpy().astype(np.int32)
    names = [*kept, *[out for _c, out, _n in fields]]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(f"_text{i}") for i in range(len(fields))]
            size = sum(pc.fill_null(pc.binary_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in sides)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // _SLICE, prepend=-1))  # a first row always begins a slice
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                made = [_ids_of(side.slice(a, b - a), n - 2, tokens, ids) for side, (_c, _out, n) in zip(sides, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in kept], *made], names)

    schema = StructType([*[rows.schema[c] for c in kept], *[StructField(out, ArrayType(IntegerType())) for _c, out, _n in fields]])
    return rows.mapInArrow(look_up, schema)


def decode(df: DataFrame, vocab: DataFrame, ids_col: str, key_cols: Sequence[str],
           out: str = "text", skip_special: bool = True, vocab_size: int = 8000,
           n_special: int = len(SPECIAL_TOKENS)) -> DataFrame:
    """T5: ids back to space-joined words, special tokens skipped. A row whose
    ids are all special decodes to the empty string (it is kept)."""
    ex = df.repartition(*key_cols).select(*key_cols, F.posexplode_outer(ids_col).alias("pos", "id"))
    v = broadcast_bounded(vocab.select("token", "id"), vocab_size)
    j = ex.join(v, "id", "left")
    keep = F.col("pos").isNotNull()
    if skip_special:
        keep = keep & (F.col("id") >= F.lit(n_special))
    g = j.groupBy(*key_cols).agg(F.array_sort(F.collect_list(
        F.when(keep, F.struct("pos", F.coalesce("token", F.lit("<unk>")).alias("token"))))).alias("_s"))
    return g.select(*key_cols, F.array_join(F.transform("_s", lambda s: s["token"]), " ").alias(out))


def hist_quantiles(df: DataFrame, value: str, by: Sequence[str], qs: Sequence[float],
                   names: Sequence[str]) -> DataFrame:
    """Exact continuous quantiles (linear interpolation) of an integer column
    from its histogram: one row per distinct value instead of buffering every
    value of a group, so a huge group costs no more than its distinct lengths."""
    hist = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    hist = (hist.withColumn("_hi", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_lo", F.col("_hi") - F.col("_c"))
            .withColumn("_n", F.sum("_c").over(Window.partitionBy(*by))))
    aggs = []
    for q, name in zip(qs, names):
        r = (F.col("_n") - F.lit(1)).cast("double") * F.lit(float(q))
        klo, khi = F.floor(r), F.ceil(r)
        at = lambda k: F.min(F.when((F.col("_lo") <= k) & (k < F.col("_hi")), F.col(value)))
        frac = F.max(r - F.floor(r))
        aggs.append((at(klo) + frac * (at(khi) - at(klo))).cast("double").alias(name))
    return hist.groupBy(*by).agg(*aggs)


def length_report(df: DataFrame, by: Sequence[str] = ("source",), col: str = "input_text",
                  max_len: int = MAX_INPUT_LENGTH, prefix: str = "") -> DataFrame:
    """Per group, rows truncated by the limit, tokens lost, length quantiles.

    Length counts the wrapped sequence (words + ``<s>`` + ``</s>``)."""
    c = F.col(col)
    if prefix:
        c = F.concat(F.lit(prefix), c)
    lens = df.select(*by, (F.size(words(c)) + F.lit(2)).cast("bigint").alias("n_tokens"))
    base = lens.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("n_tokens") > max_len, 1).otherwise(0)).cast("bigint").alias("rows_truncated"),
        F.sum(F.greatest(F.col("n_tokens") - F.lit(max_len), F.lit(0))).cast("bigint").alias("tokens_lost"),
        F.max("n_tokens").alias("max_tokens"))
    q = hist_quantiles(lens, "n_tokens", by, [0.5, 0.9, 0.99], ["p50", "p90", "p99"])
    return base.join(q, list(by))


def audit_ids(df: DataFrame, ids_col: str, vocab_size: int, by: Sequence[str] = ("split",),
              allow: Sequence[int] = ()) -> DataFrame:
    """Rows with an id outside [0, vocab_size), rows not wrapped in
    ``<s>``/``</s>``. Ids in ``allow`` (e.g. -100 in labels) are accepted."""
    ids = F.col(ids_col)

    def out_of_range(x):
        c = (x < F.lit(0)) | (x >= F.lit(vocab_size))
        return c & ~x.isin(list(allow)) if allow else c

    bad = F.exists(ids, out_of_range)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("rows_bad_id"),
        F.sum(F.when(F.element_at(ids, 1) != F.lit(BOS_ID), 1).otherwise(0)).cast("bigint").alias("rows_no_bos"),
        F.sum(F.when(~F.array_contains(ids, F.lit(EOS_ID)), 1).otherwise(0)).cast("bigint").alias("rows_no_eos"),
        F.max(F.array_max(ids)).cast("bigint").alias("max_id"))


def vocab_check(vocab: DataFrame, size: int, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """T7 (vocabulary side): specials at their ids, ids dense, size within limit."""
    sp = F.create_map(*[x for i, t in enumerate(specials) for x in (F.lit(t), F.lit(i))])
    return vocab.agg(
        F.count(F.lit(1)).alias("entries"),
        F.max("id").cast("bigint").alias("max_id"),
        F.sum(F.when(F.element_at(sp, F.col("token")) == F.col("id"), 1).otherwise(0)).cast("bigint")
        .alias("specials_in_place"),
        (F.count(F.lit(1)) <= F.lit(size)).alias("within_size"))
