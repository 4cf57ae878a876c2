"""Batch assignment (B1), dynamic padding (B2-B4), batch accounting (B5) and
denoising text-infilling examples (B6)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.functions.hashing import u
from textpairs.functions.text import LABEL_IGNORE, PAD_ID, SPECIAL_TOKENS, let, words

# fixed values: per-device batch sizes of the reference (train, evaluation)
TRAIN_BATCH = 4
EVAL_BATCH = 8
REFERENCE_BATCHES = {"train": TRAIN_BATCH, "validation": EVAL_BATCH, "test": EVAL_BATCH}
NUM_EPOCHS = 3
MASK_TOKEN = SPECIAL_TOKENS[4]


def batch_size_col(sizes: Mapping[str, int], split_col: str = "split") -> Column:
    expr = None
    for split, n in sizes.items():
        expr = (F.when(F.col(split_col) == F.lit(split), F.lit(n)) if expr is None
                else expr.when(F.col(split_col) == F.lit(split), F.lit(n)))
    return expr


def assign_batches(df: DataFrame, sizes: Mapping[str, int] = REFERENCE_BATCHES,
                   rank_col: str = "shuffle_rank") -> DataFrame:
    """B1: consecutive shuffle ranks form a batch: ``batch_id = (rank-1) div size``.

    A split without a batch size fails the job instead of getting null ids."""
    size = F.coalesce(batch_size_col(sizes), F.raise_error(
        F.concat(F.lit("no batch size for split "), F.coalesce(F.col("split"), F.lit("null")))).cast("int"))
    return df.withColumn("batch_id", F.floor((F.col(rank_col) - F.lit(1)) / size).cast("bigint"))


def pad_batch(df: DataFrame, ids_col: str = "input_ids", pad_id: int = PAD_ID,
              batch_cols: Sequence[str] = ("split", "batch_id"), multiple: int | None = None,
              mask_col: str | None = "attention_mask", out: str | None = None) -> DataFrame:
    """Pad every row to the longest row of its batch (rounded up to a
    multiple when given); the attention mask marks real tokens. Labels are
    padded with ``-100`` by passing ``pad_id=-100, mask_col=None`` (B3)."""
    df = df.withColumn("_real_len", F.size(ids_col))
    n = F.col("_real_len")
    longest = F.max(n).over(Window.partitionBy(*batch_cols))
    if multiple:
        longest = F.ceil(longest / F.lit(multiple)).cast("int") * F.lit(multiple)
    df = df.withColumn("_target_len", longest)
    fill = F.col("_target_len") - n
    df = df.withColumn(out or ids_col, F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id), fill)))
    if mask_col:
        df = df.withColumn(mask_col, F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)))
    return df.drop("_target_len", "_real_len")


def pad_labels(df: DataFrame, labels_col: str = "labels",
               batch_cols: Sequence[str] = ("split", "batch_id"), multiple: int | None = None) -> DataFrame:
    """Label padding with -100 (ignored by the loss)."""
    return pad_batch(df, labels_col, LABEL_IGNORE, batch_cols, multiple, mask_col=None)


def batch_report(df: DataFrame, sizes: Mapping[str, int] = REFERENCE_BATCHES,
                 epochs: int = NUM_EPOCHS, ids_col: str = "input_ids",
                 padded_col: str = "padded_ids") -> DataFrame:
    """Per split, rows, batches per epoch, optimiser steps for all epochs,
    real and padded token counts and the padding share."""
    g = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("batch_id").alias("batches"),
        F.sum(F.size(ids_col)).cast("bigint").alias("real_tokens"),
        F.sum(F.size(padded_col)).cast("bigint").alias("padded_tokens"))
    return (g.withColumn("batch_size", batch_size_col(sizes).cast("bigint"))
            .withColumn("steps", (F.col("batches") * F.lit(epochs)).cast("bigint"))
            .withColumn("pad_share", F.round(F.lit(1.0) - F.col("real_tokens") / F.col("padded_tokens"), 6)))


def infill_bernoulli(df: DataFrame, text_col: str, key_col: str, ratio: float = 0.3,
                     seed: int = 42, out: str = "masked_text") -> DataFrame:
    """B6 (span="bernoulli"): word ``i`` (1-based) is masked when
    ``u(seed, key:i) < ratio``; each run of masked words becomes one ``[MASK]``.
    Target is the original word sequence. Built-ins only."""
    w = words(text_col)
    key = F.col(key_col).cast("string")
    flags = F.transform(w, lambda x, i: u(seed, F.concat(key, F.lit(":"), (i + 1).cast("string")))
                        < F.lit(ratio))
    df = df.withColumn("_w", w).withColumn("_m", flags)
    kept = F.transform("_w", lambda x, i: F.when(
        F.col("_m")[i],
        F.when((i > 0) & F.coalesce(F.col("_m")[i - 1], F.lit(False)), F.lit(None)).otherwise(F.lit(MASK_TOKEN))
    ).otherwise(x))
    return (df.withColumn(out, F.array_join(F.filter(kept, lambda x: x.isNotNull()), " "))
            .withColumn("target_text", F.array_join("_w", " "))
            .withColumn("masked_words", F.size(F.filter("_m", lambda b: b)).cast("bigint"))
            .drop("_w", "_m"))


def poisson_cuts(lam: float) -> list[float]:
    """Cumulative Poisson probabilities for 0, 1, 2, ... as far as a 32-bit uniform can tell them from 1."""
    cuts, p, total, k = [], math.exp(-lam), 0.0, 0
    while total < 1 - 2 ** -32:
        total += p
        cuts.append(round(total, 12))
        k += 1
        p *= lam / k
    return cuts


#: Draws beyond the budget: enough for lengths to reach it although a drawn length may be 0.
SPARE_DRAWS = 12


def infill_poisson(df: DataFrame, text_col: str, key_col: str, ratio: float = 0.3,
                   lam: float = 3.0, seed: int = 42, out: str = "masked_text") -> DataFrame:
    """B6 (span="poisson"): text infilling with Poisson(``lam``) span lengths; built-ins only.

    Of n words, ``floor(n * ratio + 0.5)`` are masked. Span lengths are drawn by
    inverse CDF from ``u(seed, key:len:k)`` until they add up to that (the last is cut); a
    length of 0 masks no word. Each span goes before one of the words that stay, or
    behind the last, by ``u(seed, key:gap:k)``, so spans never overlap: with spans in the order of
    their gaps, running sums of the lengths give the place of each. Every span
    becomes one ``[MASK]``."""
    key, cuts, zero = F.col(key_col).cast("string"), poisson_cuts(lam), F.lit(0)

    def draw(kind: str, k: Column) -> Column:
        return u(seed, F.concat(key, F.lit(f":{kind}:"), k.cast("string")))

    def poisson(k: Column) -> Column:
        return let(draw("len", k), lambda x: sum((F.when(x >= c, 1).otherwise(0) for c in cuts), zero))

    def sums(lengths: Column) -> Column:
        """0 and the running sums."""
        return F.aggregate(lengths, F.array(zero), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))

    def spans(budget: Column, stay: Column) -> Column:
        """(gap, k, n) in the order of their places."""
        lengths = F.transform(F.sequence(F.lit(1), budget + SPARE_DRAWS), poisson)

        def placed(lengths: Column, before: Column) -> Column:
            k_n = F.transform(lengths, lambda n, i: F.struct((i + 1).alias("k"), F.least(n, budget - F.get(before, i)).alias("n"),
                                                            F.get(before, i).alias("before")))
            return F.array_sort(F.transform(F.filter(k_n, lambda s: s["before"] < budget), lambda s: F.struct(
                F.floor(draw("gap", s["k"]) * (stay + 1)).cast("int").alias("gap"), s["k"].alias("k"), s["n"].alias("n"))))

        return let(lengths, lambda x: let(sums(x), lambda before: placed(x, before)))

    def masked(w: Column, stay: Column, found: Column, skipped: Column) -> Column:
        gap = lambda i: F.when(i > 0, F.get(found, i - 1)["gap"]).otherwise(zero)
        pieces = F.transform(found, lambda s, i: F.concat(
            F.slice(w, gap(i) + F.get(skipped, i) + 1, s["gap"] - gap(i)), F.array(F.lit(MASK_TOKEN))))
        last = gap(F.size(found))
        rest = F.slice(w, last + F.element_at(skipped, -1) + 1, F.greatest(stay - last, zero))
        return F.array_join(F.concat(F.flatten(pieces), rest), " ")

    def infilled(w: Column, budget: Column) -> Column:
        def of_spans(stay: Column) -> Column:
            return let(spans(budget, stay), lambda found: let(
                sums(F.transform(found, lambda s: s["n"])), lambda skipped: masked(w, stay, found, skipped)))
        return F.struct(let(F.size(w) - budget, of_spans).alias("text"), budget.cast("bigint").alias("n"))

    all_words = F.coalesce(words(text_col), F.array().cast("array<string>"))
    budget_of = lambda w: F.floor(F.size(w) * F.lit(ratio) + F.lit(0.5)).cast("int")
    done = let(all_words, lambda w: let(budget_of(w), lambda budget: infilled(w, budget)))
    df = df.withColumn("_done", done)
    return df.withColumn(out, F.col("_done.text")).withColumn("masked_words", F.col("_done.n")).drop("_done")
