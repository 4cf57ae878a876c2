"""Mean generated length (E10), metric finishing (E11), perplexity of a
held-out set (E12) and checkpoint ranking with retention (E13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpairs.functions.text import LABEL_IGNORE, PAD_ID, lm_tokens
from textpairs.session import cut_lineage


def gen_len(df: DataFrame, ids_col: str = "pred_ids", pad_id: int = PAD_ID,
            strict_reference: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mean count of generated ids that are not padding.

    Default also ignores -100; ``strict_reference=True`` counts every id other
    than the pad id, as the reference does."""
    if strict_reference:
        keep = lambda x: x != F.lit(pad_id)
    else:
        keep = lambda x: (x != F.lit(pad_id)) & (x != F.lit(LABEL_IGNORE))
    return df.groupBy(*by).agg(F.avg(F.size(F.filter(ids_col, keep))).alias("gen_len"))


def finish_metrics(df: DataFrame, metrics: Sequence[str], prefix: str, keys: Sequence[str] = (),
                   digits: int = 4) -> DataFrame:
    """Wide metric columns to long ``(name, value)``, name prefixed
    (``test_rouge1``), value rounded to ``digits``."""
    pairs = ", ".join(f"'{prefix}_{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    long = df.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(metrics)}, {pairs}) AS (name, value)")
    return long.withColumn("value", F.round("value", digits))


def background_counts(corpus: DataFrame, text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Unigram counts of a corpus and its totals C (tokens) and V (types).

    The corpus is counted once: the totals and every later use read the written
    counts. The two totals come back to the driver as two numbers."""
    cf = cut_lineage(corpus.select(F.explode(lm_tokens(text_col)).alias("w"))
                     .groupBy("w").agg(F.count(F.lit(1)).alias("cf")))
    tot = cf.agg(F.sum("cf").alias("C"), F.count(F.lit(1)).alias("V")).first()
    return cf, int(tot["C"] or 0), int(tot["V"] or 0)


def background_p(cf: DataFrame, C: int, V: int) -> DataFrame:
    """p(w) = (cf(w)+1)/(C+V+1); an unseen word gets 1/(C+V+1)."""
    return cf.select("w", ((F.col("cf") + F.lit(1)).cast("double") / F.lit(float(C + V + 1))).alias("p"))


def perplexity(train: DataFrame, held: DataFrame, text_col: str = "text", by: Sequence[str] = (),
               lam: float = 0.5) -> DataFrame:
    """exp(-mean ln q(w | v)) over held-out tokens, where
    q = lam * c(v,w)/c(v) + (1-lam) * p(w) from training counts; the first word
    of a text, and any word whose history v never starts a training bigram,
    uses p(w) alone.

    Held-out tokens are counted per (group, v, w) before any join, so stop words
    join as one row per type, not once per token."""
    cf, C, V = background_counts(train, text_col)
    bg = background_p(cf, C, V)
    floor = 1.0 / float(C + V + 1)
    tr = train.select(lm_tokens(text_col).alias("t"))
    bigr = tr.select(F.explode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("v"),
                                            F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("w"))).alias("b"))
    cvw = bigr.groupBy(F.col("b.v").alias("v"), F.col("b.w").alias("w")).agg(F.count(F.lit(1)).alias("cvw"))
    cvw = cut_lineage(cvw)
    cv = cvw.groupBy("v").agg(F.sum("cvw").alias("cv"))
    # (history, word) per held-out token, zipped in-row: no token row carries
    # the whole text
    ht = held.select(*by, lm_tokens(text_col).alias("_t"))
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))))
    ho = ht.select(*by, F.explode(F.arrays_zip(prev.alias("v"), F.col("_t").alias("w"))).alias("z"))
    ho = ho.select(*by, F.col("z.v").alias("v"), F.col("z.w").alias("w"))
    ho = ho.groupBy(*by, "v", "w").agg(F.count(F.lit(1)).alias("n"))
    j = (ho.join(bg, "w", "left").join(cv, "v", "left").join(cvw, ["v", "w"], "left"))
    p = F.coalesce(F.col("p"), F.lit(floor))
    q = F.when(F.col("v").isNull() | F.col("cv").isNull(), p).otherwise(
        F.lit(lam) * F.coalesce(F.col("cvw"), F.lit(0)) / F.col("cv") + F.lit(1.0 - lam) * p)
    return j.groupBy(*by).agg(F.sum("n").alias("n_tokens"),
                              F.exp(-F.sum(F.col("n") * F.log(q)) / F.sum("n")).alias("perplexity"))


def rank_runs(metrics: DataFrame, name: str = "loss", greater_is_better: bool = False,
              keep: int = 2, run_col: str = "run", step_col: str = "step") -> DataFrame:
    """Per run, rank checkpoints by one metric (ties: later step first),
    mark the best, and keep the best plus the latest ``keep - 1`` steps."""
    m = metrics.filter(F.col("name") == F.lit(name))
    order = F.desc("value") if greater_is_better else F.asc("value")
    by_metric = Window.partitionBy(run_col).orderBy(order, F.desc(step_col))
    by_step = Window.partitionBy(run_col).orderBy(F.desc(step_col))
    return (m.withColumn("metric_rank", F.row_number().over(by_metric).cast("bigint"))
            .withColumn("recency", F.row_number().over(by_step))
            .withColumn("is_best", F.col("metric_rank") == 1)
            .withColumn("kept", (F.col("metric_rank") == 1) | (F.col("recency") <= F.lit(keep - 1)))
            .drop("recency"))
