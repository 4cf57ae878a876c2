"""Evaluation of generated summaries: label unmasking (E1), sentence split
(E2), ROUGE tokens (E3), ROUGE-1/2 (E4, E5), ROUGE-L/Lsum (E6, E7), corpus
roll-up (E8) and bootstrap intervals (E9).

ROUGE-N deals the pairs out by key and counts the n-grams of each in its own row;
only those of pairs that share a key are exploded, counted per (key, gram), clipped
with ``least`` and summed. ROUGE-L is a bit-parallel expression over the token arrays. Only the union of ROUGE-Lsum, which needs positions, runs in
an Arrow-batched UDF over the sentences Spark already split.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from textpairs.functions.hashing import poisson1, u
from textpairs.functions.lcs import lcs_length
from textpairs.functions.lcs import rouge_lsum as _rouge_lsum
from textpairs.functions.multisets import clipped_overlap
from textpairs.functions.text import (LABEL_IGNORE, PAD_ID, ngrams, rouge_tokens, sentences)
from textpairs.operators.joins import with_key_rows
from textpairs.operators.metrics import finish_metrics, gen_len
from textpairs.operators.stems import stemmed
from textpairs.operators.vocab import decode
from textpairs.session import cut_lineage

PRF = StructType([StructField("precision", DoubleType()), StructField("recall", DoubleType()),
                  StructField("fmeasure", DoubleType())])


def unmask_labels(df: DataFrame, col: str = "labels", pad_id: int = PAD_ID,
                  out: str | None = None) -> DataFrame:
    """-100 (loss-ignore marker) back to the pad id before decoding."""
    return df.withColumn(out or col, F.transform(col, lambda x: F.when(
        x == F.lit(LABEL_IGNORE), F.lit(pad_id)).otherwise(x)))


def with_sentences(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Strip, split into sentences, join with newlines."""
    return df.withColumn(out or col, F.array_join(sentences(col), "\n"))


#: The metrics of an evaluation, in the order in which they are reported.
METRICS = ["rouge1", "rouge2", "rougeL", "rougeLsum"]


def tokens(col, ascii_only: bool = True) -> Column:
    """ROUGE tokens, unstemmed (``stems.stemmed`` stems the arrays of a table)."""
    return rouge_tokens(col, ascii_only)


def score_pairs(df: DataFrame, key_cols: Sequence[str], cand_col: str = "candidate", ref_col: str = "reference",
                stem: bool = True) -> DataFrame:
    """``key_cols`` and the F-measures of ROUGE-1, -2, -L and -Lsum of every pair of texts.

    Sentences are lines (E2). ``stem`` stems the tokens of all four, as an English evaluation does."""
    keys = list(key_cols)
    given = df.select(*keys, tokens(cand_col).alias("cand_tokens"), tokens(ref_col).alias("ref_tokens"),
                      sentence_tokens(cand_col).alias("_cs"), sentence_tokens(ref_col).alias("_rs"))
    if stem:
        # a text's tokens are those of its sentences in order, so one pass stems both forms
        flat = given.withColumn("cand_tokens", F.flatten("_cs")).withColumn("ref_tokens", F.flatten("_rs"))
        done = stemmed(flat, keys, ["cand_tokens", "ref_tokens"])
        given = done.withColumn("_cs", _resplit("_cs", "cand_tokens")).withColumn("_rs", _resplit("_rs", "ref_tokens"))
    pairs = cut_lineage(given)
    scored = _lsum(rouge_l(pairs), F.col("_cs"), F.col("_rs"), "rougeLsum").select(*keys, "rougeL_f", "rougeLsum_f")
    scored = scored.join(rouge_ns(pairs, (1, 2), keys), keys)
    return scored.select(*keys, *[F.col(f"{m}_f").alias(m) for m in METRICS])


def _resplit(sentences_col: str, tokens_col: str) -> Column:
    """Stemmed tokens cut into sentences of the lengths of ``sentences_col``."""
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(sentences_col, start, lambda s, x: F.struct(
        F.concat(s["out"], F.array(F.slice(F.col(tokens_col), s["at"] + 1, F.size(x)))).alias("out"),
        (s["at"] + F.size(x)).alias("at")), lambda s: s["out"])


def evaluate(df: DataFrame, vocab: DataFrame, key_cols: Sequence[str], pred_col: str = "pred_ids", label_col: str = "labels",
             vocab_size: int = 8000, stem: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """One row (a group of ``by``): corpus ROUGE-1/2/L/Lsum times 100, ``gen_len`` and ``pairs``, unrounded.

    Masked labels back to the pad id, both sides decoded, sentences on lines (E1, E2), tokens stemmed (E3),
    F-measures (E4-E7) and their corpus mean times 100 (E8), the mean generated length (E10)."""
    keys = list(key_cols)
    given = cut_lineage(unmask_labels(df, label_col).select(*keys, pred_col, label_col))
    cand = with_sentences(decode(given, vocab, pred_col, keys, out="candidate", vocab_size=vocab_size), "candidate")
    ref = with_sentences(decode(given, vocab, label_col, keys, out="reference", vocab_size=vocab_size), "reference")
    scored = score_pairs(cand.join(ref, keys), keys, stem=stem)
    means = rouge_summary(scored, METRICS, by)
    lengths = gen_len(given, pred_col, by=by)
    if by:
        return means.join(lengths, list(by))
    # one row of means and one of the mean length
    return means.withColumn("_one", F.lit(1)).join(lengths.withColumn("_one", F.lit(1)), "_one").drop("_one")


def compute_metrics(df: DataFrame, vocab: DataFrame, key_cols: Sequence[str], pred_col: str = "pred_ids",
                    label_col: str = "labels", prefix: str = "test", vocab_size: int = 8000, stem: bool = True) -> DataFrame:
    """The evaluation of one set of predictions as one flow, ``(name, value)``: ``evaluate`` with
    names prefixed and values rounded to four places (E11)."""
    wide = evaluate(df, vocab, key_cols, pred_col, label_col, vocab_size, stem)
    return finish_metrics(wide, [*METRICS, "gen_len"], prefix)


def rouge_n(df: DataFrame, n: int, key: str | Sequence[str], cand_tokens: str = "cand_tokens",
            ref_tokens: str = "ref_tokens", prefix: str | None = None) -> DataFrame:
    """ROUGE-N precision, recall and F per pair, with clipped counts.

    Pairs with no n-grams on either side score 0 (never dropped).
    """
    prefix = prefix or f"rouge{n}"
    per_pair = clipped_counts(df, [n], key, cand_tokens, ref_tokens)
    for c in ("overlap", "n_cand", "n_ref"):
        per_pair = per_pair.withColumnRenamed(f"{c}{n}", c)
    return prf_columns(per_pair, "overlap", "n_cand", "n_ref", prefix)


def rouge_ns(df: DataFrame, ns: Sequence[int], key: str | Sequence[str]) -> DataFrame:
    """Keys and ``rouge<n>_f`` of every ``n`` in one pass over the pairs."""
    scored = clipped_counts(df, ns, key)
    for n in ns:
        scored = prf_columns(scored, f"overlap{n}", f"n_cand{n}", f"n_ref{n}", f"rouge{n}")
    return scored.select(*([key] if isinstance(key, str) else key), *[f"rouge{n}_f" for n in ns])


def clipped_counts(df: DataFrame, ns: Sequence[int], key: str | Sequence[str], cand_tokens: str = "cand_tokens",
                   ref_tokens: str = "ref_tokens") -> DataFrame:
    """One row a key: ``overlap<n>``, ``n_cand<n>`` and ``n_ref<n>`` for each ``n``.

    A row that has its key for itself is counted where it stands. The n-grams of rows that share a key
    count together: they are exploded and added up."""
    keys = [key] if isinstance(key, str) else list(key)
    # (counted before rows are dealt out: what follows a Python step would be dealt out anew)
    rows = df.select(*keys, F.col(cand_tokens).alias("_c"), F.col(ref_tokens).alias("_r")).withColumn("_hits", _overlap_udf(tuple(ns))("_c", "_r"))
    rows = with_key_rows(rows, keys, "_rows")
    zero = F.lit(0).cast("bigint")

    def entry(n: int, c: Column, r: Column, hits: Column, g: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), g.cast("string").alias("g"), c.cast("bigint").alias("c"), r.cast("bigint").alias("r"), hits.cast("bigint").alias("hits"))

    def many(col: str, n: int) -> Column:
        return F.greatest(F.coalesce(F.size(col), F.lit(0)) - F.lit(n - 1), F.lit(0))

    def counted(k: int, n: int) -> Column:
        return F.array(entry(n, many("_c", n), many("_r", n), F.col("_hits")[k], F.lit(None)))

    def spread(n: int) -> Column:
        one, none = F.lit(1), F.lit(None)
        grams = F.concat(F.transform(ngrams(F.col("_c"), n), lambda g: entry(n, one, zero, none, g)),
                         F.transform(ngrams(F.col("_r"), n), lambda g: entry(n, zero, one, none, g)))
        first = F.array(entry(n, zero, zero, zero, none))  # keeps a key without n-grams
        return F.concat(first, F.coalesce(grams, F.slice(first, 1, 0)))

    alone = F.col("_rows") == 1
    ex = rows.select(*keys, F.explode(F.when(alone, F.concat(*[counted(k, n) for k, n in enumerate(ns)]))
                                      .otherwise(F.concat(*[spread(n) for n in ns]))).alias("x"))
    per_gram = ex.groupBy(*keys, F.col("x.n").alias("_n"), F.col("x.g").alias("_g")).agg(
        F.sum("x.c").alias("_c"), F.sum("x.r").alias("_r"), F.sum("x.hits").alias("_hits"))

    def total(n: int, c: Column, name: str) -> Column:
        return F.sum(F.when(F.col("_n") == n, c).otherwise(0)).cast("bigint").alias(f"{name}{n}")

    return per_gram.groupBy(*keys).agg(*[x for n in ns for x in (
        total(n, F.coalesce("_hits", F.least("_c", "_r")), "overlap"), total(n, F.col("_c"), "n_cand"), total(n, F.col("_r"), "n_ref"))])


def _overlap_udf(ns: tuple[int, ...]):
    @F.arrow_udf(ArrayType(LongType()))
    def overlap(cand: pa.Array, ref: pa.Array) -> pa.Array:
        return clipped_overlap(cand, ref, ns)

    return overlap


def prf_columns(df: DataFrame, hits: str, n_cand: str, n_ref: str, prefix: str) -> DataFrame:
    p = F.when(F.col(n_cand) > 0, F.col(hits) / F.col(n_cand)).otherwise(F.lit(0.0))
    r = F.when(F.col(n_ref) > 0, F.col(hits) / F.col(n_ref)).otherwise(F.lit(0.0))
    df = df.withColumn(f"{prefix}_p", p).withColumn(f"{prefix}_r", r)
    pp, rr = F.col(f"{prefix}_p"), F.col(f"{prefix}_r")
    return df.withColumn(f"{prefix}_f", F.when(pp + rr > 0, F.lit(2.0) * pp * rr / (pp + rr)).otherwise(F.lit(0.0)))


@F.pandas_udf(PRF)
def _rouge_lsum_udf(cand: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [_rouge_lsum([list(s) for s in c] if c is not None else [],
                        [list(s) for s in r] if r is not None else [])
            for c, r in zip(cand, ref)]
    return pd.DataFrame(rows, columns=["precision", "recall", "fmeasure"])


def rouge_l(df: DataFrame, cand_tokens: str = "cand_tokens", ref_tokens: str = "ref_tokens",
            prefix: str = "rougeL") -> DataFrame:
    """ROUGE-L from the LCS length, bit-parallel in JVM expressions for texts of any length."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    hits = df.withColumn("_hits", lcs_length(F.col(cand_tokens), F.col(ref_tokens)))
    counted = hits.withColumn("_n_cand", size(cand_tokens)).withColumn("_n_ref", size(ref_tokens))
    return prf_columns(counted, "_hits", "_n_cand", "_n_ref", prefix).drop("_hits", "_n_cand", "_n_ref")


def sentence_tokens(col, ascii_only: bool = True) -> Column:
    """Per sentence token arrays (sentences from E2), empty sentences dropped."""
    sents = F.transform(sentences(col), lambda s: rouge_tokens(s, ascii_only))
    return F.filter(sents, lambda t: F.size(t) > 0)


def rouge_lsum(df: DataFrame, cand_col: str, ref_col: str, prefix: str = "rougeLsum",
               ascii_only: bool = True) -> DataFrame:
    """ROUGE-Lsum over newline-separated sentences (E2 output)."""
    return _lsum(df, sentence_tokens(cand_col, ascii_only=ascii_only), sentence_tokens(ref_col, ascii_only=ascii_only), prefix)


def _lsum(df: DataFrame, cand: Column, ref: Column, prefix: str) -> DataFrame:
    s = _rouge_lsum_udf(cand, ref)
    return (df.withColumn("_l", s).withColumn(f"{prefix}_p", F.col("_l.precision"))
            .withColumn(f"{prefix}_r", F.col("_l.recall"))
            .withColumn(f"{prefix}_f", F.col("_l.fmeasure")).drop("_l"))


def rouge_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (),
                  rollup: bool = False) -> DataFrame:
    """Corpus roll-up: mean F-measure x 100 per group (and grand total with
    ``rollup``)."""
    aggs = [(F.avg(F.col(m)) * F.lit(100.0)).alias(m) for m in metrics]
    aggs.append(F.count(F.lit(1)).alias("pairs"))
    g = df.rollup(*by) if (rollup and by) else df.groupBy(*by)
    return g.agg(*aggs)


def bootstrap(df: DataFrame, metrics: Sequence[str], key: str, n: int = 1000, seed: int = 42,
              by: Sequence[str] = ()) -> DataFrame:
    """Low / mid / high (2.5, 50, 97.5 percentiles) of each metric mean by
    Poisson bootstrap.

    Each pair joins replicate ``b`` with weight Poisson(1) drawn from
    ``u(seed, b:key)``: the replicate ids are generated per row (``explode`` of a
    sequence, no join) and the weighted sums aggregate map-side, so only
    (groups x replicates) partial rows are shuffled, however many pairs there are.
    """
    rep = df.select(*by, key, *metrics, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate"))
    w = poisson1(u(seed, F.concat(F.col("replicate").cast("string"), F.lit(":"), F.col(key).cast("string"))))
    rep = rep.withColumn("_w", w)
    sums = rep.groupBy(*by, "replicate").agg(
        F.sum("_w").alias("_ws"), *[F.sum(F.col("_w") * F.col(m)).alias(f"_s_{m}") for m in metrics])
    means = sums.select(*by, "replicate", *[
        F.when(F.col("_ws") > 0, F.col(f"_s_{m}") / F.col("_ws")).alias(m) for m in metrics])
    out = []
    for m in metrics:
        out += [F.percentile(m, 0.025).alias(f"{m}_low"), F.percentile(m, 0.5).alias(f"{m}_mid"),
                F.percentile(m, 0.975).alias(f"{m}_high")]
    return means.groupBy(*by).agg(*out)
