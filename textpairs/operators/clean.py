"""Corpus cleaning: normalisation (C1), exact deduplication (C2), quality
signals and filter (C4), corpus-wide repeated-line removal (C5) and the
cleaning funnel (C6). The reference names these steps only ("deduplication,
quality filtering, normalization"); the rules below are ours and fixed in
SURVEY section 2.13.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textpairs.functions.text import strip_ws, words
from textpairs.operators.dedup import dedup_near
from textpairs.session import collect_garbage, remove_scratch, scratch_path

# fixed values: quality rules (words >= 20; mean word length 2..12; symbol
# share <= 0.3; digit share <= 0.2; repeated-line share <= 0.3) and the common
# line rule (length >= 20, in >= 5 documents)
MIN_WORDS = 20
MEAN_WORD_LEN = (2.0, 12.0)
MAX_SYMBOL_SHARE = 0.3
MAX_DIGIT_SHARE = 0.2
MAX_REPEATED_LINE_SHARE = 0.3
COMMON_LINE_MIN_LEN = 20
COMMON_LINE_MIN_DOCS = 5

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC (no built-in does this); Arrow-batched."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def normalise(df: DataFrame, col: str = "text", out: str | None = None) -> DataFrame:
    """NFC; control characters out (newline and tab kept); runs of spaces,
    tabs and carriage returns to one space; spaces around newlines and runs of
    newlines collapsed; stripped. Texts of code points below U+0300 only are in NFC as they are and do not go to Python."""
    t = F.col(col)
    t = F.coalesce(nfc(F.when(t.rlike(r"[^\x00-\u02FF]"), t)), t)
    t = F.regexp_replace(t, CONTROL, "")
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n+", "\n")
    return df.withColumn(out or col, strip_ws(t))


def exact_groups(df: DataFrame, col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, copies): the lowest id of each distinct text and how many documents share it, from one
    aggregate; copies are combined map-side, so a text copied into a third of
    the corpus is one partial row per task."""
    return (df.groupBy(F.md5(F.col(col)).alias("_h"))
            .agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))
            .select(id_col, "copies"))


def dedup_exact(df: DataFrame, col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document per distinct text, the lowest id, with its copy count.

    The kept ids join back on the (unique) id, so ``df`` is read twice: give a stored table."""
    return df.join(exact_groups(df, col, id_col), id_col, "inner")


def quality_signals(df: DataFrame, col: str = "text") -> DataFrame:
    """C4 signals: words, mean word length, symbol share, digit share and the
    share of non-empty lines that repeat an earlier line of the same text."""
    df = (df.withColumn("_w", words(col))
          .withColumn("_lines", F.filter(F.transform(F.split(F.col(col), "\n"), lambda x: strip_ws(x)),
                                         lambda x: x != F.lit(""))))
    w, lines = F.col("_w"), F.col("_lines")
    n = F.size(w)
    chars = F.length(col)
    share = lambda num: F.when(chars > 0, num / chars).otherwise(F.lit(0.0))
    return (df.withColumn("n_words", n.cast("bigint"))
            .withColumn("mean_word_len", F.when(n > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n))
            .withColumn("symbol_share", share(F.length(F.regexp_replace(col, r"[\p{L}\p{N}\s]", ""))))
            .withColumn("digit_share", share(F.length(F.regexp_replace(col, r"[^0-9]", ""))))
            .withColumn("repeated_line_share", F.when(F.size(lines) > 0, F.lit(1.0) - F.size(F.array_distinct(lines))
                                                      / F.size(lines)).otherwise(F.lit(0.0)))
            .drop("_w", "_lines"))


def quality_reasons(df: DataFrame) -> DataFrame:
    """C4 rules: ``reasons`` lists every failed rule; ``keep`` when none failed."""
    lo, hi = MEAN_WORD_LEN
    checks = [
        F.when(F.col("n_words") < F.lit(MIN_WORDS), F.lit("too_few_words")),
        F.when(F.col("mean_word_len").isNull() | (F.col("mean_word_len") < F.lit(lo))
               | (F.col("mean_word_len") > F.lit(hi)), F.lit("word_length")),
        F.when(F.col("symbol_share") > F.lit(MAX_SYMBOL_SHARE), F.lit("symbols")),
        F.when(F.col("digit_share") > F.lit(MAX_DIGIT_SHARE), F.lit("digits")),
        F.when(F.col("repeated_line_share") > F.lit(MAX_REPEATED_LINE_SHARE), F.lit("repeated_lines")),
    ]
    r = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.withColumn("reasons", r).withColumn("keep", F.size(r) == 0)


def quality_filter(df: DataFrame, col: str = "text") -> DataFrame:
    return quality_reasons(quality_signals(df, col)).filter(F.col("keep"))


def drop_common_lines(df: DataFrame, col: str = "text", id_col: str = "doc_id",
                      min_len: int = COMMON_LINE_MIN_LEN, min_docs: int = COMMON_LINE_MIN_DOCS) -> DataFrame:
    """Remove lines (stripped, >= ``min_len`` characters) found in at least
    ``min_docs`` documents; the other lines keep their order.

    Lines long enough to be common leave their row as md5 digests, one a document (blank and short lines never do).
    Document frequency is a two-level aggregate (line, doc) then line, both
    map-side combined, so boilerplate present in a third of the corpus does
    not gather in one task. The few digests that hit come
    back per document and their lines are filtered out of the text in its own row: a text is shuffled once. AQE
    splits a hot line's partition.
    """
    lines = F.split(F.col(col), "\n")
    digest = lambda x: F.unhex(F.md5(x))
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines, lambda x: strip_ws(x)), lambda x: F.length(x) >= F.lit(min_len)), digest))
    long_lines = df.select(id_col, F.explode(keys).alias("key"))
    common = (long_lines.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
              .filter(F.col("n_docs") >= F.lit(min_docs)).select("key"))
    hits = long_lines.join(common, "key").groupBy(id_col).agg(F.collect_set("key").alias("_hits"))
    none = F.array().cast("array<string>")
    stays = lambda x: (F.length(strip_ws(x)) < F.lit(min_len)) | ~F.array_contains("_hits", digest(strip_ws(x)))
    kept = F.when(F.col("_hits").isNull(), F.col("_lines")).otherwise(F.filter("_lines", stays))
    return (df.select(id_col, F.coalesce(lines, none).alias("_lines")).join(hits, id_col, "left").withColumn("_kept", kept)
            .select(id_col, F.array_join("_kept", "\n").alias(col), (F.size("_lines") - F.size("_kept")).cast("bigint").alias("lines_removed")))


def funnel(df: DataFrame, col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows in, removed and out per cleaning step and per reason, in the order normalise -> exact
    dedup -> quality filter -> common lines (a document left empty is removed) -> near dedup (C3).

    Three tables are written: the normalised texts with their failed rules, the ids of those that are not copies with the
    same, and the texts that remain after line removal, whereupon the first goes. All counts are read from narrow columns of
    these tables; unlike counts observed on the way, they stay right when a lost task runs
    again. ``reason`` is ``all`` for a step's total; a document can fail several rules."""
    spark = df.sparkSession
    paths = {name: scratch_path(spark, name) for name in ("normalised", "judged", "lines")}

    def written(d: DataFrame, name: str) -> DataFrame:
        d.write.option("compression", "zstd").parquet(paths[name])
        return spark.read.parquet(paths[name])

    norm = written(quality_reasons(quality_signals(normalise(df.select(id_col, col), col), col)).select(id_col, col, "reasons", "keep"), "normalised")
    unique = dedup_exact(norm, col, id_col).drop("copies")
    judged = written(unique.select(id_col, "reasons", "keep"), "judged")
    lines = written(drop_common_lines(unique.filter("keep").select(id_col, col), col, id_col).filter(F.length(col) > 0), "lines")
    n_in = norm.count()
    remove_scratch(spark, paths["normalised"])
    del norm, unique
    collect_garbage(spark)
    near = dedup_near(lines.select(id_col, col), col, id_col, hash_kind="md5").filter("keep")
    rules = {r["reason"]: r["n"] for r in judged.select(F.explode("reasons").alias("reason")).groupBy("reason")
             .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a rule
    n = {"in": n_in, "dedup": judged.count(), "quality": judged.filter("keep").count(), "lines": lines.count(), "near": near.count()}
    steps = [("0_input", n["in"], n["in"]), ("1_normalise", n["in"], n["in"]), ("2_dedup_exact", n["in"], n["dedup"]),
             ("3_quality", n["dedup"], n["quality"]), ("4_common_lines", n["quality"], n["lines"]), ("5_dedup_near", n["lines"], n["near"])]
    rows = [(step, "all", before, before - after, after) for step, before, after in steps]
    rows += [("3_quality", rule, n["dedup"], hit, n["dedup"] - hit) for rule, hit in sorted(rules.items())]
    for name in ("judged", "lines"):
        remove_scratch(spark, paths[name])
    return spark.createDataFrame(rows, "step string, reason string, rows_in bigint, removed bigint, rows_out bigint")
