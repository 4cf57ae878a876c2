"""Pair-level operators: column check and canonical pair (P1, P2), task prefix
(P3), pair validation (P4), key alignment (J1), reference expansion (J2) and
per-split concatenation (U1)."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textpairs.functions.text import strip_ws
from textpairs.session import cut_lineage

log = logging.getLogger(__name__)

# fixed value: the reference's task prefix
SUMMARIZATION_PREFIX = "summarize: "
ENGINE_COLS = ["source", "split", "row_no", "row_key"]

#: Repeated keys, counted before, that may go to every task.
FEW_KEYS = 100_000


class ColumnMappingError(ValueError):
    pass


def require_columns(df: DataFrame, source: str, document_col: str | None,
                    summary_col: str | None) -> None:
    """Analysis-time check, no job. Names source, wanted and found columns."""
    if not document_col or not summary_col:
        raise ColumnMappingError(f"source '{source}': no column mapping registered")
    found = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in (document_col, summary_col) if c not in found]
    if missing:
        raise ColumnMappingError(
            f"source '{source}' lacks columns {missing}; wanted '{document_col}' and "
            f"'{summary_col}'; found {sorted(found)}")
    wrong = [c for c in (document_col, summary_col) if not isinstance(found[c], StringType)]
    if wrong:
        raise ColumnMappingError(f"source '{source}': columns {wrong} are not strings")


def canonicalise(df: DataFrame, document_col: str, summary_col: str,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Rename to ``input_text``/``target_text`` and drop everything else
    (engine columns listed in ``keep`` survive)."""
    return df.select(*keep, F.col(document_col).alias("input_text"),
                     F.col(summary_col).alias("target_text"))


def with_prefix(df: DataFrame, prefix: str = SUMMARIZATION_PREFIX, col: str = "input_text",
                out: str | None = None) -> DataFrame:
    """Task prefix in front of the document, before any truncation."""
    return df.withColumn(out or col, F.concat(F.lit(prefix), F.col(col)))


def validate_pairs(docs: DataFrame, sums: DataFrame, key: str, doc_col: str = "document",
                   sum_col: str = "summary") -> DataFrame:
    """Full outer join on the pair key; every pair gets a ``status``.

    ``ok`` pairs are scorable; the rest keep the reason (a side missing or
    blank) instead of voiding the whole call.
    """
    j = docs.select(key, doc_col).join(sums.select(key, sum_col), key, "full_outer")
    blank = lambda c: strip_ws(F.col(c)) == F.lit("")
    status = (F.when(F.col(doc_col).isNull(), F.lit("missing_document"))
              .when(F.col(sum_col).isNull(), F.lit("missing_summary"))
              .when(blank(doc_col), F.lit("blank_document"))
              .when(blank(sum_col), F.lit("blank_summary"))
              .otherwise(F.lit("ok")))
    return j.withColumn("status", status)


def split_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid canonical pairs, rejects ``source, split, row_key, reason``).

    A pair is rejected when a side is missing or blank, when it has no row key,
    or when its row key stands more than once in its split (encoding groups by
    that key and would merge the rows). The key count is a map-side combined
    aggregate; the keys that repeat are written and counted, and unless they are
    many, they go to the texts: no text is shuffled."""
    blank = lambda c: strip_ws(F.col(c)) == F.lit("")
    repeated = cut_lineage(pairs.filter(F.col("row_key").isNotNull()).groupBy("split", "row_key").agg(F.count(F.lit(1)).alias("_key_n"))
                           .filter(F.col("_key_n") > 1))
    repeated = F.broadcast(repeated) if repeated.count() <= FEW_KEYS else repeated
    # (a side's fault is found before the join, so that a reader of keys only does not shuffle texts)
    side = (F.when(F.col("input_text").isNull(), F.lit("missing_document"))
            .when(F.col("target_text").isNull(), F.lit("missing_summary"))
            .when(blank("input_text"), F.lit("blank_document"))
            .when(blank("target_text"), F.lit("blank_summary")))
    reason = (F.when(F.col("row_key").isNull(), F.lit("missing_key"))
              .when(F.col("_key_n").isNotNull(), F.lit("duplicate_key")).otherwise(F.col("_side")))
    marked = (pairs.withColumn("_side", side).join(repeated, ["split", "row_key"], "left").withColumn("_reason", reason)
              .drop("_key_n", "_side"))
    valid = marked.filter(F.col("_reason").isNull()).select(*pairs.columns)
    rejects = marked.filter(F.col("_reason").isNotNull())
    return valid, rejects.select("source", "split", "row_key", F.col("_reason").alias("reason"))


def _mark_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    # Window on the join key: its exchange is the one the sort-merge join
    # needs anyway, so finding duplicates costs no extra shuffle.
    return df.withColumn("_key_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))


def align(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "inner"
          ) -> tuple[DataFrame, DataFrame]:
    """Align two tables on a key (the zip of two lists, made a join).

    Keys duplicated on either side are rejected first: a join would multiply
    them where a positional zip would not. Rows with a null key are rejected
    too. Returns (aligned, rejects).
    """
    keys = [key] if isinstance(key, str) else list(key)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    keyless = None
    for side, df in (("left", left), ("right", right)):
        part = df.filter(~whole).select(*keys, F.lit(side).alias("side"), F.lit("missing_key").alias("reason"))
        keyless = part if keyless is None else keyless.unionByName(part)
    left, right = left.filter(whole), right.filter(whole)
    lm, rm = _mark_duplicates(left, keys), _mark_duplicates(right, keys)
    rejects = (lm.filter(F.col("_key_n") > 1).select(*keys).withColumn("side", F.lit("left"))
               .unionByName(rm.filter(F.col("_key_n") > 1).select(*keys)
                            .withColumn("side", F.lit("right")))
               .dropDuplicates([*keys, "side"]).withColumn("reason", F.lit("duplicate_key")))
    aligned = (lm.filter(F.col("_key_n") == 1).drop("_key_n")
               .join(rm.filter(F.col("_key_n") == 1).drop("_key_n"), keys, how))
    return aligned, rejects.unionByName(keyless)


def expand_references(df: DataFrame, refs_col: str = "references",
                      keep: Sequence[str] = ("candidate_id", "candidate")) -> DataFrame:
    """One row per (candidate, reference) of a ragged reference list."""
    return df.select(*keep, F.posexplode(refs_col).alias("ref_pos", "reference")) \
             .withColumn("ref_no", (F.col("ref_pos") + 1).cast("bigint")).drop("ref_pos")


def concat_sources(dfs: Sequence[DataFrame], split_col: str = "split") -> DataFrame:
    """Bag union by column name (strict: same columns), never distinct."""
    dfs = [d for d in dfs if d is not None]
    if not dfs:
        raise RuntimeError("every source failed or is empty: nothing to concatenate")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
