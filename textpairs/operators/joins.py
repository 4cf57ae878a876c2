"""Left join on a key of which a few values hold most rows.

The rows of frequent keys find their partner in a broadcast table; what remains
is a shuffle join, in which rows that need no partner any more are dealt out
by another expression, so that no frequent value and no null is one shuffle key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.session import broadcast_bounded


def frequent(counts: DataFrame, count: str, share: float) -> DataFrame:
    """The rows of ``counts`` that hold at least ``share`` of all occurrences: at most ``1 / share`` rows,
    whatever the data (the proof for a broadcast)."""
    total = counts.agg(F.sum(count).alias("n")).first()["n"]  # one number
    return counts.filter(F.col(count) >= F.lit(share * (total or 0)))


def heavy_left_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, bound: int, spread: Column) -> DataFrame:
    """``left`` with the other columns of ``right`` (one row a key); null where no row fits.

    ``heavy`` holds the rows of ``right`` for the frequent keys, at most ``bound`` of them.
    ``spread`` is any expression over ``left`` with many values."""
    values = [c for c in right.columns if c != key]
    head = broadcast_bounded(heavy.select(key, F.struct(*values).alias("_head")), bound)
    tail = right.select(F.col(key).alias("_key"), F.struct(*values).alias("_tail"), F.lit(0).cast("long").alias("_part"))
    settled = F.col("_head").isNotNull() | F.col(key).isNull()
    # settled rows keep a null key, which matches nothing, and are dealt out by ``spread``
    keyed = (left.join(head, key, "left").withColumn("_key", F.when(~settled, F.col(key)))
             .withColumn("_part", F.when(settled, F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))))
    found = keyed.join(tail, ["_key", "_part"], "left")
    got = [F.coalesce(F.col("_head")[v], F.col("_tail")[v]).alias(v) for v in values]
    return found.select(*left.columns, *got)


def with_key_rows(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``df`` dealt out by ``keys``, with the number of rows that have the same ones (nulls are equal)."""
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
