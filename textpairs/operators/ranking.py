"""Global positions and ranks without a single-partition window (design D1).

A global ``row_number()`` over an unpartitioned window moves every row into one
task. Instead rows are cut into *shards* whose order agrees with the sort order
(a prefix of the sort key, or a range between quantiles); each shard is numbered in its own
task and shifted by the number of rows in all earlier shards. The shard-count
table has at most (groups x shards) rows, so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.session import broadcast_bounded


def _cols(cs) -> list:
    if cs is None:
        return []
    if isinstance(cs, (str, Column)):
        return [cs]
    return list(cs)


def sharded_row_number(df: DataFrame, order: Sequence, shard_col: str,
                       partition_cols: Sequence[str] = (), out: str = "position",
                       max_shards: int = 65536) -> DataFrame:
    """1-based row number by ``order`` within ``partition_cols``.

    ``shard_col`` must be monotone in ``order``: every row of a smaller shard
    sorts before every row of a larger one. ``order`` must be a total order
    (append a unique key) for the result to be deterministic.
    """
    pcols = _cols(partition_cols)
    w = Window.partitionBy(*pcols, shard_col).orderBy(*_cols(order))
    local = df.withColumn("_local_no", F.row_number().over(w))
    counts = df.groupBy(*pcols, shard_col).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*pcols).orderBy(shard_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pcols, shard_col,
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (local.join(broadcast_bounded(offsets, max_shards), [*pcols, shard_col])
            .withColumn(out, (F.col("_offset") + F.col("_local_no")).cast("bigint"))
            .drop("_offset", "_local_no"))


def numeric_shard(df: DataFrame, col: str, n_shards: int = 256) -> Column:
    """A shard column monotone in a numeric column, cut at its approximate
    quantiles, so outliers and skew leave the shards about equally full.

    One aggregate is read on the driver: at most ``n_shards - 1`` numbers.
    """
    shares = [i / n_shards for i in range(1, n_shards)]
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), shares, 10 * n_shards).alias("q")).first()["q"]
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))])
    return F.size(F.filter(bounds, lambda b: b < F.col(col).cast("double")))


def average_rank(df: DataFrame, col: str, out: str, partition_cols: Sequence[str] = (),
                 n_shards: int = 256) -> DataFrame:
    """Average rank (1-based, ties share ``rank + (ties-1)/2``) of ``col``.

    Works on the table of distinct values with their counts (map-side combined,
    so a value held by a third of all rows costs one row here), ranks that
    table with sharded offsets and joins the ranks back on the value. Null
    values get a null rank and do not count.
    """
    pcols = _cols(partition_cols)
    vals = (df.filter(F.col(col).isNotNull())
            .groupBy(*pcols, col).agg(F.count(F.lit(1)).alias("_ties")))
    shard = numeric_shard(vals, col, n_shards)
    vals = vals.withColumn("_vshard", shard)
    w = (Window.partitionBy(*pcols, "_vshard").orderBy(col)
         .rowsBetween(Window.unboundedPreceding, -1))
    local = vals.withColumn("_below_local", F.coalesce(F.sum("_ties").over(w), F.lit(0)))
    counts = vals.groupBy(*pcols, "_vshard").agg(F.sum("_ties").alias("_n"))
    before = Window.partitionBy(*pcols).orderBy("_vshard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pcols, "_vshard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranks = (local.join(broadcast_bounded(offsets, n_shards * 16), [*pcols, "_vshard"])
             .select(*pcols, col, (F.col("_off") + F.col("_below_local") + F.lit(1)
                                   + (F.col("_ties") - F.lit(1)) / F.lit(2.0)).alias(out)))
    return df.join(ranks, [*pcols, col], "left")
