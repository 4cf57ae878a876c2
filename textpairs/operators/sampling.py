"""L1 head cap per (source, split) and L2 seeded shuffle rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpairs.functions.hashing import seeded_md5
from textpairs.operators.ranking import sharded_row_number
from textpairs.session import cut_lineage, scratch_path

# fixed values: caps of the reference (train rows per source; evaluation rows
# per source, used for validation and for test)
TRAIN_CAP = 1000
EVAL_CAP = 200
_LAST = (1 << 62)  # place of a row without a position
REFERENCE_CAPS = {"train": TRAIN_CAP, "validation": EVAL_CAP, "test": EVAL_CAP}


#: Bins of one refinement round: 12 bits of the position.
BINS = 4096


def cutoffs(keys: DataFrame, caps: Mapping[str, int], by: Sequence[str], order: str, split_col: str = "split",
            bins: int = BINS) -> DataFrame:
    """(``by``, cutoff, below) of each group that has more rows than its cap: the position of
    its cap-th row and the number of rows before that position.

    Histogram refinement: every round counts the rows of each group's interval in
    ``bins`` equal bins (map-side combined) and goes on with the bin that holds the cap-th row, until
    intervals are single positions. No row is moved or sorted; the interval table has a row a group."""
    limit = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    groups = [*by]
    now = (keys.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"))
           .withColumn("cap", limit[F.col(split_col)]).filter((F.col("n") > F.col("cap")) & (F.col("cap") > 0))
           .select(*groups, "cap", F.lit(0).cast("long").alias("below"), "lo", "hi"))
    # positions span less than 2^63, so widths are found by exact integer arithmetic
    while True:
        now = cut_lineage(now)
        if now.filter("hi > lo").isEmpty():
            return now.select(*groups, F.col("lo").alias("cutoff"), "cap", "below")
        width = F.expr(f"(hi - lo) div {bins} + 1")
        binned = (keys.join(F.broadcast(now.withColumn("width", width)), groups)
                  .filter(F.col(order).between(F.col("lo"), F.col("hi")))
                  .groupBy(*groups, "cap", "below", "lo", "hi", "width", F.expr(f"({order} - lo) div width").alias("bin"))
                  .agg(F.count(F.lit(1)).alias("n")))
        upto = Window.partitionBy(*groups).orderBy("bin")  # at most ``bins`` rows a group
        now = (binned.withColumn("upto", F.col("below") + F.sum("n").over(upto))
               .filter((F.col("upto") >= F.col("cap")) & (F.col("upto") - F.col("n") < F.col("cap")))
               .select(*groups, "cap", (F.col("upto") - F.col("n")).alias("below"),
                       (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
                       F.least("hi", F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1).alias("hi")))


def cap(df: DataFrame, caps: Mapping[str, int | None], order: str = "row_no",
        by: Sequence[str] = ("source", "split"), split_col: str = "split", fanout: int = 256) -> DataFrame:
    """Keep the first ``min(cap, n)`` rows of each (source, split) by ``order``, an
    integer position.

    Each group's cutoff position is found by counting (``cutoffs``); the cap is
    then a filter, so no task sees more than its own rows however large the cap
    or the group is. Where several rows stand at the cutoff itself, as many
    of them as still fit are kept, in the order of their hashes. Splits whose cap is None or that ``caps`` does not name
    pass through untouched, as do null splits; null positions come last and are
    dropped from a group that has more rows than its cap.
    """
    wanted = {s: int(c) for s, c in caps.items() if c is not None}
    if not wanted:
        return df
    spark = df.sparkSession
    capped = F.coalesce(F.col(split_col).isin(sorted(wanted)), F.lit(False))
    path = scratch_path(spark, "cap-keys")
    df.filter(capped).select(*by, F.coalesce(F.col(order).cast("long"), F.lit(_LAST)).alias(order)).write.parquet(path)
    found = cutoffs(spark.read.parquet(path), wanted, by, order, split_col)
    # one row per (source, split): bounded by the registry
    none_kept = [s for s, c in wanted.items() if c <= 0]
    marked = (df.filter(~F.col(split_col).isin(none_kept) | F.col(split_col).isNull() if none_kept else F.lit(True))
              .join(F.broadcast(found.select(*[F.col(c).alias(f"_{c}") for c in by], "cutoff", "cap", "below")),
                    [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
              .withColumn("_at", F.coalesce(F.col(order).cast("long"), F.lit(_LAST))))
    cols = [F.col(c) for c in df.columns]
    inside = marked.filter(~capped | F.col("cutoff").isNull() | (F.col("_at") < F.col("cutoff"))).select(*cols)
    # rows at the cutoff: one a group where positions are unique
    tied = marked.filter(capped & (F.col("_at") == F.col("cutoff"))).withColumn("_h", F.xxhash64(*df.columns))
    piece = Window.partitionBy(*by, F.pmod(F.col("_h"), F.lit(fanout))).orderBy("_h")
    whole = Window.partitionBy(*by).orderBy("_h")
    fits = F.col("_rn") <= F.col("cap") - F.col("below")
    last = (tied.withColumn("_rn", F.row_number().over(piece)).filter(fits)
            .withColumn("_rn", F.row_number().over(whole)).filter(fits).select(*cols))
    return inside.unionByName(last)


def with_shuffle_key(df: DataFrame, seed: int = 42, key: str = "row_key",
                     shard_digits: int = 3) -> DataFrame:
    """Add the md5(seed|key) sort key and its hex prefix shard."""
    k = seeded_md5(seed, F.col(key))
    return df.withColumn("shuffle_key", k).withColumn("shuffle_shard", F.substring(k, 1, shard_digits))


def shuffle(df: DataFrame, seed: int = 42, key: str = "row_key",
            partition_cols: Sequence[str] = ("split",), shard_digits: int = 3,
            keep_keys: bool = False) -> DataFrame:
    """Seeded permutation per split: ``shuffle_rank`` 1..n, ordered by the md5
    hex of ``seed|key`` and then the key. Same seed and keys, same order."""
    keyed = with_shuffle_key(df, seed, key, shard_digits)
    out = sharded_row_number(keyed, ["shuffle_key", key], "shuffle_shard", partition_cols,
                             out="shuffle_rank", max_shards=(16 ** shard_digits) * 8)
    return out if keep_keys else out.drop("shuffle_key", "shuffle_shard")
