"""Sharding by jump consistent hashing (operator 3).

A row's shard is a function of its key and the number of shards alone; there
is no ring table. Growing from n to n+1 shards moves a key only into the new
shard, with probability 1/(n+1). ``assign_shards`` is a narrow map over the key
column; ``with_slots`` numbers the rows of each shard from 0 without gaps;
``write_shards`` writes whole rows, one folder per shard.

Numbering never sorts a shard in one task. Rows are dealt into ``bins`` ranges of a hash of all
their columns in each shard, identical rows are counted first (map-side combined, so
one repeated row costs one row), each (shard, bin) is numbered on its own and
shifted by the counts of the earlier bins. The offset table has at most
shards x bins rows, which is why it may be broadcast.

Defined results: a null key is a key of its own (one shard); repeated keys
share a shard and get slots of their own; a null text counts as empty (size 8,
crc 0); an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

_STEP = np.uint64(2862933555777941757)  # fixed value of the published algorithm
_REPEAT_BLOCK = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key, by the published jump consistent hash."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.uint64)
    bucket = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = jump[live]
            key[live] = key[live] * _STEP + np.uint64(1)
            scale = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump[live] = ((bucket[live] + 1).astype(np.float64) * scale).astype(np.int64)
            live = live[jump[live] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """Column expression: shard of a 64-bit key."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(key)


def stable_key(*cols: str) -> Column:
    """64-bit key of one or more columns of any type (nulls included)."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in cols])


def assign_shards(df: DataFrame, key_cols: list[str], shards: int,
                  shard: str = "shard", grown: str | None = "grown_shard") -> DataFrame:
    """``df`` with its shard among ``shards`` and, if named, among ``shards + 1``."""
    out = df.withColumn(shard, shard_of(stable_key(*key_cols), shards))
    return out.withColumn(grown, shard_of(stable_key(*key_cols), shards + 1)) if grown else out


def with_slots(rows: DataFrame, shards: int, shard: str = "shard",
               slot: str = "slot", bins: int = 1024) -> DataFrame:
    """Narrow rows (no map columns) numbered from 0 within each shard.

    The order is that of a hash of all columns, then of the columns, so it is the same
    whenever the same rows are given. Rows of one hot key fall into all bins of their shard."""
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count("*").alias("_n"))
    keyed = counted.withColumn("_h", F.xxhash64(stable_key(*cols), F.lit(7)))
    width = (1 << 64) // bins
    binned = keyed.withColumn("_bin", F.floor((F.col("_h").cast("double") + float(1 << 63)) / float(width)).cast("int"))
    per_bin = binned.groupBy(shard, "_bin").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select(shard, "_bin", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    if shards * bins <= 200_000:  # at most this many rows of three numbers
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(shard, "_bin").orderBy("_h", *cols).rowsBetween(Window.unboundedPreceding, -1)
    first = (binned.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
             .join(offsets, [shard, "_bin"]).withColumn("_first", F.col("_first") + F.col("_offset")))
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_REPEAT_BLOCK}"))
    spread = first.withColumn("_block", F.explode(blocks))
    last = F.least(F.lit(_REPEAT_BLOCK).cast("long"), F.col("_n") - F.col("_block") * _REPEAT_BLOCK) - 1
    return (spread.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select(*cols, (F.col("_first") + F.col("_block") * _REPEAT_BLOCK + F.col("_k")).alias(slot)))


def write_shards(df: DataFrame, path: str, key_cols: list[str], shards: int, files_per_shard: int = 1) -> None:
    """Whole rows as Parquet, one ``shard=k`` folder per shard.

    Each shard is dealt over ``files_per_shard`` tasks by a hash of all columns that can be cast to a text."""
    placed = assign_shards(df, key_cols, shards, grown=None)
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    piece = F.pmod(F.xxhash64(stable_key(*plain), F.lit(7)), F.lit(files_per_shard))
    (placed.repartition(shards * files_per_shard, "shard", piece)
     .write.partitionBy("shard").mode("overwrite").parquet(path))
