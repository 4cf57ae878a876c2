"""Sinks: tokenised splits (K1), metrics (K2), cleaned text (K3), vocabulary
and merges (K4). All writes go to folders the caller names (on a cluster, a
shared file system); none goes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, order: str = "shuffle_rank", rows_per_file: int = 100_000) -> None:
    """K1: one directory per split, in it one directory per file (``split=train/part=0/``).

    ``order`` counts from 1 in each split, so a row's file is ``(order - 1) div rows_per_file``: no
    sampling run finds the cuts. Each file is sorted, and files follow each other by ``part``, so
    readers stream batches in order."""
    (df.withColumn("part", F.expr(f"int(({order} - 1) div {rows_per_file})"))
     .repartition("split", "part").sortWithinPartitions("split", "part", order)
     .write.mode("overwrite").partitionBy("split", "part").parquet(path))


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K2: metrics ``run, split, name, value``, keyed by (run, split, name).

    Each key is a partition folder and only the folders of keys in ``df`` are overwritten, so a job that is run again
    replaces its own values and leaves those of other runs and splits alone."""
    (df.select("run", "split", "name", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run", "split", "name").format(fmt).save(path))


def read_metrics(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """``run, split, name, value`` as written by ``write_metrics``."""
    return (spark.read.schema("value double, run string, split string, name string").format(fmt).load(path)
            .select("run", "split", "name", "value"))


def write_text(df: DataFrame, path: str, col: str = "text") -> None:
    """K3: plain text, one record per line: inner line ends (``\\r\\n``, ``\\n`` and a
    lone ``\\r``, which readers also split at) become one space first."""
    df.select(F.regexp_replace(F.col(col), "\r\n|\r|\n", " ").alias("value")).write.mode("overwrite").text(path)


def write_vocab(vocab: DataFrame, merges: DataFrame | None, path: str) -> None:
    """K4: vocabulary (token, id, cnt) and merges (rank, left, right) as
    parquet tables, plus a JSON export of the vocabulary."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    vocab.select("token", "id").coalesce(1).write.mode("overwrite").json(f"{path}/vocab_json")
    if merges is not None:
        merges.write.mode("overwrite").parquet(f"{path}/merges")
