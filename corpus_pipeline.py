"""A corpus pipeline: raw documents to token ids, one operator per stage.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and works
on everything its predecessor kept; its result is written as Parquet and read
again as the next one's documents, so a lost executor costs tasks, not stages.
All but the last return the columns of ``documents``.

Nulls, empty texts, ties and repeated rows follow the operators' own rules: a
null or empty text fails the quality rules' base rule and goes there; repeated
rows end in one row at the near-duplicate stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.llm import bpe_codec, decontaminate, quality_rules, simhash, toxicity
from textpairs.llm.queries import tokenizer_path
from textpairs.session import apply_job_conf, scratch_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; labels of the training fold teach."""
    apply_job_conf(spark)
    return toxicity.remove_toxic(docs, _labels(spark, sf_dir).filter(toxicity.in_training_fold(F.col("doc_id"))))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled rules keep."""
    apply_job_conf(spark)
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: shingles of 4 words, at most 4 differing bits."""
    apply_job_conf(spark)
    return simhash.deduplicate(docs, shingle=4, max_bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    apply_job_conf(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their digest and that of the text they decode to."""
    apply_job_conf(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    out = bpe_codec.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No SQL: classifier training and BPE have no SQL form. A test compares run() with the stages by brute force, one after the other.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    apply_job_conf(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
