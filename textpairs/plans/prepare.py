"""The reference's data preparation as one Spark plan:

read sources -> canonical pair -> split resolution -> rejects out -> (head cap,
only where one is asked for) -> task prefix -> encode inputs and targets ->
concatenate splits -> seeded shuffle rank.

Shuffles: the row-identity check on the row key and the shuffle-rank window on
(split, md5 shard). Rows are encoded where they are read and written once; the
window and its offsets read the ids, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.operators.pairs import SUMMARIZATION_PREFIX, split_pairs
from textpairs.operators.ranking import sharded_row_number
from textpairs.operators.sampling import cap, with_shuffle_key
from textpairs.operators.vocab import MAX_INPUT_LENGTH, MAX_TARGET_LENGTH, encode
from textpairs.session import cut_lineage
from textpairs.sources.registry import SourceSpec, read_sources


def prepare_pairs(spark: SparkSession, specs: Sequence[SourceSpec], vocab: DataFrame,
                  vocab_size: int, caps: Mapping[str, int | None] | None = None,
                  seed: int = 42, prefix: str = SUMMARIZATION_PREFIX,
                  max_input: int = MAX_INPUT_LENGTH, max_target: int = MAX_TARGET_LENGTH,
                  shard_digits: int = 3) -> DataFrame:
    """Tokenised, shuffled splits: ``split, source, row_key, shuffle_rank,
    input_ids array<int>, labels array<int>``. Every valid pair is kept unless
    ``caps`` asks for a head of each (source, split); ``rejected_pairs`` lists
    the others with their reasons."""
    pairs, _rejects = split_pairs(read_sources(spark, specs))
    capped = cap(pairs, caps) if caps else pairs
    enc = cut_lineage(encode(capped, vocab,
                             [("input_text", "input_ids", max_input), ("target_text", "labels", max_target)],
                             key_cols=["split", "row_key"], carry_cols=["source"], vocab_size=vocab_size,
                             prefix={"input_text": prefix}))
    keyed = with_shuffle_key(enc, seed, "row_key", shard_digits)
    ranked = sharded_row_number(keyed, ["shuffle_key", "row_key"], "shuffle_shard", ["split"],
                                out="shuffle_rank", max_shards=(16 ** shard_digits) * 8)
    return ranked.select("split", "source", "row_key", "shuffle_rank", "input_ids", "labels")


def rejected_pairs(spark: SparkSession, specs: Sequence[SourceSpec]) -> DataFrame:
    """``source, split, row_key, reason`` of every pair that ``prepare_pairs`` leaves out."""
    return split_pairs(read_sources(spark, specs))[1]


def joined_ids(df: DataFrame, cols: Sequence[str] = ("input_ids", "labels")) -> DataFrame:
    """Arrays as space-joined strings (stable to hash and compare)."""
    for c in cols:
        df = df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), " "))
    return df
