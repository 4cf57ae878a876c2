"""Row-wise cleaning over a file stream.

The reference has no streaming operator (SURVEY section 2.14). The row-wise
cleaning steps (normalise, quality signals and rules) contain no aggregate, so
the same functions run unchanged on a streaming DataFrame: new corpus files
dropped into a folder are normalised and filtered incrementally, with the
checkpoint in the shared folder. Corpus-wide steps (exact and near
deduplication, common lines) need the whole corpus and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textpairs.operators.clean import normalise, quality_reasons, quality_signals
from textpairs.session import scratch_path

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clean_rows(df: DataFrame, col: str = "text") -> DataFrame:
    """Normalise and attach quality reasons; works on batch and stream frames."""
    q = quality_reasons(quality_signals(normalise(df, col), col))
    return q.withColumn("reasons", F.array_join("reasons", ","))


def start_clean_stream(spark: SparkSession, src_dir: str, sink_dir: str, schema: str = DOCUMENT_SCHEMA,
                       checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Parquet files arriving in ``src_dir`` -> cleaned rows appended to
    ``sink_dir`` (parquet). ``available_now`` processes what is there and stops."""
    stream = spark.readStream.schema(schema).parquet(src_dir)
    out = clean_rows(stream).select("doc_id", "text", "n_words", "reasons", "keep")
    w = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
