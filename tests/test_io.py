"""Arrow source: IPC file and IPC stream formats, broken files, row order."""

import os
import tempfile

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest


def _write(path, table, stream):
    with pa.OSFile(path, "wb") as sink:
        w = ipc.new_stream(sink, table.schema) if stream else ipc.new_file(sink, table.schema)
        w.write_table(table)
        w.close()


def test_arrow_file_and_stream_and_broken(spark):
    from textpairs.sources import arrow_ipc
    arrow_ipc.register(spark)
    d = tempfile.mkdtemp(prefix="tp-arrow-", dir="/tmp")
    t1 = pa.table({"article": ["a", "b"], "summary": ["x", "y"]})
    t2 = pa.table({"article": ["c"], "summary": ["z"]})
    _write(os.path.join(d, "a.arrow"), t1, stream=False)
    _write(os.path.join(d, "b.arrow"), t2, stream=True)
    rows = spark.read.format("arrow_ipc").option("rowNo", "true").load(d).orderBy("row_no").collect()
    assert [r["article"] for r in rows] == ["a", "b", "c"]
    assert rows[2]["row_no"] == (1 << 32)
    with open(os.path.join(d, "c.arrow"), "wb") as f:
        f.write(b"not arrow at all")
    with pytest.raises(Exception):
        spark.read.format("arrow_ipc").load(d).collect()
    got = spark.read.format("arrow_ipc").option("errorColumn", "true").load(d)
    errs = [r["_error"] for r in got.collect() if r["_error"]]
    assert len(errs) == 1 and "c.arrow" in errs[0]


def test_arrow_write_roundtrip(spark):
    from textpairs.sources import arrow_ipc
    arrow_ipc.register(spark)
    d = os.path.join(tempfile.mkdtemp(prefix="tp-arrow-w-", dir="/tmp"), "out")
    df = spark.range(0, 1000).selectExpr("id AS doc_id", "cast(id * 2 AS string) AS text").repartition(3)
    df.write.format("arrow_ipc").mode("overwrite").save(d)
    back = spark.read.format("arrow_ipc").load(d)
    assert back.count() == 1000 and sorted(r["doc_id"] for r in back.collect()) == list(range(1000))
    df.limit(10).write.format("arrow_ipc").mode("overwrite").save(d)
    assert spark.read.format("arrow_ipc").load(d).count() == 10


def test_streaming_clean_equals_batch(spark, small):
    import shutil
    from pyspark.sql import functions as F
    from textpairs.streaming.cleaning import clean_rows, start_clean_stream
    src = tempfile.mkdtemp(prefix="tp-stream-src-", dir="/tmp")
    shutil.copy(f"{small}/documents.parquet", os.path.join(src, "part-0.parquet"))
    sink = os.path.join(tempfile.mkdtemp(prefix="tp-stream-out-", dir="/tmp"), "out")
    q = start_clean_stream(spark, src, sink)
    q.awaitTermination(120)
    streamed = spark.read.parquet(sink)
    batch = clean_rows(spark.read.parquet(f"{small}/documents.parquet"))
    a = sorted((r["doc_id"], r["reasons"]) for r in streamed.collect())
    b = sorted((r["doc_id"], r["reasons"]) for r in batch.select("doc_id", "reasons").collect())
    assert a == b and len(a) == 200
