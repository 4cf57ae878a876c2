"""Queries for the Arrow source (S2) and the sinks (K1-K4): each writes data
Spark derives from the test tables to a fresh folder under the shared
checkpoint location and returns what reads back."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.operators import clean as C
from textpairs.operators.bpe import N_MERGES, counted_types, learn_bpe
from textpairs.plans import fixtures as FX
from textpairs.plans.catalog import ORACLES, PREPARE_SQL, VOCAB_SIZE, _vocab, register, sql_vocab
from textpairs.plans.prepare import joined_ids, prepare_pairs
from textpairs.plans.q_clean import NORM
from textpairs.plans.q_eval import q_e11
from textpairs.session import cut_lineage, read_table, scratch_path
from textpairs.sources import arrow_ipc, registry, sinks

# fixed values: split directory names of the Arrow-file source layout
SPLIT_DIRS = {"train": "traindataset", "validation": "devdataset", "test": "testdataset"}


@register("s1_read_split_dirs", ORACLES["s1_read_sources"])
def q_s1_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Each source stored as one folder per split with several files, read by path."""
    base = scratch_path(spark, "sources")
    specs = []
    for s in FX.fixture_specs(sf):
        s.loader(spark).repartition(3, "row_no").write.partitionBy("stored_split").parquet(f"{base}/{s.name}")
        specs.append(registry.SourceSpec(
            name=s.name, document_col=s.document_col, summary_col=s.summary_col, split_map=s.split_map,
            path=f"{base}/{s.name}", format="parquet", split_dirs={sp: f"stored_split={sp}" for sp in registry.SPLITS}))
    return registry.read_sources(spark, specs)


def _one_file(spark: SparkSession, folder: str):
    """(file system, path) of the one Parquet file of a folder."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.globStatus(pattern)[0].getPath()


def _cut_in_half(spark: SparkSession, folder: str, to: str) -> None:
    """The first half of the bytes of a folder's one file, copied to a file of the same name in ``to``: from
    stream to stream through a buffer of a fixed size, so no file is ever held."""
    jvm = spark.sparkContext._jvm
    fs, path = _one_file(spark, folder)
    source, target = fs.open(path), fs.create(jvm.org.apache.hadoop.fs.Path(to, path.getName()), True)
    jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, fs.getFileStatus(path).getLen() // 2)
    target.close()
    source.close()


def _overwrite(spark: SparkSession, folder: str, data: bytes) -> None:
    """``data`` in place of a folder's one Parquet file."""
    fs, path = _one_file(spark, folder)
    stream = fs.create(path, True)
    stream.write(bytearray(data))
    stream.close()


@register("s5_damaged_files", f"""WITH {FX.sql_pairs()}
SELECT source, split, CASE WHEN split = 'train' AND source IN ('set_a', 'set_b') THEN 'damaged' ELSE 'ok' END AS status,
  sum(CASE WHEN split = 'train' AND (source = 'set_a' AND row_no % 2 = 1 OR source = 'set_b' AND row_no % 2 = 0) THEN 0 ELSE 1 END)::BIGINT AS rows,
  CASE WHEN split = 'train' AND source IN ('set_a', 'set_b') THEN 1 ELSE 0 END::BIGINT AS lost_files
FROM fx_pairs GROUP BY source, split""")
def q_s5_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """S5 at run time: two folders of files a split. Of the train files, set_a's second folder is one
    file cut in half and set_b's first one that is no Parquet file at all. Both are reported and skipped, everything else is loaded.

    A source is split up in one write; only the two files that get damaged are written by one task each."""
    base = scratch_path(spark, "sources")
    single = {"set_a": 1, "set_b": 0}  # the half of the train rows that stands in one file
    specs = []
    for s in FX.fixture_specs(sf):
        rows = s.loader(spark).withColumn("half", F.col("row_no") % 2).filter(F.col("half").isin(0, 1))
        alone = (F.col("stored_split") == "train") & (F.col("half") == single.get(s.name, -1))
        rows.filter(~alone).write.partitionBy("stored_split", "half").parquet(f"{base}/{s.name}")
        specs.append(registry.SourceSpec(
            name=s.name, document_col=s.document_col, summary_col=s.summary_col, split_map=s.split_map, order_col="row_no",
            path=f"{base}/{s.name}", format="parquet", split_dirs={sp: f"stored_split={sp}/half=*" for sp in registry.SPLITS}))
        if s.name in single:
            folder = f"{base}/{s.name}/stored_split=train/half={single[s.name]}"
            whole = f"{base}/whole/{s.name}" if s.name == "set_a" else folder
            rows.filter(alone).drop("stored_split", "half").repartition(1).write.parquet(whole)
            if s.name == "set_a":
                _cut_in_half(spark, whole, folder)
            else:
                _overwrite(spark, folder, b"not a table")
        for split, half in itertools.product(registry.SPLITS, (0, 1)):  # a folder without rows holds an empty file
            folder = f"{base}/{s.name}/stored_split={split}/half={half}"
            if not registry.path_exists(spark, folder):
                rows.limit(0).drop("stored_split", "half").write.parquet(folder)
    return registry.load_with_report(spark, specs)[1].drop("error")


@register("s2_arrow_scan", f"WITH {FX.sql_stored()} SELECT doc_id, stored_split, text FROM fx_stored")
def q_s2(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as Arrow IPC files, one directory per stored split,
    read back through the Arrow source (one input partition per file)."""
    arrow_ipc.register(spark)
    base = scratch_path(spark, "arrow")
    st = FX.fx_stored(spark, sf).select("doc_id", "text", "stored_split")
    for split, sub in SPLIT_DIRS.items():
        (st.filter(F.col("stored_split") == split).drop("stored_split")
         .write.format("arrow_ipc").mode("overwrite").save(f"{base}/{sub}"))
    parts = [spark.read.format("arrow_ipc").load(f"{base}/{sub}").withColumn("stored_split", F.lit(split))
             for split, sub in SPLIT_DIRS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "stored_split", "text")


@register("k1_write_splits", PREPARE_SQL)
def q_k1(spark: SparkSession, sf: str) -> DataFrame:
    """K1: prepared splits written one directory per split, read back."""
    path = scratch_path(spark, "splits")
    sinks.write_splits(prepare_pairs(spark, FX.fixture_specs(sf), _vocab(spark, sf), VOCAB_SIZE), path)
    back = spark.read.parquet(path)
    return joined_ids(back.select("split", "source", "row_key", "shuffle_rank", "input_ids", "labels"))


@register("k2_write_metrics", f"SELECT 'base' AS run, 'test' AS split, name, value FROM ({ORACLES['e11_finish_metrics']}) "
          f"UNION ALL SELECT 'other', 'test', name, value FROM ({ORACLES['e11_finish_metrics']}) WHERE name = 'test_rouge1'")
def q_k2(spark: SparkSession, sf: str) -> DataFrame:
    """K2: finished test metrics keyed by run, split and name; one run written twice, another
    beside it, all read back."""
    path = scratch_path(spark, "metrics")
    found = cut_lineage(q_e11(spark, sf)).withColumn("split", F.lit("test"))
    sinks.write_metrics(found.withColumn("run", F.lit("other")).filter("name = 'test_rouge1'"), path)
    for _ in range(2):
        sinks.write_metrics(found.withColumn("run", F.lit("base")), path)
    return sinks.read_metrics(spark, path)


@register("k3_write_text", f"WITH {NORM} SELECT replace(text, chr(10), ' ') AS value FROM norm")
def q_k3(spark: SparkSession, sf: str) -> DataFrame:
    """K3: normalised corpus as plain text, one document per line, read back."""
    path = scratch_path(spark, "text")
    sinks.write_text(C.normalise(read_table(spark, sf, "documents").select("doc_id", "text")), path)
    return spark.read.text(path)


@register("k4_write_vocab", f"WITH {sql_vocab()} SELECT token, id, cnt FROM vocab")
def q_k4(spark: SparkSession, sf: str) -> DataFrame:
    """K4: vocabulary and BPE merges written as tables; the vocabulary read back, and
    the merges read back and compared with what was learned."""
    path = scratch_path(spark, "vocab")
    merges = learn_bpe(counted_types(read_table(spark, sf, "documents").select("text")), N_MERGES)
    sinks.write_vocab(_vocab(spark, sf), merges, path)
    stored = spark.read.parquet(f"{path}/merges").select(*merges.columns)
    if stored.exceptAll(merges).union(merges.exceptAll(stored)).count():  # both bounded by the number of merges
        raise RuntimeError("stored merges differ from the learned ones")
    v = spark.read.parquet(f"{path}/vocab")
    return v.select("token", F.col("id").cast("bigint").alias("id"), "cnt")
