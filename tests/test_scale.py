"""Operators that must hold for hot keys and large groups: caps, joins, near duplicates, ordered files, damaged files."""

import random

from pyspark.sql import functions as F


def test_cap_of_a_large_group_by_counting(spark):
    from textpairs.operators.sampling import cap, cutoffs
    rows = spark.range(0, 200_000).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"), F.lit("train").alias("split"),
        (F.col("id") * 7919 % 1_000_003 - 500_000).alias("row_no")).repartition(6)
    for n in (1, 4095, 100_000):
        kept = cap(rows, {"train": n})
        for source in "ab":
            of = [r["row_no"] for r in rows.filter(F.col("source") == source).orderBy("row_no").limit(n).collect()]
            assert sorted(r["row_no"] for r in kept.filter(F.col("source") == source).collect()) == of
    found = cutoffs(rows, {"train": 4095}, ["source", "split"], "row_no")
    assert all(r["below"] == 4094 for r in found.collect())


def test_cap_with_ties_nulls_and_zero(spark):
    from textpairs.operators.sampling import cap
    rows = spark.createDataFrame([("s", "train", 5, i) for i in range(50)] + [("s", "train", 1, 99), ("s", "train", None, 98), (None, "train", 3, 1),
                                 ("s", "test", None, 5), ("s", "test", None, 6)], "source string, split string, row_no long, x int")
    kept = cap(rows, {"train": 4, "test": 1}).collect()
    assert sorted(r["row_no"] for r in kept if r["split"] == "train" and r["source"] == "s") == [1, 5, 5, 5]
    assert [r["source"] for r in kept if r["source"] is None] == [None] and len([r for r in kept if r["split"] == "test"]) == 1
    assert cap(rows, {"train": 0}).filter("split = 'train'").count() == 0
    assert sorted(map(str, cap(rows, {"train": 4}).collect())) == sorted(map(str, cap(rows.repartition(7), {"train": 4}).collect()))


def test_heavy_join_is_a_left_join(spark):
    from textpairs.operators.joins import frequent, heavy_left_join
    rnd = random.Random(1)
    left = spark.createDataFrame([(i, rnd.choice(["the"] * 6 + ["a", "b", "c", None, "x"])) for i in range(3000)], "id long, w string")
    right = spark.createDataFrame([("the", 1, "p"), ("a", 2, None), ("c", 4, "q")], "w string, v int, u string")
    counts = left.groupBy("w").agg(F.count("*").alias("n")).filter("w is not null")
    heavy = right.join(frequent(counts, "n", 0.2).select("w"), "w")
    assert heavy.count() == 1
    got = heavy_left_join(left, right, "w", heavy, 5, F.col("id"))
    want = left.join(right, "w", "left").select("id", "w", "v", "u")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    none = heavy_left_join(left, right, "w", heavy.limit(0), 5, F.col("id"))
    assert sorted(map(str, none.collect())) == sorted(map(str, want.collect()))


def test_prefix_index_finds_every_similar_pair(spark):
    from textpairs.operators.dedup import prefix_index
    rnd = random.Random(2)
    base = [rnd.sample(range(400), 40) for _ in range(12)]
    sets = {}
    for i in range(150):
        x = set(rnd.choice(base))
        for _ in range(rnd.randint(0, 14)):
            x ^= {rnd.randrange(400)}
        sets[i] = sorted(x)
    df = spark.createDataFrame(list(sets.items()), "id long, sh array<long>")
    for t in (0.5, 0.7, 0.9):
        index = prefix_index(df, t).collect()
        by = {}
        for r in index:
            by.setdefault(r["shingle"], []).append(r)
        met = {(min(a["id"], b["id"]), max(a["id"], b["id"])) for rows in by.values() for a in rows for b in rows
               if a["id"] != b["id"] and a["indexed"] and a["n"] <= b["n"]}
        similar = {(i, j) for i in sets for j in sets if i < j
                   and len(set(sets[i]) & set(sets[j])) >= t * len(set(sets[i]) | set(sets[j]))}
        assert similar <= met and len(similar) > 20


def test_members_that_share_a_passage_do_not_meet(spark):
    """3,000 sets in one bucket with 75 % in common: no pair reaches 0.7, so none may be compared."""
    from textpairs.operators.dedup import prefix_index, verified_components
    sets = spark.range(3000).select("id", F.concat(F.sequence(F.lit(0), F.lit(74)), F.transform(
        F.sequence(F.lit(0), F.lit(24)), lambda k: F.col("id") * 25 + k + 1000)).cast("array<long>").alias("sh"))
    assert prefix_index(sets, 0.7).filter("indexed").count() == 0
    assert verified_components(sets.select(F.lit(1).cast("long").alias("bucket"), "id"), sets, 0.7).count() == 0


def test_files_of_a_split_follow_each_other(spark, tmp_path):
    from textpairs.sources.sinks import write_splits
    n = {"train": 950, "test": 130}
    rows = [(s, r, f"{s}{r}") for s, k in n.items() for r in range(1, k + 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "split string, shuffle_rank long, row_key string").repartition(5)
    write_splits(df, str(tmp_path / "out"), rows_per_file=100)
    for split, k in n.items():
        parts = sorted((tmp_path / "out" / f"split={split}").iterdir(), key=lambda p: int(p.name.split("=")[1]))
        read = []
        for part in parts:
            files = list(part.glob("*.parquet"))
            assert len(files) == 1
            import pyarrow.parquet as pq
            read += pq.ParquetFile(files[0]).read(["shuffle_rank"])["shuffle_rank"].to_pylist()
        assert read == list(range(1, k + 1))


def test_metrics_are_keyed(spark, tmp_path):
    from textpairs.sources.sinks import read_metrics, write_metrics
    path = str(tmp_path / "m")
    schema = "run string, split string, name string, value double"
    write_metrics(spark.createDataFrame([("r1", "test", "rouge1", 1.0), ("r1", "test", "rouge2", 2.0), ("r2", "dev", "rouge1", 3.0)], schema), path)
    write_metrics(spark.createDataFrame([("r1", "test", "rouge1", 9.0)], schema), path)
    write_metrics(spark.createDataFrame([("r1", "test", "rouge1", 9.0)], schema), path)
    got = {tuple(r) for r in read_metrics(spark, path).collect()}
    assert got == {("r1", "test", "rouge1", 9.0), ("r1", "test", "rouge2", 2.0), ("r2", "dev", "rouge1", 3.0)}


def test_damaged_files_are_named(spark, tmp_path):
    import pytest

    from textpairs.sources.registry import SourceSpec, load_with_report, lost_files
    rows = spark.range(40_000).select(F.col("id").alias("row_no"), F.sha2(F.col("id").cast("string"), 256).alias("document"),
                                      F.md5(F.col("id").cast("string")).alias("summary"))
    base = tmp_path / "s"
    for k in range(4):
        rows.filter(F.col("row_no") % 4 == k).coalesce(1).write.parquet(str(base / "train" / f"p{k}"))
    rows.limit(0).coalesce(1).write.parquet(str(base / "train" / "p4"))  # empty, not lost
    rows.limit(10).coalesce(1).write.parquet(str(base / "test" / "p0"))

    def file(k):
        return next((base / "train" / f"p{k}").glob("*.parquet"))

    def damage(path, data):
        for crc in path.parent.glob(".*.crc"):
            crc.unlink()
        path.write_bytes(data)

    whole = file(1).read_bytes()
    damage(file(1), whole[:len(whole) // 2])                       # no footer
    middle = bytearray(file(2).read_bytes())
    middle[200_000:300_000] = bytes(100_000)                       # a page in the middle; footer intact
    damage(file(2), bytes(middle))
    spec = SourceSpec(name="s", document_col="document", summary_col="summary", path=str(base), order_col="row_no",
                      split_dirs={"train": "train/p*", "validation": "dev", "test": "test/p*"})
    found = {r["file"].rsplit("/", 2)[1]: r for r in lost_files(spark, [spec]).collect()}
    assert set(found) == {"p1", "p2"}
    assert found["p1"]["problem"] == "unreadable" and found["p2"]["problem"] == "cut short"
    assert found["p2"]["rows_stored"] == 10_000 > found["p2"]["rows_read"]
    pairs, report = load_with_report(spark, [spec])
    status = {r["split"]: (r["status"], r["lost_files"]) for r in report.collect()}
    assert status == {"train": ("damaged", 2), "validation": ("missing", 0), "test": ("ok", 0)}
    read = pairs.filter("split = 'train'").groupBy(F.length("input_text")).count().agg(F.sum("count")).first()[0]
    assert 20_000 <= read < 30_000 and {r["rows"] for r in report.collect() if r["split"] == "train"} == {read}
    with pytest.raises(RuntimeError, match="train files"):
        load_with_report(spark, [SourceSpec(name="s", document_col="document", summary_col="summary", path=str(base), order_col="row_no",
                                            split_dirs={"train": "nowhere", "validation": "dev", "test": "test/p*"})])


def test_a_file_is_cut_in_half_without_being_held(spark, tmp_path, monkeypatch):
    from textpairs.plans import q_io
    rows = spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"))
    whole, part = str(tmp_path / "whole"), str(tmp_path / "part")
    rows.coalesce(1).write.parquet(whole)
    monkeypatch.setattr(type(rows), "first", lambda self: 1 / 0)  # no row, so no file's content, comes to the driver
    q_io._cut_in_half(spark, whole, part)
    data, cut = (next((tmp_path / d).glob("*.parquet")).read_bytes() for d in ("whole", "part"))
    assert cut == data[:len(data) // 2]
