"""Hand-computed cases, brute-force checks and properties."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from plain_lcs import lcs_length_dp, lcs_positions_dp, rouge_l
from plain_porter import porter_stem, stem_token

from textpairs.functions.lcs import lcs_positions, rouge_lsum


# ---------------------------------------------------------------- LCS / ROUGE

@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_lcs_positions_are_those_of_the_table(a, b):
    assert lcs_positions(a, b) == lcs_positions_dp(a, b)


def test_lcs_positions_of_long_texts():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    a, b = rng.choices(vocabulary, k=20_000), rng.choices(vocabulary, k=20_000)
    began = time.time()
    at = lcs_positions(a, b)
    assert time.time() - began < 20 and len(at) > 500
    rest = iter(b)
    assert at == sorted(set(at)) and all(a[i] in rest for i in at)  # a common subsequence


def test_rouge_l_hand_case():
    p, r, f = rouge_l("the cat sat".split(), "the cat sat on the mat".split())
    assert (p, r) == (1.0, 0.5) and abs(f - 2 / 3) < 1e-12


def test_rouge_lsum_union_lcs():
    # reference sentence "w1 w2 w3 w4 w5" against candidate sentences
    # "w1 w2 w6 w7 w8" and "w1 w3 w8 w9 w5": union LCS = {w1 w2 w3 w5} -> 4 hits
    ref = [["w1", "w2", "w3", "w4", "w5"]]
    cand = [["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]]
    p, r, f = rouge_lsum(cand, ref)
    assert r == 4 / 5 and p == 4 / 10


def test_rouge_n_counts_clip(spark):
    from textpairs.operators.rouge import rouge_n
    df = spark.createDataFrame([("p", ["a", "a", "b"], ["a", "b", "b", "c"]), ("q", [], [])],
                               "pair_id string, cand_tokens array<string>, ref_tokens array<string>")
    got = {r["pair_id"]: r for r in rouge_n(df, 1, "pair_id").collect()}
    assert got["p"]["overlap"] == 2 and got["p"]["rouge1_p"] == 2 / 3 and got["p"]["rouge1_r"] == 0.5
    assert got["q"]["rouge1_f"] == 0.0


def test_rouge_l_expression_is_the_table(spark):
    """Up to 60 tokens, at the edges of the words of a row, and far beyond."""
    from textpairs.operators.rouge import rouge_l as spark_rouge_l
    rng = random.Random(7)
    sizes = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(200)]
    sizes += [(n, m) for n in (61, 62, 63, 124, 125, 400) for m in (61, 62, 63, 124, 125, 400)]
    rows = [(str(i), rng.choices("abcdefgh", k=n), rng.choices("abcdefgh", k=m)) for i, (n, m) in enumerate(sizes)]
    rows += [("same", ["a"] * 200, ["a"] * 130), ("none", ["a"] * 70, ["b"] * 70)]
    df = spark.createDataFrame(rows, "pair_id string, cand_tokens array<string>, ref_tokens array<string>")
    got = {r["pair_id"]: r["rougeL_f"] for r in spark_rouge_l(df).collect()}
    for k, c, r in rows:
        assert abs(got[k] - rouge_l(c, r)[2]) < 1e-12


# ---------------------------------------------------------------- stemming

PORTER = [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"),
    ("falling", "fall"), ("hissing", "hiss"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("hopeful", "hope"), ("goodness", "good"), ("adjustment", "adjust"),
    ("adoption", "adopt"), ("controlling", "control"), ("generalizations", "gener"),
]


def test_porter_published_examples(spark):
    """The SQL rules on the published examples, and on made-up words against one-word-at-a-time code."""
    from textpairs.operators.stems import STEP2, STEP3, STEP4, stem_table
    rng = random.Random(3)
    ends = [s for s, _ in [*STEP2, *STEP3]] + STEP4 + ["s", "sses", "ies", "ed", "ing", "eed", "y", "e", "ll", ""]
    made = {"".join(rng.choices("abeilosty", k=rng.randint(1, 6))) + "".join(rng.choices(ends, k=rng.randint(1, 2))) for _ in range(3000)}
    words = sorted(made | {w for w, _ in PORTER} - {""})
    got = {r["token"]: r["stem"] for r in stem_table(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert {w: got[w] for w, _ in PORTER} == dict(PORTER)
    assert {w: g for w, g in got.items() if porter_stem(w) != g} == {}


def test_stems_join_back_in_order(spark):
    from textpairs.operators.stems import stemmed
    rows = [(1, ["cats", "was", "running", "cats"], ["ponies"]), (2, [], None), (3, None, ["running", "was"])]
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    got = {r["k"]: (r["a"], r["b"]) for r in stemmed(df, ["k"], ["a", "b"]).collect()}
    plain = lambda ts: None if ts is None else [stem_token(t) for t in ts]
    assert got == {k: (plain(a), plain(b)) for k, a, b in rows}


def test_stems_of_shared_and_null_keys(spark):
    from textpairs.operators.stems import stemmed
    rows = [(1, "x", ["cats", "dogs"]), (1, "y", ["ponies"]), (None, "z", ["cats"]), (None, "n", None), (2, "e", []), (3, "o", ["ponies", None])]
    df = spark.createDataFrame(rows, "k long, other string, a array<string>")
    got = {r["other"]: r["a"] for r in stemmed(df, ["k"], ["a"]).collect()}
    assert got == {"x": ["cat", "poni", "dog"], "y": ["cat", "poni", "dog"], "z": [], "n": None, "e": [], "o": ["poni", None]}


def test_stems_move_distinct_tokens(spark, monkeypatch):
    from textpairs.operators import stems as ST
    words = ["running", "cats", "ponies", "was", "hopeful"]
    df = spark.createDataFrame([(k, words * 100) for k in range(40)], "k long, a array<string>").repartition(2)
    moved, joined = [], type(df).join

    def seen(self, other, *args, **kw):
        moved.append(max(self.count(), other.count()))
        return joined(self, other, *args, **kw)

    monkeypatch.setattr(type(df), "join", seen)
    got = ST.stemmed(df, ["k"], ["a"]).collect()
    assert all(r["a"] == ["run", "cat", "poni", "was", "hope"] * 100 for r in got) and len(got) == 40
    assert max(moved) <= 40  # of 20,000 tokens


# ---------------------------------------------------------------- ranking, cap, shuffle

def test_sharded_row_number_equals_global(spark):
    from textpairs.operators.sampling import shuffle
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("row_key"),
                                     F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("split"))
    got = shuffle(df, keep_keys=True)
    w = Window.partitionBy("split").orderBy("shuffle_key", "row_key")
    bad = got.withColumn("ref", F.row_number().over(w)).filter(F.col("ref") != F.col("shuffle_rank")).count()
    assert bad == 0
    # a permutation per split
    agg = got.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("shuffle_rank").alias("d"),
                                  F.max("shuffle_rank").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] for r in agg)


def test_average_rank_ties(spark):
    import pandas as pd
    from textpairs.operators.ranking import average_rank
    vals = [3.0, 1.0, 3.0, 2.0, None, 3.0, 0.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    got = {r["i"]: r["r"] for r in average_rank(df, "v", "r").collect()}
    ref = pd.Series(vals).rank(method="average")
    for i, v in enumerate(vals):
        assert (got[i] is None) if v is None else got[i] == ref[i]


def test_cap_is_head_and_idempotent(spark):
    from textpairs.operators.sampling import cap
    df = spark.createDataFrame([("s", "train", i) for i in range(50)] + [("s", "test", i) for i in range(7)],
                               "source string, split string, row_no long")
    caps = {"train": 10, "test": 3}
    once = cap(df, caps)
    assert sorted(r["row_no"] for r in once.filter("split='train'").collect()) == list(range(10))
    assert cap(once, caps).count() == once.count() == 13


# ---------------------------------------------------------------- batches

def test_padding_rules(spark):
    from textpairs.operators.batches import pad_batch, pad_labels
    df = spark.createDataFrame([("t", 0, [0, 5, 2], [0, 9, 2]), ("t", 0, [0, 5, 6, 7, 2], [0, 2])],
                               "split string, batch_id long, input_ids array<int>, labels array<int>")
    p = pad_labels(pad_batch(df)).orderBy(F.size("input_ids")).collect()
    assert p[0]["input_ids"] == [0, 5, 2, 1, 1] and p[0]["attention_mask"] == [1, 1, 1, 0, 0]
    assert p[1]["labels"] == [0, 2, -100]
    p8 = pad_batch(df, multiple=8).collect()
    assert all(len(r["input_ids"]) == 8 for r in p8)


def test_unmask_and_gen_len(spark):
    from textpairs.operators.metrics import gen_len
    from textpairs.operators.rouge import unmask_labels
    df = spark.createDataFrame([([7, 8, -100, -100],), ([7, 1, 1, 1],)], "pred_ids array<int>")
    assert unmask_labels(df, "pred_ids").first()["pred_ids"] == [7, 8, 1, 1]
    assert gen_len(df).first()["gen_len"] == 1.5
    assert gen_len(df, strict_reference=True).first()["gen_len"] == 2.5


# ---------------------------------------------------------------- scoring

def test_quarantine_keeps_other_rows(spark):
    from textpairs.operators.scoring import score_pairs

    class FailsOn:  # local: pickled by value for the Python workers
        def __init__(self, bad):
            self.bad = bad

        def open(self):
            pass

        def score(self, srcs, tgts):
            if any(t == self.bad for t in tgts):
                raise ValueError("bad input")
            return [float(len(t)) for t in tgts]

    df = spark.createDataFrame([(i, "doc", "x" * i) for i in range(1, 20)], "k long, document string, summary string")
    out = {r["k"]: r for r in score_pairs(df, lambda: FailsOn("x" * 5), "k", batch_size=8).collect()}
    assert out[5]["score"] is None and "bad input" in out[5]["score_error"]
    assert all(out[i]["score"] == float(i) for i in out if i != 5)


def test_user_scorer_equals_python(spark):
    from textpairs.operators.scoring import OverlapScorer, score_pairs
    rows = [(1, "a b c a", "a d"), (2, "x y", "y y x"), (3, "", "q")]
    df = spark.createDataFrame(rows, "k long, document string, summary string")
    got = {r["k"]: r["score"] for r in score_pairs(df, OverlapScorer, "k").collect()}
    s = OverlapScorer()
    s.open()
    for k, d, q in rows:
        assert abs(got[k] - s.score([d], [q])[0]) < 1e-12


# ---------------------------------------------------------------- cleaning, dedup, BPE

def test_near_dedup_matches_brute_force(spark):
    from textpairs.operators.dedup import dedup_near
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base + " tail", base.replace("w30", "zz"), "completely different words here " * 5,
             "completely different words here " * 5 + "x", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in dedup_near(df).collect()}

    def sh(t):
        w = t.lower().split()
        return {" ".join(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)}
    # brute force: components of pairs with Jaccard >= 0.7
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            a, b = sh(texts[i]), sh(texts[j])
            if len(a & b) / len(a | b) >= 0.7:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: find(i) for i in range(len(texts))} == got


def brute_bpe(counts, n):
    words = {tuple(f"<{b:02X}>" for b in w.encode()): c for w, c in counts.items()}
    merges = []
    for _ in range(n):
        pc = Counter()
        for w, c in words.items():
            for a, b in zip(w, w[1:]):
                pc[a + b] += c
        if not pc:
            break
        best = sorted(pc.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        if best[1] < 2:
            break
        merges.append(best[0])
        new = {}
        for w, c in words.items():
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] + w[i + 1] == best[0]:
                    out.append("<" + w[i][1:-1] + w[i + 1][1:-1] + ">")
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            new[tuple(out)] = new.get(tuple(out), 0) + c
        words = new
    return merges


def plain_bpe(word, ranks):
    """The symbols of one word: the lowest-ranked pair first, one merge at a time."""
    syms = [f"<{b:02X}>" for b in word.encode()]
    while True:
        known = [(ranks[p], i) for i, p in enumerate(zip(syms, syms[1:])) if p in ranks]
        if not known:
            return syms
        i = min(known)[1]
        syms[i:i + 2] = ["<" + syms[i][1:-1] + syms[i + 1][1:-1] + ">"]


def test_merged_runs_count_every_pair():
    from textpairs.functions.symbols import PAIR, SymbolRuns
    rnd = random.Random(2)
    for _ in range(200):
        words = [[rnd.randrange(3) for _ in range(rnd.randint(1, 9))] for _ in range(rnd.randint(1, 8))]
        cnt = [rnd.randint(1, 5) for _ in words]
        runs = SymbolRuns(np.array([s for w in words for s in w]), np.array([len(w) for w in words]), np.array(cnt))
        for new in range(3, 9):
            a, b = rnd.randrange(new), rnd.randrange(new)
            before = Counter(p for w, c in zip(words, cnt) for p in list(zip(w, w[1:])) * c)
            for w in words:
                i = 0
                while i + 1 < len(w):
                    if w[i] == a and w[i + 1] == b:
                        w[i:i + 2] = [new]
                    i += 1
            after = Counter(p for w, c in zip(words, cnt) for p in list(zip(w, w[1:])) * c)
            want = {p[0] * PAIR + p[1]: after[p] - before[p] for p in before | after if after[p] != before[p]}
            keys, change = runs.merge(a, b, new)
            assert {k: c for k, c in zip(keys.tolist(), change.tolist()) if c} == want
            flat, lengths = runs.words()
            assert flat.tolist() == [s for w in words for s in w] and lengths.tolist() == [len(w) for w in words]


def test_bpe_order_of_close_merges(spark):
    """Ties and near ties in any order of guessing give plain BPE's order."""
    from textpairs.operators.bpe import learn_segments, word_types
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdé", k=rnd.randint(2, 7))) for _ in range(300)]
    text = " ".join(rnd.choices(words, k=2000))
    df = spark.createDataFrame([(text,)], "text string")
    for head in (1, 40, 1000):
        got = learn_segments(word_types(df), 80, head_types=head)[0].orderBy("rank").collect()
        assert [r["left"] + r["right"] for r in got] == brute_bpe(Counter(text.split()), 80)


def test_bpe_matches_brute_force(spark):
    from textpairs.operators.bpe import learn_bpe, word_types
    text = "ababaaa aaa abab ba ba aab " * 3 + "héllo hé"
    df = spark.createDataFrame([(text,)], "text string")
    got = [r["left"] + r["right"] for r in learn_bpe(word_types(df), 6).orderBy("rank").collect()]
    counts = Counter(text.split())
    assert got == brute_bpe(counts, 6)


def test_bpe_rounds_equal_one_merge_at_a_time(spark):
    from textpairs.operators.bpe import learn_bpe, word_types
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    text = " ".join(r["text"] for r in docs.collect())
    one = spark.createDataFrame([(text,)], "text string")
    got = [r["left"] + r["right"] for r in learn_bpe(word_types(one), 40).orderBy("rank").collect()]
    assert got == brute_bpe(Counter(text.split()), 40)


def test_bpe_of_production_size(spark):
    from textpairs.operators.bpe import learn_segments, word_types
    from textpairs.plans.catalog import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    counts = Counter(" ".join(r["text"] or "" for r in docs.collect()).split())
    want = brute_bpe(counts, 400)
    types = word_types(docs)
    merges, ends = learn_segments(types, 400)
    assert [r["left"] + r["right"] for r in merges.orderBy("rank").collect()] == want
    few, ends_of_few = learn_segments(types, 60, head_types=5)  # poor guesses: more rounds, the same merges
    assert [r["left"] + r["right"] for r in few.orderBy("rank").collect()] == want[:60]
    ranks = {(r["left"], r["right"]): r["rank"] for r in few.collect()}
    spelt = {"".join(f"<{b:02X}>" for b in w.encode()): "".join(plain_bpe(w, ranks)) for w in counts}
    assert {r["word"]: r["sym"] for r in ends_of_few.collect()} == spelt
    learned = QUERIES["t2_learn_bpe"](spark, "/root/testdata/sf0.001").orderBy("rank").collect()
    assert [r["rank"] for r in learned] == list(range(1, 4001))
    assert all(a["cnt"] >= b["cnt"] for a, b in zip(learned, learned[1:]))


def test_load_report_and_faults(spark):
    from textpairs.plans.fixtures import fixture_specs
    from textpairs.sources.registry import SourceSpec, load_with_report
    SMALL = "/root/testdata/sf0.001"
    specs = fixture_specs(SMALL, with_failing=True)
    pairs, report = load_with_report(spark, specs)
    st = {r["source"]: r["status"] for r in report.collect()}
    assert st["set_e"] == "error" and st["set_a"] == st["set_d"] == "ok"
    broken = [SourceSpec(name="x", document_col="nope", summary_col="summary", loader=specs[0].loader)]
    with pytest.raises(RuntimeError):
        load_with_report(spark, broken)


def test_results_independent_of_partitioning(spark):
    """Shuffle rank and the two-level cap are functions of the data, not of
    how the input happens to be split (so re-planned or retried tasks agree)."""
    from textpairs.operators.sampling import cap, shuffle
    base = spark.range(0, 2000).select(
        F.lit("s").alias("source"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"),
        F.col("id").alias("row_no"), F.col("id").cast("string").alias("row_key"))
    runs = []
    for n in (1, 3, 7):
        df = base.repartition(n)
        capped = cap(df, {"train": 50, "test": 20})
        ranked = shuffle(capped)
        runs.append(sorted((r["split"], r["row_key"], r["shuffle_rank"]) for r in ranked.collect()))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 70


def test_cap_passes_unnamed_splits(spark):
    from textpairs.operators.sampling import cap
    df = spark.createDataFrame([("s", sp, i) for sp in ("train", "test", None) for i in range(5)], "source string, split string, row_no long")
    assert cap(df, {}).count() == 15
    got = Counter(r["split"] for r in cap(df, {"train": 3, "other": 1}).collect())
    assert got == {"train": 3, "test": 5, None: 5}


def test_pairs_with_a_missing_side_are_rejected_not_emptied(spark):
    from textpairs.operators.pairs import align, split_pairs
    from textpairs.operators.vocab import build_vocab, encode
    rows = [("s", "train", 1, "s:1", "a b", "c"), ("s", "train", 2, "s:2", "a b", None), ("s", "train", 3, "s:3", None, "c"),
            ("s", "train", 4, "s:4", " \n", "c"), ("s", "train", 5, "s:5", "a", ""), ("s", "train", 6, "s:6", "a", "c"),
            ("s", "train", 6, "s:6", "b", "c"), ("s", "test", 6, "s:6", "b", "c"), ("s", "train", 7, None, "b", "c")]
    pairs = spark.createDataFrame(rows, "source string, split string, row_no long, row_key string, input_text string, target_text string")
    valid, rejects = split_pairs(pairs)
    assert sorted((r["split"], r["row_key"]) for r in valid.collect()) == [("test", "s:6"), ("train", "s:1")]
    assert Counter(r["reason"] for r in rejects.collect()) == {"missing_summary": 1, "missing_document": 1, "blank_document": 1,
                                                               "blank_summary": 1, "duplicate_key": 2, "missing_key": 1}
    vocab = build_vocab(pairs, "input_text", 50, 1)
    ids = {r["row_no"]: r for r in encode(pairs, vocab, [("input_text", "i", 10), ("target_text", "l", 10)], ["row_no"], vocab_size=50).collect()}
    assert len(ids[2]["i"]) == 4 and ids[2]["l"] == [0, 2]  # the null side is empty, the other one whole
    left = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k long, a string")
    right = spark.createDataFrame([(1, "p"), (None, "q")], "k long, b string")
    aligned, left_out = align(left, right, "k")
    assert aligned.count() == 1
    assert Counter((r["side"], r["reason"]) for r in left_out.collect()) == {("left", "missing_key"): 1, ("right", "missing_key"): 1}


def test_blank_text_has_no_lead_sentence(spark):
    from textpairs.functions.text import lead_sentence
    rows = spark.createDataFrame([("One. Two.",), ("",), (" \n",), (None,)], "text string").select(lead_sentence("text").alias("l")).collect()
    assert [r["l"] for r in rows] == ["One.", None, None, None]


def test_unknown_split_has_no_batch(spark):
    from textpairs.operators.batches import assign_batches
    df = spark.createDataFrame([("extra", 1)], "split string, shuffle_rank long")
    with pytest.raises(Exception, match="no batch size for split extra"):
        assign_batches(df).collect()


def test_declared_schema_must_be_in_the_files(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType
    from textpairs.operators.pairs import ColumnMappingError
    from textpairs.sources.registry import read_with_schema
    spark.createDataFrame([("a", 1)], "text string, n long").write.parquet(str(tmp_path / "t"))
    for bad in (StructField("other", StringType()), StructField("n", StringType())):
        with pytest.raises(ColumnMappingError):
            read_with_schema(spark, [str(tmp_path / "t")], StructType([bad]))


def test_text_sink_keeps_one_record_per_line(spark, tmp_path):
    from textpairs.sources.sinks import write_text
    write_text(spark.createDataFrame([("a\rb",), ("c\r\nd\ne",)], "text string"), str(tmp_path / "t"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a b", "c d e"]


def test_outliers_do_not_fill_one_shard(spark):
    from textpairs.operators.ranking import numeric_shard
    df = spark.range(0, 9999).union(spark.createDataFrame([(10 ** 12,)], "id long"))
    sizes = [r["count"] for r in df.groupBy(numeric_shard(df, "id", 64).alias("s")).count().collect()]
    assert len(sizes) >= 60 and max(sizes) < 400


def test_components_of_a_long_chain(spark):
    from textpairs.operators.dedup import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (101, 102)], "src long, dst long")
    assert {r["node"]: r["label"] for r in components(edges).collect()} == {**{i: 0 for i in range(61)}, 101: 101, 102: 101}


def test_near_dedup_loses_no_link_of_a_bucket(spark):
    """A chain in one bucket: neighbours are similar, ends are not."""
    from textpairs.operators.dedup import verified_components
    sets = spark.createDataFrame([(i, list(range(10 * i, 10 * i + 100))) for i in range(60)], "id long, sh array<long>")
    members = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 0), (2, 59)], "bucket long, id long")
    got = {r["node"]: r["label"] for r in verified_components(members, sets, 0.8).collect()}
    assert got == {i: 0 for i in range(60)}


def test_near_dedup_joins_every_verified_bucket_pair(spark):
    from textpairs.operators.dedup import band_keys, dedup_near, with_shingles
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sh = {r["doc_id"]: set(r["sh"]) for r in with_shingles(docs, "text").collect()}
    buckets = {}
    for r in band_keys(docs).collect():
        buckets.setdefault((r["band"], r["band_key"]), []).append(r["doc_id"])
    parent = {d: d for d in sh}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for ids in buckets.values():
        for i in ids:
            for j in ids:
                if i < j and len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= 0.7:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["component"] for r in dedup_near(docs, hash_kind="md5").collect()} == {d: find(d) for d in sh}


def test_compute_metrics_counts_the_vocabulary_once(spark, tmp_path, monkeypatch):
    from textpairs.operators import vocab as V
    from textpairs.plans.catalog import QUERIES
    text = "The cats were running home. They saw ponies there. "
    rows = [(k, text * (k % 3 + 1), "en", "web", len(text)) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    built, build = [], V.build_vocab

    def seen(*args, **kw):
        built.append(1)
        return build(*args, **kw)

    monkeypatch.setattr(V, "build_vocab", seen)
    got = {r["name"]: r["value"] for r in QUERIES["compute_metrics"](spark, str(tmp_path)).collect()}
    assert len(built) == 1
    assert got["test_gen_len"] > 0 and 0 < got["test_rouge1"] < 100


def test_compute_metrics_by_hand(spark):
    from textpairs.functions.lcs import rouge_lsum
    from textpairs.operators.rouge import compute_metrics
    vocab = spark.createDataFrame([(w, 5 + i, 1) for i, w in enumerate(["the", "cat", "sat.", "on", "mat.", "dog"])], "token string, id int, cnt long")
    rows = [(1, [0, 5, 6, 7, 8, 5, 9, 2, 1, 1], [0, 5, 10, 7, 8, 5, 9, 2, -100, -100]), (2, [0, 5, 6, 2], [0, 10, 2, -100])]
    df = spark.createDataFrame(rows, "k long, pred_ids array<int>, labels array<int>")
    got = {r["name"]: r["value"] for r in compute_metrics(df, vocab, ["k"]).collect()}
    one = ([["the", "cat", "sat"], ["on", "the", "mat"]], [["the", "dog", "sat"], ["on", "the", "mat"]])
    flat = [[w for s in side for w in s] for side in one]
    stemmed = compute_metrics(spark.createDataFrame([(1, [0, 5, 2], [0, 6, 2])], df.schema), spark.createDataFrame(
        [("running", 5, 1), ("runs", 6, 1)], "token string, id int, cnt long"), ["k"])
    assert {r["name"]: r["value"] for r in stemmed.collect()}["test_rouge1"] == 100.0
    assert got["test_rouge1"] == round(100 * (5 / 6 + 0) / 2, 4)
    assert got["test_rouge2"] == round(100 * (3 / 5 + 0) / 2, 4)
    assert got["test_rougeL"] == round(100 * rouge_l(*flat)[2] / 2, 4)
    assert got["test_rougeLsum"] == round(100 * rouge_lsum(*one)[2] / 2, 4)
    assert got["test_gen_len"] == 6.0


def test_sources_by_path(spark, tmp_path):
    from textpairs.sources.registry import SourceSpec, load_with_report
    rows = spark.createDataFrame([(i, f"doc {i}", f"sum {i}") for i in range(20)], "row_no long, document string, summary string")
    rows.repartition(3).write.parquet(str(tmp_path / "a" / "train"))
    dirs = {"train": "train", "validation": "dev", "test": "test"}
    spec = SourceSpec(name="a", document_col="document", summary_col="summary", split_map={s: s for s in dirs},
                      path=str(tmp_path / "a"), format="parquet", split_dirs=dirs)
    pairs, report = load_with_report(spark, [spec])
    assert pairs.count() == 20
    assert {(r["split"], r["status"], r["rows"]) for r in report.collect()} == {("train", "ok", 20), ("validation", "missing", 0), ("test", "missing", 0)}
    nowhere = SourceSpec(name="b", document_col="document", summary_col="summary", split_map={s: s for s in dirs},
                         path=str(tmp_path / "b"), format="parquet", split_dirs=dirs)
    _, report = load_with_report(spark, [spec, nowhere])
    assert {r["source"] for r in report.filter("status = 'error'").collect()} == {"b"}
    with pytest.raises(RuntimeError):
        load_with_report(spark, [nowhere])


def test_poisson_infilling_masks_the_budget(spark):
    from textpairs.operators.batches import infill_poisson
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 2, 3, 10, 57, 400)] + [(1000, None)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r["k"]: r for r in infill_poisson(df, "text", "k").collect()}
    lengths = []
    for n, text in rows:
        words, out = (text or "").split(), got[n]["masked_text"].split()
        kept = [w for w in out if w != "[MASK]"]
        assert len(words) - len(kept) == got[n]["masked_words"] == int(len(words) * 0.3 + 0.5)
        rest = iter(words)
        assert all(w in rest for w in kept)  # the words that stay keep their order
        gaps = [-1, *[int(w[1:]) for w in kept], len(words)]
        lengths += [b - a - 1 for a, b in zip(gaps, gaps[1:]) if b - a > 1]
    assert 2 < sum(lengths) / len(lengths) < 5  # runs of spans of mean 3


def test_bpe_ids_by_joins(spark):
    from textpairs.operators.bpe import bpe_encode, bpe_encode_ids, bpe_vocab, learn_segments, word_types
    texts = ["low lower lowest low", "new newer né newest wide", "", None, "low " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    types = word_types(df)
    merges, segments = learn_segments(types, 12)
    pairs = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    vocab = {r["token"]: r["id"] for r in bpe_vocab(merges).collect()}
    assert sorted(vocab.values()) == list(range(5 + 256 + len(pairs)))
    ranks = {p: i for i, p in enumerate(pairs)}
    back = {i: t for t, i in vocab.items()}
    got = {r["doc_id"]: r for r in bpe_encode_ids(df, segments, types, bpe_vocab(merges), 12, ["doc_id"], max_len=20).collect()}
    for i, t in enumerate(texts):
        want = [vocab[s] for w in (t or "").split() for s in plain_bpe(w, ranks)][:18]
        assert got[i]["input_ids"] == [0, *want, 2]
        assert got[i]["attention_mask"] == [1] * (len(want) + 2)
    tokens = {r["doc_id"]: r["bpe_tokens"] for r in bpe_encode(df, segments, types, ["doc_id"], max_tokens=18).collect()}
    assert tokens == {i: [s for w in (t or "").split() for s in plain_bpe(w, ranks)][:18] for i, t in enumerate(texts)}
    whole = "".join(back[i].strip("<>") for i in got[0]["input_ids"][1:-1])
    assert bytes.fromhex(whole).decode() == "lowlowerlowestlow"


def test_whitespace_rules_and_first_sentence(spark):
    from textpairs.functions.text import lead_sentence, sentences, strip_ws, words
    texts = ["", " \t\n\x0b\f\r ", "a", " a  b\n\nc\x0bd\r", "One. Two! ", " \n Three?\n", "1.5 is. \n x", "no end\n then", "..", ". . a", "e.g.x !? y", "  z  ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    old = F.regexp_replace("t", r"^\s+|\s+$", "")
    got = df.select("i", "t", strip_ws("t").alias("s"), old.alias("o"), words("t").alias("w"),
                    F.filter(F.split(old, r"\s+"), lambda x: x != "").alias("ow"), lead_sentence("t").alias("l"), F.get(sentences("t"), 0).alias("ol")).collect()
    for r in got:
        assert (r.s, r.w, r.l) == (r.o, r.ow, r.ol), r.t


def test_encode_looks_rows_up_where_they_stand(spark, monkeypatch):
    from textpairs.operators import vocab as V
    monkeypatch.setattr(V, "_SLICE", 40)  # several slices a batch
    vocab = spark.createDataFrame([("<s>", 0), ("a", 5), ("b", 6), ("é", 7)], "token string, id int")
    texts = ["", None, " a\x0bb\tz ", "é  é\r\n a", "a " * 50, "b"] * 3
    df = spark.createDataFrame([(i // 2, t, "b") for i, t in enumerate(texts)], "k int, t string, u string").coalesce(1)
    e = V.encode(df, vocab, [("t", "x", 6), ("u", "y", 3)], ["k"], vocab_size=4)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # no token is a row
    known = {"a": 5, "b": 6, "é": 7}
    want = [(i // 2, [0, *[known.get(w, 3) for w in (t or "").split()][:4], 2], [0, 6, 2]) for i, t in enumerate(texts)]
    assert sorted(map(repr, map(tuple, e.collect()))) == sorted(map(repr, want))
    assert V.encode(df.limit(0), vocab, [("t", "x", 6)], ["k"], vocab_size=4).collect() == []
    with pytest.raises(ValueError, match="vocabulary"):
        V.encode(df, vocab, [("t", "x", 6)], ["k"], vocab_size=3)


def test_signatures_equal_the_built_ins(spark, monkeypatch):
    import hashlib

    from textpairs.operators import dedup as D
    monkeypatch.setattr(D, "_BLOCK", 7)  # several blocks a batch
    df = spark.createDataFrame([(1, ["a", "b c", "é"]), (2, ["a"]), (3, []), (4, None), (5, [None]), (6, [None, "x", "a"])] * 2, "i int, sh array<string>")
    for r in D.minhash_md5(df.coalesce(1)).join(df.distinct(), "i").collect():
        have = [x for x in r.sh or [] if x is not None]
        assert r.mins == ([min(hashlib.md5(f"{j // 4}|{x}".encode()).hexdigest()[8 * (j % 4):8 * (j % 4) + 8] for x in have) for j in range(32)]
                          if have else None)
    longs = spark.createDataFrame([(1, [0, -1, 1 << 62]), (2, [-(1 << 63)]), (3, [5, 6, 7, 8])], "i int, sh array<long>")
    want = F.array(*[F.array_min(F.transform("sh", (lambda g: lambda s: F.xxhash64(F.lit(g), s))(g))) for g in range(32)])
    assert {r.i: r.mins for r in D.minhash_xx(longs).collect()} == {r.i: r.w for r in longs.select("i", want.alias("w")).collect()}


def test_md5_of_many_strings():
    import hashlib

    from textpairs.functions.md5 import prefixed_md5
    rng = random.Random(5)
    texts = [rng.randbytes(n) for n in [*range(0, 140), 53, 54, 55, 119, 700]] + [b""] * 3
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    for prefixes in ([b"0|", b"7|"], [b"10|"]):
        for prefix, found in zip(prefixes, prefixed_md5(data, np.array([len(t) for t in texts]), prefixes)):
            assert ["".join(f"{x:08x}" for x in row) for row in found.tolist()] == [hashlib.md5(prefix + t).hexdigest() for t in texts]
    assert len(prefixed_md5(data[:0], np.zeros(0, dtype=np.int64), [b"0|"])[0]) == 0


def test_texts_in_nfc_stay_in_the_jvm(spark):
    import unicodedata

    from textpairs.operators import clean as C
    assert all(unicodedata.is_normalized("NFC", a + chr(b)) for a in ("", "e", "é") for b in range(0x300))
    texts = ["plain", "é ü ˿", "é x", "ﬁ Å", None, "", "a\U0001F600ë"]
    got = {r.i: r.text for r in C.normalise(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}

    @F.pandas_udf("string")
    def strict(s):
        if any(x is not None and max(x, default="") < "\u0300" for x in s):
            raise ValueError("a text in NFC came to Python")
        return s
    plain, C.nfc = C.nfc, strict
    try:
        C.normalise(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    finally:
        C.nfc = plain


def test_bpe_ids_number_pieces_in_their_row(spark, monkeypatch):
    from textpairs.operators import bpe as B
    segments = spark.createDataFrame([("<61><62><63>", "<6162><63>"), ("<64>", "<64>"), ("<65>", "<7A7A>")], "word string, sym string")
    types = spark.createDataFrame([("<61><62><63>", 3), ("<64>", 1), ("<65>", 1)], "sym string, cnt bigint")
    vocab = spark.createDataFrame([("<63>", 9), ("<6162>", 7), ("<64>", 8)], "token string, id int")
    df = spark.createDataFrame([(1, "abc d x"), (2, "e abc"), (3, "")], "doc_id int, text string")
    monkeypatch.setattr(type(df), "groupBy", (lambda f: lambda self, *c: 1 / 0 if c == ("word",) else f(self, *c))(type(df).groupBy))
    got = {r.doc_id: r.input_ids for r in B.bpe_encode_ids(df, segments, types, vocab, 3, ["doc_id"]).collect()}
    assert got == {1: [0, 7, 9, 8, 3, 2], 2: [0, 3, 7, 9, 2], 3: [0, 2]}


def test_ngrams_are_counted_in_their_row(spark, monkeypatch):
    """Random pairs, some of which share a key or miss a side, against counts a key; one shuffle for all n."""
    from textpairs.functions import multisets
    from textpairs.operators.rouge import clipped_counts, rouge_ns
    monkeypatch.setattr(multisets, "_SLICE", 7)
    rng = random.Random(5)
    side = lambda: None if rng.random() < 0.1 else [rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 5, 40]))]
    rows = [(rng.choice([None, k, k, k, 0]), side(), side()) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, cand_tokens array<string>, ref_tokens array<string>").repartition(3)
    for ns in ((1,), (2, 1, 4)):
        got = {r["k"]: r for r in clipped_counts(df, ns, "k").collect()}
        assert set(got) == {k for k, _c, _r in rows}
        for k, n in ((k, n) for k in got for n in ns):
            mine = [[Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in r[1:]] for r in rows if r[0] == k and None not in r[1:]]
            cand, ref = (sum((m[s] for m in mine), Counter()) for s in (0, 1))
            if not any(None in r[1:] for r in rows if r[0] == k):
                assert [got[k][f"{c}{n}"] for c in ("overlap", "n_cand", "n_ref")] == [(cand & ref).total(), cand.total(), ref.total()]
    assert rouge_ns(df, (1, 2), "k")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert multisets.clipped_overlap(*(pa.array([r[s] for r in rows if None not in r[1:]], pa.list_(pa.string())) for s in (1, 2)), (2,)).to_pylist() == [
        [sum((Counter(zip(c, c[1:])) & Counter(zip(r, r[1:]))).values())] for _k, c, r in rows if None not in (c, r)]


def test_words_of_a_pair_are_scored_in_their_row(spark, monkeypatch):
    """Random pairs, some of which share a key or miss a side, with frequent, rare and unseen words, against the formula."""
    from textpairs.functions import multisets
    from textpairs.operators import scoring
    monkeypatch.setattr(multisets, "_SLICE", 9)
    monkeypatch.setattr(scoring, "HEAVY_SHARE", 0.2)
    corpus = Counter("a a a a b b b c d".split())
    lm = scoring.fit_lm(spark.createDataFrame([(" ".join(corpus.elements()),)], "text string"))
    assert sorted(r["w"] for r in lm.heavy.collect()) == ["a", "b"]
    rng = random.Random(3)
    side = lambda: None if rng.random() < 0.1 else " ".join(rng.choice("aabcde") for _ in range(rng.choice([0, 1, 3, 30])))
    rows = [(rng.choice([None, k, k, k, 0]), side(), side(), side()) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, s string, t1 string, t2 string").repartition(3)
    got = {r["k"]: r for r in scoring.lm_scores(df, lm, "k", "s", {"x": "t1", "y": "t2"}).collect()}
    assert len(got) == len({r[0] for r in rows})
    for k, r in got.items():
        source, *targets = (sum((Counter((x[i] or "").split()) for x in rows if x[0] == k), Counter()) for i in (1, 2, 3))
        longest = max(len((x[1] or "").split()) for x in rows if x[0] == k)
        for name, words in zip("xy", targets):
            assert r[f"n_{name}"] == words.total()
            want = sum(n * np.log(0.5 * (source[w] / longest if longest else 0.0) + 0.5 * (corpus[w] + 1 if w in corpus else 1) / (lm.C + lm.V + 1)) for w, n in words.items())
            assert r[f"score_{name}"] == (pytest.approx(want / words.total()) if words else None)


def test_settled_words_do_not_leave_their_row(spark, monkeypatch):
    from textpairs.operators import scoring
    lm = scoring.fit_lm(spark.createDataFrame([("a b c " * 9,)], "text string"))
    seen = []
    monkeypatch.setattr(scoring, "heavy_left_join", lambda left, *rest, f=scoring.heavy_left_join: seen.append(left) or f(left, *rest))
    df = spark.createDataFrame([(k, "a b a", "a b c") for k in range(5)], "k int, s string, t string")
    assert scoring.lm_score(df, lm, "k", "s", "t").count() == 5
    assert seen[0].count() == 5


def test_second_sentence_and_tokens_in_one_reading(spark):
    from textpairs.functions.text import has_second_sentence, lm_tokens, rouge_tokens, sentences
    rng = random.Random(8)
    texts = [None, "", " ", "a.", "a. ", "a.\n", "\n a.b", "a\n\n", "a\n \nb", "?! ?", "É-ß 9_x", "\x0b.\x0ca", "a. b"]
    texts += ["".join(rng.choice("ab.!? \n\t\réİ_9") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    replaced = lambda pat: F.filter(F.split(F.regexp_replace(F.lower("t"), pat, " "), " "), lambda x: x != "")
    for r in df.select(has_second_sentence("t").alias("two"), (F.size(sentences("t")) >= 2).alias("plain"), rouge_tokens("t").alias("a"),
                       replaced("[^a-z0-9]+").alias("a2"), lm_tokens("t").alias("l"), replaced(r"[^\p{L}\p{N}]+").alias("l2"), "t").collect():
        assert (bool(r["two"]), r["a"], r["l"]) == (bool(r["plain"]), r["a2"], r["l2"]), r["t"]


def test_prepared_pairs_shuffle_no_text(spark, monkeypatch):
    """Repeated keys go to the texts, and rows are encoded before they are ranked."""
    from textpairs.operators import pairs as P
    from textpairs.operators.vocab import build_vocab
    from textpairs.plans import prepare
    rows = [("s", "train", k, f"s:{k}", f"\x0ba{k} b\nb", "c") for k in range(9)] + [("s", "train", 3, "s:3", "d", "c"), ("s", "test", 3, "s:3", None, "c")]
    pairs = spark.createDataFrame(rows, "source string, split string, row_no long, row_key string, input_text string, target_text string")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    valid = P.split_pairs(pairs)[0]
    assert sorted(r["row_key"] for r in valid.collect()) == [f"s:{k}" for k in range(9) if k != 3]
    assert exchanges(valid) == 0
    monkeypatch.setattr(P, "FEW_KEYS", 0)  # many keys that repeat are joined
    many = P.split_pairs(pairs)[0]
    assert sorted(many.collect()) == sorted(valid.collect())
    monkeypatch.setattr(prepare, "read_sources", lambda *_: pairs)
    vocab = build_vocab(pairs, "input_text", 50, 1)
    assert {r["token"]: r["cnt"] for r in vocab.collect() if r["cnt"]} == {"b": 18, "d": 1, **{f"a{k}": 1 for k in range(9)}}
    ready = prepare.prepare_pairs(spark, [], vocab, 50)
    assert "MapInArrow" not in ready._jdf.queryExecution().executedPlan().toString()
    got = ready.collect()
    assert sorted(r["shuffle_rank"] for r in got) == list(range(1, 9))
    assert all(r["input_ids"][2:] == [next(v["id"] for v in vocab.collect() if v["token"] == w) for w in (f"a{r['row_key'][2:]}", "b", "b")] + [2] for r in got)


def test_first_sentence_of_a_long_text(spark):
    from textpairs.functions.text import has_second_sentence, lead_sentence
    df = spark.createDataFrame([("a " * 500_000,), ("b " * 500_000 + "b.\n c",)], "t string")
    got = df.select(F.length(lead_sentence("t")).alias("n"), has_second_sentence("t").alias("two")).collect()
    assert [(r["n"], r["two"]) for r in got] == [(999_999, False), (1_000_002, True)]
    plan = df.select(lead_sentence("t").alias("l"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(") + plan.count(" split(") == 1  # the text is read once


def test_words_of_a_lone_key_are_summed_where_they_find_p(spark, monkeypatch):
    from textpairs.operators import scoring
    monkeypatch.setattr(scoring, "HEAVY_SHARE", 0.5)  # no word is frequent
    lm = scoring.fit_lm(spark.createDataFrame([("a b c d " * 9,)], "text string"))
    rows = [(1, "a b b", "b c x"), (2, "d", "d d a"), (3, "a", None), (4, None, "a"), (5, "a b", "a"), (5, "c b", "b z"), (None, "a", "a")]
    scored = scoring.lm_scores(spark.createDataFrame(rows, "k int, s string, t string"), lm, "k", "s", {"t": "t"})
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan  # nothing is sorted to be looked up
    assert not re.search(r"keys=\[k#\d+, w#\d+", plan)  # a lone row's words are not shuffled by key before
    p = lambda w: (10 if w in "abcd" else 1) / (lm.C + lm.V + 1)
    want = {1: [(2 / 3, "b"), (0, "c"), (0, "x")], 2: [(1, "d"), (1, "d"), (0, "a")], 3: [], 4: [(0, "a")], 5: [(1 / 2, "a"), (1, "b"), (0, "z")], None: [(1, "a")]}
    for r in scored.collect():
        terms = [np.log(0.5 * rel + 0.5 * p(w)) for rel, w in want.pop(r["k"])]
        assert (r["score_t"], r["n_t"]) == (pytest.approx(np.mean(terms)) if terms else None, len(terms))
    assert not want


def test_bpe_slices_meet_the_words_pieces(spark, monkeypatch):
    """Random texts, repeated and null keys, unknown words and small slices against words looked up one by one; no word is a row."""
    from textpairs.operators import bpe as B
    monkeypatch.setattr(B, "_SLICE", 40)
    monkeypatch.setattr(B, "_TEXT", 60)
    monkeypatch.setattr(F, "posexplode_outer", lambda *c: 1 / 0)
    rnd = random.Random(9)
    known = {"".join(rnd.choices("abé", k=rnd.randint(1, 6))) for _ in range(60)}
    symbols = {w: [f"<{b:02X}>" for b in w.encode()] if rnd.random() < 0.5 else [f"<{w.encode().hex().upper()}>"] for w in known}
    numbers = {s: i + 10 for i, s in enumerate(sorted({s for x in symbols.values() for s in x}))}
    pool = [*known, "zz", "no"]
    texts = [None if rnd.random() < 0.1 else rnd.choice(["", " \n "]) + rnd.choice([" ", "\t\r\n"]).join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(80)]
    rows = [(k if k > 12 else rnd.choice([None, 1, 2]), "x", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, j string, text string").repartition(3)
    spelt = lambda w: "".join(f"<{b:02X}>" for b in w.encode())
    segments = spark.createDataFrame([(spelt(w), "".join(s)) for w, s in symbols.items()], "word string, sym string")
    types = spark.createDataFrame([(spelt(w), 1) for w in known], "sym string, cnt bigint")
    vocab = spark.createDataFrame(list(numbers.items()), "token string, id int")
    for most in (1, 7, 500):
        want = {}
        for key in {r[0] for r in rows}:
            words = sorted((p, symbols.get(w, ["<unk>"])) for r in rows if r[0] == key for p, w in enumerate((r[2] or "").split()[:most]))
            ids = sorted((p, [numbers.get(s, 3) for s in x]) for p, x in words)
            want[key] = ([s for _, x in words for s in x][:most], [0, *[i for _, x in ids for i in x][:most], 2])
        got = {r.k: r.bpe_tokens for r in B.bpe_encode(df, segments, types, ["k", "j"], max_tokens=most).collect()}
        assert got == {k: t for k, (t, _) in want.items()}
        coded = B.bpe_encode_ids(df, segments, types, vocab, 500, ["k", "j"], max_len=most + 2).collect()
        assert {r.k: r.input_ids for r in coded} == {k: i for k, (_, i) in want.items()} and len(coded) == len(want)
    empty = df.limit(0)
    assert B.bpe_encode(empty, segments, types, ["k"]).count() == 0
    assert {tuple(r.bpe_tokens) for r in B.bpe_encode(df.filter("k > 12"), segments.limit(0), types.limit(0), ["k"], max_tokens=2).collect()} <= {
        (), ("<unk>",), ("<unk>", "<unk>")}


def test_bpe_learning_keeps_one_table_of_types(spark, monkeypatch, tmp_path):
    from textpairs.operators import bpe as B
    monkeypatch.setattr(B, "WRITE_EVERY", 5)
    paths = []
    monkeypatch.setattr(B, "scratch_path", lambda _spark, name: paths.append(str(tmp_path / f"{name}-{len(paths)}")) or paths[-1])
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcd", k=rnd.randint(2, 7))) for _ in range(60)]
    df = spark.createDataFrame([(" ".join(rnd.choices(words, k=500)),)], "text string")
    merges, segments = B.learn_segments(B.word_types(df), 40, head_types=5)
    assert len(paths) > 3 and [p.name for p in tmp_path.iterdir()] == [paths[-1].rsplit("/", 1)[1]]
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}
    spelt = {"".join(f"<{b:02X}>" for b in w.encode()): "".join(plain_bpe(w, ranks)) for w in df.first()[0].split()}
    assert {r["word"]: r["sym"] for r in segments.collect()} == spelt


def test_funnel_leaves_no_table_and_shingles_only_of_partners(spark, monkeypatch, tmp_path):
    """The texts of no step stay written, and a shingle set is written only for a text that shares a band."""
    from textpairs.operators import clean as C
    from textpairs.operators import dedup as D
    monkeypatch.setattr(C, "scratch_path", lambda _spark, name: str(tmp_path / name))
    sets = []
    cut = D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda d: sets.append(sorted(r["id"] for r in d.select("id").collect())) or cut(d) if "sh" in d.columns else cut(d))
    rnd = random.Random(6)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(n))
    base, line = text(80), "this line stands in every text of some"
    rows = [(1, base), (2, base), (3, base + " tail"), (4, text(60)), (5, text(60)), (6, text(3)), (7, None)]
    rows += [(k, f"{line}\n{text(40)}") for k in range(10, 16)]
    got = {(r.step, r.reason): (r.rows_in, r.removed, r.rows_out) for r in C.funnel(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {("0_input", "all"): (13, 0, 13), ("1_normalise", "all"): (13, 0, 13), ("2_dedup_exact", "all"): (13, 1, 12),
                   ("3_quality", "all"): (12, 2, 10), ("4_common_lines", "all"): (10, 0, 10), ("5_dedup_near", "all"): (10, 1, 9),
                   ("3_quality", "too_few_words"): (12, 1, 11), ("3_quality", "word_length"): (12, 1, 11)}
    assert list(tmp_path.iterdir()) == [] and sets == [[1, 3]]


def test_common_lines_are_counted_by_digest(spark, monkeypatch):
    from textpairs.operators.clean import drop_common_lines
    rnd = random.Random(8)
    pool = [f"{k} is a line that may be common" for k in range(6)] + ["short", "  0 is a line that may be common\t", "", "ünïcödé line of twenty chars"]
    rows = [(k, None if k == 3 else "\n".join(rnd.choices(pool, k=rnd.randint(0, 7)))) for k in range(40)]
    held = Counter(s for _, t in rows for s in {x.strip() for x in (t or "").split("\n")} if len(s) >= 20)
    for least in (1, 14, 18):
        gone = {s for s, n in held.items() if n >= least}
        want = {k: [x for x in t.split("\n") if x.strip() not in gone] if t is not None else [] for k, t in rows}
        got = {r.doc_id: (r.text, r.lines_removed) for r in drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=least).collect()}
        assert got == {k: ("\n".join(want[k]), len((t or "").split("\n")) - len(want[k]) if t is not None else 0) for k, t in rows}
