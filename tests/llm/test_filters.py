import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textpairs.llm import quality_rules, sharding, toxicity, url_filters
from textpairs.llm.queries import ORACLES, SITE_RULES, op3_jump_hash, op4_toxicity, op5_url_filters, op10_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ sharding

def jump_by_hand(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_loop():
    keys = np.random.default_rng(0).integers(0, 1 << 64, 500, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump_by_hand(int(k), n) for k in keys]


def test_op3(spark, docs, small_dir):
    rows = op3_jump_hash(spark, small_dir).toPandas()
    texts = {r.doc_id: r.text.encode() for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts) and (rows.law == "key").all()
    assert all(zlib.crc32(texts[r.doc_id]) == r.text_crc32 and len(texts[r.doc_id]) + 8 == r.size for r in rows.itertuples())
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard").slot)
    assert ((rows.grown_shard == rows.shard) | (rows.grown_shard == 24)).all()


def test_shards_of_odd_rows(spark, odd, none, tmp_path):
    narrow = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hot = spark.createDataFrame([(7, "hot")] * 9000, "doc_id long, text string")
    rows = sharding.with_slots(sharding.assign_shards(narrow.union(hot), ["doc_id"], 5), 5).toPandas()
    assert len(rows) == odd.count() + 9000
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard").slot)
    assert rows[rows.doc_id == 7].shard.nunique() == 1 and rows[rows.doc_id.isna()].shard.nunique() == 1
    assert sharding.with_slots(sharding.assign_shards(none.select("doc_id"), ["doc_id"], 5), 5).count() == 0
    path = str(tmp_path / "shards")
    sharding.write_shards(odd, path, ["doc_id"], 5, files_per_shard=2)
    assert spark.read.parquet(path).count() == odd.count()


# ------------------------------------------------------------------ URL filters

URLS = ["http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/x?q=1", "https://example.net/de/", "https://x.example.com/de/1",
        "https://notexample.com/de/1", "https://example.com/den", "https://a.org/fr/", "https://a.org/fra", "https://casino-win.example.com/en/",
        "https://x.org/ads/policy", "https://x.org/ads/1", "https://x.org/loads/1", "no scheme.net/", "", None, "://net/", "a://b://c/d",
        "https://x.org/?click_id=12&z", "http://net/#x", "http://\x00é.org/fr/ü"]


def test_url_filters_by_brute_force(spark):
    rows = spark.createDataFrame([(i, u, "clash", "y") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string, rule_verdict string")
    out = url_filters.judge_urls(rows, SITE_RULES).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url or "", re.S)
        host = re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)) if m else ""
        path = m.group(2) if m else ""
        fits = [s for s in SITE_RULES if (host == s.host or host.endswith("." + s.host)) and path.startswith(s.path)]
        best = max(fits, key=lambda s: len(s.host + s.path), default=None)
        hits = {p.verdict for p in url_filters.DEFAULT_PATTERNS if m and re.search(url_filters.pattern_regex(p.pattern), r.url.lower())}
        verdict = best.verdict if best else "allow" if "allow" in hits or not hits else "block"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.host + best.path, verdict), r.url
    assert url_filters.judge_urls(rows.limit(0), SITE_RULES).count() == 0


def test_patterns_need_a_whole_token(spark):
    assert url_filters.whole_tokens("||casino-win.") == ["casino", "win"]
    assert url_filters.whole_tokens("/ads*/x") == []
    with pytest.raises(ValueError):
        url_filters.pattern_index(spark.createDataFrame([("a", 1)], "token string, n long"), [url_filters.PatternRule("block", "ads*")])


def test_rules_are_indexed_by_their_rarest_token(spark):
    tokens = spark.createDataFrame([("casino", 5), ("win", 2), ("other", 1)], "token string, n long")
    index = url_filters.pattern_index(tokens, [url_filters.PatternRule("block", "||casino-win.")]).collect()
    assert [r.token for r in index] == ["win"]


def test_op5_oracle(spark, small_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{small_dir}/pages.parquet')")
    got, want = op5_url_filters(spark, small_dir).toPandas(), con.sql(ORACLES["op5_url_filters"]).df()
    for df in (got, want):
        df.sort_values("page_id", inplace=True, ignore_index=True)
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None), want[got.columns].astype(object).where(want.notna(), None), check_dtype=False)


# ------------------------------------------------------------------ quality rules

def counts_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k:k + 5])].append(k)
    covered = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_op10_metrics(spark, docs, small_dir):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = op10_quality_rules(spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_hand(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_odd_metrics(odd, none, labels):
    measured = quality_rules.measure(odd)
    for r in measured.join(odd.select(F.col("doc_id").alias("id"), "text").distinct(), "id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_hand(r.text)
    kept = quality_rules.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} <= {5, 6, 8, None}
    assert quality_rules.keep_good(none, labels).count() == 0
    assert quality_rules.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.2), (0, 5000, 0.01), (20, 4000, 0.01), (900, 100_000, 0.01), (30, 100, 0.2), (17, 21, 0.9)]
    rows = spark.createDataFrame(cases, "k long, n long, p double")
    for r in rows.select("*", quality_rules.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("tail")).collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(r.p) + (r.n - i) * math.log1p(-r.p)
                for i in range(r.k + 1)]
        want = sum(map(math.exp, logs)) if r.k < r.n * r.p else 1.0
        assert math.isclose(r.tail, want, rel_tol=1e-7)


def test_thresholds_bound_false_rejection(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v), 0.0, 0.0, 0.0, 0.0) for v in np.where(rng.random(4000) < 0.002, 0.5, 0.01)] + [("b", 0.0, 0.0, 0.0, 0.0, 0.0)] * 20
    cuts = {r.stratum: r for r in quality_rules.thresholds(spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} double" for r in quality_rules.RULES))).collect()}
    assert "b" not in cuts  # twenty good documents prove nothing
    assert cuts["a"].cut_symbols == 0.01  # 0.2 % lost is within 1 % of that rule; values at the cutoff are kept
    assert cuts["a"].cut_capitals == 0.01


def test_kept_is_the_brute_force_verdict_where_cutoffs_bind(spark):
    """Two strata with enough good labels, copies among them, and one without: cutoffs and verdicts by hand."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]

    def text(marks):
        body = list(rng.choice(words, 30))
        for k in rng.choice(30, marks, replace=False):
            body[k] += "#!"
        return " ".join(body)

    rows, good = [], []
    for lang, n in (("en", 1500), ("de", 900), ("fr", 60)):
        for _ in range(n):
            rows.append((len(rows), text(int(rng.choice([0, 0, 0, 0, 1, 6]) if rng.random() < 0.02 else 0)), lang))
            good.append(rows[-1][0])
        for _ in range(100):
            rows.append((len(rows), text(int(rng.integers(0, 12))), lang))
    copy = next(r for r in rows if "#" in r[1])
    for _ in range(200):  # copies of one text are one trial
        rows.append((len(rows), copy[1], "en"))
        good.append(rows[-1][0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    ratios = {r.id: r for r in quality_rules.measure(docs).collect()}
    trials = {}
    for i, t, lang in rows:
        if i in set(good):
            trials.setdefault(lang, {})[t] = ratios[i]
    tests = len(trials) * len(quality_rules.RULES)
    alpha, cuts = 0.05 / len(quality_rules.RULES), {}
    for lang, of in trials.items():
        for rule in quality_rules.RULES:
            for cutoff in quality_rules.GRID:
                k, n = sum(r[rule] > cutoff for r in of.values()), len(of)
                p = 1.0 if k >= n * alpha else sum(math.comb(n, i) * alpha ** i * (1 - alpha) ** (n - i) for i in range(k + 1))
                if p > 0.05 / tests:
                    break
                cuts[lang, rule] = cutoff
    assert {lang for lang, _ in cuts} == {"en", "de"}
    want = {i for i, t, lang in rows if all(ratios[i][rule] <= cuts.get((lang, rule), 1e9) for rule in quality_rules.RULES)
            and counts_by_hand(t)[0] >= 10 and 100 * counts_by_hand(t)[4] <= 20 * counts_by_hand(t)[0]}
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert kept == want and 0 < len(want) < len(rows)
    measured = quality_rules.measure(docs)
    judged = quality_rules.verdict(measured, quality_rules.thresholds(quality_rules.good_documents(measured, labels)))
    assert {r.id for r in judged.filter("kept").collect()} == want


# ------------------------------------------------------------------ toxicity

def test_op4_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op4_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert ((held.toxic == 0) & (held.predicted == 1)).sum() <= 10
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_toxicity_of_odd_rows(spark, odd, none, labels):
    model = toxicity.fit(odd, labels)
    scores = [r.s for r in odd.select(toxicity.score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.remove_toxic(none, labels.limit(0)).count() == 0
    given = toxicity.fit(odd, labels.limit(0))
    assert given.score("you stupid idiot, you pathetic moron") > 0.5 > given.score("a quiet morning by the river")


def test_sample_holds_one_row_an_id(spark):
    rows = [(1, "you stupid idiot " + str(k), "en") for k in range(50)] + [(k, f"a calm text number {k} by the river", "en") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 60)], "doc_id long, toxic int")
    first, second = (toxicity.fit(docs.repartition(n), labels) for n in (2, 5))
    for text in ("you stupid idiot", "a calm text by the river"):
        assert first.score(text) == second.score(text)  # which row of the repeated id is taken does not depend on the order


def test_label_model_weighs_correlated_voters_once():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(int)
    one = (rng.random(4000) < np.where(y == 1, 0.8, 0.1)).astype(float)
    other = (rng.random(4000) < np.where(y == 1, 0.7, 0.05)).astype(float)
    votes = np.column_stack([one, one, one, other, ((one + other) == 0)])
    q, accuracy, shares = toxicity.label_model(votes, y)
    assert shares[0, 1] > 0.99 and abs(shares[0, 3]) < 0.2
    assert abs(accuracy[1, 0] - 0.8) < 0.1 and ((q > 0.5) == (y == 1)).mean() > 0.95
