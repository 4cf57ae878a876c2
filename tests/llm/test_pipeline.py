import hashlib
import math

import corpus_pipeline
import public_tokenizers
from test_filters import counts_by_hand
from test_simhash import brute_fingerprint, brute_groups
from tokenizers import Tokenizer

from textpairs.llm.queries import op4_toxicity


def test_run_is_the_chain_of_brute_force_stages(spark, docs, small_dir):
    """Each stage by hand on what the one before it kept; toxicity by its held-out-tested scores."""
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = {r.doc_id for r in op4_toxicity(spark, small_dir).collect() if r.predicted == 0}
    # quality: too few good labels here to prove a cutoff, so the base rule alone
    good = spark.read.parquet(f"{small_dir}/labels.parquet").filter("quality = 1").groupBy().count().first()[0]
    assert 0.99 ** good > 0.05 / 20
    counts = {i: counts_by_hand(texts[i]) for i in kept}
    kept = {i for i in kept if counts[i][0] >= 10 and 100 * counts[i][4] <= 20 * counts[i][0]}
    ids = sorted(kept)
    groups = brute_groups([brute_fingerprint(texts[i]) for i in ids], 4)
    kept = {ids[k] for k, g in enumerate(groups) if g == k}
    # benchmark: an item verbatim, or a run of 13 words of it (80 % of a short one)
    leaked = set()
    for item in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect():
        words = item.text.lower().split()
        n = min(13, math.ceil(0.8 * len(words)))
        runs = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}
        for i in kept:
            own = texts[i].lower().split()
            if any(tuple(own[k:k + n]) in runs for k in range(len(own) - n + 1)):
                leaked.add(i)
    kept -= leaked
    assert leaked and len(kept) > 100
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_padding(), tokenizer.no_truncation()
    want = {}
    for i in kept:
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, small_dir).collect()}
    assert got == want


def test_pipeline_stages(spark, docs, small_dir):
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, small_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            assert after.exceptAll(before).count() == 0  # rows are kept as they are or go
            before = after
        else:
            assert after.count() == before.count()
    assert 0 < before.count() < docs.count()


def test_pipeline_on_odd_rows(spark, odd, none, small_dir):
    for rows in (odd, none):
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, small_dir)
        assert {r.doc_id for r in now.collect()} <= {5, 6, 8, None}
