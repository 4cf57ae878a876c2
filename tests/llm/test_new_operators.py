"""Importance resampling, MinHash groups and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textpairs.llm import importance, minhash, prefix_trie
from textpairs.llm.arrow_words import slices, split_words
from textpairs.llm.queries import op11_importance, op12_minhash, op13_prefix_trie

ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- operator 11 -----------------------------------------------------------------------------------

def brute_features(text):
    words = ASCII_WORD.findall(lower_az(text))
    return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target):
    made = [(i, *brute_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in brute_features(x)[1])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)}
    rows = []
    for i, words, f in made:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in rows)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz{É-_\x00\n 7é\U0001F600", max_size=40)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_features_are_brute_force(texts):
    words = split_words(pa.array(texts, pa.string()), importance.SEPARATORS)
    values, offsets = importance.run_buckets(words, 3, 10_000)
    got = [sorted(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert got == [sorted(brute_features(t)[1]) for t in texts]


def test_crc_shift_of_long_parts():
    rnd = random.Random(1)
    heads = [rnd.randbytes(rnd.randint(0, 9)) for _ in range(60)]
    tails = [rnd.randbytes(rnd.choice([0, 1, 63, 64, 65, 1000, 70_000])) for _ in range(60)]
    head, tail = (np.array([zlib.crc32(x) for x in xs], dtype=np.uint32) for xs in (heads, tails))
    got = importance._SHIFT(head, np.array([len(x) for x in tails])) ^ tail
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails, strict=True)]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 100, 3, 3, 3)] + [None])], ["text"])
    parts = list(slices(batch, "text", 10))
    assert sum(p.num_rows for p in parts) == 7 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()


def test_op11_is_brute_force(spark, docs, small_dir):
    target = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    want = brute_resample([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], target)
    rows = op11_importance(spark, small_dir).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows)) == want


def test_draw_ranks_ties_and_repeats(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 40), 7, rnd.randint(-9, 9) * 100, rnd.random() < 0.8) for _ in range(3000)]
    rows += [(3, 7, 500, True)] * 900 + [(None, 7, 500, True)] * 5
    scored = spark.createDataFrame(rows, "id long, n_features long, score long, eligible boolean")
    for percent, bins in ((0, 8), (5, 8), (37, 3), (100, 64)):
        got = importance.ranked_draw(scored, percent, bins).collect()
        able = sorted((-s, i is None, i) for i, _, s, e in rows if e)
        able = able[:percent * len(able) // 100]
        assert len(got) == len(rows)
        ranked = sorted((r["rank"], -r.score, r.id is None, r.id) for r in got if r["rank"] is not None)
        assert ranked == [(k + 1, *key) for k, key in enumerate(able)]


def test_op11_odd_rows(odd, none):
    rows = importance.resample(odd, odd, percent=50).collect()
    assert len(rows) == odd.count()
    assert {r.weight for r in rows if r.id in (1, 2, 3)} == {0} and {r.n_features for r in rows if r.id in (1, 2, 3)} == {0}
    assert importance.resample(none, none).count() == 0
    assert importance.resample(odd, none, percent=100).filter("rank is not null").count() == 1  # only one text has 20 words


# --- operator 12 -----------------------------------------------------------------------------------

def brute_sets(rows, shingle=3):
    out = []
    for text in rows:
        words = WORD.findall(lower_az(text))
        out.append({tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    return out


def brute_groups(sets, percent=85):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_op12_is_brute_force(spark, docs, small_dir):
    rows = sorted(docs.select("doc_id", "text").collect())
    sets = brute_sets(r.text for r in rows)
    groups = brute_groups(sets)
    want = {r.doc_id: (len(sets[i]), rows[groups[i]].doc_id, groups[i] == i) for i, r in enumerate(rows)}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op12_minhash(spark, small_dir).collect()} == want


def crowd():
    """Texts that share a long passage without linking, a large family of near copies, a chain and small fry."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    passage = [word() for _ in range(60)]
    texts = [" ".join(passage + [word() for _ in range(30)]) for _ in range(150)]
    base = [word() for _ in range(100)]
    for _ in range(120):
        copy = list(base)
        copy[rnd.randrange(100)] = word()
        texts.append(" ".join(copy))
    step = [word() for _ in range(120)]
    for k in range(25):
        step[4 * k] = word()
        texts.append(" ".join(step))
    return [*texts, "a b", "A  b", "a", "", " "]


@pytest.mark.parametrize("whole", [64, 4])
def test_large_buckets_lose_no_link(spark, whole, monkeypatch):
    texts = crowd()
    want = brute_groups(brute_sets(texts))
    classes = minhash.near_duplicate_classes
    monkeypatch.setattr(minhash, "near_duplicate_classes", lambda *a: classes(*a, whole=whole))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in minhash.near_duplicate_groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_verification_is_exact(spark):
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(15, 100))), (3, list(range(16, 100)))],
                                 "set_no long, shingles array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [r.b for r in minhash._linked(pairs, sets, 85).collect()] == [2]


def test_sketches_lose_no_link(spark):
    rnd = random.Random(3)
    sets = []
    for n in (1, 2, 40, 64, 65, 120, 700):
        base = rnd.sample(range(1 << 62), n)
        sets += [base, *[sorted({*rnd.sample(base, max(1, n - k)), *rnd.sample(range(1 << 62), j)}) for k in (0, 1, n // 20, n // 7) for j in (0, 1, n // 12)]]
    odd = minhash.odd_sketches([np.array(s, dtype=np.uint64) for s in sets])
    rows = spark.createDataFrame([(i, s, o) for i, (s, o) in enumerate(zip(sets, odd.to_pylist(), strict=True))],
                                 "set_no long, shingles array<long>, odd array<long>")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    for percent in (85, 30):
        linked = {(i, j) for i, j in pairs if 100 * len({*sets[i]} & {*sets[j]}) >= percent * len({*sets[i]} | {*sets[j]})}
        got = {(r.a, r.b) for r in minhash._close(spark.createDataFrame(pairs, "a long, b long"), rows, percent).collect()}
        assert linked <= got
    assert len(linked) < len(pairs)


def test_few_sets_of_a_group_below_the_threshold_are_compared(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    base, texts = [word() for _ in range(60)], []
    for _ in range(150):
        copy = list(base)
        for at in rnd.sample(range(0, 60, 3), 3):
            copy[at] = word()
        texts.append(" ".join(copy))
    compared, linked = [], minhash._linked

    def seen(pairs, sets, percent):
        compared.append(pairs.count())
        return linked(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_linked", seen)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in minhash.near_duplicate_groups(rows).collect()}
    want = brute_groups(brute_sets(texts))
    assert [got[i] for i in range(len(texts))] == want
    assert sum(compared) < 3 * len(texts)  # of 11,175 pairs


def test_shingles_of_short_texts():
    hashes, offsets = minhash.shingle_hashes(pa.array(["a b c d a b c", "a b", "b a", "", None, "a\tB "]), 3)
    assert np.diff(offsets).tolist() == [5, 1, 1, 0, 0, 1]
    assert hashes[0] == hashes[4] and hashes[5] == hashes[7] and hashes[5] != hashes[6]
    assert not minhash.band_keys(hashes, offsets, 3, 2, 0)[3].any()


def test_op12_odd_rows(odd, none):
    rows = minhash.near_duplicate_groups(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.id, r.n_shingles, r.component_id) for r in rows if r.id in (1, 2, 3)} == {(i, 0, i) for i in (1, 2, 3)}
    assert sorted((r.component_id, r.kept) for r in rows if r.n_shingles == 7) == [(6, False), (6, True), (6, True)]
    assert minhash.near_duplicate_groups(none).count() == 0
    assert minhash.deduplicate(odd).columns == odd.columns


# --- operator 13 -----------------------------------------------------------------------------------

def brute_trie(paths):
    """Rows of the contract for {conversation: [(role, text), ...]}."""
    nodes = {}
    for i, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(i)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(i for i in members if len(paths[i]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else -1, len(members), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def plain(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


def own_turns(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0)):
        out.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    return out


def test_op13_is_brute_force(spark, small_dir):
    own = own_turns(spark.read.parquet(f"{small_dir}/conversations.parquet").collect())
    rebuilt = {}
    for i, turns in own.items():
        h = zlib.crc32(str(i).encode()) % 6
        rebuilt[i] = own.get(i - i % 100, [])[:h] + turns[h:]
    assert plain(op13_prefix_trie(spark, small_dir).collect()) == brute_trie(rebuilt)


@pytest.mark.parametrize("shard_turns,fan_in", [(8, 2), (40, 3), (100_000, 64)])
def test_shards_merge_to_one_trie(spark, shard_turns, fan_in):
    rnd = random.Random(4)
    turns, paths = [], {}
    for conv in range(1, 160):
        path = [("u", rnd.choice("ab") * rnd.randint(1, 2)) for _ in range(rnd.choice([1, 2, 3, 5, 9]))]
        paths[conv * 7] = path
        turns += [(conv * 7, d, *t) for d, t in enumerate(path)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    assert plain(prefix_trie.conversation_trie(rows, shard_turns=shard_turns, fan_in=fan_in).collect()) == brute_trie(paths)


@given(st.lists(st.lists(st.integers(0, 5), max_size=5), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_ternary_tree_has_every_prefix(sequences):
    trie = prefix_trie.TernaryTrie()
    ordered = sorted(set(map(tuple, sequences)))
    ends = {ordered[i]: trie.insert(list(ordered[i])) for i in prefix_trie.median_order(len(ordered))}
    assert len(trie.turn) == len({s[:d] for s in ordered for d in range(len(s) + 1)} | {()})
    assert all(tuple(trie.turn[v] for v in trie.path_to(end)[1:]) == s for s, end in ends.items())


def test_median_order_keeps_siblings_balanced():
    trie = prefix_trie.TernaryTrie()
    for i in prefix_trie.median_order(1023):
        trie.insert([i])
    depth = {trie.eq[0]: 1}
    for v in range(1, len(trie.turn)):
        for side in (trie.lo[v], trie.hi[v]):
            if side:
                depth[side] = depth[v] + 1
    assert max(depth.values()) == 10


def test_op13_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, depth int, node string, n int"
    rows = [(1, 1, None, "é\U0001F600", 1, "x", 2), (1, None, "u", None, 1, "x", 2), (1, 2, "u", "b", None, None, None),
            (2, 0, "u", "", 1, "x", 2), (2, 5, "", "é\U0001F600", 1, "x", 2), (3, 0, "u", "", 1, "x", 2), (3, 0, "u", "", 1, "x", 2),
            (4, 0, "u", "x" * 500_000, 1, "x", 2), (None, 0, "u", "lost", 1, "x", 2)]
    table = spark.createDataFrame(rows, schema)
    want = brute_trie({1: [("u", ""), ("", "é\U0001F600"), ("u", "b")], 2: [("u", ""), ("", "é\U0001F600")],
                       3: [("u", ""), ("u", "")], 4: [("u", "x" * 500_000)]})
    assert plain(prefix_trie.conversation_trie(table).collect()) == want
    assert prefix_trie.conversation_trie(table.limit(0)).count() == 0
    turnless = prefix_trie.conversation_trie(table, base=F.lit(99).cast("long"), shared=F.lit(3), most_shared=3)
    assert plain(turnless.collect()) == brute_trie({1: [], 2: [], 3: [], 4: []})
