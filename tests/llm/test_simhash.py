import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from textpairs.llm import simhash
from textpairs.llm.components import connected_components
from textpairs.llm.queries import op1_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, shingle=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fingerprints, max_bits):
    """{position: smallest position reachable}, all pairs."""
    root = list(range(len(fingerprints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(root)):
        for j in range(i):
            if bin(fingerprints[i] ^ fingerprints[j]).count("1") <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(root))]


@given(st.text(alphabet="aB é\n\t.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_brute_force(text):
    assert simhash.majority_bits(simhash.shingle_hashes(text, 4)) % (1 << 64) == brute_fingerprint(text)


def test_majority_over_many_chunks():
    h = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)
    expected = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.majority_bits(h) % (1 << 64) == expected


def test_segments_cover_all_bits():
    for d in range(0, 9):
        masks = simhash.segment_masks(d)
        assert sum(masks) == (1 << 64) - 1 and len(masks) == d // 2 + 1


def test_links_are_all_pairs(spark):
    rnd = random.Random(3)
    values = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(12):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
            values.add(x - (1 << 64) if x >> 63 else x)
    values |= {0, -1, 1, -2}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for d in (0, 3, 4, 5):
        got = {(r.src, r.dst) for r in simhash.links(fps, d).collect()}
        want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) % (1 << 64)).count("1") <= d}
        assert got == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1060)] + [(1050, 1050), (1000, 1001)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + star, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1000 for i in range(1000, 1060)}}


def test_query_is_brute_force(spark, docs, small_dir):
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in rows]
    groups = brute_groups(fps, 4)
    want = {r.doc_id: (f"{fps[i]:016x}", rows[groups[i]].doc_id) for i, r in enumerate(rows)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, small_dir).collect()}
    assert got == want


def test_odd_rows(odd, none):
    rows = simhash.near_duplicate_groups(odd).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if r.id in (1, 2, 3)]
    assert {r.fp for r in blank} == {0} and {r.component_id for r in blank} == {1}
    assert [r.component_id for r in rows if r.id is None].count(6) == 1  # the copy without an id joins group 6
    assert simhash.near_duplicate_groups(none).count() == 0


def test_deduplicate_keeps_the_smallest_id(odd, none, docs):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 8]
    assert simhash.deduplicate(none).count() == 0
    groups = simhash.near_duplicate_groups(docs)
    want = {r.component_id for r in groups.collect()}
    assert {r.doc_id for r in simhash.deduplicate(docs).select("doc_id").collect()} == want
