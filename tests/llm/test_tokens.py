import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textpairs.llm import bpe_codec, token_files
from textpairs.llm.queries import op7_token_planes, op8_bpe, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PIECES = st.lists(st.sampled_from(["a", "aa", "é", " ", "  ", "\n", "\t", "\u00a0", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", "12", "!!",
                                   "\x1c", "\x00", "日本", "e\u0301", "The", "ΑΣ", "İ", "\r\n", "\u2003", "😀"]), max_size=25).map("".join)


def library(name):
    t = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


BYTE_LIBRARY, WORD_LIBRARY = library(BYTE), library(WORD)
BYTE_OURS, WORD_OURS = bpe_codec.ByteBPE(tokenizer_path(BYTE)), token_files.LibraryEncoder(tokenizer_path(WORD), False)


def split(ids, counts):
    return [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])]


@given(st.lists(PIECES | st.text(max_size=40).filter(lambda t: t.isprintable()), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoders_equal_the_library(texts):
    for ours, lib in ((BYTE_OURS, BYTE_LIBRARY), (WORD_OURS, WORD_LIBRARY)):
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert split(*ours.encode_many(texts)) == want
    for t in texts:
        ids = BYTE_LIBRARY.encode(t, add_special_tokens=False).ids
        assert BYTE_OURS.decode(ids) == BYTE_LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.lists(st.integers(0, 50256), max_size=30))
@settings(max_examples=200, deadline=None)
def test_decode_of_any_ids(ids):
    assert BYTE_OURS.decode(ids) == BYTE_LIBRARY.decode(ids, skip_special_tokens=False)


def test_long_runs_merge_like_the_library():
    for t in ("a" * 5000, "ab" * 3000, " " * 3000, "!" * 2001):
        assert BYTE_OURS.encode_many([t])[0].tolist() == BYTE_LIBRARY.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 10_000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = token_files.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (token_files.from_planes(planes, n) == ids).all()


def test_op7_is_the_library(spark, docs, small_dir):
    start, want = 0, {}
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = WORD_LIBRARY.encode(r.text, add_special_tokens=False).ids + [1]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op7_token_planes(spark, small_dir).collect()} == want


def test_op8_is_the_library(spark, docs, small_dir):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = BYTE_LIBRARY.encode(r.text, add_special_tokens=False).ids
        decoded = BYTE_LIBRARY.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op8_bpe(spark, small_dir).collect()} == want


@pytest.mark.parametrize("bits", [False, True])
def test_odd_rows_in_files(spark, odd, none, tmp_path, bits):
    path = str(tmp_path / "files")
    token_files.write_token_files(odd, path, tokenizer_path(WORD), end_id=1, bits=bits, chunk_ids=1000)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == odd.count()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    keys = [(-1 if r.id is None else r.id) for r in rows]
    assert keys == sorted(keys)
    assert [r.n_tokens for r in rows if r.id in (1, 2, 3)] == [1, 1, 1]
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert sum(r.n_docs for r in index) == len(rows) and len({r.start for r in index}) == len(index)
    token_files.write_token_files(none, path, tokenizer_path(WORD), end_id=1)
    assert token_files.read_token_files(spark, path).count() == 0


def test_odd_rows_round_trip(odd, none):
    path = tokenizer_path(BYTE)
    both = bpe_codec.round_trip(odd, path)
    out = bpe_codec.decode(bpe_codec.encode(odd, path), path)
    assert both.columns == out.columns and both.exceptAll(out).count() == 0
    assert out.columns == [*[c for c in odd.columns if c != "ids"], "ids", "decoded"]  # `ids` is replaced
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert bpe_codec.decode(bpe_codec.encode(none, path), path).count() == 0
