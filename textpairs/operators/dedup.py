"""Near-duplicate removal (C3): word shingles, MinHash signatures, banded LSH,
verified Jaccard, connected components.

Signatures are computed in-row by Arrow functions on some 250,000 shingles at a time (no explode, no
shuffle); a document leaves its bands and a key of its shingle set, and its shingles are made again
if another shares a band. Documents with equal shingle sets are one class, so exact copies never
meet as pairs. Documents that share a band with another are candidates. They meet in
a prefix-filtered inverted index of their rarest shingles (an exact Jaccard join),
so members of a bucket that share one passage but do not reach the threshold are
not compared. Pairs in a posting are compared in rounds: round r elects about
4^r members by hash, each is compared (exact shingle Jaccard) with the
members that are not yet in its component, and components are
merged. Members that a round has joined need no comparison any more, so a large
group of near copies costs about one comparison per member instead of all
pairs, and no link between two components is ever left out: a posting is done
only when all its members were elected or stand in one component. Components
come from large-star / small-star rounds until nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from textpairs.functions.md5 import prefixed_md5
from textpairs.functions.text import ngrams, words
from textpairs.operators.joins import frequent, heavy_left_join
from textpairs.session import broadcast_bounded, cut_lineage

# fixed values: 3-word shingles, 32 hashes in 8 bands of 4, Jaccard >= 0.7
SHINGLE = 3
N_HASHES = 32
N_BANDS = 8
THRESHOLD = 0.7

#: Shingles that hold at least this share of all shared ones are looked up in a broadcast table.
HEAVY_SHARE = 1e-5


def with_shingles(df: DataFrame, col: str, out: str = "sh", k: int = SHINGLE) -> DataFrame:
    """Distinct k-word shingles of the lower-cased text; a text of fewer than k
    words is one shingle (the whole text). The word array is a column of its
    own first, so the n-gram lambda reads it instead of re-splitting the text."""
    df = df.withColumn("_w", words(F.lower(F.col(col))))
    w = F.col("_w")
    return df.withColumn(out, F.when(F.size(w) >= F.lit(k), F.array_distinct(ngrams(w, k)))
                         .otherwise(F.array(F.array_join(w, " ")))).drop("_w")


#: Shingles (hashes) that a task works on together.
_BLOCK = 1 << 18


def _minima(df: DataFrame, sh: str, n_hashes: int, hashes: Callable[[pa.Array], Iterator[np.ndarray]], kind: str,
            shown: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """``df`` without ``sh`` and with ``mins``: for every hash function its minimum over the row's
    values, null for a row without any. ``hashes`` gives the functions' values of a flat array a few at a time, as (values x functions);
    rows are taken some 250,000 values at a time."""
    kept = [c for c in df.columns if c != sh]
    rows = df.select(*kept, sh)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(sh)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // _BLOCK, prepend=-1))  # a first row always begins a block
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                flat, n = lists.slice(a, b - a).flatten(), size[a:b]
                if flat.null_count:  # a null text's one shingle
                    n = np.bincount(np.repeat(np.arange(len(n)), n)[pc.is_valid(flat).to_numpy(zero_copy_only=False)], minlength=len(n))
                    flat = flat.drop_null()
                some = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[some]
                mins = [np.minimum.reduceat(h, starts, axis=0) for h in hashes(flat)] if len(some) else []
                table = np.concatenate(mins, axis=1) if mins else np.zeros((0, n_hashes), dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, n_hashes, 0))]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), shown(table.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in kept], found], [*kept, "mins"])

    return rows.mapInArrow(least, StructType([*[rows.schema[c] for c in kept], StructField("mins", ArrayType(kind))]))


def minhash_md5(df: DataFrame, sh: str = "sh", n_hashes: int = N_HASHES) -> DataFrame:
    """Repeatable signature ``mins``: hash j is the minimum over shingles of the
    (j mod 4)-th 8-hex-digit slice of md5(j div 4 | shingle). Fixed-width hex
    compares like the number, so the minimum is taken on numbers."""
    def hashes(flat: pa.Array) -> Iterator[np.ndarray]:
        strings = pa.array(flat.cast(pa.large_binary()))
        ends = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset:strings.offset + len(strings) + 1]
        data = np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
        prefixes = [f"{g}|".encode() for g in range((n_hashes + 3) // 4)]
        for _, alike in groupby(enumerate(prefixes), lambda x: len(x[1])):  # padded once for prefixes of one length
            numbers, some = zip(*alike, strict=True)
            for g, found in zip(numbers, prefixed_md5(data, np.diff(ends), list(some)), strict=True):
                yield found[:, :n_hashes - 4 * g].astype(np.int64)

    return _minima(df, sh, n_hashes, hashes, StringType(), lambda m: pa.array([f"{x:08x}" for x in m.tolist()], pa.string()))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)  # fixed values: XXH64's finaliser
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def xxhash64_of(seeds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``xxhash64(seed, value)`` of Spark for every int seed and long value (values x seeds)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values: XXH64's primes
    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(4) ^ (seeds.astype(np.uint64) * p1)
        start = _mixed(_rotated(h, 23) * p2 + p3)
        word = _rotated(values.astype(np.int64).view(np.uint64) * p2, 31) * p1
        return _mixed(_rotated((start + p5 + np.uint64(8))[None, :] ^ word[:, None], 27) * p1 + p4).view(np.int64)


def minhash_xx(df: DataFrame, sh: str = "sh", n_hashes: int = N_HASHES) -> DataFrame:
    """Production signature ``mins`` of sets of longs: hash i is the minimum of xxhash64(i, value)."""

    def hashes(flat: pa.Array) -> Iterator[np.ndarray]:
        values = flat.to_numpy(zero_copy_only=False)
        for g in range(0, n_hashes, 4):
            yield xxhash64_of(np.arange(g, min(g + 4, n_hashes)), values)

    return _minima(df, sh, n_hashes, hashes, LongType(), lambda m: pa.array(m, pa.int64()))


def band_keys(df: DataFrame, col: str = "text", id_col: str = "doc_id", hash_kind: str = "md5",
              n_hashes: int = N_HASHES, n_bands: int = N_BANDS) -> DataFrame:
    """One row per (document, band) with the band's key."""
    base = with_shingles(df.select(id_col, col), col).select(id_col, "sh")
    if hash_kind != "md5":
        base = base.withColumn("sh", F.transform("sh", lambda s: F.xxhash64(s)))
    sig = (minhash_md5 if hash_kind == "md5" else minhash_xx)(base, "sh", n_hashes)
    return sig.select(id_col, F.explode(_bands(n_hashes, n_bands)).alias("b")).select(
        id_col, F.col("b.band").cast("bigint").alias("band"), F.col("b.band_key").alias("band_key"))


def _bands(n_hashes: int = N_HASHES, n_bands: int = N_BANDS) -> Column:
    """(band, key) of every band of a signature ``mins``."""
    r = n_hashes // n_bands
    return F.array(*[F.struct(F.lit(b).alias("band"), F.concat_ws("-", F.slice(F.col("mins").cast("array<string>"), b * r + 1, r)).alias("band_key"))
                     for b in range(n_bands)])


def _jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the undirected edges ``(src, dst)``: label is the smallest
    node of the component. Large-star and small-star rounds, without a limit,
    until the edge table no longer changes."""
    now = cut_lineage(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                      .distinct())
    state = None
    while True:
        found = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if found == state or found[0] == 0:
            break
        state = found
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        first = large.groupBy("src").agg(F.min("dst").alias("m"))
        rest = large.join(first, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        rest = rest.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        now = cut_lineage(rest.union(first.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct())
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(roots)


def _shingled(df: DataFrame, col: str) -> DataFrame:
    """(id, words, sh, k) of (id, ``col``): the shingles, their sorted hashes and the key of these."""
    hashes = F.array_sort(F.array_distinct(F.transform("words", lambda s: F.xxhash64(s))))
    return (with_shingles(df, col, "words").select("id", "words", hashes.alias("sh"))
            .withColumn("k", F.struct(F.xxhash64("sh").alias("a"), F.xxhash64(F.lit("again"), "sh").alias("b"))))


def _signed(df: DataFrame, col: str, hash_kind: str) -> DataFrame:
    """(id, k, buckets): a text's key by its shingle set and the bucket of each of its bands. No shingle leaves its row."""
    rows = _shingled(df, col)
    if hash_kind == "md5":
        sig = minhash_md5(rows.select("id", "k", "words"), "words")
        buckets = F.transform(_bands(), lambda b: F.xxhash64(b["band"].cast("bigint"), b["band_key"]))
    else:
        sig = minhash_xx(rows.select("id", "k", "sh"), "sh")
        r = N_HASHES // N_BANDS
        least = [F.col("mins")[j].cast("string") for j in range(N_HASHES)]
        buckets = F.array(*[F.xxhash64(F.lit(b), *least[b * r:(b + 1) * r]) for b in range(N_BANDS)])
    return sig.select("id", "k", buckets.alias("buckets"))


def prefix_index(sets: DataFrame, threshold: float) -> DataFrame:
    """(shingle, id, n, pos, indexed): the shingles under which a set (id, sh) can meet a similar one.

    A set's shingles are ordered by the number of sets that hold them, then by hash. Sets of n and
    m >= n shingles that reach the threshold t share one of the first ``m - ceil(t m) + 1`` of the
    larger and of the first ``n - ceil(2 t / (1 + t) n) + 1`` of the smaller (``indexed``). Shingles of one set only
    come first in that order and meet nothing, so they take their places (``pos``) and make no row."""
    ex = sets.select("id", F.size("sh").alias("n"), F.explode("sh").alias("shingle"))
    held = cut_lineage(ex.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    shared = heavy_left_join(ex, held, "shingle", frequent(held, "held", HEAVY_SHARE), int(1 / HEAVY_SHARE), F.col("id"))
    own = (shared.filter("held is not null").groupBy("id", "n")
           .agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("s"))
           .withColumn("before", F.col("n") - F.size("s")))
    n = F.col("n").cast("double")
    # (a hair below the product: rounding must not shorten a prefix)
    probe = F.col("n") - F.ceil(n * threshold - 1e-9) + 1
    index = F.col("n") - F.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9) + 1
    first = F.slice("s", F.lit(1), F.greatest(probe - F.col("before"), F.lit(0)).cast("int"))
    return (own.select("id", "n", "before", index.alias("last"), F.posexplode(first).alias("at", "x"))
            .select(F.col("x.shingle").alias("shingle"), "id", "n", (F.col("before") + F.col("at") + 1).alias("pos"), "last")
            .withColumn("indexed", F.col("pos") <= F.col("last")).drop("last"))


def verified_components(members: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """(node, label) over all pairs that share a bucket and reach the Jaccard threshold.

    ``members``: (bucket, id); ``sets``: (id, sh), or what adds ``sh`` to the (id, buckets) that it is given.
    Sets without a partner in any bucket go first. The others
    meet on the shingles of ``prefix_index``, so members of a bucket that cannot reach the threshold
    never meet; pairs that do are kept by length, position and a common bucket before their
    sets are fetched. See the module's docstring for the rounds."""
    # the members' buckets are compared as arrays, so each id's are collected: at most one a band
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = cut_lineage(members.join(shared, "bucket").groupBy("id").agg(F.collect_set("bucket").alias("buckets")))
    nobody = buckets.select(F.col("id").alias("node")).limit(0).withColumn("label", F.col("node"))
    full = cut_lineage(sets(buckets) if callable(sets) else sets.join(buckets, "id"))
    index = prefix_index(full, threshold)
    sizes = (index.groupBy("shingle").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("indexed").cast("int")).alias("firsts"))
             .filter("all > 1 and firsts > 0").select("shingle", "firsts"))
    # an id's draw in (0, 1]: round r elects those with draw * firsts <= 4^r, the same ids in all their postings
    draw = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double") + 1) / float(1 << 30)
    open_ = cut_lineage(index.join(sizes, "shingle").withColumn("turn", draw * F.col("firsts")).drop("firsts"))
    labels, turn = nobody, 1.0
    while True:
        now = open_.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
        # postings of one component only are done
        split = now.groupBy("shingle").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("shingle")
        now = cut_lineage(now.join(split, "shingle", "left_semi"))
        if now.isEmpty():
            break
        elected = now.filter(F.col("indexed") & (F.col("turn") <= turn) & (F.col("turn") > (turn / 4 if turn > 1 else 0)))
        a = elected.select("shingle", F.col("id").alias("src"), F.col("n").alias("sn"), F.col("pos").alias("sp"), F.col("comp").alias("sc"))
        b = now.select("shingle", F.col("id").alias("dst"), F.col("n").alias("dn"), F.col("pos").alias("dp"), F.col("comp").alias("dc"))
        larger = (F.col("dn") > F.col("sn")) | ((F.col("dn") == F.col("sn")) & (F.col("src") != F.col("dst")))
        fits = F.col("sn") >= F.col("dn") * threshold - 1e-9
        left = F.least(F.col("sn") - F.col("sp"), F.col("dn") - F.col("dp")) + 1  # at most so many in common from here on
        enough = left >= (F.col("sn") + F.col("dn")) * (threshold / (1 + threshold)) - 1e-9
        pairs = a.join(b, "shingle").filter((F.col("sc") != F.col("dc")) & larger & fits & enough).select("src", "dst").distinct()
        near = (pairs.join(full.select(F.col("id").alias("src"), F.col("sh").alias("sa"), F.col("buckets").alias("ba")), "src")
                .join(full.select(F.col("id").alias("dst"), F.col("sh").alias("sb"), F.col("buckets").alias("bb")), "dst")
                .filter(F.arrays_overlap("ba", "bb") & (_jaccard(F.col("sa"), F.col("sb")) >= F.lit(threshold))).select("src", "dst"))
        edges = near.union(labels.select(F.col("node").alias("src"), F.col("label").alias("dst")))
        labels = cut_lineage(components(edges))
        open_ = now.drop("comp")
        if now.filter(F.col("indexed") & (F.col("turn") > turn)).isEmpty():
            break
        turn *= 4
    return labels


def dedup_near(df: DataFrame, col: str = "text", id_col: str = "doc_id", hash_kind: str = "xxhash64",
               threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its component (lowest id of its near-duplicate
    group) and ``keep`` (true for the lowest id of each group)."""
    texts = df.select(F.col(id_col).alias("id"), F.col(col))
    signed = cut_lineage(_signed(texts, col, hash_kind))
    docs = signed.join(signed.groupBy("k").agg(F.min("id").alias("class")), "k")  # the smallest id with the same shingle set
    first = docs.filter("id = class").select("id", "k").distinct()
    own = signed.join(first.select("id").distinct(), "id", "left_semi") if hash_kind == "md5" else docs.filter("id = class")
    members = own.select(F.explode("buckets").alias("bucket"), "id").distinct()

    def sets(buckets: DataFrame) -> DataFrame:
        """Shingles are made anew for texts with a partner; their ids go to the texts if they are few."""
        some = texts.join(broadcast_bounded(buckets.select("id"), buckets.count()), "id", "left_semi")
        return _shingled(some, col).select("id", "k", "sh").join(buckets.join(first, "id"), ["id", "k"]).select("id", "sh", "buckets")

    labels = verified_components(members, sets, threshold)
    comp = (docs.select("id", "class").join(labels.withColumnRenamed("node", "class"), "class", "left")
            .withColumn("component", F.coalesce("label", "class")))
    return comp.select(F.col("id").alias(id_col), "component", (F.col("component") == F.col("id")).alias("keep"))
