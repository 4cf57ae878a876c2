"""MinHash near-dedup with tensored banding (operator 12).

Documents link when the Jaccard similarity of their sets of distinct word
shingles reaches a threshold; a group is a connected component of links.

Instead of one family of minhashes for each table, two small collections of
``groups`` keys each are made, a key being ``rows`` minhashes. A table belongs
to every pair of a key of the first and a key of the second collection: groups
squared tables for 2 x groups x rows minhashes, where plain banding would
compute groups squared x 2 x rows. Two documents meet when they agree on a key of the
first *and* on a key of the second collection: 1 - 2 (1 - s^rows)^groups of the
pairs of similarity s, which misses about two pairs in a hundred thousand at
0.85 with the default 9 groups of 2 rows, and far fewer above.

1. Texts are read once; equal sets are one row from there on (their members are
   counted and grouped by a 128-bit digest of the set).
2. Only keys that another set shares can form a table key, so keys met once go
   before the pairs of keys are formed.
3. ``_resolve`` verifies candidates on full sets: first each member with one head of its
   buckets, then in rounds that elect members outside the bucket's largest component, ``elect`` times more in every round, compared with
   members of other components. It ends when every bucket
   is of one component or all those members were elected, so no pair is capped and a group of near copies costs about one
   comparison a member.
4. Before sets are fetched or compared, a pair must pass its sketches: parities of the shingle
   hashes that fall on each of about as many cells as the set has shingles (odd sketches). Cells that differ are never more than
   the shingles that only one of the two sets has, so the test loses no link, and what it lets pass is mostly linked.
5. A large bucket of members that did not link (documents that only share a passage)
   is not compared pair by pair: its members get further, longer keys from a
   third collection, which separate them, and only members that meet again are
   candidates.

Members and counts are shuffle joins and map-side combined aggregates. The set
of an elected member goes to as many pieces as its bucket has, by a salt.

Defined results: a null text, an empty text or one of blanks has an empty set
(n_shingles 0) and links with nothing, itself its component; fewer words than
a shingle make one shingle; null or repeated ids stay rows of their own (the
component is the smallest non-null id, null when there is none; an empty set's
is its own id); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.arrow_words import slices, split_words
from textpairs.llm.components import connected_components, forget
from textpairs.session import cut_lineage, scratch_path

BLANKS = r"[\x20\x09-\x0D]+"
_ODD = np.random.default_rng(20_11).integers(0, 1 << 63, (3, 1 << 10), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers
_SALTS = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed values: a published 64-bit finaliser
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every shingle, offsets of the texts), repeats included.

    Distinct words are hashed once; a shingle's hash mixes those of its words."""
    words = split_words(texts, BLANKS)
    plain = words.dictionary.cast(pa.binary()).to_pylist()
    word_hash = np.fromiter(map(xxhash.xxh64_intdigest, plain), dtype=np.uint64, count=len(plain))
    n = words.counts()
    per_text = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
    out = np.zeros(offsets[-1], dtype=np.uint64)
    owner = words.owners()
    rank = np.arange(len(words.ids)) - words.starts[:-1].repeat(n)
    hashes = word_hash[words.ids] if len(plain) else np.zeros(0, np.uint64)
    whole = words.runs(shingle)
    h = np.full(len(whole), shingle, dtype=np.uint64)
    for k in range(shingle):
        h = _mixed(h * _STEP + hashes[whole + k])
    out[offsets[owner[whole]] + rank[whole]] = h
    for d in np.flatnonzero((n > 0) & (n < shingle)):  # fewer words than a shingle
        short = np.uint64(n[d])
        for x in hashes[words.starts[d]:words.starts[d + 1]]:
            short = _mixed(np.array([short]) * _STEP + x)[0]
        out[offsets[d]] = short
    return out, offsets


def band_keys(hashes: np.ndarray, offsets: np.ndarray, groups: int, rows: int, family: int) -> np.ndarray:
    """Keys (texts x groups) of ``rows`` minhashes each; texts without shingles get zeros."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, groups), dtype=np.uint64)
    if not len(some):
        return out.view(np.int64)
    starts, mixed = offsets[:-1][some], _mixed(hashes)
    for g in range(groups):
        key = np.full(len(some), (family << 32) + g, dtype=np.uint64)
        for r in range(rows):
            t = g * rows + r
            low = np.minimum.reduceat(mixed * _ODD[family, t] + _ODD[family, ~t], starts)
            key = _mixed(key * _FOLD + low)
        out[some, g] = key
    return out.view(np.int64)


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]


def odd_sketches(sets: list[np.ndarray]) -> pa.ListArray:
    """For every set, parities of the hashes on its cells as 64-bit words: the least power of two cells that is as large as the set."""
    words = []
    for s in sets:
        cells = max(64, 1 << max(len(s) - 1, 0).bit_length())
        odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
        words.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, shingle: int, groups: int, rows: int) -> DataFrame:
    """(id, text_hash, set_id, n, first, second): digest and size of a row's set, its keys of two collections."""
    id_type = docs.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = shingle_hashes(part.column("text"), shingle)
                sets = _distinct(hashes, offsets)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys = [pa.FixedSizeListArray.from_arrays(pa.array(band_keys(hashes, offsets, groups, rows, f).ravel()), groups)
                        .cast(pa.list_(pa.int64())) for f in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_hash"), pa.array(digests, pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), *keys],
                    ["id", "text_hash", "set_id", "n", "first", "second"])

    return docs.mapInArrow(sketch, f"id {id_type}, text_hash long, set_id binary, n long, first array<long>, second array<long>")


def full_sets(docs: DataFrame, shingle: int, groups: int, rows: int) -> DataFrame:
    """(set_id, shingles, longer, odd): whole sets of texts, ``groups`` further keys of ``rows`` minhashes, and the odd sketch."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = shingle_hashes(part.column("text"), shingle)
                sets = _distinct(hashes, offsets)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                longer = pa.FixedSizeListArray.from_arrays(
                    pa.array(band_keys(hashes, offsets, groups, rows, 2).ravel()), groups).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), longer, odd_sketches(sets)], ["set_id", "shingles", "longer", "odd"])

    return docs.mapInArrow(sets_of, "set_id binary, shingles array<long>, longer array<long>, odd array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of distinct sets whose similarity is ``percent`` hundredths or more.

    ``a`` may stand in very many pairs: its set is sent to one piece per salt."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)))
    wanted = salted.select("a", "salt").distinct()
    of_a = wanted.join(sets.select(F.col("set_no").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = (salted.join(sets.select(F.col("set_no").alias("b"), F.col("shingles").alias("set_b")), "b")
            .join(of_a, ["a", "salt"]))
    # 100 c >= percent (|a| + |b| - c) for c common shingles
    total = (F.size("set_a") + F.size("set_b")).cast("long")
    return both.filter(F.size(F.array_intersect("set_a", "set_b")).cast("long") * (100 + percent) >= total * percent).select("a", "b")


def _alike_in_size(percent: int, n: str, m: str) -> Column:
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _may_link(percent: int, n: str, odd: str, m: str, other: str) -> Column:
    """Whether sets of ``n`` and ``m`` shingles may have that similarity, by their odd sketches; false only if they have not.

    The cells of a sketch twice as long as the other are added up, so that both have the same ones."""
    least = F.least(F.size(odd), F.size(other))
    xor = lambda x, y: x.bitwiseXOR(y)

    def halved(c: str) -> Column:
        return F.when(F.size(c) > least, F.zip_with(F.slice(c, F.lit(1), least), F.slice(c, least + 1, least), xor)).otherwise(F.col(c))

    apart = F.aggregate(F.zip_with(halved(odd), halved(other), xor), F.lit(0), lambda k, x: k + F.bit_count(x).cast("int"))
    alike = apart.cast("long") * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent)
    return F.when(F.greatest(F.size(odd), F.size(other)) <= 2 * least, alike).otherwise(F.lit(True))


def _sketched(sets: DataFrame, c: str) -> DataFrame:
    return sets.select(F.col("set_no").alias(c), F.size("shingles").cast("long").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches let pass."""
    return (pairs.join(_sketched(sets, "a"), "a").join(_sketched(sets, "b"), "b")
            .filter(_may_link(percent, "n_a", "odd_a", "n_b", "odd_b")).select("a", "b"))


def _roots_of(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of sets in different components, with these (ra, rb)."""
    ra, rb = (comp.select(F.col("set_no").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return pairs.join(ra, "a").join(rb, "b").filter("ra <> rb")


def _merged(comp: DataFrame, found: DataFrame) -> DataFrame:
    """``comp`` (set_no, root) after the links ``found`` (a, b): components of the roots they connect."""
    links = _roots_of(found, comp).select(F.col("ra").alias("src"), F.col("rb").alias("dst"))
    moved = connected_components(links, tidy=True).select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = cut_lineage(comp.join(moved, "root", "left").select("set_no", F.coalesce("to", "root").alias("root")))
    forget(comp.sparkSession)
    return out


def _unresolved(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their ``root``, the bucket's ``size``
    and whether each is an ``outsider``: not of the bucket's largest component."""
    placed = members.join(comp, "set_no")
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("of_root"))
    buckets = (parts.groupBy("bucket").agg(F.sum("of_root").alias("size"), F.count("*").alias("roots"), F.max("of_root").alias("most"),
                                           F.max_by("root", F.struct("of_root", "root")).alias("largest")).filter("roots > 1"))
    return (placed.join(buckets, "bucket").withColumn("outsiders", F.col("size") - F.col("most"))
            .withColumn("outsider", F.col("root") != F.col("largest")).drop("roots", "most", "largest"))


def _resolve(members: DataFrame, sets: DataFrame, comp: DataFrame, percent: int,
             whole: int | None, elect: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """(components, members of large buckets): verifies the buckets of ``members`` (bucket, set_no, n).

    Every member first meets one set: among the smallest of its buckets, the one it shares most buckets with. What
    holds several components after that goes on in rounds: members outside the bucket's largest component are elected, and
    meet all that are of other components. When all of them were elected, no pair is left. With
    ``whole``, buckets of more members than that are returned unfinished instead."""
    heads = members.groupBy("bucket").agg(F.min("set_no").alias("a"), F.min_by("n", "set_no").alias("na"))
    best = (members.join(heads, "bucket").filter((F.col("set_no") != F.col("a")) & _alike_in_size(percent, "n", "na"))
            .groupBy("a", F.col("set_no").alias("b")).agg(F.count("*").alias("buckets"))
            .groupBy("b").agg(F.max_by("a", F.struct("buckets", "a")).alias("a")))
    comp = _merged(comp, _linked(_close(_roots_of(best, comp).select("a", "b"), sets, percent), sets, percent))
    forget(sets.sparkSession)
    left = cut_lineage(_unresolved(members, comp))
    large = left.filter(F.col("size") > whole).select("bucket", "set_no", "n") if whole else None
    left = (left.filter(F.col("size") <= whole) if whole else left).withColumn("met", F.lit(False))
    # a member's number, from 0 to 1 and the same in all its buckets, elects it in the round whose share it is below
    number = (F.xxhash64("set_no").cast("double") + float(1 << 63)) / float(1 << 64)
    upto = float(elect)
    while not left.filter("outsider and not met").isEmpty():
        now = left.withColumn("elected", F.col("outsider") & ~F.col("met") & (number < upto / F.col("outsiders")))
        known = now.join(sets.select("set_no", "odd"), "set_no")
        a = known.filter("elected").select("bucket", F.col("set_no").alias("a"), F.col("n").alias("na"), F.col("odd").alias("odd_a"), F.col("root").alias("ra"))
        # a member elected in an earlier round has met all; two that are elected now meet once
        open_ = ~F.col("met") & (~F.col("elected") | (F.col("set_no") > F.col("a")))
        pairs = (known.join(a, "bucket").filter((F.col("root") != F.col("ra")) & open_ & _alike_in_size(percent, "n", "na")
                                                & _may_link(percent, "n", "odd", "na", "odd_a"))
                 .select("a", F.col("set_no").alias("b")).distinct())
        comp = _merged(comp, _linked(pairs, sets, percent))
        # a bucket of which all outsiders were elected is done: components only grow together
        rest = now.filter(F.col("outsiders") > upto).select("bucket", "set_no", "n", (F.col("met") | F.col("elected")).alias("met"))
        upto *= elect
        left = cut_lineage(_unresolved(rest, comp))
        forget(sets.sparkSession)
    return comp, large


def _shared(keyed: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` stands in more than one row."""
    often = keyed.groupBy(key).agg(F.count("*").alias("_times")).filter("_times > 1").select(key)
    return keyed.join(often, key)


def near_duplicate_classes(docs: DataFrame, distinct: DataFrame, shingle: int, percent: int, whole: int = 64,
                           longer_groups: int = 48, longer_rows: int = 8) -> DataFrame:
    """(set_no, root) of the sets of ``distinct`` that may have a near copy: the component of each.

    ``distinct`` has columns set_no, set_id, n, first, second and rep (id and text hash of a row that has the set)."""
    spark = docs.sparkSession
    parts = distinct.select("set_no", F.explode(F.concat(
        F.transform("first", lambda k: F.struct(F.lit(True).alias("one"), k.alias("key"))),
        F.transform("second", lambda k: F.struct(F.lit(False).alias("one"), k.alias("key"))))).alias("part")
    ).select("set_no", "part.one", "part.key")
    met = (_shared(parts, "key").groupBy("set_no")
           .agg(F.collect_list(F.when(F.col("one"), F.col("key"))).alias("first"),
                F.collect_list(F.when(~F.col("one"), F.col("key"))).alias("second"))
           .filter((F.size("first") > 0) & (F.size("second") > 0)))
    tables = (met.select("set_no", F.explode("first").alias("x"), "second").select("set_no", "x", F.explode("second").alias("y"))
              .select(F.xxhash64("x", "y").alias("bucket"), "set_no"))
    members = cut_lineage(_shared(cut_lineage(tables), "bucket").join(distinct.select("set_no", "n"), "set_no"))
    forget(spark)
    candidates = members.select("set_no").distinct().join(distinct.select("set_no", "set_id", "rep"), "set_no")
    path = scratch_path(spark, "shingle-sets")
    rows = docs.join(candidates.select(F.col("rep.id").alias("cid"), F.col("rep.text_hash").alias("ch")).hint("shuffle_hash"),
                     (F.col("ch") == F.col("text_hash")) & F.col("cid").eqNullSafe(F.col("id")), "left_semi")
    found = full_sets(rows, shingle, longer_groups, longer_rows).join(candidates.select("set_id", "set_no"), "set_id")
    found.groupBy("set_no").agg(F.first("shingles").alias("shingles"), F.first("longer").alias("longer"),
                                F.first("odd").alias("odd")).write.parquet(path)
    sets = spark.read.parquet(path)
    forget(spark)
    comp, large = _resolve(members, sets, sets.select("set_no", F.col("set_no").alias("root")), percent, whole)
    if large.isEmpty():
        return comp
    again = (sets.join(large.select("set_no", "n").distinct(), "set_no")
             .select("set_no", "n", F.explode("longer").alias("bucket")))
    open_ = cut_lineage(_unresolved(_shared(again, "bucket"), comp).select("bucket", "set_no", "n"))
    return _resolve(open_, sets, comp, percent, None)[0]


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                          percent: int = 85, groups: int = 9, rows: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; ``kept`` marks the row of the component's id."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    path = scratch_path(spark, "sketches")
    sketches(plain, shingle, groups, rows).write.parquet(path)
    sketched = spark.read.parquet(path)
    # the keys follow from the set, so any row's will do; a set gets a number of its own once, when written
    table = scratch_path(spark, "distinct-sets")
    (sketched.filter("n > 0").groupBy("set_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("rep"),
        F.first("n").alias("n"), F.first("first").alias("first"), F.first("second").alias("second"))
     .withColumn("set_no", F.monotonically_increasing_id()).write.parquet(table))
    distinct = spark.read.parquet(table)
    comp = near_duplicate_classes(plain, distinct, shingle, percent)
    member = (distinct.select("set_no", "set_id", F.col("rep.id").alias("least")).join(comp, "set_no", "left")
              .select("set_id", "least", F.coalesce("root", "set_no").alias("root")))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = member.select("set_id", "root").join(ids, "root").select("set_id", "component_id")
    return (sketched.select("id", "set_id", F.col("n").alias("n_shingles")).join(classes, "set_id", "left")
            .select("id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id is their component's; rows that repeat an id stay together."""
    kept = (near_duplicate_groups(docs, id_col, text_col, **params).filter("kept")
            .select(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null")).alias("_id")).distinct())
    mark = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))
    return docs.withColumn("_id", mark).join(kept, "_id", "left_semi").drop("_id").select(*docs.columns)
