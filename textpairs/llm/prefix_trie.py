"""Prefix trie of conversations (operator 13).

Every distinct sequence of the first d turns (role and text) of a conversation
is a node. For each node: its members, children, leaves below, the tokens a
prefix cache would save below, and the conversations that end there.

A conversation is a *path*: its turns' 16-byte digests and lengths, one after the other as one
binary value, so that paths sort like their sequences, a prefix first. Texts
are digested before anything is shuffled. Equal paths are one row with the
number and the smallest id of their conversations.

Distinct paths are cut into range shards, at most ``shard_turns`` turns or so
in each. In a shard the turns are dictionary-encoded in digest order and the
paths are put into a ternary search tree, the median of each run of paths before
those to its left and right, which keeps the ``lo``/``hi`` links between siblings balanced. A
traversal from the last node made to the first (children come after their
parent) adds up members, children, leaves and savings without recursion.

A node can have members in other shards only if it lies on the first or last
path of its shard. Those boundary nodes leave the shard as partial sums and are
merged by rounds: each round merges up to ``fan_in`` neighbouring shards in one task
into one, of which again only nodes on the first and last path stay open. A
task holds a shard's paths or ``fan_in`` times two paths of boundary nodes.

The ids that end at a node are hashed as a stream of sorted rows, never as a list. A SHA-256 is
sequential, so the ids of one path go through one task, in constant memory.

Defined results: a null role or text is an empty text; turns are ordered by
turn (null first), then role and a digest of the text; a repeated row is a turn of its own; rows
without a conversation id belong to no conversation; a conversation without
turns ends at the root; an empty table gives no node, not even a root; further
columns are ignored. One conversation must fit a task's memory as 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.session import cut_lineage, scratch_path

_TURN = 20  # bytes of a turn in a path: digest and number of code points
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_keys(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, key): turns numbered from 0 within their conversation, as 20 bytes each."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what)))
    length = F.unhex(F.lpad(F.hex(F.length(what)), 8, "0"))
    # repeated turn numbers: role and text decide by their digests' order, which is the same wherever they stand
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "who", "what_hash", "key")
    keyed = (turns.filter(F.col(conv).isNotNull())
             .select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("who"), F.md5(what).alias("what_hash"),
                     F.concat(digest, length).alias("key")))
    return keyed.withColumn("pos", F.row_number().over(order) - 1).select("conv", "pos", "key")


def paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv, path) of all ``conversations`` (conv); ``turns`` (conv, pos, key) in any order."""
    joined = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("turns"))
    path = F.aggregate("turns", F.unhex(F.lit("")), lambda done, t: F.concat(done, t["key"]))
    return conversations.join(joined.select("conv", path.alias("path")), "conv", "left").select(
        "conv", F.coalesce("path", F.unhex(F.lit(""))).alias("path"))


def _ends(members: DataFrame) -> DataFrame:
    """(path_key, n, conv, ends_sha256) of each path: its conversations counted, the smallest, and their ids hashed."""
    kind = members.schema["conv"].dataType.simpleString()

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path_key", "n", "conv", "ends_sha256"]
        types = [pa.binary(), pa.int64(), None, pa.string()]
        now, n, least, digest, out, kind_of = None, 0, None, None, [], None
        for batch in batches:
            kind_of = batch.column("conv").type
            rows = zip(batch.column("path_key").to_pylist(), batch.column("conv").to_pylist(), strict=True)
            for key, run in groupby(rows, key=lambda r: r[0]):
                ids = [conv for _, conv in run]
                if key != now:
                    if now is not None:
                        out.append((now, n, least, digest.hexdigest()))
                    now, n, least, digest = key, 0, ids[0], hashlib.sha256()
                digest.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
                n += len(ids)
            if len(out) >= 10_000:
                yield _batch(out, names, [types[0], types[1], kind_of, types[3]])
                out = []
        if now is not None:
            out.append((now, n, least, digest.hexdigest()))
            yield _batch(out, names, [types[0], types[1], kind_of, types[3]])

    ordered = members.select("path_key", "conv").repartition("path_key").sortWithinPartitions("path_key", "conv")
    return ordered.mapInArrow(hash_runs, f"path_key binary, n long, conv {kind}, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class TernaryTrie:
    """Ternary search tree over sequences of turn ids; node 0 is the textless root.

    ``eq[v]`` is the first child met of trie node v; ``lo`` and ``hi`` lead to its siblings."""

    def __init__(self) -> None:
        self.turn, self.lo, self.hi, self.eq = [-1], [0], [0], [0]
        self.parent, self.depth = [0], [0]

    def _new(self, turn: int, parent: int) -> int:
        self.turn.append(turn)
        self.lo.append(0)
        self.hi.append(0)
        self.eq.append(0)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.turn) - 1

    def insert(self, sequence: list[int]) -> int:
        """Node of the whole sequence, made where it is new."""
        turn, lo, hi, eq = self.turn, self.lo, self.hi, self.eq
        at = 0
        for t in sequence:
            child = eq[at]
            if not child:
                child = eq[at] = self._new(t, at)
            while t != turn[child]:
                side = lo if t < turn[child] else hi
                if not side[child]:
                    side[child] = self._new(t, at)
                child = side[child]
            at = child
        return at

    def path_to(self, node: int) -> list[int]:
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out[::-1]


def median_order(n: int) -> Iterator[int]:
    """0..n-1, the middle of every run before its left and right parts."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            todo += [(mid + 1, b), (a, mid)]


#: A node, complete or partial. ``open``: 1 on the first, 2 on the last path of its part, 3 both, 0 complete.
_FIELDS = "shard int, node binary, parent binary, open int, conv {kind}, depth long, parent_conv {kind}, n_convs long, " \
          "n_children long, n_leaves long, saved long, points long, ends_sha256 string"


def _root_key() -> bytes:
    return b"\0" * 16


def _child_key(parent: bytes, turn: bytes) -> bytes:
    """Name of a boundary node: a digest of its whole sequence, made step by step."""
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


def shard_nodes(shard: int, path_list: list[bytes], counts: list[int], least: list, ends: list[str]) -> list[tuple]:
    """Rows of ``_FIELDS`` for one shard's distinct paths, given in order."""
    records = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_TURN), sum(map(len, path_list)) // _TURN,
                                                   [None, pa.py_buffer(b"".join(path_list))]).dictionary_encode()
    turns = records.dictionary.to_pylist()
    by_bytes = sorted(range(len(turns)), key=turns.__getitem__)
    place = np.empty(len(turns), dtype=np.int64)
    place[by_bytes] = np.arange(len(turns))
    ids = place[records.indices.to_numpy(zero_copy_only=False)].tolist() if len(turns) else []
    turns = [turns[i] for i in by_bytes]
    cuts = np.concatenate([[0], np.cumsum([len(p) // _TURN for p in path_list])]).tolist()
    trie, end_of = TernaryTrie(), {}
    for i in median_order(len(path_list)):
        end_of[i] = trie.insert(ids[cuts[i]:cuts[i + 1]])
    size = len(trie.turn)
    members, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    first: list = [None] * size
    ended: list = [None] * size
    for i, node in end_of.items():
        members[node], first[node], ended[node] = counts[i], least[i], ends[i]
    edge: dict[int, int] = {}
    for bit, i in ((1, 0), (2, len(path_list) - 1)):
        for node in trie.path_to(end_of[i]):
            edge[node] = edge.get(node, 0) | bit
    points = [0] + [int.from_bytes(turns[t][16:], "big") for t in trie.turn[1:]]
    parent = trie.parent
    for v in range(size - 1, 0, -1):  # children before parents
        p = parent[v]
        members[p] += members[v]
        if first[p] is None or first[v] < first[p]:
            first[p] = first[v]
        if v not in edge:
            if not children[v]:
                leaves[v] = 1
            saved[v] += (members[v] - 1) * points[v]
            children[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    names = {0: _root_key()}
    for v in sorted(edge):
        if v:
            names[v] = _child_key(names[parent[v]], turns[trie.turn[v]])
    out = []
    for v in range(size):
        up = names.get(parent[v]) if v else None
        out.append((shard, names.get(v), up, edge.get(v, 0), first[v], trie.depth[v],
                    first[parent[v]] if v and up is None else None, members[v], children[v], leaves[v], saved[v], points[v], ended[v]))
    return out


def merged_nodes(part: int, rows: list[tuple], closing: bool) -> list[tuple]:
    """One part's rows from the open rows of neighbouring parts (in the form of ``_FIELDS``).

    Open nodes of the same name are added up. A node stays open on the first path of the first part
    or the last path of the last one; the others are completed and added to their parents."""
    parts = sorted({r[0] for r in rows})
    total: dict[bytes, list] = {}
    for shard, node, up, edge, conv, depth, _, n, kids, leaves, saved, points, ends in rows:
        stays = (edge & 1 if shard == parts[0] else 0) | (edge & 2 if shard == parts[-1] else 0)
        t = total.get(node)
        if t is None:
            total[node] = [part, node, up, stays, conv, depth, None, n, kids, leaves, saved, points, ends]
        else:
            t[3] |= stays
            t[4] = min(t[4], conv)
            t[7] += n
            t[8] += kids
            t[9] += leaves
            t[10] += saved
            t[12] = t[12] or ends
    for t in sorted(total.values(), key=lambda t: -t[5]):
        if closing or not t[3]:
            t[3] = 0
            if not t[8]:
                t[9] = 1
            t[10] += (t[7] - 1) * t[11]
            up = total.get(t[2]) if t[2] is not None else None
            if up is not None:
                up[8] += 1
                up[9] += t[9]
                up[10] += t[10]
    return [tuple(t) for t in total.values()]


def _arrow_fields(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("open", pa.int32()), ("conv", kind),
                      ("depth", pa.int64()), ("parent_conv", kind), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                      ("n_leaves", pa.int64()), ("saved", pa.int64()), ("points", pa.int64()), ("ends_sha256", pa.string())])


def _as_batches(rows: list[tuple], schema: pa.Schema, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), most):
        yield _batch(rows[a:a + most], schema.names, list(schema.types))


def _merging(closing: bool):
    """Arrow function of one group of neighbouring parts."""

    def merge(key, table):
        schema = _arrow_fields(table.schema.field("conv").type)
        rows = list(zip(*[c.to_pylist() for c in table.select(schema.names).columns], strict=True))
        return pa.Table.from_batches(list(_as_batches(merged_nodes(key[0].as_py(), rows, closing), schema)), schema)

    return merge


def trie_nodes(members: DataFrame, shard_turns: int = 200_000, fan_in: int = 64) -> DataFrame:
    """One row per node of the trie of ``members`` (conv, path)."""
    spark = members.sparkSession
    kind = members.schema["conv"].dataType.simpleString()
    fields = _FIELDS.format(kind=kind)
    keyed = members.withColumn("path_key", F.unhex(F.md5("path")))
    table = scratch_path(spark, "conversation-paths")
    (keyed.groupBy("path_key").agg(F.first("path").alias("path")).join(_ends(keyed), "path_key")
     .select("path", "n", "conv", "ends_sha256").write.parquet(table))
    distinct = spark.read.parquet(table)
    size = distinct.agg(F.sum(F.length("path") / _TURN + 1).alias("turns")).first()["turns"]
    shards = max(1, int((size or 0) // shard_turns) + 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held)
            shard = whole.column("shard")[0].as_py()
            nodes = shard_nodes(shard, whole.column("path").to_pylist(), whole.column("n").to_pylist(),
                                whole.column("conv").to_pylist(), whole.column("ends_sha256").to_pylist())
            yield from _as_batches(nodes, _arrow_fields(whole.schema.field("conv").type))

    built = scratch_path(spark, "trie-shards")
    (distinct.repartitionByRange(shards, "path").sortWithinPartitions("path")
     .withColumn("shard", F.spark_partition_id()).mapInArrow(build, fields).write.parquet(built))
    nodes = spark.read.parquet(built)
    complete, still_open, parts = [nodes.filter("open = 0")], nodes.filter("open > 0"), shards

    while True:
        closing = parts <= fan_in
        path = scratch_path(spark, "trie-merge")
        (still_open.withColumn("part", F.expr(f"shard div {fan_in}").cast("int")).groupBy("part")
         .applyInArrow(_merging(closing), fields).write.parquet(path))
        merged = spark.read.parquet(path)
        complete.append(merged.filter("open = 0"))
        still_open, parts = merged.filter("open > 0"), -(-parts // fan_in)
        if closing:
            break

    out = complete[0]
    for more in complete[1:]:
        out = out.union(more)
    # children of boundary nodes learn their parent's smallest id once that node is complete
    tops = out.filter(F.col("node").isNotNull()).select(F.col("node").alias("parent"), F.col("conv").alias("top_conv"))
    return (out.join(tops, "parent", "left")
            .select("conv", "depth", F.coalesce("parent_conv", "top_conv").alias("parent_conv"), "n_convs", "n_children",
                    "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def branched(turns: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """(conv, pos, key): every conversation with its first ``shared`` turns taken from conversation ``base``.

    ``base`` and ``shared`` are expressions over ``conv``; ``shared`` is at most ``most``. A conversation keeps its own
    turns after its first ``shared``; turns that its base does not have are left out."""
    convs = turns.select("conv").distinct().select("conv", base.alias("base"), shared.alias("shared"))
    heads = turns.filter(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "key")
    taken = convs.filter("shared > 0").join(heads, "base").filter("pos < shared").select("conv", "pos", "key")
    own = turns.filter(F.col("pos") >= shared).select("conv", "pos", "key")
    return taken.union(own)


def conversation_trie(turns: DataFrame, base: Column | None = None, shared: Column | None = None, most_shared: int = 5,
                      conv: str = "conv_id", shard_turns: int = 200_000, fan_in: int = 64) -> DataFrame:
    """The trie of a table of turns, one row per node; conversations may first be branched off base conversations."""
    keyed = cut_lineage(turn_keys(turns, conv))
    rebuilt = keyed if base is None else branched(keyed, base, shared, most_shared)
    return trie_nodes(cut_lineage(paths(rebuilt, keyed.select("conv").distinct())), shard_turns, fan_in)
