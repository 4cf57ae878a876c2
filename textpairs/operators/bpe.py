"""Byte-level BPE merge learning (T2) and encoding with learned merges (T3,
mode ``bpe``).

The learner's state is a written table of word *types* (symbols, count), not
the corpus. Learning goes in rounds over that table, one path at any size:

1. The driver holds the exact counts of the pairs (at most the symbols squared,
   and none below ``min_freq``) and guesses the next merges by trying them on a
   bounded head of the most frequent types.
2. One job applies the guessed merges in order. Each task indexes the places of
   the guessed pairs in its types, so a merge touches only types that hold it,
   and reports by how much every merge changes the count of every pair. The
   changes are added up in Spark.
3. The driver replays them: as long as the guessed merge is the most frequent
   pair by the exact counts, it is accepted and its changes are booked. The first wrong guess
   ends the round; the next round starts with exact counts.

So the head decides how many rounds are needed and nothing else: merges are
those of plain BPE (count desc, then pair string). The types are written anew
with their merges every few hundred merges, in the shared folder, in place of those before.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from textpairs.functions.symbols import PAIR, SymbolRuns, added_up
from textpairs.functions.text import BOS_ID, EOS_ID, SPECIAL_TOKENS, UNK_ID, words
from textpairs.operators.pairs import FEW_KEYS
from textpairs.session import collect_garbage, cut_lineage, remove_scratch, scratch_path


def byte_symbols(word: Column) -> Column:
    """``abc`` -> ``<61><62><63>`` (hex of the UTF-8 bytes, bracketed)."""
    return F.regexp_replace(F.hex(F.encode(word, "UTF-8")), "(..)", "<$1>")


def word_types(df: DataFrame, col: str = "text") -> DataFrame:
    """``sym, cnt``: distinct words as byte symbols with corpus counts."""
    return (df.select(F.explode(words(col)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("cnt"))
            .select(byte_symbols(F.col("w")).alias("sym"), "cnt"))


def counted_types(df: DataFrame, col: str = "text") -> DataFrame:
    """``word_types``, written once for its several readers."""
    path = scratch_path(df.sparkSession, "word-types")
    word_types(df, col).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def pair_counts(types: DataFrame) -> DataFrame:
    """``pair, cnt``: adjacent symbol pairs weighted by word counts."""
    sy = F.regexp_extract_all(F.col("sym"), F.lit("<[^>]*>"), 0)
    pairs = F.when(F.size(sy) >= 2, F.transform(F.sequence(F.lit(1), F.size(sy) - 1),
                                                lambda i: F.concat(F.element_at(sy, i), F.element_at(sy, i + 1))))
    return (types.select(F.explode(pairs).alias("pair"), "cnt")
            .groupBy("pair").agg(F.sum("cnt").cast("bigint").alias("cnt")))


#: Merges of the registered queries.
N_MERGES = 4000

#: Most frequent word types on which the driver tries merges before it guesses (a bound, not a switch).
HEAD_TYPES = 200_000

#: Merges after which the types are written anew, and the longest guess.
WRITE_EVERY, LONGEST_GUESS = 512, 512

_SWAPS = 24  # merges of which the order may differ from the guess
_BLOCK = 4_000_000  # symbols that a task takes together


class _PairCounts:
    """Exact or estimated pair counts with their maximum (count desc, pair string asc)."""

    def __init__(self, names: list[str], counts: dict[int, int]):
        self.names, self.counts = names, counts
        self.heap = [(-n, self.name(key), key) for key, n in counts.items()]
        heapq.heapify(self.heap)

    def name(self, key: int) -> str:
        return f"<{self.names[key // PAIR]}><{self.names[key % PAIR]}>"

    def copy(self) -> _PairCounts:
        out = object.__new__(_PairCounts)
        out.names, out.counts, out.heap = list(self.names), dict(self.counts), list(self.heap)
        return out

    def top(self) -> tuple[int, int] | None:
        """(pair, count) of the most frequent pair."""
        while self.heap:
            n, _, key = self.heap[0]
            if self.counts.get(key, 0) == -n:
                return key, -n
            heapq.heappop(self.heap)  # counted anew since
        return None

    def leading(self, most: int) -> list[tuple[int, int]]:
        """The ``most`` most frequent pairs with their counts, in order."""
        out: list[tuple[int, int]] = []
        while len(out) < most and (best := self.top()):
            out.append(best)
            heapq.heappop(self.heap)
            while self.heap and self.heap[0][2] == best[0]:  # the same entry twice
                heapq.heappop(self.heap)
        for key, n in out:
            heapq.heappush(self.heap, (-n, self.name(key), key))
        return out

    def certain(self, guess: Sequence[int]) -> list[tuple[int, int]]:
        """The next merges (pair, count) in their order, if they are the first few of ``guess``; else none.

        That is the first pair alone, if it is the most frequent one. Or the first n pairs, if they are the
        n most frequent ones in any order, no two share a symbol and the next pair is counted less often:
        such merges leave each other's counts as they are, and a pair that one of them creates is counted
        at most as often as an old pair that shares a symbol with it."""
        best = self.top()
        if best is None or best[0] == guess[0]:
            return [best] if best else []
        lead = self.leading(_SWAPS + 1)
        used: set[int] = set()
        for n, key in enumerate(guess[:_SWAPS], 1):
            sides = {key // PAIR, key % PAIR}
            if sides & used:
                break
            used |= sides
            if n < len(lead) and lead[n - 1][1] > lead[n][1] and {k for k, _ in lead[:n]} == set(guess[:n]):
                return lead[:n]
        return []

    def merge(self, key: int, changes: dict[int, int], min_freq: int) -> None:
        """Book a merge: its new symbol's name and the changes of counts. Pairs below ``min_freq``
        are forgotten: a pair is most frequent when the later of its symbols is made."""
        self.names.append(self.names[key // PAIR] + self.names[key % PAIR])
        for pair, change in changes.items():
            now = self.counts.get(pair, 0) + change
            if now >= min_freq and (change > 0 or pair in self.counts):
                self.counts[pair] = now
                heapq.heappush(self.heap, (-now, self.name(pair), pair))
            else:
                self.counts.pop(pair, None)
        self.counts.pop(key, None)


def _guess(exact: _PairCounts, head: SymbolRuns, most: int, min_freq: int) -> list[int]:
    """The next merges as far as the head tells: its changes, scaled to each merge's count."""
    likely, runs = exact.copy(), head.copy()
    runs.index(None, len(exact.names))
    out: list[int] = []
    while len(out) < most:
        best = likely.top()
        if best is None or best[1] < min_freq:
            break
        key, count = best
        keys, change = runs.merge(key // PAIR, key % PAIR, len(likely.names))
        held = -int(change[keys == key].sum()) or 1
        likely.merge(key, {int(k): round(int(c) * count / held) for k, c in zip(keys, change, strict=True)}, min_freq)
        out.append(key)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], lists: str = "syms") -> Iterator[pa.Table]:
    """Consecutive rows of a task's part, about ``_BLOCK`` symbols (of ``lists``) together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(lists).flatten())
        if size >= _BLOCK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size or held:
        yield pa.Table.from_batches(held)


def _runs_of(block: pa.Table) -> SymbolRuns:
    lists = block.column("syms").combine_chunks()
    return SymbolRuns(lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False),
                      block.column("cnt").to_numpy())


def _merge_all(runs: SymbolRuns, merges: Sequence[int], first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    runs.index(np.unique(np.array(merges, dtype=np.int64)), first)
    for k, key in enumerate(merges):
        yield runs.merge(key // PAIR, key % PAIR, first + k)


def _merged_types(state: DataFrame, merges: Sequence[int], first: int) -> DataFrame:
    """The types with ``merges`` applied; their symbols are numbered from ``first``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            runs = _runs_of(block)
            for _ in _merge_all(runs, merges, first):
                pass
            flat, lengths = runs.words()
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            merged = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            out = pa.table({"word": block.column("word"), "cnt": block.column("cnt"), "syms": merged})
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    return state.mapInArrow(apply, "word string, cnt bigint, syms array<int>")


def _changes(state: DataFrame, done: Sequence[int], guess: Sequence[int], first: int, min_freq: int) -> list[dict[int, int]]:
    """For each merge of ``guess``, applied after ``done``: the changes of pair counts over all types."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[list[np.ndarray]] = [[] for _ in guess]
        values: list[list[np.ndarray]] = [[] for _ in guess]
        for block in _blocks(batches):
            runs = _runs_of(block)
            for k, (pairs, change) in enumerate(_merge_all(runs, [*done, *guess], first)):
                if k >= len(done):
                    keys[k - len(done)].append(pairs)
                    values[k - len(done)].append(change)
        for k in range(len(guess)):
            if keys[k]:
                pairs, change = added_up(np.concatenate(keys[k]), np.concatenate(values[k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), k, dtype=np.int32)), pa.array(pairs), pa.array(change)],
                                                 ["step", "pair", "change"])

    rows = (state.mapInArrow(count, "step int, pair bigint, change bigint").groupBy("step", "pair").agg(F.sum("change").alias("change"))
            .filter((F.col("change") < 0) | (F.col("change") >= min_freq)).toArrow())
    out: list[dict[int, int]] = [{} for _ in guess]
    for step, pair, change in zip(*[rows.column(c).to_pylist() for c in ("step", "pair", "change")], strict=True):
        out[step][pair] = change
    return out


def _spelled(state: DataFrame, names: Sequence[str]) -> DataFrame:
    """``word, sym`` with the symbols spelt out."""
    spelt = [f"<{n}>" for n in names]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("syms")
            texts = pc.take(pa.array(spelt, pa.string()), lists.flatten())
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)
            sym = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), texts), "")
            yield pa.RecordBatch.from_arrays([batch.column("word"), sym], ["word", "sym"])

    return state.mapInArrow(spell, "word string, sym string")


def learn_bpe(types: DataFrame, n_merges: int, min_freq: int = 2) -> DataFrame:
    """``rank, left, right, cnt`` of the first ``n_merges`` merges (exact BPE;
    ties broken by the pair string)."""
    return learn_segments(types, n_merges, min_freq)[0]


def learn_segments(types: DataFrame, n_merges: int, min_freq: int = 2, head_types: int = HEAD_TYPES,
                   progress: Callable[[int, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """T2 with its by-product: the merges, and ``word, sym``, every word type (as
    byte symbols) with the symbols it ends in. ``progress`` is told the guessed and
    the accepted merges of every round."""
    spark = types.sparkSession
    number = F.transform(F.regexp_extract_all(F.col("sym"), F.lit("<(..)>"), 1), lambda h: F.conv(h, 16, 10).cast("int"))

    def written(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "bpe-types"))
        df.write.option("compression", "zstd").parquet(paths[-1])
        for path in paths[:-1]:  # what was written before has been read for the last time
            remove_scratch(spark, path)
        del paths[:-1]
        collect_garbage(spark)  # shuffle files of the rounds
        return spark.read.parquet(paths[-1])

    paths: list[str] = []
    state = written(types.select(F.col("sym").alias("word"), "cnt", number.alias("syms")))
    # at most 65,536 pairs of bytes
    exact = _PairCounts([f"{b:02X}" for b in range(256)],
                        {int(r["pair"][1:3], 16) * PAIR + int(r["pair"][5:7], 16): int(r["cnt"])
                         for r in pair_counts(types).filter(F.col("cnt") >= min_freq).collect()})
    top = state.orderBy(F.desc("cnt"), "word").limit(head_types).toArrow()
    head = _runs_of(top) if top.num_rows else None
    merges: list[tuple[int, str, str, int]] = []
    keys: list[int] = []
    saved, most = 0, 16
    while len(merges) < n_merges and head is not None:
        guess = _guess(exact, head, min(most, n_merges - len(merges)), min_freq)
        if not guess:
            break
        changes = _changes(state, keys[saved:], guess, 256 + saved, min_freq)
        accepted = 0
        head.index(None, len(exact.names))
        while accepted < len(guess) and (sure := exact.certain(guess[accepted:])):
            for key, count in sure:
                left, right = exact.name(key)[:-1].split(">")
                merges.append((len(merges) + 1, left + ">", right + ">", count))
            for key in guess[accepted:accepted + len(sure)]:
                head.merge(key // PAIR, key % PAIR, len(exact.names))
                exact.merge(key, changes[accepted], min_freq)
                keys.append(key)
                accepted += 1
        if progress:
            progress(len(guess), accepted)
        most = min(LONGEST_GUESS, max(16, 2 * accepted))
        if len(keys) - saved >= WRITE_EVERY:
            state, saved = written(_merged_types(state, keys[saved:], 256 + saved)), len(keys)
    ends = _merged_types(state, keys[saved:], 256 + saved) if len(keys) > saved else state
    segments = written(_spelled(ends, exact.names))
    return spark.createDataFrame(merges, "rank int, left string, right string, cnt bigint"), segments


def bpe_vocab(merges: DataFrame) -> DataFrame:
    """``token, id``: the special tokens, the 256 bytes, then the merges in order."""
    spark = merges.sparkSession
    specials = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, id int")
    first = len(SPECIAL_TOKENS)
    of_bytes = spark.range(256).select(F.format_string("<%02X>", "id").alias("token"), (F.col("id") + first).cast("int").alias("id"))
    inner = F.concat(F.regexp_replace("left", "[<>]", ""), F.regexp_replace("right", "[<>]", ""))
    merged = merges.select(F.concat(F.lit("<"), inner, F.lit(">")).alias("token"), (F.col("rank") + (first + 255)).cast("int").alias("id"))
    return specials.unionByName(of_bytes).unionByName(merged)


#: Words of texts that a task looks up together, bytes of text that it splits together, and the corpus's words for each bucket.
_SLICE, _TEXT, _BUCKET_WORDS = 1 << 20, 1 << 22, 4_000_000


def _first_words(texts: pa.Array, most: int) -> tuple[pa.Array, np.ndarray]:
    """The first ``most`` words of every text one after the other, and how many they are."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # splits at the characters of ``words``
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    starts = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    n = np.diff(starts)
    full[full] = np.arange(starts[-1]) - np.repeat(starts[:-1], n) < most
    return flat.filter(pa.array(full)), np.minimum(n, most)


def _listed(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blocks: pa.ChunkedArray, schema: pa.Schema) -> tuple[pa.Table, list[int]]:
    """The rows of all blocks, and how many each has."""
    tables = [pa.ipc.open_stream(b.as_buffer()).read_all().cast(schema) for b in blocks]
    return pa.concat_tables([schema.empty_table(), *tables]).combine_chunks(), [len(t) for t in tables]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else column.combine_chunks()


def _bucketed(table: pa.Table, word: str, n: int) -> tuple[np.ndarray, list[tuple[int, pa.Table]]]:
    """The rows by the bucket of their word, of ``n``: the order they stand in then, and the rows of every bucket there is."""
    bucket = (hash_array(table.column(word).to_numpy(), categorize=False) % np.uint64(n)).astype(np.int32)
    order = pc.sort_indices(pa.table({"bucket": bucket, "word": table.column(word)}),
                            sort_keys=[("bucket", "ascending"), ("word", "ascending")]).to_numpy()
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    rows = table.take(pa.array(order))
    return order, [(int(bucket[order[a]]), rows.slice(a, b - a)) for a, b in zip(cuts, [*cuts, len(order)][1:], strict=True)]


_WORD = pa.schema([("word", pa.binary())])


def _cut_texts(keys: Sequence[str], most: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the number of their slice and their first words as places in the slice's distinct words; a slice's
    first row has these, in packed blocks by bucket."""

    def slice_of(number: int, rows: list[pa.RecordBatch], words: list[pa.Array], n: list[np.ndarray]) -> pa.RecordBatch:
        coded = pa.concat_arrays(words).cast(pa.binary()).dictionary_encode()
        order, parts = _bucketed(pa.table({"word": coded.dictionary}), "word", buckets)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        blocks = pa.StructArray.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([_packed(t) for _, t in parts], pa.binary())],
                                            ["bucket", "words"])
        kept = pa.Table.from_batches(rows).combine_chunks()
        of_first = np.zeros(len(kept), dtype=np.int32)
        of_first[0] = len(parts)
        codes = _listed(np.concatenate(n), pa.array(place[coded.indices.to_numpy(zero_copy_only=False)]))
        return pa.RecordBatch.from_arrays([*[_whole(kept.column(k)) for k in keys], pa.array(np.full(len(kept), number)), codes,
                                           _listed(of_first, blocks)], [*keys, "_slice", "_codes", "_blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows, words, n, size = [], [], [], 0
        for batch in batches:
            text = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(text) // _TEXT, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.slice(a, b - a)
                some, counts = _first_words(part.column("_text"), most)
                rows.append(part.select(list(keys)))
                words.append(some)
                n.append(counts)
                size += len(some) + len(part)
                if size >= _SLICE:
                    yield slice_of(number, rows, words, n)
                    rows, words, n, size, number = [], [], [], 0, number + 1
        if rows:
            yield slice_of(number, rows, words, n)

    return run


def _with_pieces(df: DataFrame, pieces: DataFrame, types: DataFrame, key_cols: Sequence[str], col: str, most: int, item: str) -> DataFrame:
    """``key_cols, items``: the texts' first words (at most ``most``) with their ``pieces`` (word, items), joined up in order.

    Rows stay whole: tasks cut them into slices of about a million words and write a row's words as places in its slice's
    distinct words. Only these leave the slice, packed by bucket, to meet the pieces of their bucket, and only pieces come back, in the same order.
    ``types`` has the counts by which the buckets are made as many as bound their size. Rows that share a key have
    their words merged by place, nulls are one key."""
    spark, keys = df.sparkSession, list(key_cols)
    corpus = types.agg(F.sum("cnt").alias("n")).first()["n"] or 0  # one number
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-corpus // _BUCKET_WORDS))
    kind, arrow = (ArrayType(IntegerType()), pa.int32()) if item == "int" else (ArrayType(StringType()), pa.string())
    unknown = pa.array([[UNK_ID if item == "int" else SPECIAL_TOKENS[UNK_ID]]], pa.list_(arrow))
    items_of, known_of = pa.schema([("items", pa.list_(arrow))]), pa.schema([("word", pa.binary()), ("items", pa.list_(arrow))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "items"):
            _, parts = _bucketed(block.cast(known_of), "word", buckets)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([_packed(t) for _, t in parts], pa.binary())],
                                             ["bucket", "known"])

    def look_up(blocks: pa.Table, known: pa.Table) -> pa.Table:
        wanted, sizes = _unpacked(blocks.column("words"), _WORD)
        found, _ = _unpacked(known.column("known"), known_of)
        at = pc.fill_null(pc.index_in(_whole(wanted.column("word")), value_set=_whole(found.column("word"))), len(found))
        items = pa.concat_arrays([_whole(found.column("items")), unknown]).take(at)
        ends = np.cumsum(sizes)
        return pa.table({"_slice": blocks.column("_slice"), "bucket": blocks.column("bucket"), "items": pa.array(
            [_packed(pa.table({"items": items.slice(e - n, n)})) for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    def placed(rows: pa.Table, found: pa.Table) -> tuple[pa.ListArray, np.ndarray]:
        """The items of all words one after the other, and how many words a row has."""
        items, _ = _unpacked(found.sort_by("bucket").column("items"), items_of)
        codes = _whole(rows.column("_codes"))
        return _whole(items.column("items")).take(codes.flatten()), pc.list_value_length(codes).to_numpy(zero_copy_only=False)

    def join_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        taken, n = placed(rows, found)
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(n)])]
        size = np.diff(starts)
        first = np.arange(starts[-1]) - np.repeat(starts[:-1], size) < most
        return pa.table([*[rows.column(k) for k in keys], _listed(np.minimum(size, most), taken.flatten().filter(pa.array(first)))], [*keys, "items"])

    def number(rows: pa.Table, found: pa.Table) -> pa.Table:
        taken, n = placed(rows, found)
        pos = np.arange(len(taken)) - np.repeat(np.cumsum(n) - n, n)
        words = _listed(n, pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), taken], ["pos", "items"]))
        return pa.table([*[rows.column(k) for k in keys], words], [*keys, "s"])

    texts = df.select(*keys, F.col(col).alias("_text"))
    key_fields = [texts.schema[k] for k in keys]
    blocks_of = ArrayType(StructType([StructField("bucket", IntegerType()), StructField("words", BinaryType())]))
    path = scratch_path(spark, "bpe-slices")  # read for the words and for the rows
    texts.mapInArrow(_cut_texts(keys, most, buckets), StructType([*key_fields, StructField("_slice", LongType()), StructField(
        "_codes", ArrayType(IntegerType())), StructField("_blocks", blocks_of)])).write.option("compression", "zstd").parquet(path)
    given = spark.read.parquet(path)
    words_by_bucket = given.select("_slice", F.explode("_blocks").alias("b")).select("_slice", "b.bucket", "b.words").groupBy("bucket")
    by_bucket = (pieces.filter(F.col("items").isNotNull()).select(F.unhex(F.regexp_replace("word", "[<>]", "")).alias("word"), "items")
                 .mapInArrow(pack, "bucket int, known binary").groupBy("bucket"))
    found = words_by_bucket.cogroup(by_bucket).applyInArrow(look_up, "_slice bigint, bucket int, items binary").groupBy("_slice")
    rows = given.select(*keys, "_slice", "_codes")
    # (null is a key like another)
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    alike = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    repeated = cut_lineage(given.select(*[F.col(k).alias(n) for k, n in named.items()]).groupBy(*named.values()).agg(F.count(F.lit(1)).alias("_n"))
                           .filter("_n > 1").drop("_n"))
    many = repeated.count()
    repeated = F.broadcast(repeated) if many <= FEW_KEYS else repeated
    alone = rows.join(repeated, alike, "left_anti") if many else rows
    out = alone.groupBy("_slice").cogroup(found).applyInArrow(join_up, StructType([*key_fields, StructField("items", kind)]))
    if many:
        shared = rows.join(repeated, alike, "left_semi").groupBy("_slice").cogroup(found).applyInArrow(number, StructType(
            [*key_fields, StructField("s", ArrayType(StructType([StructField("pos", IntegerType()), StructField("items", kind)])))]))
        merged = shared.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
        out = out.union(merged.select(*keys, F.slice(F.flatten(F.transform("s", lambda x: x["items"])), 1, most).alias("items")))
    return out


def bpe_encode(df: DataFrame, segments: DataFrame, types: DataFrame, key_cols: Sequence[str], col: str = "text",
               max_tokens: int = 1022, out: str = "bpe_tokens") -> DataFrame:
    """T3 (mode ``bpe``): ``key_cols``, ``out`` = the first ``max_tokens`` merged symbols."""
    pieces = segments.select("word", F.regexp_extract_all(F.col("sym"), F.lit("<[^>]*>"), 0).alias("items"))
    return _with_pieces(df, pieces, types, key_cols, col, max_tokens, "string").withColumnRenamed("items", out)


def bpe_encode_ids(df: DataFrame, segments: DataFrame, types: DataFrame, vocab: DataFrame, n_merges: int, key_cols: Sequence[str],
                   col: str = "text", max_len: int = 1024, out: str = "input_ids") -> DataFrame:
    """T3 (mode ``bpe``) as joins: ``key_cols``, ``out`` = ``<s> ids </s>`` of at most
    ``max_len`` ids and its attention mask.

    Learning has already split every word type and its symbols are numbered in its own row, so a word's ids are one join away
    (a word it has not seen is ``<unk>``). Texts are cut to ``max_len - 2`` words
    before the join: a word has at least one id."""
    keys = list(key_cols)
    bound = n_merges + 256 + len(SPECIAL_TOKENS)
    known = vocab.select("token", "id").limit(bound + 1).toArrow()
    if known.num_rows > bound:
        raise ValueError(f"the vocabulary has more than {bound} rows")
    tokens, ids = known.column("token").combine_chunks().cast(pa.string()), known.column("id").combine_chunks().cast(pa.int32())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            found = pc.index_in(lists.flatten(), value_set=tokens)
            upto = np.concatenate([[0], np.cumsum(pc.is_valid(found).to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            items = pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pc.take(ids, found.drop_null()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), items], ["word", "items"])

    pieces = (segments.select("word", F.regexp_extract_all(F.col("sym"), F.lit("<[^>]*>"), 0).alias("items"))
              .mapInArrow(numbered, "word string, items array<int>").filter(F.size("items") > 0))
    body = _with_pieces(df, pieces, types, keys, col, max_len - 2, "int")
    return (body.select(*keys, F.concat(F.array(F.lit(BOS_ID)), "items", F.array(F.lit(EOS_ID))).alias(out))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(out))))
