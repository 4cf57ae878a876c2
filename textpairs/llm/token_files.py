"""Token-ID files with shuffled bit or byte planes (operator 7).

``write_token_files`` encodes whole texts with the public tokenizers library,
appends an end id to each, and writes the ids in ascending order of the
document id. A file row is a chunk of whole documents. Its ids are cut into
blocks of a fixed size, each block is transposed into byte planes (or bit
planes), the planes of the chunk's blocks stand together, and each plane is
compressed with zstandard. A second table is the chunk index: which documents a
chunk holds, where its ids start in the whole stream, and its size. The files
are Parquet rows written by Spark, so a lost executor's attempt never shows and
any store that Spark reaches will do.

Documents are range-partitioned by id and sorted within a partition; a
partition writes its chunks in order. The only global step is a running sum
over one number per partition.

The tokenizers library encodes each distinct piece between blanks once per
worker (``pieces``). This equals encoding the whole text as long as the
vocabulary's pre-tokeniser drops white space, which holds for the word-level
BPE file used here; ``encode_whole=True`` passes whole texts for any other. If
the vocabulary lower-cases, ASCII texts are lower-cased first: fewer pieces.

Defined results: a null text has only the end id; null document ids come first;
repeated ids are documents of their own, ordered by the hash of their text; an
empty table gives files and results without rows; other columns are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpairs.llm.pieces import PieceCache, by_size

BLOCK_IDS = 4096
CHUNK_IDS = 1 << 18
_TOGETHER = 256
MAX_BROADCAST_PARTS = 200_000


def to_planes(ids: np.ndarray, bits: bool, block: int = BLOCK_IDS) -> list[bytes]:
    """Compressed planes of uint32 ids: 4 byte planes or 32 bit planes."""
    padded = np.concatenate([ids, np.zeros((-len(ids)) % block, dtype=np.uint32)]).astype("<u4")
    rows = padded.view(np.uint8).reshape(-1, block, 4)
    if bits:
        rows = np.unpackbits(rows, axis=2, bitorder="little")
    planes = rows.transpose(2, 0, 1)
    if bits:
        planes = np.packbits(planes, axis=2, bitorder="little")
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ids of ``to_planes``; the number of planes tells bits from bytes."""
    bits = len(planes) == 32
    n_blocks = -(-n_ids // block)
    width = block // 8 if bits else block
    unpress = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(unpress.decompress(p, max_output_size=max(1, n_blocks * width)), dtype=np.uint8)
                     .reshape(n_blocks, width) for p in planes])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=2, bitorder="little"), axis=0, bitorder="little")
    return np.ascontiguousarray(rows.transpose(1, 2, 0)).view("<u4").reshape(-1)[:n_ids]


class LibraryEncoder:
    """The public tokenizers library over whole texts or over the pieces between blanks."""

    def __init__(self, path: str, whole: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.whole = whole
        normalizer = self.library.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.cache = PieceCache(self._encode_pieces, limit=1_500_000)

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter((i for one in ids for i in one), dtype=np.int64, count=int(counts.sum())), counts

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces joined by blanks, so that the library is called once for many; each
        token goes to the piece in which its offset lies."""
        ids, counts = [], []
        for a in range(0, len(pieces), _TOGETHER):
            group = pieces[a:a + _TOGETHER]
            found = self.library.encode(" ".join(group), add_special_tokens=False)
            starts = np.cumsum([0] + [len(p) + 1 for p in group[:-1]])
            tokens = np.array([o[0] for o in found.offsets], dtype=np.int64)
            # an empty piece shares its start with nothing: the last piece that starts at or before the token
            owner = np.searchsorted(starts, tokens, side="right") - 1
            ids.append(np.array(found.ids, dtype=np.int64))
            counts.append(np.bincount(owner, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.whole:
            return self._encode_each(texts)
        # an upper-case marker of an added token must not become one
        low = [t.lower() if self.folds and t.isascii() and "<|" not in t else t for t in texts]
        return self.cache.ids_of([t.replace("\n", " ").split(" ") for t in low])


_ENCODERS: dict[tuple[str, bool], LibraryEncoder] = {}


def _encoder(path: str, whole: bool) -> LibraryEncoder:
    if (path, whole) not in _ENCODERS:
        _ENCODERS[path, whole] = LibraryEncoder(path, whole)
    return _ENCODERS[path, whole]


_CHUNK_SCHEMA = ("part int, seq int, part_start long, n_docs int, n_ids long, first_doc long, last_doc long, "
                 "doc_ids array<long>, doc_lengths array<int>, planes array<binary>")
_CHUNK_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int32()),
                          ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                          ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int32())),
                          ("planes", pa.list_(pa.binary()))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", bits: bool = False, encode_whole: bool = False,
                      chunk_ids: int = CHUNK_IDS) -> None:
    """Write ``path``/chunks and ``path``/index for the documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, encode_whole)
        part = TaskContext.get().partitionId()
        seq = start = 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        n_held = 0

        def chunk() -> pa.RecordBatch:
            ids = np.concatenate(held).astype(np.uint32)
            columns = [[part], [seq], [start], [len(doc_ids)], [len(ids)], [doc_ids[0]], [doc_ids[-1]],
                       [doc_ids], [lengths], [to_planes(ids, bits)]]
            return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, _CHUNK_ARROW, strict=True)],
                                   schema=_CHUNK_ARROW)

        for batch in batches:
            at = 0
            batch_ids = batch.column(0).to_pylist()
            for texts in by_size(batch.column(1).to_pylist()):
                flat, counts = encoder.encode_many(texts)
                ends = np.cumsum(counts)
                held.append(np.insert(flat, ends, end_id))
                doc_ids += batch_ids[at:at + len(texts)]
                lengths += (counts + 1).tolist()
                n_held += len(flat) + len(texts)
                at += len(texts)
                if n_held >= chunk_ids:
                    yield chunk()
                    seq, start = seq + 1, start + n_held
                    held, doc_ids, lengths, n_held = [], [], [], 0
        if doc_ids:
            yield chunk()

    (ordered.mapInArrow(chunks, _CHUNK_SCHEMA).write.mode("overwrite")
     .option("compression", "none").parquet(f"{path}/chunks"))
    stored = spark.read.schema(_CHUNK_SCHEMA).parquet(f"{path}/chunks")
    n_bytes = F.aggregate("planes", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    index = (stored.join(_bases(stored), "part")
             .select("part", "seq", "n_docs", "n_ids", "first_doc", "last_doc",
                     (F.col("base") + F.col("part_start")).alias("start"), n_bytes.alias("n_bytes")))
    index.write.mode("overwrite").parquet(f"{path}/index")


def _bases(stored: DataFrame) -> DataFrame:
    """(part, base): ids before each part; one row per written partition."""
    per_part = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.broadcast(bases) if parts <= MAX_BROADCAST_PARTS else bases


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files; ``ids`` are the
    little-endian unsigned 32-bit ids, the end id included."""
    stored = spark.read.schema(_CHUNK_SCHEMA).parquet(f"{path}/chunks")
    based = stored.join(_bases(stored), "part").select(
        (F.col("base") + F.col("part_start")).alias("start"), "n_ids", "doc_ids", "doc_lengths", "planes")
    out = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, n_ids, doc_ids, lengths, planes = (batch.column(c)[row].as_py() for c in range(5))
                data = memoryview(from_planes(planes, n_ids).tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                ids = [bytes(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(start + starts, pa.int64()),
                                       pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], schema=out)

    return based.mapInArrow(documents, "id long, start long, n_tokens long, ids binary")
