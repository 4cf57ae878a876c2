"""Masked pseudo-likelihood scores (operator 2).

A small network predicts every token from both sides: the embeddings of the
``SIDE`` words before and after a masked position are concatenated, pass one
tanh layer and give the probability of the token's class; the token's share of
its class comes from the corpus counts. The sum of the conditional log
probabilities of all tokens is a document's pseudo-log-likelihood.

*Counts.* Word counts cover all documents (counted per task, summed in one
shuffle). A word that makes up at least ``SHARE`` of the corpus is a symbol of
its own, so there are at most ``1 / SHARE`` of them; any other word is one of
``OTHERS`` symbols by its hash. Inside a hash symbol every word has its own
share, its count over the symbol's mass: the counts stay a Spark table.

*Tokens.* After counting, texts are read once more and written as symbols, with the
hashes of the words of hash symbols beside them (``encode``). Classes, training and scores read that table.

*Classes.* Words that stand among the same neighbours share one of ``CLASSES``
classes, so a class tells which words a context allows: every symbol's neighbours are added up
as random vectors in one grouped sum, and the mean vectors are clustered. The driver holds one
vector a symbol.

*Training.* Every position of every document is a target once: a generator seeded by
the text deals the positions over the rounds. Each task
trains the current parameters on its own documents in numpy and emits the rows
of the parameter matrix it touched with the number of updates; one grouped sum
averages the rows over all tasks. What is gathered grows with the number of
tasks, and so with the input; the driver holds one averaged matrix, whose size
the parameters bound.

*Scores.* A narrow map over the symbols gives every word of a hash symbol the
share of a word counted once, which is also the floor of words that were never
counted. Those words, counted per document, are joined
with the counts, and the logarithms of those are added. None of these words is a
hot key: each makes up less than ``SHARE`` of the corpus.

Defined results: null and empty texts have no tokens and score 0 with a null
mean; repeated rows get equal scores; an empty table gives an empty result;
extra columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.session import cut_lineage, scratch_path

SHARE = 1e-5
OTHERS = 256
CLASSES = 48
SIDE = 2
DIM = 8
HIDDEN = 16
ROUNDS = 2
_BATCH = 4096
_TOGETHER = 1 << 18  # tokens taken together
_FLUSH = 300_000
_MEMO = 500_000
_SEED = 42  # of Spark's xxhash64


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens_of(text))
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Symbols(dict):
    """Word -> symbol, or for a word outside the vocabulary -1 - h with the upper 63 bits h of its hash (remembered)."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.limit = len(words) + _MEMO

    def __missing__(self, word: str) -> int:
        s = -1 - (xxhash.xxh64_intdigest(word, _SEED) >> 1)
        if len(self) < self.limit:
            self[word] = s
        return s


@dataclass
class MaskedLM:
    words: list[str]
    mass: np.ndarray  # tokens of each symbol
    class_of: np.ndarray  # of each symbol
    matrix: np.ndarray  # all parameters, DIM to a row
    tail: DataFrame | None = None  # (word_hash, n) of the words of hash symbols; stays on the driver

    def __post_init__(self) -> None:
        self._symbols: _Symbols | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_symbols", "tail")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._symbols = self.tail = None

    @property
    def n_symbols(self) -> int:
        return len(self.words) + OTHERS

    @property
    def log_share(self) -> np.ndarray:
        """log p(word | class) of each symbol; of a hash symbol, for a word counted once."""
        count = np.where(np.arange(len(self.mass)) < len(self.words), self.mass, 1.0)
        in_class = np.bincount(self.class_of, weights=self.mass, minlength=CLASSES)
        return np.log(count) - np.log(in_class[self.class_of])

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of a text's words, hashes of those that are hash symbols)."""
        if self._symbols is None:
            self._symbols = _Symbols(self.words)
        words = tokens_of(text)
        found = np.fromiter(map(self._symbols.__getitem__, words), dtype=np.int64, count=len(words))
        rare = found < 0
        hashes = -1 - found[rare]
        found[rare] = len(self.words) + hashes % OTHERS
        return found.astype(np.int32), hashes

    def ids(self, text: str) -> np.ndarray:
        return self.codes(text)[0]


def encode(docs: DataFrame, model: MaskedLM, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, written once: ``_ids`` (int32 symbols), ``_rare`` (hashes of the words of hash
    symbols), ``_seed`` (hash of the text) and ``_row`` (a number of its own)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by vocabulary x DIM

    @F.arrow_udf("struct<ids: binary, rare: binary, seed: bigint>")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lm = shared.value
        for batch in batches:
            texts = batch.to_pylist()
            found = [lm.codes(t) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([h.tobytes() for _, h in found], pa.binary()),
                 pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in texts], pa.int64())], names=["ids", "rare", "seed"])

    path = scratch_path(spark, "symbols")
    kept = [c for c in docs.columns if c != text_col]
    (docs.withColumn("_e", codes(F.coalesce(F.col(text_col), F.lit(""))))
     .select(*kept, F.col("_e.ids").alias("_ids"), F.col("_e.rare").alias("_rare"), F.col("_e.seed").alias("_seed"),
             F.monotonically_increasing_id().alias("_row")).write.parquet(path))
    return spark.read.parquet(path)


def padded(documents: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of documents with ``SIDE`` edge symbols between them, places of the documents' tokens)."""
    gap = np.full(SIDE, edge, dtype=np.int32)
    flat = np.concatenate([gap, *[x for d in documents for x in (d, gap)]])
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    starts = np.cumsum(sizes + SIDE) - sizes
    return flat, np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


_OFFSETS = np.array([k for k in range(-SIDE, SIDE + 1) if k])


def _documents(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first row, symbols of consecutive rows), about ``_TOGETHER`` tokens together."""
    group: list[np.ndarray] = []
    size = first = 0
    for k, x in enumerate(batch.column(column).to_pylist()):
        group.append(np.frombuffer(x, dtype=np.int32))
        size += len(group[-1])
        if size >= _TOGETHER:
            yield first, group
            group, size, first = [], 0, k + 1
    if group:
        yield first, group


_SHAPES = [(2 * SIDE * DIM, HIDDEN), (1, HIDDEN), (HIDDEN, CLASSES), (1, CLASSES)]


def _layers(matrix: np.ndarray, n_symbols: int) -> list[np.ndarray]:
    """The layers behind the embeddings, as views of the matrix."""
    flat, at, out = matrix.reshape(-1), (n_symbols + 1) * DIM, []
    for shape in _SHAPES:
        n = shape[0] * shape[1]
        out.append(flat[at:at + n].reshape(shape))
        at += n
    return out


class Network:
    """The window network: views of a parameter matrix, and its training step."""

    def __init__(self, matrix: np.ndarray, n_symbols: int):
        self.matrix = matrix
        self.embedding = matrix[:n_symbols + 1]
        self.w1, self.b1, self.w2, self.b2 = _layers(matrix, n_symbols)
        self.squares = np.full_like(matrix, 1e-8)
        self.square_parts = _layers(self.squares, n_symbols)

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embedding[context].reshape(len(context), -1)
        return x, np.tanh(x @ self.w1 + self.b1)

    def logits(self, context: np.ndarray) -> np.ndarray:
        return self.hidden(context)[1] @ self.w2 + self.b2

    def log_probabilities(self, context: np.ndarray, target_class: np.ndarray) -> np.ndarray:
        z = self.logits(context)
        z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(z)), target_class].astype(np.float64)
        return own - np.log(np.exp(z, out=z).sum(axis=1, dtype=np.float64))

    def step(self, context: np.ndarray, target_class: np.ndarray, rate: float) -> None:
        """One Adagrad step on a batch of masked positions."""
        n = len(context)
        x, h = self.hidden(context)
        z = h @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z, out=z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), target_class] -= 1.0
        p /= n
        dh = (p @ self.w2.T) * (1 - h * h)
        dx = (dh @ self.w1.T).reshape(-1, DIM)
        grads = [x.T @ dh, dh.sum(axis=0, keepdims=True), h.T @ p, p.sum(axis=0, keepdims=True)]
        for w, s, g in zip((self.w1, self.b1, self.w2, self.b2), self.square_parts, grads, strict=True):
            s += g * g
            w -= rate * g / np.sqrt(s)
        flat = context.reshape(-1)
        order = np.argsort(flat)
        ordered = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        symbols = ordered[starts]
        g = np.add.reduceat(dx[order], starts, axis=0)
        square = self.squares[symbols] + g * g
        self.squares[symbols] = square
        self.embedding[symbols] -= rate * g / np.sqrt(square)


def _rows_of(n_symbols: int) -> int:
    return -(-((n_symbols + 1) * DIM + sum(a * b for a, b in _SHAPES)) // DIM)


def _fresh_matrix(n_symbols: int, class_mass: np.ndarray, seed: int) -> np.ndarray:
    """Small random parameters whose output, before training, is near each class's share of the corpus."""
    rnd = np.random.default_rng(seed)
    matrix = (rnd.standard_normal((_rows_of(n_symbols), DIM)) * 0.1).astype(np.float32)
    _layers(matrix, n_symbols)[-1][:] = np.log(np.maximum(class_mass, 1.0) / class_mass.sum())
    return matrix


def initial_model(counts: DataFrame, share: float = SHARE, seed: int = 5) -> MaskedLM:
    """Vocabulary from the corpus counts, classes of equal mass by frequency, and random parameters."""
    least = max(1, math.ceil((counts.agg(F.sum("n").alias("n")).first()["n"] or 0) * share))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()  # at most 1 / share words
    words = [r["word"] for r in top]
    mass = np.ones(len(words) + OTHERS)
    mass[:len(words)] += [r["n"] for r in top]
    rest = counts.filter(F.col("n") < least).select(F.shiftrightunsigned(F.xxhash64("word"), 1).alias("word_hash"), "n")
    for r in rest.groupBy(F.pmod("word_hash", F.lit(OTHERS)).alias("other")).agg(F.sum("n").alias("n")).collect():
        mass[len(words) + r["other"]] += r["n"]
    order = np.argsort(-mass, kind="stable")
    middle = np.cumsum(mass[order]) - mass[order] / 2
    class_of = np.zeros(len(mass), dtype=np.int64)
    class_of[order] = np.minimum((middle / mass.sum() * CLASSES).astype(np.int64), CLASSES - 1)
    matrix = _fresh_matrix(len(mass), np.bincount(class_of, weights=mass, minlength=CLASSES), seed)
    tail = rest.filter(F.col("n") > 1).groupBy("word_hash").agg(F.sum("n").alias("n"))  # a count of 1 adds log 1
    return MaskedLM(words, mass, class_of, matrix, tail)


_NAMES = [f"v{k}" for k in range(DIM)]


def _summed_rows(partial: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, weights, weighted sums) of matrix rows over all tasks: one row a matrix row reaches the driver."""
    table = (partial.groupBy("row").agg(F.sum("weight").alias("weight"), *[F.sum(c).alias(c) for c in _NAMES])).toArrow()
    values = np.stack([table.column(c).to_numpy() for c in _NAMES], axis=1)
    return table.column("row").to_numpy(), table.column("weight").to_numpy(), values


_SUM_TYPE = "row int, weight double, " + ", ".join(f"{c} float" for c in _NAMES)


def _sum_batch(rows: np.ndarray, weight: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows.astype(np.int32)), pa.array(weight.astype(np.float64)),
                            *[pa.array(np.ascontiguousarray(values[:, k]).astype(np.float32)) for k in range(DIM)]],
                           names=["row", "weight", *_NAMES])


def context_classes(encoded: DataFrame, model: MaskedLM, seed: int = 5) -> MaskedLM:
    """``model`` with classes of symbols that have like neighbours, and parameters to match."""
    n = model.n_symbols
    rnd = np.random.default_rng(seed)
    vectors = rnd.standard_normal((n + 1, DIM)).astype(np.float32)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((n, DIM)), np.zeros(n)
        for batch in batches:
            for _, documents in _documents(batch, "_ids"):
                flat, at = padded(documents, n)
                if len(at):
                    around = vectors[flat[at - 1]] + vectors[flat[at + 1]]
                    own = flat[at]
                    seen += np.bincount(own, minlength=n)
                    for k in range(DIM):
                        sums[:, k] += np.bincount(own, weights=around[:, k], minlength=n)
        some = np.flatnonzero(seen)
        yield _sum_batch(some, seen[some], sums[some])

    rows, weights, values = _summed_rows(encoded.select("_ids").mapInArrow(neighbours, _SUM_TYPE))
    if not len(rows):
        return model
    points = np.zeros((n, DIM))
    points[rows] = values / weights[:, None]
    # what sets a symbol's neighbours apart from those of all, by direction only
    points -= np.average(points, axis=0, weights=model.mass)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    class_of = _clusters(points, model.mass, CLASSES, seed)
    mass = np.bincount(class_of, weights=model.mass, minlength=CLASSES)
    return replace(model, class_of=class_of, matrix=_fresh_matrix(n, mass, seed))


def _clusters(points: np.ndarray, mass: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    """Weighted k-means; starts are drawn by mass and distance from the starts so far."""
    rnd = np.random.default_rng(seed)
    centres = points[[int(np.argmax(mass))]]
    nearest = np.full(len(points), np.inf)
    while len(centres) < k:
        nearest = np.minimum(nearest, ((points - centres[-1]) ** 2).sum(axis=1))
        odds = mass * nearest
        if not odds.sum():
            break
        centres = np.vstack([centres, points[rnd.choice(len(points), p=odds / odds.sum())]])
    for _ in range(turns):
        distance = (centres ** 2).sum(axis=1)[None] - 2 * points @ centres.T
        of = distance.argmin(axis=1)
        total = np.bincount(of, weights=mass, minlength=len(centres))
        for d in range(points.shape[1]):
            centres[:, d] = np.where(total > 0, np.bincount(of, weights=mass * points[:, d], minlength=len(centres)) / np.maximum(total, 1e-9), centres[:, d])
    return of.astype(np.int64)


def train_round(encoded: DataFrame, model: MaskedLM, turn: int, rounds: int = ROUNDS, rate: float = 0.1) -> np.ndarray:
    """The parameter matrix after every task trained on its documents and the rows were averaged. The
    positions that ``turn`` has for targets are those of no other turn."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = shared.value
        n = lm.n_symbols
        net = Network(lm.matrix.copy(), n)
        touched = np.zeros(len(net.matrix))
        for batch in batches:
            seeds = batch.column("_seed").to_numpy()
            for first, documents in _documents(batch, "_ids"):
                flat, at = padded(documents, n)
                dealt = np.concatenate([np.random.default_rng(int(seeds[first + i])).integers(0, rounds, len(d), dtype=np.int8)
                                        for i, d in enumerate(documents)])
                at = at[dealt == turn]
                np.random.default_rng(len(at)).shuffle(at)  # a step sees positions of many documents
                for a in range(0, len(at), _BATCH):
                    some = at[a:a + _BATCH]
                    context = flat[some[:, None] + _OFFSETS]
                    net.step(context, lm.class_of[flat[some]], rate)
                    touched[:n + 1] += np.bincount(context.reshape(-1), minlength=n + 1)
                touched[n + 1:] += len(at)
        rows = np.flatnonzero(touched)
        yield _sum_batch(rows, touched[rows], net.matrix[rows] * touched[rows, None])

    rows, weights, values = _summed_rows(encoded.select("_ids", "_seed").mapInArrow(train, _SUM_TYPE))
    matrix = model.matrix.copy()
    if len(rows):
        matrix[rows] = values / weights[:, None]
    return matrix


def fit_encoded(encoded: DataFrame, model: MaskedLM, rounds: int = ROUNDS) -> MaskedLM:
    """Classes from contexts, then ``rounds`` rounds of training over all documents."""
    model = context_classes(encoded, model)
    for turn in range(rounds):
        model = replace(model, matrix=train_round(encoded, model, turn, rounds, rate=0.1 / (turn + 1)))
    return model


def fit(docs: DataFrame, text_col: str = "text", share: float = SHARE, rounds: int = ROUNDS) -> MaskedLM:
    """Count, encode and train over all documents."""
    model = initial_model(cut_lineage(word_counts(docs, text_col)), share)
    return fit_encoded(encode(docs.select(text_col), model, text_col), model, rounds)


def rare_words(encoded: DataFrame) -> DataFrame:
    """(_row, word_hash, times): the distinct words of hash symbols of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(x, dtype=np.int64), return_counts=True) for x in batch.column("_rare").to_pylist()]
            if found:
                yield pa.record_batch([pa.array(np.repeat(batch.column("_row").to_numpy(), [len(h) for h, _ in found])),
                                       pa.array(np.concatenate([h for h, _ in found])),
                                       pa.array(np.concatenate([c for _, c in found]).astype(np.int32))], names=["_row", "word_hash", "times"])

    return encoded.select("_row", "_rare").mapInArrow(rows, "_row long, word_hash long, times int")


def score_encoded(encoded: DataFrame, model: MaskedLM) -> DataFrame:
    """The rows of ``encode`` with n_tokens, log_likelihood (sum over tokens) and mean_log_likelihood."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)  # bounded by vocabulary x DIM

    @F.arrow_udf("struct<n_tokens: bigint, log_likelihood: double>")
    def likelihood(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lm = shared.value
        net, log_share = Network(lm.matrix, lm.n_symbols), lm.log_share
        for batch in batches:
            sizes, totals = [], []
            for _, documents in _documents(pa.record_batch([batch], names=["_ids"]), "_ids"):
                flat, at = padded(documents, lm.n_symbols)
                own = flat[at]
                logs = log_share[own]
                for a in range(0, len(at), 2 * _BATCH):
                    some = at[a:a + 2 * _BATCH]
                    logs[a:a + 2 * _BATCH] += net.log_probabilities(flat[some[:, None] + _OFFSETS], lm.class_of[flat[some]])
                ends = np.cumsum([len(d) for d in documents])
                sizes += [len(d) for d in documents]
                totals += [float(logs[e - len(d):e].sum()) for d, e in zip(documents, ends, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(totals, pa.float64())], names=["n_tokens", "log_likelihood"])

    adds = (rare_words(encoded).join(model.tail, "word_hash").groupBy("_row")
            .agg(F.sum(F.col("times") * F.log("n")).alias("_counted")))
    scored = encoded.withColumn("_lm", likelihood(F.col("_ids"))).drop("_ids", "_rare", "_seed").join(adds, "_row", "left")
    total = F.col("_lm.log_likelihood") + F.coalesce("_counted", F.lit(0.0))
    kept = [c for c in encoded.columns if c not in ("_ids", "_rare", "_seed", "_row", "n_tokens", "log_likelihood", "mean_log_likelihood")]
    return scored.select(*kept, F.col("_lm.n_tokens").alias("n_tokens"), total.alias("log_likelihood"),
                         F.try_divide(total, F.col("_lm.n_tokens")).alias("mean_log_likelihood"))


def score(docs: DataFrame, model: MaskedLM, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, log_likelihood and mean_log_likelihood by ``model``."""
    texts = docs.withColumn("_text", F.col(text_col))  # ``encode`` leaves the text itself out
    return score_encoded(encode(texts, model, text_col), model).withColumnRenamed("_text", text_col)


def fit_and_score(docs: DataFrame, text_col: str = "text", share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``score`` of the documents, without their texts, by the model that is trained on them, with one pass that encodes them."""
    model = initial_model(cut_lineage(word_counts(docs, text_col)), share)
    encoded = encode(docs, model, text_col)
    return score_encoded(encoded, fit_encoded(encoded, model, rounds))
