"""Toxicity scores by weak supervision (operator 4).

1. *Voters.* A bounded sample of labelled rows gives lexicon and pattern
   voters: whole words, word beginnings and word endings that stand far more
   often in toxic than in other texts (lower bound of the log-odds), besides a
   small given lexicon. Each votes "toxic" where it occurs and abstains
   elsewhere; count voters vote on the number of hits, one votes "clean" where
   nothing hits, and the label itself is one more voter with an error rate of
   its own.
2. *Label model.* A generative model with a hidden class estimates by EM each
   voter's accuracy and, from residuals given the class, the correlations
   between voters. Correlated voters share one voice: a voter's log-likelihood
   ratio is divided by the sum of its correlations.
3. *Classifier.* The posterior labels train a logistic regression over word
   evidence of a text. It scores every whole text in a narrow map.

Sample bound (documented parameters): ``max_toxic`` + ``max_clean`` labelled
rows, those with the smallest hash of their id, one of each group of near
copies. Candidate patterns are counted by Spark over the sample; only the
``max_voters`` best and the sample's sparse votes reach the driver. All
documents are scored whole. Labels, language, source and id are no inputs.

Defined results: null and empty texts have no words and get the score of the
classifier's other inputs at zero; without both classes among the labels the
given lexicon alone scores; a document with several labels is toxic if one says
so; rows repeating an id are scored each; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.session import cut_lineage

#: Given lexicon: insults and slurs of everyday use.
LEXICON = frozenset("""
    idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown imbecile filthy vermin freak
    bastard bitch asshole shit fuck dickhead wanker crap cretin degenerate retard whore slut
    idiot dummkopf arschloch scheisse abschaum connard salaud ordure imbécile idiota estúpido basura escoria imbécil
""".split())
WORDS = re.compile(r"[^\W\d_]+")
AFFIXES = range(3, 7)
_FLUSH = 200_000
_MEMO = 300_000


def words_of(text: str) -> Counter:
    return Counter(WORDS.findall(text.lower()))


def word_keys(word: str) -> list[str]:
    """The pattern keys a word may hit: itself, its beginnings and its endings."""
    keys = ["w:" + word]
    for k in AFFIXES:
        if len(word) > k:
            keys += ["p:" + word[:k], "s:" + word[-k:]]
    return keys


@dataclass
class Evidence:
    """The voters: pattern key -> number, and the log-odds of each."""

    number: dict[str, int]
    log_odds: np.ndarray

    def __post_init__(self) -> None:
        self._memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"number": self.number, "log_odds": self.log_odds}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._memo = {}

    def hits_of(self, word: str) -> tuple[int, ...]:
        found = self._memo.get(word)
        if found is None:
            if len(self._memo) > _MEMO:
                self._memo.clear()
            found = tuple(n for n in map(self.number.get, word_keys(word)) if n is not None)
            self._memo[word] = found
        return found

    def summary(self, text: str) -> tuple[list[float], dict[int, int]]:
        """(dense inputs, hits of each voter) of one text."""
        words = words_of(text)
        total = sum(words.values())
        hits: dict[int, int] = {}
        n_hits = n_types = n_given = 0
        weight = 0.0
        for word, n in words.items():
            found = self.hits_of(word)
            n_given += n * (word in LEXICON)
            if found:
                n_hits += n
                n_types += 1
                weight += float(self.log_odds[list(found)].max()) * min(n, 3)
                for v in found:
                    hits[v] = hits.get(v, 0) + n
        share = n_hits / total if total else 0.0
        dense = [float(n_hits >= 1), float(n_hits >= 2), float(n_hits >= 3), float(n_types >= 2), float(n_types >= 3),
                 np.log1p(n_hits), np.log1p(weight), min(share * 20, 3.0), np.log1p(n_given), float(n_given >= 2)]
        return dense, hits


N_DENSE = 10


def _pattern_counts(sample: DataFrame) -> DataFrame:
    """(key, toxic, clean): sample texts of each class in which a pattern occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.record_batch([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                   pa.array([seen[0][k] for k in keys], pa.int64())], names=["key", "toxic", "clean"])
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update({k for w in words_of(text) for k in word_keys(w)})
                if len(seen[0]) + len(seen[1]) > _FLUSH:
                    yield flush()
        yield flush()

    return (sample.select("text", "label").mapInArrow(count, "key string, toxic long, clean long")
            .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _near_copy_key(text: Column) -> Column:
    """Equal for copies and mostly for near copies: the smallest hashes of a text's words."""

    @F.pandas_udf("string")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(["-".join(f"{h:x}" for h in sorted(xxhash.xxh64_intdigest(w) for w in words_of(t))[:3])
                             for t in batch], dtype=object)

    return key(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int,
                    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of at most ``max_toxic`` + ``max_clean`` labelled ids, written once."""
    label = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    ranked = label.withColumn("h", F.xxhash64("id"))
    picked = (ranked.filter("label = 1").orderBy("h", "id").limit(max_toxic)
              .union(ranked.filter("label = 0").orderBy("h", "id").limit(max_clean)).select("id", "label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # at most max_toxic + max_clean rows of two numbers
    found = cut_lineage(texts.join(F.broadcast(picked), "id").withColumn("copy", _near_copy_key(F.col("text"))))
    one = found.groupBy("copy", "label").agg(F.min("id").alias("id")).drop("copy")
    # rows that repeat an id: its smallest text, so that the sample's bound holds
    return found.join(F.broadcast(one), ["id", "label"]).groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")


def choose_voters(counts: DataFrame, n_toxic: int, n_clean: int, max_voters: int, least_log_odds: float = 1.0) -> Evidence:
    """The patterns with the highest lower bound (95 %) of their log-odds."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.ln(t / (n_toxic + 1)) - F.ln(c / (n_clean + 1))
    best = (counts.filter("toxic >= 3").withColumn("odds", odds)
            .withColumn("low", odds - 1.64 * F.sqrt(1 / t + 1 / c)).filter(F.col("low") >= least_log_odds)
            .orderBy(F.desc("low"), "key").limit(max_voters).select("key", "odds").collect())
    return Evidence({r["key"]: i for i, r in enumerate(best)}, np.array([r["odds"] for r in best], dtype=np.float64))


def _sample_votes(sample: DataFrame, evidence: Evidence, at_most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense inputs, hits of each voter, labels) of the sample rows, on the driver."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [evidence.summary(t) for t in batch["text"]]
            yield pd.DataFrame({"dense": [d for d, _ in rows], "voter": [list(h) for _, h in rows],
                                "hits": [list(h.values()) for _, h in rows], "label": batch["label"].to_numpy()})

    schema = "dense array<double>, voter array<int>, hits array<int>, label int"
    rows = sample.mapInPandas(votes, schema).limit(at_most).collect()
    dense = np.array([r["dense"] for r in rows], dtype=np.float64).reshape(len(rows), N_DENSE)
    hits = np.zeros((len(rows), len(evidence.number)), dtype=np.float32)
    for i, r in enumerate(rows):
        hits[i, r["voter"]] = r["hits"]
    return dense, hits, np.array([r["label"] for r in rows], dtype=np.int64)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM of the generative model; ``votes`` is 0/1 (rows x voters).

    A voter's 0 is an abstention and says nothing, except for the two voters
    that vote both ways: "no voter hit" (the last column) and the label. Labels
    are taken to be right in 90 to 99.5 % of either class and set the class
    balance; without that anchor one-sided voters could claim every row.

    Returns (posterior of class 1, accuracies P(vote | class) as 2 x voters,
    correlations between voters given the class)."""
    all_votes = np.column_stack([votes, labels]).astype(np.float64)
    m = all_votes.shape[1]
    both_ways = np.arange(m) >= m - 2
    q = np.where(labels == 1, 0.9, 0.05)
    shares = np.eye(m)
    weights = np.ones(m)
    prior = np.log((labels.sum() + 1) / ((1 - labels).sum() + 1))
    for step in range(rounds):
        mass = np.array([(1 - q).sum(), q.sum()])
        p = np.stack([((1 - q) @ all_votes + 0.5) / (mass[0] + 1), (q @ all_votes + 0.5) / (mass[1] + 1)])
        p[:, -1] = np.clip(p[:, -1], [0.005, 0.9], [0.1, 0.995])
        if step % 5 == 0:
            rest = all_votes - (1 - q)[:, None] * p[0] - q[:, None] * p[1]
            spread = np.sqrt((rest * rest).sum(axis=0)) + 1e-9
            shares = (rest.T @ rest) / spread / spread[:, None]
            strong = np.where(np.abs(shares) > 0.1, np.abs(shares), 0.0)
            np.fill_diagonal(strong, 1.0)
            weights = 1.0 / strong.sum(axis=0)
            weights[-1] = 1.0
        yes, no = np.log(p[1] / p[0]), np.where(both_ways, np.log((1 - p[1]) / (1 - p[0])), 0.0)
        odds = prior + all_votes @ (weights * (yes - no)) + (weights * no).sum()
        q = 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))
    return q, p, shares


@dataclass
class ToxicityModel:
    evidence: Evidence
    weights: np.ndarray  # dense inputs, then log hits of each voter
    bias: float

    def score(self, text: str) -> float:
        dense, hits = self.evidence.summary(text)
        z = self.bias + float(self.weights[:N_DENSE] @ dense)
        for v, n in hits.items():
            z += self.weights[N_DENSE + v] * np.log1p(n)
        return float(1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0))))


def train_classifier(x: np.ndarray, q: np.ndarray, rounds: int = 500, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (full-batch Adam)."""
    w, b = np.zeros(x.shape[1]), float(np.log((q.sum() + 1) / ((1 - q).sum() + 1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    decay = np.concatenate([np.full(N_DENSE, l2 / 10), np.full(len(w) - N_DENSE, l2 * 3)])
    for t in range(1, rounds + 1):
        error = 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -30, 30))) - q
        g = np.append(x.T @ error / len(q) + decay * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_toxic: int = 4000, max_clean: int = 6000, max_voters: int = 400) -> ToxicityModel:
    """Learn a model from the rows of ``labels`` (all of them may be used)."""
    sample = labelled_sample(docs, labels, max_toxic, max_clean, id_col, text_col, label_col)
    sample = cut_lineage(sample)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        given = Evidence({}, np.zeros(0))
        weights = np.zeros(N_DENSE)
        weights[N_DENSE - 2:] = [2.0, 2.0]
        return ToxicityModel(given, weights, -3.0)
    evidence = choose_voters(_pattern_counts(sample), n_toxic, n_clean, max_voters)
    dense, hits, y = _sample_votes(sample, evidence, max_toxic + max_clean)
    votes = np.column_stack([hits > 0, dense[:, 1:5] > 0, dense[:, -1] > 0, dense[:, 0] == 0])
    q, _, _ = label_model(votes, y)
    w, b = train_classifier(np.column_stack([dense, np.log1p(hits)]), q)
    return ToxicityModel(evidence, w, b)


def score(text: Column, model: ToxicityModel) -> Column:
    """Column expression: the score (0 to 1) of a text."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return toxicity(F.coalesce(text, F.lit("")))


def in_training_fold(id_col: Column) -> Column:
    """Rows that may teach: crc32 of the id as text is not divisible by 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = 0.5, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    model = fit(docs, labels, id_col, text_col, **bounds)
    return docs.filter(score(F.col(text_col), model) < threshold)
