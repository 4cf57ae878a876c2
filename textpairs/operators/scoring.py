"""Pair scoring as a batch job: user scorer in mini-batches (G1) with
quarantine (G8); built-in smoothed language-model scorer (G2) and its
direction (G3); multi-reference aggregation (G4); system comparison (G5);
correlation with human judgements (G6); score report (G7).

G2 is a query-likelihood model (Zhai & Lafferty, 2001): score(s | d) is the
mean over summary words w of ln(lam * tf(w,d)/len(d) + (1-lam) * p(w)), with
p(w) the add-one background probability of a corpus. Scores are
log-likelihoods: negative, higher is better. They are not the scores of the
reference's neural model and are not presented as such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from textpairs.functions.multisets import codes, lengths, token_slices
from textpairs.functions.text import lm_tokens
from textpairs.operators.joins import heavy_left_join, with_key_rows
from textpairs.operators.metrics import background_counts, background_p
from textpairs.operators.ranking import average_rank
from textpairs.session import cut_lineage

# fixed values: scoring batch sizes of the reference (function default, script)
SCORE_BATCH = 8
SCRIPT_SCORE_BATCH = 4
LAMBDA = 0.5


#: Words that hold at least this share of the corpus are looked up in a broadcast table.
HEAVY_SHARE = 1e-6


class LM:
    """A fitted background model: word probabilities, those of the frequent words apart, and the unseen floor."""

    def __init__(self, p: DataFrame, C: int, V: int, heavy: DataFrame):
        self.p, self.C, self.V, self.heavy = p, C, V, heavy
        self.floor = 1.0 / float(C + V + 1)


def fit_lm(corpus: DataFrame, text_col: str = "text") -> LM:
    """G2 (fit): unigram background model of a corpus."""
    cf, C, V = background_counts(corpus, text_col)
    heavy = cf.filter(F.col("cf") >= F.lit(HEAVY_SHARE * C))  # at most 1 / HEAVY_SHARE words
    return LM(background_p(cf, C, V), C, V, background_p(heavy, C, V))


def lm_scores(df: DataFrame, lm: LM, key: str | Sequence[str], source_col: str, target_cols: Mapping[str, str],
              lam: float = LAMBDA) -> DataFrame:
    """G2 (score) of several targets of one source: ``key``, and for each name in ``target_cols`` the columns
    ``score_<name>`` and ``n_<name>`` (words of the target; the score of an empty one is null).

    Texts are dealt out by key and counted in their own row, a source once for all targets. The frequent words of a
    target, at most ``1 / HEAVY_SHARE`` of them, find p(w) there too; a row leaves one entry with their sums and one
    for each other distinct word of its targets, which look up p(w) in a shuffle join (hashed: a word stands there
    once) and are summed by key where they meet it. Rows that
    share a key count together: all their words become entries and are added up by word first."""
    keys = [key] if isinstance(key, str) else list(key)
    names = list(target_cols)
    texts = [F.col(source_col).alias("_t0"), *[F.col(target_cols[n]).alias(f"_t{i}") for i, n in enumerate(names, 1)]]
    dealt = with_key_rows(df.select(*keys, *texts), keys, "_rows")
    rows = dealt.select(*keys, (F.col("_rows") == 1).alias("_alone"), *[lm_tokens(f"_t{i}").alias(f"_t{i}") for i in range(len(names) + 1)])
    counts = [f"_n{i}" for i in range(len(names) + 1)]
    sums = [x for i in range(1, len(names) + 1) for x in (f"_ll{i}", f"_all{i}")]
    kept = [*keys, "_alone"]
    ex = (rows.mapInArrow(_count_words(kept, len(names), lm, lam), StructType([*[rows.schema[k] for k in kept], *_counted(counts, sums)]))
          .select(*kept, "_len", *sums, F.explode("_entries").alias("z")).select(*kept, "_len", *sums, "z.*"))
    j = heavy_left_join(ex, lm.p.hint("shuffle_hash"), "w", lm.heavy, int(1 / HEAVY_SHARE), F.xxhash64(*keys, "w"))
    p = F.coalesce(F.col("p"), F.lit(lm.floor))
    rel = F.when(F.col("_len") > 0, F.col("_n0") / F.col("_len")).otherwise(F.lit(0.0))
    ll = F.log(F.lit(lam) * rel + F.lit(1.0 - lam) * p)
    scored = [F.when(F.col(f"_n{i}") > 0, F.col(f"_n{i}") * ll) for i in range(1, len(names) + 1)]
    # the entry without a word carries its row's sums; a word's entry is a sum of its own unless the key is shared
    whole, settled = F.col("w").isNull(), F.col("w").isNull() | F.col("_alone")
    by_word = j.groupBy(*keys, F.when(~settled, F.col("w")).alias("_word")).agg(
        F.max("_len").alias("_len"), F.max("p").alias("p"), *[F.sum(c).alias(c) for c in counts],
        *[x for i, s in enumerate(scored, 1) for x in (
            F.sum(F.when(whole, F.col(f"_ll{i}")).when(settled, s)).alias(f"_ll{i}"),
            F.sum(F.when(whole, F.col(f"_all{i}")).when(settled, F.col(f"_n{i}"))).alias(f"_all{i}"))])
    done = F.col("_word").isNull()
    g = by_word.groupBy(*keys).agg(*[x for i, s in enumerate(scored, 1) for x in (
        F.sum(F.when(done, F.col(f"_ll{i}")).otherwise(s)).alias(f"_ll{i}"),
        F.sum(F.when(done, F.col(f"_all{i}")).otherwise(F.col(f"_n{i}"))).alias(f"_all{i}"))])
    return g.select(*keys, *[x for i, n in enumerate(names, 1) for x in (
        (F.col(f"_ll{i}") / F.when(F.col(f"_all{i}") > 0, F.col(f"_all{i}"))).alias(f"score_{n}"), F.col(f"_all{i}").alias(f"n_{n}"))])


def _counted(counts: Sequence[str], sums: Sequence[str]) -> list[StructField]:
    """What ``_count_words`` adds to the columns kept."""
    entry = StructType([StructField("w", StringType()), *[StructField(c, LongType()) for c in counts]])
    return [StructField("_len", LongType()), *[StructField(c, DoubleType() if c.startswith("_ll") else LongType()) for c in sums],
            StructField("_entries", ArrayType(entry))]


def _count_words(kept: Sequence[str], n_targets: int, lm: LM, lam: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the words of each row's source ``_t0`` and targets ``_t1``, ... (see ``lm_scores``)."""
    heavy = lm.heavy.select("w", "p").limit(int(1 / HEAVY_SHARE) + 1).toArrow()  # at most 1 / HEAVY_SHARE words
    frequent, shares = heavy.column("w").combine_chunks().cast(pa.string()), heavy.column("p").to_numpy()

    def part(alone: np.ndarray, sides: list[pa.Array]) -> list[pa.Array]:
        n = len(alone)
        sizes = [lengths(side) for side in sides]
        owners = [np.repeat(np.arange(n), size) for size in sizes]
        words, single = codes(sides)
        many = max(len(words), 1)
        # (row, word) of every word of a target, and of every word where a key is shared
        held = [np.unique(o * many + c, return_counts=True) for o, c in zip(owners, single, strict=True)]
        pairs = np.sort(np.concatenate([held[0][0][~alone[held[0][0] // many]], *[h for h, _n in held[1:]]]))
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        found = []
        for h, times in held:
            at = np.searchsorted(h, pairs)
            found.append(np.where(np.append(h, -1)[at] == pairs, np.append(times, 0)[at], 0))
        row, word = pairs // many, pairs % many
        place = pc.index_in(words, value_set=frequent).to_numpy(zero_copy_only=False)
        p = np.where(np.isnan(place), np.nan, np.append(shares, np.nan)[np.nan_to_num(place, nan=len(shares)).astype(np.int64)])[word]
        here = alone[row] & ~np.isnan(p)
        rel = found[0][here] / np.maximum(sizes[0], 1)[row[here]]
        ll = np.log(lam * rel + (1.0 - lam) * p[here])
        sums = []
        for times in found[1:]:
            # (without a single frequent word, bincount counts in integers)
            sums += [pa.array(np.bincount(row[here], weights=times[here] * ll, minlength=n).astype(np.float64)),
                     pa.array(np.bincount(row[here], weights=times[here], minlength=n).astype(np.int64))]
        # one entry without a word before those of each row
        left = np.flatnonzero(~here)
        before = np.searchsorted(row[left], np.arange(n + 1))
        ends = before + np.arange(n + 1)
        order = np.full(ends[-1], -1, dtype=np.int64)
        order[np.arange(len(left)) + row[left] + 1] = left
        entry_words = words.take(pa.array(np.append(word, 0)[order], mask=order < 0))
        entry_counts = [pa.array(np.append(times, 0)[order]) for times in found]
        entries = pa.StructArray.from_arrays([entry_words, *entry_counts], ["w", *[f"_n{i}" for i in range(n_targets + 1)]])
        return [pa.array(sizes[0]), *sums, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*kept, "_len", *[x for i in range(1, n_targets + 1) for x in (f"_ll{i}", f"_all{i}")], "_entries"]
        for batch in batches:
            for a, b in token_slices([batch.column(f"_t{i}") for i in range(n_targets + 1)]):
                rows = batch.slice(a, b - a)
                made = part(rows.column("_alone").to_numpy(zero_copy_only=False).astype(bool), [rows.column(f"_t{i}") for i in range(n_targets + 1)])
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in kept], *made], names)

    return run


def lm_score(df: DataFrame, lm: LM, key: str | Sequence[str], source_col: str = "document",
             target_col: str = "summary", lam: float = LAMBDA, out: str = "score") -> DataFrame:
    """G2 (score): one row per pair with ``score`` and ``score_error``. An empty summary
    gives a null score and the reason instead of dropping the pair."""
    keys = [key] if isinstance(key, str) else list(key)
    g = lm_scores(df, lm, keys, source_col, {"t": target_col}, lam)
    return g.select(*keys, F.col("score_t").alias(out),
                    F.when(F.col("n_t") == 0, F.lit("empty_target")).otherwise(F.lit(None).cast("string")).alias("score_error"))


def score_systems(df: DataFrame, lm: LM, key: str, source_col: str, systems: Mapping[str, str], lam: float = LAMBDA) -> DataFrame:
    """``key, system, score`` of every system's summary of a document (``systems``: name -> column)."""
    wide = lm_scores(df, lm, key, source_col, systems, lam)
    return wide.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("system"), F.col(f"score_{n}").alias("score"))
                                                for n in systems])).alias("x")).select(key, "x.system", "x.score")


def directed(df: DataFrame, direction: str, document_col: str = "document",
             summary_col: str = "summary") -> DataFrame:
    """G3: "forward" scores the summary given the document; "reverse" scores
    the document given the summary (faithfulness). Returns source/target."""
    if direction == "forward":
        src, tgt = document_col, summary_col
    elif direction == "reverse":
        src, tgt = summary_col, document_col
    else:
        raise ValueError(f"direction must be forward or reverse, not {direction!r}")
    return df.withColumn("_src", F.col(src)).withColumn("_tgt", F.col(tgt))


def multi_ref_score(expanded: DataFrame, lm: LM, aggs: Sequence[str] = ("max",), key: str = "candidate_id",
                    candidate_col: str = "candidate", reference_col: str = "reference") -> DataFrame:
    """Score every (candidate, reference) row (reference given candidate, as
    the plan's call passes candidates first) and aggregate per candidate."""
    scored = lm_score(expanded, lm, [key, "ref_no"], candidate_col, reference_col)
    known = {"max": F.max, "mean": F.avg}
    return scored.groupBy(key).agg(*[known[a]("score").alias(f"score_{a}") for a in aggs],
                                   F.count(F.lit(1)).alias("n_refs"))


def compare_systems(scores: DataFrame, pair_col: str = "pair_id", system_col: str = "system",
                    score_col: str = "score", digits: int = 9) -> DataFrame:
    """A system wins a pair when its score is strictly the highest there.
    Per system: pairs, mean score, wins, ties for first, win rate. Scores are
    compared at ``digits`` decimals, so equal texts tie however the sums ran."""
    w = Window.partitionBy(pair_col)
    s = scores.withColumn("_cmp", F.round(score_col, digits))
    s = (s.withColumn("_best", F.max("_cmp").over(w))
         .withColumn("_n_best", F.sum(F.when(F.col("_cmp") == F.col("_best"), 1).otherwise(0)).over(w)))
    top = F.col("_cmp") == F.col("_best")
    return s.groupBy(system_col).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(score_col).alias("mean_score"),
        F.sum(F.when(top & (F.col("_n_best") == 1), 1).otherwise(0)).cast("bigint").alias("wins"),
        F.sum(F.when(top & (F.col("_n_best") > 1), 1).otherwise(0)).cast("bigint").alias("ties")
    ).withColumn("win_rate", F.col("wins") / F.col("pairs"))


def correlate(df: DataFrame, score_col: str, judgements: Sequence[str]) -> DataFrame:
    """Pearson and Spearman (Pearson on average ranks) of the score with
    each human judgement column; one row per (judgement, method).

    The (score, judgements) table is checkpointed once in the shared folder,
    so the rank steps read it instead of recomputing the scores."""
    df = cut_lineage(df.select(score_col, *judgements))
    ranked = average_rank(df, score_col, "_rank_score")
    for j in judgements:
        ranked = average_rank(ranked, j, f"_rank_{j}")
    aggs = []
    for j in judgements:
        aggs += [F.corr(score_col, F.col(j).cast("double")).alias(f"pearson__{j}"),
                 F.corr("_rank_score", f"_rank_{j}").alias(f"spearman__{j}")]
    wide = ranked.agg(F.count(F.lit(1)).alias("n"), *aggs)
    pairs = ", ".join(f"'{j}', '{m}', `{m}__{j}`" for j in judgements for m in ("pearson", "spearman"))
    return wide.selectExpr("n", f"stack({2 * len(judgements)}, {pairs}) AS (judgement, method, value)")


def score_report(df: DataFrame, position_col: str, document_col: str, summary_col: str,
                 score_col: str = "score", width: int = 50) -> DataFrame:
    """1-based pair number, document preview of ``width`` characters and
    ``...``, the summary and the score to 4 places."""
    return df.select(F.col(position_col).alias("pair_no"),
                     F.concat(F.substring(document_col, 1, width), F.lit("...")).alias("document_preview"),
                     F.col(summary_col).alias("summary"), F.round(score_col, 4).alias("score"))


class Scorer(Protocol):
    """User scorer for G1: ``open()`` once per task, then ``score`` per batch."""

    def open(self) -> None: ...

    def score(self, sources: list[str], targets: list[str]) -> list[float]: ...


def score_pairs(df: DataFrame, make_scorer: Callable[[], Scorer], key: str,
                source_col: str = "document", target_col: str = "summary",
                batch_size: int = SCORE_BATCH) -> DataFrame:
    """G1 + G8: score pairs with a user scorer in mini-batches of ``batch_size``
    inside ``mapInPandas``; the scorer (a model) is opened once per task.

    A batch that raises is retried row by row; rows that still fail get a null
    score and the error text, and every other row keeps its score.
    Select and filter *before* calling: nothing pushes through ``mapInPandas``.
    """
    kdt = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        scorer.open()
        for pdf in batches:
            keys, scores, errors = [], [], []
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                srcs = chunk[source_col].tolist()
                tgts = chunk[target_col].tolist()
                try:
                    got = list(scorer.score(srcs, tgts))
                    if len(got) != len(srcs):
                        raise ValueError(f"scorer returned {len(got)} scores for {len(srcs)} pairs")
                    errs = [None] * len(got)
                except Exception:  # noqa: BLE001 - isolate the failing rows
                    got, errs = [], []
                    for s, t in zip(srcs, tgts):
                        try:
                            got.append(float(scorer.score([s], [t])[0]))
                            errs.append(None)
                        except Exception as e:  # noqa: BLE001
                            got.append(None)
                            errs.append(f"{type(e).__name__}: {e}")
                keys += chunk[key].tolist()
                scores += got
                errors += errs
            yield pd.DataFrame({key: keys, "score": pd.Series(scores, dtype="float64"),
                                "score_error": pd.Series(errors, dtype="object")})

    return df.select(key, source_col, target_col).mapInPandas(
        run, f"{key} {kdt}, score double, score_error string")


class OverlapScorer:
    """A small deterministic Python scorer for G1/G8: the G2 formula with the
    background replaced by a uniform floor 1/(len(d)+1). Raises on inputs longer
    than ``max_words`` (as a model with a length limit would)."""

    def __init__(self, lam: float = LAMBDA, max_words: int | None = None):
        self.lam, self.max_words = lam, max_words

    def open(self) -> None:
        import re
        self._split = re.compile(r"[^\w]+|_")

    def _toks(self, s: str) -> list[str]:
        return [t for t in self._split.split(s.lower()) if t]

    def score(self, sources: list[str], targets: list[str]) -> list[float]:
        import math
        from collections import Counter
        out = []
        for s, t in zip(sources, targets):
            d, q = self._toks(s), self._toks(t)
            if self.max_words is not None and len(d) > self.max_words:
                raise ValueError(f"input of {len(d)} words exceeds {self.max_words}")
            if not q:
                raise ValueError("empty target")
            tf, n = Counter(d), len(d)
            floor = 1.0 / (n + 1)
            out.append(sum(math.log(self.lam * (tf[w] / n if n else 0.0) + (1 - self.lam) * floor)
                           for w in q) / len(q))
        return out
