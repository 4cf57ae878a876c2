"""Quality rules with risk-controlled thresholds, native expressions only (operator 10).

Every rule rejects a document when a ratio of the document exceeds a cutoff.
The cutoffs are not given: labelled documents (quality 1 = good) choose them.
For each stratum (language) and rule, the cutoffs of a grid are tested from the
most lenient to the strictest. A cutoff passes when the exact binomial test
rejects "at least ``max_false_rejection / rules`` of the good documents are
lost" at level ``error / (strata x rules)``. Testing stops at the first cutoff
that fails (fixed-sequence testing, which needs no further correction), and the
last one that passed is used. With probability at least ``1 - error``, all
strata at once lose at most ``max_false_rejection`` of their good documents to
the learned rules. A stratum with too few labels to prove any cutoff keeps
everything but what the base rule rejects.

Counts are per (stratum, rule, level): bounded by the strata, whatever the
number of labelled rows, and map-side combined. Document metrics are a narrow
map: higher-order functions over the words of one row. Repeated five-word
windows are found by sorting the windows' hashes within the row, and only for
rows where the number of distinct hashes shows that there is a repeat.

Defined results: a null text has no words and fails the base rule; a label of
several rows counts as good if one of them says so; documents or labels with a
null id are not used to choose cutoffs; a null stratum is the stratum ``''``;
an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.session import scratch_path

WINDOW = 5
MAX_BROADCAST_IDS = 1_000_000
#: Cutoffs of every ratio, from the most lenient to the strictest.
GRID = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01]
RULES = ["symbols", "exclamations", "capitals", "dup_lines", "repeats"]
_SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, whatever the optimiser inlines."""
    return F.transform(F.array(value), body)[0]


def _kept_chars(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash stands twice or more, from the array of window hashes."""

    def by_hash(pairs: Column) -> Column:
        repeated = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]))
        return _let(F.sort_array(F.transform(repeated, lambda p: p["i"])), by_position)

    def by_position(at: Column) -> Column:
        # windows start at sorted positions: each adds the words up to the next start
        adds = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(adds, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, by_hash))


def _word_metrics(words: Column) -> Column:
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW),
                          lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    repeats = F.when(n > WINDOW, _let(windows, _covered)).otherwise(F.lit(0).cast("long"))
    return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                    repeats.alias("n_repeat_words"))


def _line_metrics(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def metrics(text: Column) -> Column:
    """Struct of a text's counts (all long)."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, _SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda line: F.regexp_like(line, F.lit("[^\\x20\\x09-\\x0D]")))
    return F.struct(_let(words, _word_metrics).alias("w"), _let(lines, _line_metrics).alias("l"),
                    _kept_chars(t, "#*$%&|<>").alias("n_symbols"), _kept_chars(t, "!").alias("n_exclamations"),
                    _kept_chars(t, "\\p{Lu}").alias("n_capitals"))


METRIC_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_capitals"]


def with_metrics(df: DataFrame, text_col: str = "text", into: str = "_m") -> DataFrame:
    """``df`` with one struct column of the document metrics."""
    return df.withColumn(into, metrics(F.col(text_col)))


def metric(name: str, of: str = "_m") -> Column:
    if name in ("n_words", "word_chars", "n_repeat_words"):
        return F.col(of)["w"][name]
    return F.col(of)["l"][name] if name in ("n_lines", "n_dup_lines") else F.col(of)[name]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (n_repeat_words * 100 > n_words * 20)


def ratios(get: Callable[[str], Column]) -> dict[str, Column]:
    """The rules' ratios, 0 where nothing can be counted."""
    def part(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(get(a), get(b)), F.lit(0.0))

    return {"symbols": part("n_symbols", "word_chars"), "exclamations": part("n_exclamations", "word_chars"),
            "capitals": part("n_capitals", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"),
            "repeats": part("n_repeat_words", "n_words")}


def _ln_factorial(x: Column) -> Column:
    """ln(x!): exact up to 20, Stirling's series (error below 1e-13) beyond."""
    x = x.cast("double")
    z = x + 1
    series = ((z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
              + 1 / (1260 * z * z * z * z * z))
    return F.when(x <= 20, F.ln(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n p, else 1 (such a test cannot reject).

    Summed downwards from the term at k; below k terms fall at least as fast as
    the normal tail, so 40 standard deviations hold all of the sum that a
    double can."""
    top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.ln(p) + (n - k) * F.ln(1 - p)
    terms = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 40).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1).cast("double") / (n - k + i).cast("double") * (1 - p) / p
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def _level(cutoffs: Column, ratio: str) -> Column:
    """How many cutoffs of the grid do not reject a document."""
    return F.size(F.filter(cutoffs, lambda c: c >= F.col(ratio)))


def thresholds(good: DataFrame, max_false_rejection: float = 0.05, error: float = 0.05,
               grid: list[float] | None = None) -> DataFrame:
    """(stratum, one cutoff per rule; null where none is proven).

    ``good`` has one row per good labelled document: stratum and the rules' ratios."""
    grid = GRID if grid is None else grid
    if sorted(grid, reverse=True) != list(grid):
        raise ValueError("the grid must go from lenient (high) to strict (low)")
    alpha = F.lit(max_false_rejection / len(RULES))
    cutoffs = F.array(*[F.lit(float(g)) for g in grid])
    level = {r: _level(cutoffs, r) for r in RULES}
    per_rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level[r].alias("level")) for r in RULES]))
    counts = (good.select("stratum", per_rule.alias("x")).groupBy("stratum", "x.rule", "x.level")
              .agg(F.count("*").alias("n")))
    # every rule of a stratum sees the same documents, so one rule counts them
    strata = counts.filter(F.col("rule") == RULES[0]).groupBy("stratum").agg(F.sum("n").alias("total"))
    tests = strata.count() * len(RULES)
    steps = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(g)).alias("cutoff")) for j, g in enumerate(grid)]))
    lost = (counts.select("stratum", "rule", "level", "n", steps.alias("s")).select("stratum", "rule", "s.j", "s.cutoff", "level", "n")
            .groupBy("stratum", "rule", "j", "cutoff")
            .agg(F.sum(F.when(F.col("level") <= F.col("j"), F.col("n")).otherwise(0)).alias("k")))
    tested = (lost.join(strata, "stratum")
              .withColumn("passes", binomial_tail(F.col("k"), F.col("total"), alpha) <= F.lit(error / max(tests, 1))))
    so_far = Window.partitionBy("stratum", "rule").orderBy("j")
    passed = tested.withColumn("all_pass", F.min(F.col("passes").cast("int")).over(so_far) == 1).filter("all_pass")
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def good_ids(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(id) of the documents labelled good."""
    return (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
            .agg(F.max(label_col).alias("good")).filter("good = 1").select("id"))


def good_documents(measured: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Ratios of the documents labelled good; ``measured`` has (id, stratum, text_hash, ratios).

    Equal texts of a stratum are one trial: the binomial bound counts independent documents."""
    return (measured.join(good_ids(labels, label_col), "id").groupBy("stratum", "text_hash")
            .agg(*[F.first(r).alias(r) for r in RULES]).drop("text_hash"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Narrow table (id, stratum, text_hash, metrics, ratios) of every document."""
    text = F.col(text_col)
    m = with_metrics(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                                 F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text")))
    flat = m.select("id", "stratum", "text_hash", *[metric(c).alias(c) for c in METRIC_COLUMNS])
    return flat.select("*", *[c.alias(r) for r, c in ratios(F.col).items()])


def verdict(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept; strata without cutoffs keep what the base rule keeps."""
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return (measured.join(cuts, "stratum", "left")
            .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
            .withColumn("kept", ~F.col("base_failed") & ~over)
            .drop(*[f"cut_{r}" for r in RULES]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang", **control: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Cutoffs come from the documents labelled good, which alone are measured for them. Their ids are
    broadcast only after they were counted. The texts themselves are then
    filtered where they are, and never shuffled."""
    good = good_ids(labels)
    small = good.count() <= MAX_BROADCAST_IDS
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(stratum_col).alias("stratum"))
    labelled = plain.join(F.broadcast(good) if small else good, "id", "left_semi")
    cuts = thresholds(good_documents(measure(labelled, "id", "text", "stratum"), labels), **control)
    path = scratch_path(docs.sparkSession, "quality-cutoffs")
    cuts.write.parquet(path)  # written so that Spark knows its size: a row per stratum
    cuts = docs.sparkSession.read.schema("stratum string, " + ", ".join(f"cut_{r} double" for r in RULES)).parquet(path)
    row = docs.select(F.struct(*docs.columns).alias("_row"), metrics(F.col(text_col)).alias("_m"),
                      F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    flat = row.select("_row", "stratum", *[metric(c).alias(c) for c in METRIC_COLUMNS])
    judged = verdict(flat.select("*", *[c.alias(r) for r, c in ratios(F.col).items()]), cuts)
    return judged.filter("kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
