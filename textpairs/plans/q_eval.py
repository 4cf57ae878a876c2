"""Queries for evaluation (E1-E13): ROUGE on conversation-turn pairs, label
unmasking and generated length on the prepared batches, perplexity, and
checkpoint ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.functions.text import LABEL_IGNORE, PAD_ID, sentences
from textpairs.operators import batches as B
from textpairs.operators import metrics as M
from textpairs.operators import rouge as RG
from textpairs.operators import stems as ST
from textpairs.plans import fixtures as FX
from textpairs.plans import sqlbits as S
from textpairs.plans.catalog import PREP_CTES, VOCAB_SIZE, _vocab, r6, register
from textpairs.plans.prepare import joined_ids
from textpairs.plans.q_tokens import B1_CTE, _batched
from textpairs.session import cut_lineage, read_table


def _pair_tokens(spark: SparkSession, sf: str) -> DataFrame:
    p = FX.fx_pair(spark, sf)
    return p.select("pair_id", RG.tokens("candidate").alias("cand_tokens"),
                    RG.tokens("reference").alias("ref_tokens"))


PAIR_TOKENS = (f"{FX.sql_pair()}, pt AS (SELECT pair_id, {S.rouge_tokens('candidate')} AS c, "
               f"{S.rouge_tokens('reference')} AS r FROM fx_pair)")


def sql_rouge_n(n: int, name: str) -> str:
    return (f"{name}_g AS (SELECT pair_id, unnest({S.ngrams('c', n)}) AS g, 1 AS ci, 0 AS ri FROM pt "
            f"UNION ALL SELECT pair_id, unnest({S.ngrams('r', n)}), 0, 1 FROM pt), "
            f"{name}_pg AS (SELECT pair_id, g, sum(ci) AS c, sum(ri) AS r FROM {name}_g GROUP BY pair_id, g), "
            f"{name}_pp AS (SELECT pair_id, sum(least(c, r))::BIGINT AS ov, sum(c)::BIGINT AS nc, "
            f"sum(r)::BIGINT AS nr FROM {name}_pg GROUP BY pair_id), "
            f"{name}_s AS (SELECT pt.pair_id, coalesce(ov, 0) AS ov, coalesce(nc, 0) AS nc, coalesce(nr, 0) AS nr "
            f"FROM pt LEFT JOIN {name}_pp USING (pair_id)), "
            f"{name}_prf AS (SELECT pair_id, CASE WHEN nc > 0 THEN ov / nc ELSE 0.0 END AS p, "
            f"CASE WHEN nr > 0 THEN ov / nr ELSE 0.0 END AS r FROM {name}_s), "
            f"{name} AS (SELECT pair_id, p, r, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f "
            f"FROM {name}_prf)")


def _rouge(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return RG.rouge_n(_pair_tokens(spark, sf), n, "pair_id")


def _r6_cols(df: DataFrame, key: str, cols) -> DataFrame:
    return df.select(key, *[r6(F.col(c)).alias(c) for c in cols])


@register("e1_unmask_labels", f"""WITH {PREP_CTES}, {B1_CTE},
b3 AS (SELECT *, max(n_lab) OVER (PARTITION BY split, batch_id) AS tl FROM b1),
p AS (SELECT split, row_key, labels || repeat(' -100', tl - n_lab) AS labels FROM b3)
SELECT split, row_key, array_to_string(list_transform(string_split(labels, ' '),
       lambda x: CASE WHEN x = '-100' THEN '1' ELSE x END), ' ') AS labels FROM p""")
def q_e1(spark: SparkSession, sf: str) -> DataFrame:
    """-100 in padded labels back to the pad id before decoding."""
    p = B.pad_labels(_batched(spark, sf))
    return joined_ids(RG.unmask_labels(p).select("split", "row_key", "labels"), ["labels"])


@register("e2_sentences", f"""SELECT doc_id, array_to_string({S.sentences('text')}, chr(10)) AS sentences,
len({S.sentences('text')})::BIGINT AS n_sentences FROM documents""")
def q_e2(spark: SparkSession, sf: str) -> DataFrame:
    """Strip, sentence split, newline join."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(sentences("text"), "\n").alias("sentences"),
                    F.size(sentences("text")).cast("bigint").alias("n_sentences"))


@register("e3_rouge_tokens", f"""WITH {PAIR_TOKENS}
SELECT pair_id, array_to_string(c, ' ') AS cand_tokens, array_to_string(r, ' ') AS ref_tokens FROM pt""")
def q_e3(spark: SparkSession, sf: str) -> DataFrame:
    """ROUGE tokens (lower case, [a-z0-9] runs), unstemmed."""
    t = _pair_tokens(spark, sf)
    return t.select("pair_id", F.array_join("cand_tokens", " ").alias("cand_tokens"),
                    F.array_join("ref_tokens", " ").alias("ref_tokens"))


def _sql_stemmed(side: str) -> str:
    """Stemmed tokens of one side as one string a pair, from ``pt`` and ``st`` (token, stem)."""
    return (f"(SELECT pair_id, string_agg(CASE WHEN length(t) > {ST.LONGER_THAN} THEN stem ELSE t END, ' ' ORDER BY place) AS s "
            f"FROM (SELECT pair_id, unnest({side}) AS t, unnest(range(len({side}))) AS place FROM pt) x JOIN st ON x.t = st.token GROUP BY pair_id)")


@register("e3_rouge_tokens_stemmed", f"""WITH {PAIR_TOKENS},
dt AS (SELECT DISTINCT token FROM (SELECT unnest(c) AS token FROM pt UNION ALL SELECT unnest(r) FROM pt)),
{ST.sql_stem_table('dt', 'st')}
SELECT pt.pair_id, coalesce(a.s, '') AS cand_tokens, coalesce(b.s, '') AS ref_tokens
FROM pt LEFT JOIN {_sql_stemmed('c')} a USING (pair_id) LEFT JOIN {_sql_stemmed('r')} b USING (pair_id)""")
def q_e3s(spark: SparkSession, sf: str) -> DataFrame:
    """E3 (stemmed): Porter stems of tokens longer than 3, made on the distinct tokens and joined back."""
    t = ST.stemmed(_pair_tokens(spark, sf), ["pair_id"], ["cand_tokens", "ref_tokens"])
    return t.select("pair_id", F.array_join("cand_tokens", " ").alias("cand_tokens"),
                    F.array_join("ref_tokens", " ").alias("ref_tokens"))


@register("e4_rouge1", f"WITH {PAIR_TOKENS}, {sql_rouge_n(1, 'r1')} "
          f"SELECT pair_id, {S.r6('p')} AS rouge1_p, {S.r6('r')} AS rouge1_r, {S.r6('f')} AS rouge1_f FROM r1")
def q_e4(spark: SparkSession, sf: str) -> DataFrame:
    """ROUGE-1 precision, recall, F per conversation-turn pair."""
    return _r6_cols(_rouge(spark, sf, 1), "pair_id", ["rouge1_p", "rouge1_r", "rouge1_f"])


@register("e5_rouge2", f"WITH {PAIR_TOKENS}, {sql_rouge_n(2, 'r2')} "
          f"SELECT pair_id, {S.r6('p')} AS rouge2_p, {S.r6('r')} AS rouge2_r, {S.r6('f')} AS rouge2_f FROM r2")
def q_e5(spark: SparkSession, sf: str) -> DataFrame:
    """E5: ROUGE-2 precision, recall, F per pair."""
    return _r6_cols(_rouge(spark, sf, 2), "pair_id", ["rouge2_p", "rouge2_r", "rouge2_f"])


#: The plain table of the longest common subsequence, a row at a time (``pt`` has the tokens).
_LCS_CELL = "greatest(acc[-1], above[x[1] + 1], above[x[1]] + same[x[1]])"
_LCS_ROW = f"list_reduce(list_prepend([0], list_transform(range(1, len(r) + 1), lambda j: [j])), lambda acc, x: list_append(acc, {_LCS_CELL}))"
SQL_ROUGE_L = f"""lc AS (SELECT pair_id, len(c) AS nc, len(r) AS nr, CASE WHEN len(c) = 0 OR len(r) = 0 THEN 0 ELSE
  (list_reduce(list_prepend(list_transform(range(len(r) + 1), lambda j: 0),
                            list_transform(c, lambda t: list_transform(r, lambda w: (w = t)::INTEGER))),
               lambda above, same: {_LCS_ROW}))[-1] END AS hits FROM
  (SELECT pair_id, c, r FROM pt)),
lp AS (SELECT pair_id, CASE WHEN nc > 0 THEN hits / nc ELSE 0.0 END AS p, CASE WHEN nr > 0 THEN hits / nr ELSE 0.0 END AS r FROM lc),
rl AS (SELECT pair_id, p, r, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f FROM lp)"""


@register("e6_rougeL", f"WITH {PAIR_TOKENS}, {SQL_ROUGE_L} "
          f"SELECT pair_id, {S.r6('p')} AS rougeL_p, {S.r6('r')} AS rougeL_r, {S.r6('f')} AS rougeL_f FROM rl")
def q_e6(spark: SparkSession, sf: str) -> DataFrame:
    """ROUGE-L per pair (bit-parallel LCS in JVM expressions; the oracle fills the plain table)."""
    return _r6_cols(RG.rouge_l(_pair_tokens(spark, sf)), "pair_id", ["rougeL_p", "rougeL_r", "rougeL_f"])


@register("e7_rougeLsum")
def q_e7(spark: SparkSession, sf: str) -> DataFrame:
    """ROUGE-Lsum over sentence-split texts (union LCS; tested by brute force)."""
    p = FX.fx_pair(spark, sf)
    return _r6_cols(RG.rouge_lsum(p, "candidate", "reference"), "pair_id",
                    ["rougeLsum_p", "rougeLsum_r", "rougeLsum_f"])


THREE = ["rouge1", "rouge2", "rougeL"]
SQL_THREE = f"{sql_rouge_n(1, 'r1')}, {sql_rouge_n(2, 'r2')}, {SQL_ROUGE_L}"


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cut_lineage(_pair_tokens(spark, sf))
    scored = RG.rouge_l(pairs).select("pair_id", F.col("rougeL_f").alias("rougeL"))
    scored = scored.join(RG.rouge_ns(pairs, (1, 2), "pair_id"), "pair_id").withColumnsRenamed({"rouge1_f": "rouge1", "rouge2_f": "rouge2"})
    return RG.rouge_summary(scored, THREE)


@register("e8_rouge_summary", f"""WITH {PAIR_TOKENS}, {SQL_THREE}
SELECT {S.r6('avg(r1.f) * 100.0')} AS rouge1, {S.r6('avg(r2.f) * 100.0')} AS rouge2, {S.r6('avg(rl.f) * 100.0')} AS rougeL,
       count(*)::BIGINT AS pairs
FROM r1 JOIN r2 USING (pair_id) JOIN rl USING (pair_id)""")
def q_e8(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus roll-up of F-measures x 100."""
    s = _summary(spark, sf)
    return s.select(*[r6(F.col(c)).alias(c) for c in THREE], F.col("pairs").cast("bigint").alias("pairs"))


BOOT_N = 200


@register("e9_bootstrap", f"""WITH {PAIR_TOKENS}, {sql_rouge_n(1, 'r1')},
reps AS (SELECT pair_id, f, unnest(range(1, {BOOT_N + 1})) AS replicate FROM r1),
w AS (SELECT replicate, f, {S.poisson1(S.u(42, "CAST(replicate AS VARCHAR) || ':' || pair_id"))} AS w FROM reps),
m AS (SELECT replicate, CASE WHEN sum(w) > 0 THEN sum(w * f) / sum(w) END AS f FROM w GROUP BY replicate)
SELECT {S.r6('quantile_cont(f, 0.025)')} AS rouge1_f_low, {S.r6('quantile_cont(f, 0.5)')} AS rouge1_f_mid,
       {S.r6('quantile_cont(f, 0.975)')} AS rouge1_f_high FROM m""")
def q_e9(spark: SparkSession, sf: str) -> DataFrame:
    """Poisson bootstrap (200 replicates) low / mid / high of mean ROUGE-1 F."""
    b = RG.bootstrap(_rouge(spark, sf, 1), ["rouge1_f"], "pair_id", n=BOOT_N)
    return b.select(*[r6(F.col(c)).alias(c) for c in ("rouge1_f_low", "rouge1_f_mid", "rouge1_f_high")])


@register("e10_gen_len", f"""WITH {PREP_CTES}, {B1_CTE},
b AS (SELECT *, max(n_in) OVER (PARTITION BY split, batch_id) AS tl,
             max(n_lab) OVER (PARTITION BY split, batch_id) AS tll FROM b1)
SELECT split, {S.r6('avg(n_in)')} AS gen_len, {S.r6('avg(tll)')} AS gen_len_reference FROM b GROUP BY split""")
def q_e10(spark: SparkSession, sf: str) -> DataFrame:
    """Mean non-pad length of padded id rows; the reference rule on labels
    padded with -100 counts the -100s (finding Q7), the default does not."""
    p = cut_lineage(B.pad_labels(B.pad_batch(_batched(spark, sf), "input_ids", out="padded_ids")).select("split", "padded_ids", "labels"))
    plain = M.gen_len(p, "padded_ids", by=["split"])
    strict = M.gen_len(p, "labels", strict_reference=True, by=["split"]).withColumnRenamed("gen_len", "gen_len_reference")
    return plain.join(strict, "split").select("split", r6(F.col("gen_len")).alias("gen_len"),
                                              r6(F.col("gen_len_reference")).alias("gen_len_reference"))


def sql_finished(prefix: str) -> str:
    parts = [f"SELECT '{prefix}_{m}' AS name, round(avg({t}.f) * 100.0, 4) AS value FROM {t}" for m, t in zip(THREE, ("r1", "r2", "rl"))]
    return (f"WITH {PAIR_TOKENS}, {SQL_THREE} " + " UNION ALL ".join(parts)
            + f" UNION ALL SELECT '{prefix}_gen_len', (WITH {PREP_CTES}, {B1_CTE} SELECT round(avg(n_in), 4) FROM b1)")


@register("e11_finish_metrics", sql_finished("test"))
def q_e11(spark: SparkSession, sf: str) -> DataFrame:
    """Metric names prefixed with the split, values rounded to 4 places; the means of E8
    and the mean length of the padded batches."""
    padded = B.pad_batch(_batched(spark, sf), "input_ids", out="padded_ids").select("padded_ids")
    # one row each
    wide = _summary(spark, sf).withColumn("_one", F.lit(1)).join(M.gen_len(padded, "padded_ids").withColumn("_one", F.lit(1)), "_one")
    return M.finish_metrics(wide, [*THREE, "gen_len"], "test")


@register("compute_metrics")
def q_compute_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """E1-E11 as one flow over the padded batches: the first 128 input ids stand
    in for generated ids, the labels are the reference, tokens stemmed (tested by brute force)."""
    vocab = cut_lineage(_vocab(spark, sf))  # made once, for encoding and decoding
    batched = B.pad_labels(_batched(spark, sf, vocab)).withColumn("pred_ids", F.slice("input_ids", 1, 128))
    return RG.compute_metrics(batched, vocab, ["split", "row_key"], vocab_size=VOCAB_SIZE)


@register("e12_perplexity", f"""WITH {FX.sql_stored()},
tr AS (SELECT {S.lm_tokens('text')} AS t FROM fx_stored WHERE stored_split = 'train'),
cf AS (SELECT w, count(*) AS cf FROM (SELECT unnest(t) AS w FROM tr) GROUP BY w),
tot AS (SELECT sum(cf) AS C, count(*) AS V FROM cf),
bg AS (SELECT w, (cf + 1)::DOUBLE / (C + V + 1)::DOUBLE AS p FROM cf, tot),
bi AS (SELECT unnest(list_slice(t, 1, len(t) - 1)) AS v, unnest(list_slice(t, 2, len(t))) AS w FROM tr WHERE len(t) >= 2),
cvw AS (SELECT v, w, count(*) AS cvw FROM bi GROUP BY v, w),
cv AS (SELECT v, sum(cvw) AS cv FROM cvw GROUP BY v),
ho AS (SELECT lang, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS w, t
       FROM (SELECT lang, {S.lm_tokens('text')} AS t FROM fx_stored WHERE stored_split = 'test')),
h2 AS (SELECT lang, w, CASE WHEN pos > 1 THEN t[pos - 1] END AS v FROM ho),
j AS (SELECT h.lang, coalesce(b.p, 1.0::DOUBLE / (SELECT C + V + 1 FROM tot)::DOUBLE) AS p, c.cv, x.cvw, h.v
      FROM h2 h LEFT JOIN bg b ON h.w = b.w LEFT JOIN cv c ON h.v = c.v LEFT JOIN cvw x ON h.v = x.v AND h.w = x.w)
SELECT lang, count(*)::BIGINT AS n_tokens,
  {S.r6("exp(-avg(ln(CASE WHEN v IS NULL OR cv IS NULL THEN p ELSE 0.5::DOUBLE * coalesce(cvw, 0)::DOUBLE / cv::DOUBLE + 0.5::DOUBLE * p END)))")} AS perplexity
FROM j GROUP BY lang""")
def q_e12(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolated bigram perplexity of the stored test split, trained on
    the stored train split, per language."""
    st = FX.fx_stored(spark, sf)
    ppl = M.perplexity(st.filter(F.col("stored_split") == "train"),
                       st.filter(F.col("stored_split") == "test"), by=["lang"])
    return ppl.select("lang", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                      r6(F.col("perplexity")).alias("perplexity"))


@register("e13_rank_runs", f"""WITH {FX.sql_runs()},
r AS (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY value ASC, step DESC)::BIGINT AS metric_rank,
             row_number() OVER (PARTITION BY run ORDER BY step DESC) AS recency FROM fx_runs WHERE name = 'loss')
SELECT run, step, value, metric_rank, metric_rank = 1 AS is_best, (metric_rank = 1 OR recency <= 1) AS kept FROM r""")
def q_e13(spark: SparkSession, sf: str) -> DataFrame:
    """Best checkpoint by loss (lower is better), keep best + latest."""
    r = M.rank_runs(FX.fx_runs(spark, sf), "loss", greater_is_better=False, keep=2)
    return r.select("run", "step", "value", "metric_rank", "is_best", "kept")
