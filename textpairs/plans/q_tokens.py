"""Queries for vocabulary, encoding and batch assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.operators import batches as B
from textpairs.operators import vocab as V
from textpairs.operators.pairs import SUMMARIZATION_PREFIX, split_pairs
from textpairs.plans import fixtures as FX
from textpairs.plans import sqlbits as S
from textpairs.plans.catalog import (MIN_FREQ, PAIRS_SQL, PREP_CTES, VOCAB_SIZE, _vocab, r6,
                                     register, sql_vocab)
from textpairs.plans.prepare import joined_ids, prepare_pairs
from textpairs.session import read_table
from textpairs.sources import registry as R


def _prep(spark: SparkSession, sf: str, vocab: DataFrame | None = None) -> DataFrame:
    return prepare_pairs(spark, FX.fixture_specs(sf), _vocab(spark, sf) if vocab is None else vocab, VOCAB_SIZE)


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return split_pairs(R.read_sources(spark, FX.fixture_specs(sf)))[0]


IDS = "string_split({c}, ' ')::BIGINT[]"


@register("t1_build_vocab", f"WITH {sql_vocab()} SELECT token, id, cnt FROM vocab")
def q_t1(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency-ranked word vocabulary, specials first, size 8000, min count 2."""
    v = V.build_vocab(read_table(spark, sf, "documents"), "text", VOCAB_SIZE, MIN_FREQ)
    return v.select("token", F.col("id").cast("bigint").alias("id"), "cnt")


@register("t3_encode", f"WITH {PREP_CTES} SELECT split, row_key, ids AS input_ids FROM enc_in")
def q_t3(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixed inputs to ids, truncated to 1024 including <s> and </s>."""
    e = V.encode(_valid(spark, sf), _vocab(spark, sf), [("input_text", "input_ids", V.MAX_INPUT_LENGTH)],
                 key_cols=["split", "row_key"], vocab_size=VOCAB_SIZE,
                 prefix={"input_text": SUMMARIZATION_PREFIX})
    return joined_ids(e, ["input_ids"])


@register("t4_encode_labels", f"WITH {PREP_CTES} SELECT split, row_key, ids AS labels FROM enc_lab")
def q_t4(spark: SparkSession, sf: str) -> DataFrame:
    """T4: targets to label ids, truncated to 128."""
    e = V.encode(_valid(spark, sf), _vocab(spark, sf), [("target_text", "labels", V.MAX_TARGET_LENGTH)],
                 key_cols=["split", "row_key"], vocab_size=VOCAB_SIZE)
    return joined_ids(e, ["labels"])


@register("t5_decode", f"""WITH {PREP_CTES},
dt AS (SELECT split, row_key, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS token
       FROM (SELECT split, row_key, list_slice({S.words('target_text')}, 1, 126) AS a FROM valid)),
dg AS (SELECT t.split, t.row_key, string_agg(t.token, ' ' ORDER BY t.pos) AS s
       FROM dt t JOIN vocab v ON t.token = v.token AND v.id >= 5 GROUP BY ALL)
SELECT c.split, c.row_key, coalesce(g.s, '') AS text FROM valid c LEFT JOIN dg g USING (split, row_key)""")
def q_t5(spark: SparkSession, sf: str) -> DataFrame:
    """T5: label ids back to words, special (and unknown) tokens skipped."""
    vocab = _vocab(spark, sf)
    e = V.encode(_valid(spark, sf), vocab, [("target_text", "labels", V.MAX_TARGET_LENGTH)],
                 key_cols=["split", "row_key"], vocab_size=VOCAB_SIZE)
    return V.decode(e, vocab, "labels", ["split", "row_key"], vocab_size=VOCAB_SIZE)


@register("t6_length_report", f"""WITH {PAIRS_SQL},
l AS (SELECT source, (len({S.words("'summarize: ' || input_text")}) + 2)::BIGINT AS n FROM fx_pairs)
SELECT source, count(*)::BIGINT AS rows, sum(CASE WHEN n > 1024 THEN 1 ELSE 0 END)::BIGINT AS rows_truncated,
       sum(greatest(n - 1024, 0))::BIGINT AS tokens_lost, max(n) AS max_tokens,
       {S.r6('quantile_cont(n::DOUBLE, 0.5)')} AS p50, {S.r6('quantile_cont(n::DOUBLE, 0.9)')} AS p90,
       {S.r6('quantile_cont(n::DOUBLE, 0.99)')} AS p99
FROM l GROUP BY source""")
def q_t6(spark: SparkSession, sf: str) -> DataFrame:
    """Truncation report per source at the 1024 input limit."""
    rep = V.length_report(R.read_sources(spark, FX.fixture_specs(sf)), ["source"], "input_text",
                          V.MAX_INPUT_LENGTH, prefix=SUMMARIZATION_PREFIX)
    return rep.select("source", "rows", "rows_truncated", "tokens_lost", "max_tokens",
                      r6(F.col("p50")).alias("p50"), r6(F.col("p90")).alias("p90"), r6(F.col("p99")).alias("p99"))


@register("t7_audit_ids", f"""WITH {PREP_CTES}, a AS (SELECT split, {IDS.format(c='input_ids')} AS ids FROM prep)
SELECT split, count(*)::BIGINT AS rows,
  sum(CASE WHEN len(list_filter(ids, lambda x: x < 0 OR x >= 8000)) > 0 THEN 1 ELSE 0 END)::BIGINT AS rows_bad_id,
  sum(CASE WHEN ids[1] <> 0 THEN 1 ELSE 0 END)::BIGINT AS rows_no_bos,
  sum(CASE WHEN NOT list_contains(ids, 2) THEN 1 ELSE 0 END)::BIGINT AS rows_no_eos,
  max(list_max(ids))::BIGINT AS max_id
FROM a GROUP BY split""")
def q_t7(spark: SparkSession, sf: str) -> DataFrame:
    """Every id below the vocabulary size, every row wrapped in <s> ... </s>."""
    return V.audit_ids(_prep(spark, sf), "input_ids", VOCAB_SIZE)


@register("t7_vocab_check", f"""WITH {sql_vocab()}
SELECT count(*)::BIGINT AS entries, max(id)::BIGINT AS max_id,
  sum(CASE WHEN (token, id) IN (SELECT * FROM (VALUES ('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3),
      ('[MASK]', 4)) t(a, b)) THEN 1 ELSE 0 END)::BIGINT AS specials_in_place,
  count(*) <= 8000 AS within_size FROM vocab""")
def q_t7v(spark: SparkSession, sf: str) -> DataFrame:
    """T7 (vocabulary side): specials at their ids, size within the limit."""
    return V.vocab_check(_vocab(spark, sf), VOCAB_SIZE)


# ------------------------------------------------------------------ batches

BATCH = "CASE WHEN split = 'train' THEN 4 ELSE 8 END"
B1_CTE = (f"b1 AS (SELECT *, ((shuffle_rank - 1) // {BATCH})::BIGINT AS batch_id, "
          f"len(string_split(input_ids, ' ')) AS n_in, len(string_split(labels, ' ')) AS n_lab FROM prep)")


def _batched(spark: SparkSession, sf: str, vocab: DataFrame | None = None) -> DataFrame:
    return B.assign_batches(_prep(spark, sf, vocab))


@register("b1_assign_batches", f"WITH {PREP_CTES}, {B1_CTE} SELECT split, row_key, shuffle_rank, batch_id FROM b1")
def q_b1(spark: SparkSession, sf: str) -> DataFrame:
    """B1: 4 rows per train batch, 8 per evaluation batch, in shuffle order."""
    return _batched(spark, sf).select("split", "row_key", "shuffle_rank", "batch_id")


@register("b2_pad_batch", f"""WITH {PREP_CTES}, {B1_CTE},
b2 AS (SELECT *, max(n_in) OVER (PARTITION BY split, batch_id) AS tl FROM b1)
SELECT split, row_key, batch_id, input_ids || repeat(' 1', tl - n_in) AS padded_ids,
       rtrim(repeat('1 ', n_in) || repeat('0 ', tl - n_in)) AS attention_mask FROM b2""")
def q_b2(spark: SparkSession, sf: str) -> DataFrame:
    """B2: pad to the longest row of the batch with <pad>, with attention mask."""
    p = B.pad_batch(_batched(spark, sf), "input_ids", out="padded_ids")
    return joined_ids(p.select("split", "row_key", "batch_id", "padded_ids", "attention_mask"),
                      ["padded_ids", "attention_mask"])


@register("b3_pad_labels", f"""WITH {PREP_CTES}, {B1_CTE},
b3 AS (SELECT *, max(n_lab) OVER (PARTITION BY split, batch_id) AS tl FROM b1)
SELECT split, row_key, batch_id, labels || repeat(' -100', tl - n_lab) AS labels FROM b3""")
def q_b3(spark: SparkSession, sf: str) -> DataFrame:
    """Labels padded with -100 to the longest label of the batch."""
    p = B.pad_labels(_batched(spark, sf))
    return joined_ids(p.select("split", "row_key", "batch_id", "labels"), ["labels"])


@register("b4_pad_multiple", f"""WITH {PREP_CTES}, {B1_CTE},
b4 AS (SELECT *, ((max(n_in) OVER (PARTITION BY split, batch_id) + 7) // 8) * 8 AS tl FROM b1)
SELECT split, row_key, batch_id, input_ids || repeat(' 1', tl - n_in) AS padded_ids,
       rtrim(repeat('1 ', n_in) || repeat('0 ', tl - n_in)) AS attention_mask FROM b4""")
def q_b4(spark: SparkSession, sf: str) -> DataFrame:
    """Half-precision mode pads batch length up to a multiple of 8."""
    p = B.pad_batch(_batched(spark, sf), "input_ids", multiple=8, out="padded_ids")
    return joined_ids(p.select("split", "row_key", "batch_id", "padded_ids", "attention_mask"),
                      ["padded_ids", "attention_mask"])


@register("b5_batch_report", f"""WITH {PREP_CTES}, {B1_CTE},
b2 AS (SELECT *, max(n_in) OVER (PARTITION BY split, batch_id) AS tl FROM b1)
SELECT split, count(*)::BIGINT AS rows, count(DISTINCT batch_id)::BIGINT AS batches,
       sum(n_in)::BIGINT AS real_tokens, sum(tl)::BIGINT AS padded_tokens,
       max({BATCH})::BIGINT AS batch_size, (count(DISTINCT batch_id) * 3)::BIGINT AS steps,
       {S.r6('1.0 - sum(n_in) / sum(tl)')} AS pad_share
FROM b2 GROUP BY split""")
def q_b5(spark: SparkSession, sf: str) -> DataFrame:
    """Batches, steps over 3 epochs, real vs padded tokens per split."""
    p = B.pad_batch(_batched(spark, sf), "input_ids", out="padded_ids")
    return B.batch_report(p)


@register("b6_infill", f"""WITH w AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
m AS (SELECT doc_id, w, list_transform(w, lambda x, i: {S.u(42, "CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)")} < 0.3) AS m FROM w)
SELECT doc_id,
  array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN m[i] THEN
      CASE WHEN i > 1 AND m[i - 1] THEN NULL ELSE '[MASK]' END ELSE x END), lambda y: y IS NOT NULL), ' ') AS masked_text,
  len(list_filter(m, lambda b: b))::BIGINT AS masked_words
FROM m""")
def q_b6(spark: SparkSession, sf: str) -> DataFrame:
    """Text infilling (Bernoulli 0.3 per word, runs collapse to one [MASK])."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return B.infill_bernoulli(d, "text", "doc_id").select("doc_id", "masked_text", "masked_words")


def _sql_poisson(uexpr: str, lam: float) -> str:
    return f"len(list_filter([{', '.join(map(repr, B.poisson_cuts(lam)))}], lambda c: {uexpr} >= c))::BIGINT"


def _sql_draw(kind: str) -> str:
    return S.u(42, f"CAST(doc_id AS VARCHAR) || ':{kind}:' || CAST(k AS VARCHAR)")


@register("b6_infill_poisson", f"""WITH w AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
b AS (SELECT *, floor(len(w) * 0.3::DOUBLE + 0.5::DOUBLE)::BIGINT AS budget FROM w),
d AS (SELECT doc_id, budget, len(w) - budget AS stay, k, {_sql_poisson(_sql_draw('len'), 3.0)} AS n, {_sql_draw('gap')} AS ug
      FROM (SELECT *, unnest(range(1, budget + {B.SPARE_DRAWS} + 1)) AS k FROM b)),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
s AS (SELECT doc_id, k, least(n, budget - before) AS n, floor(ug * (stay + 1))::BIGINT AS gap FROM c WHERE before < budget),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY gap, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skipped FROM s),
m AS (SELECT doc_id, gap + skipped AS place, 0 AS kind, k, '[MASK]' AS word FROM p),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM b),
g AS (SELECT doc_id, gap + skipped AS a, gap + skipped + n AS z FROM p WHERE n > 0),
y AS (SELECT x.doc_id, x.i AS place, 1 AS kind, 0 AS k, x.word FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = x.doc_id AND x.i >= a AND x.i < z)),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place, kind, k) AS t FROM (SELECT * FROM m UNION ALL SELECT * FROM y) GROUP BY doc_id)
SELECT b.doc_id, coalesce(o.t, '') AS masked_text, b.budget AS masked_words FROM b LEFT JOIN o USING (doc_id)""")
def q_b6p(spark: SparkSession, sf: str) -> DataFrame:
    """B6 (Poisson spans, lambda 3): seeded per document."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return B.infill_poisson(d, "text", "doc_id").select("doc_id", "masked_text", "masked_words")
