"""Queries for pair scoring (G1-G8) with the built-in smoothed LM scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.functions.text import has_second_sentence, lead_sentence
from textpairs.operators import scoring as G
from textpairs.operators.pairs import expand_references
from textpairs.operators.ranking import numeric_shard, sharded_row_number
from textpairs.plans import fixtures as FX
from textpairs.plans import sqlbits as S
from textpairs.plans.catalog import r6, register
from textpairs.session import cut_lineage, read_table


def _lead_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with 2+ sentences: document = text, summary = lead sentence."""
    d = read_table(spark, sf, "documents")
    return (d.filter(has_second_sentence("text"))
            .select(F.col("doc_id").cast("string").alias("pair_id"), "doc_id",
                    F.col("text").alias("document"), lead_sentence("text").alias("summary")))


def sql_bg(src: str, col: str = "text", name: str = "bg") -> str:
    return (f"{name}_cf AS (SELECT w, count(*) AS cf FROM (SELECT unnest({S.lm_tokens(col)}) AS w FROM {src}) GROUP BY w), "
            f"{name}_tot AS (SELECT sum(cf) AS C, count(*) AS V FROM {name}_cf), "
            f"{name} AS (SELECT w, (cf + 1)::DOUBLE / (C + V + 1)::DOUBLE AS p FROM {name}_cf, {name}_tot), "
            f"{name}_floor AS (SELECT 1.0::DOUBLE / (C + V + 1)::DOUBLE AS fl FROM {name}_tot)")


def sql_lm_score(pairs: str, key: str, src_col: str, tgt_col: str, name: str, bg: str = "bg") -> str:
    """CTE ``name(key, score, score_error)`` mirroring ``scoring.lm_score``."""
    return (f"{name}_b AS (SELECT {key}, {S.lm_tokens(src_col)} AS d, {S.lm_tokens(tgt_col)} AS s FROM {pairs}), "
            f"{name}_x AS (SELECT {key}, len(d) AS n, d, unnest(s) AS w FROM {name}_b), "
            f"{name}_t AS (SELECT {key}, n, w, len(list_filter(d, lambda x: x = w)) AS tf FROM {name}_x), "
            f"{name}_a AS (SELECT t.{key}, avg(ln(0.5::DOUBLE * (CASE WHEN t.n > 0 THEN t.tf::DOUBLE / t.n::DOUBLE ELSE 0.0::DOUBLE END) "
            f"+ 0.5::DOUBLE * coalesce(b.p, (SELECT fl FROM {bg}_floor)))) AS score "
            f"FROM {name}_t t LEFT JOIN {bg} b ON t.w = b.w GROUP BY t.{key}), "
            f"{name} AS (SELECT p.{key}, a.score, CASE WHEN a.score IS NULL THEN 'empty_target' END AS score_error "
            f"FROM {name}_b p LEFT JOIN {name}_a a USING ({key}))")


LEAD_PAIRS = (f"lp AS (SELECT CAST(doc_id AS VARCHAR) AS pair_id, doc_id, text AS document, "
              f"{S.lead('text')} AS summary FROM documents WHERE len({S.sentences('text')}) >= 2)")


def _doc_lm(spark: SparkSession, sf: str) -> G.LM:
    return G.fit_lm(read_table(spark, sf, "documents"))


@register("g2_lm_score", f"""WITH {sql_bg('documents')}, {LEAD_PAIRS}, {sql_lm_score('lp', 'pair_id', 'document', 'summary', 'sc')}
SELECT pair_id, {S.r6('score')} AS score, score_error FROM sc""")
def q_g2(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed LM log-likelihood of the lead sentence given its document."""
    s = G.lm_score(_lead_pairs(spark, sf), _doc_lm(spark, sf), "pair_id", "document", "summary")
    return s.select("pair_id", r6(F.col("score")).alias("score"), "score_error")


@register("g3_reverse", f"""WITH {sql_bg('documents')}, {LEAD_PAIRS}, {sql_lm_score('lp', 'pair_id', 'summary', 'document', 'sc')}
SELECT pair_id, {S.r6('score')} AS score, score_error FROM sc""")
def q_g3(spark: SparkSession, sf: str) -> DataFrame:
    """Reverse direction, document given summary (faithfulness)."""
    d = G.directed(_lead_pairs(spark, sf), "reverse")
    s = G.lm_score(d, _doc_lm(spark, sf), "pair_id", "_src", "_tgt")
    return s.select("pair_id", r6(F.col("score")).alias("score"), "score_error")


@register("g4_multi_ref", f"""WITH {sql_bg('conversations')}, {FX.sql_multi()},
ex AS (SELECT candidate_id, candidate, unnest(refs) AS reference, unnest(range(1, len(refs) + 1)) AS ref_no FROM fx_multi),
ek AS (SELECT candidate_id || '#' || CAST(ref_no AS VARCHAR) AS k, candidate_id, candidate, reference FROM ex),
{sql_lm_score('ek', 'k', 'candidate', 'reference', 'sc')}
SELECT e.candidate_id, {S.r6('max(s.score)')} AS score_max, {S.r6('avg(s.score)')} AS score_mean, count(*)::BIGINT AS n_refs
FROM ek e JOIN sc s USING (k) GROUP BY e.candidate_id""")
def q_g4(spark: SparkSession, sf: str) -> DataFrame:
    """Each reference scored given its candidate; max and mean per candidate."""
    lm = G.fit_lm(read_table(spark, sf, "conversations"))
    g = G.multi_ref_score(expand_references(FX.fx_multi(spark, sf)), lm, ["max", "mean"])
    return g.select("candidate_id", r6(F.col("score_max")).alias("score_max"), r6(F.col("score_mean")).alias("score_mean"), "n_refs")


@register("g5_compare_systems", f"""WITH {sql_bg('documents')}, {FX.sql_systems()},
sa AS (SELECT pair_id, document, A AS summary FROM fx_systems), sb AS (SELECT pair_id, document, B AS summary FROM fx_systems),
{sql_lm_score('sa', 'pair_id', 'document', 'summary', 'ga')}, {sql_lm_score('sb', 'pair_id', 'document', 'summary', 'gb')},
l AS (SELECT pair_id, 'A' AS system, score FROM ga UNION ALL SELECT pair_id, 'B', score FROM gb),
m AS (SELECT pair_id, system, score, round(score, 9) AS cmp, max(round(score, 9)) OVER (PARTITION BY pair_id) AS best FROM l),
n AS (SELECT *, sum(CASE WHEN cmp = best THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id) AS n_best FROM m)
SELECT system, count(*)::BIGINT AS pairs, {S.r6('avg(score)')} AS mean_score,
  sum(CASE WHEN cmp = best AND n_best = 1 THEN 1 ELSE 0 END)::BIGINT AS wins,
  sum(CASE WHEN cmp = best AND n_best > 1 THEN 1 ELSE 0 END)::BIGINT AS ties,
  {S.r6('sum(CASE WHEN cmp = best AND n_best = 1 THEN 1 ELSE 0 END) / count(*)')} AS win_rate
FROM n GROUP BY system""")
def q_g5(spark: SparkSession, sf: str) -> DataFrame:
    """First sentence (A) against last sentence (B) as summaries of a document."""
    scored = G.score_systems(FX.fx_systems(spark, sf), _doc_lm(spark, sf), "pair_id", "document", {"A": "A", "B": "B"})
    c = G.compare_systems(scored)
    return c.select("system", "pairs", r6(F.col("mean_score")).alias("mean_score"), "wins", "ties",
                    r6(F.col("win_rate")).alias("win_rate"))


@register("g6_correlate", f"""WITH {sql_bg('documents')}, {LEAD_PAIRS}, {sql_lm_score('lp', 'pair_id', 'document', 'summary', 'sc')},
j AS (SELECT s.score, l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic FROM sc s
      JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.pair_id WHERE s.score IS NOT NULL),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs,
             rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS rq,
             rank() OVER (ORDER BY toxic) + (count(*) OVER (PARTITION BY toxic) - 1) / 2.0 AS rt FROM j)
SELECT count(*)::BIGINT AS n, 'quality' AS judgement, 'pearson' AS method, {S.r6('corr(score, quality)')} AS value FROM r
UNION ALL SELECT count(*)::BIGINT, 'quality', 'spearman', {S.r6('corr(rs::DOUBLE, rq::DOUBLE)')} FROM r
UNION ALL SELECT count(*)::BIGINT, 'toxic', 'pearson', {S.r6('corr(score, toxic)')} FROM r
UNION ALL SELECT count(*)::BIGINT, 'toxic', 'spearman', {S.r6('corr(rs::DOUBLE, rt::DOUBLE)')} FROM r""")
def q_g6(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson and Spearman of the LM score with labels.quality / labels.toxic."""
    s = G.lm_score(_lead_pairs(spark, sf), _doc_lm(spark, sf), "pair_id", "document", "summary")
    lab = read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("pair_id"),
                                                 F.col("quality").cast("double").alias("quality"),
                                                 F.col("toxic").cast("double").alias("toxic"))
    j = s.filter(F.col("score").isNotNull()).join(lab, "pair_id").select("score", "quality", "toxic")
    c = G.correlate(j, "score", ["quality", "toxic"])
    return c.select(F.col("n").cast("bigint").alias("n"), "judgement", "method", r6(F.col("value")).alias("value"))


@register("g7_score_report", f"""WITH {sql_bg('documents')}, {LEAD_PAIRS}, {sql_lm_score('lp', 'pair_id', 'document', 'summary', 'sc')}
SELECT row_number() OVER (ORDER BY l.doc_id) AS pair_no, substr(l.document, 1, 50) || '...' AS document_preview,
       l.summary, round(s.score, 4) AS score FROM lp l JOIN sc s USING (pair_id)""")
def q_g7(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered report, 50-character document preview, score to 4 places."""
    lp = _lead_pairs(spark, sf)
    s = G.lm_score(lp, _doc_lm(spark, sf), "pair_id", "document", "summary")
    # the report needs the head of a document; it is scored once and written, since numbering reads it twice
    head = lp.select("pair_id", "doc_id", F.substring("document", 1, 50).alias("document"), "summary")
    j = cut_lineage(head.join(s, "pair_id"))
    j = j.withColumn("_shard", numeric_shard(j, "doc_id", 256))
    j = sharded_row_number(j, ["doc_id"], "_shard", out="pair_no")
    return G.score_report(j, "pair_no", "document", "summary", "score", 50)


def sql_overlap(pairs: str, doc: str, summary: str, max_words: int | None) -> str:
    """CTEs ending in ``ov(pair_id, score, score_error)``: the overlap scorer's formula and errors."""
    long = f"len(d) > {max_words}" if max_words is not None else "false"
    return (f"ov_b AS (SELECT pair_id, {S.lm_tokens(doc)} AS d, {S.lm_tokens(summary)} AS s FROM {pairs}), "
            f"ov_x AS (SELECT pair_id, d, len(d) AS n, unnest(s) AS w FROM ov_b WHERE NOT {long}), "
            f"ov_a AS (SELECT pair_id, avg(ln(0.5::DOUBLE * (CASE WHEN n > 0 THEN len(list_filter(d, lambda x: x = w))::DOUBLE / n ELSE 0.0::DOUBLE END) "
            f"+ 0.5::DOUBLE / (n + 1))) AS score FROM ov_x GROUP BY pair_id), "
            f"ov AS (SELECT b.pair_id, {S.r6('a.score')} AS score, CASE WHEN {long} THEN 'ValueError: input of ' || len(d) || ' words exceeds {max_words}' "
            f"WHEN len(s) = 0 THEN 'ValueError: empty target' END AS score_error FROM ov_b b LEFT JOIN ov_a a USING (pair_id))")


@register("g1_score_pairs", f"WITH {FX.sql_pair()}, {sql_overlap('fx_pair', 'candidate', 'reference', None)} SELECT * FROM ov")
def q_g1(spark: SparkSession, sf: str) -> DataFrame:
    """G1: user scorer (deterministic Python scorer) in batches of 8 via mapInPandas."""
    p = FX.fx_pair(spark, sf).select("pair_id", F.col("candidate").alias("document"),
                                     F.col("reference").alias("summary"))
    return G.score_pairs(p, lambda: G.OverlapScorer(), "pair_id", batch_size=G.SCORE_BATCH).withColumn("score", r6(F.col("score")))


@register("g8_quarantine", f"WITH {LEAD_PAIRS}, {sql_overlap('lp', 'document', 'summary', 500)} SELECT * FROM ov")
def q_g8(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer with a 500-word input limit: long documents are quarantined
    (null score + reason), every other pair keeps its score."""
    lp = _lead_pairs(spark, sf).select("pair_id", "document", "summary")
    scored = G.score_pairs(lp, lambda: G.OverlapScorer(max_words=500), "pair_id",
                           batch_size=G.SCRIPT_SCORE_BATCH)
    return scored.withColumn("score", r6(F.col("score")))
