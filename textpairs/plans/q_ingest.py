"""Queries for sources, pairs, joins, caps, shuffle and union (S, P, J, L, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textpairs.functions.text import lead_sentence
from textpairs.operators import pairs as P
from textpairs.operators.sampling import cap, shuffle
from textpairs.plans import fixtures as FX
from textpairs.plans import sqlbits as S
from textpairs.plans.catalog import r6, register
from textpairs.session import read_table
from textpairs.sources import registry as R

PAIRS = FX.sql_pairs()


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_sources(spark, FX.fixture_specs(sf))


@register("s1_read_sources", f"WITH {PAIRS} SELECT source, split, row_no, row_key, input_text, target_text FROM fx_pairs")
def q_s1(spark: SparkSession, sf: str) -> DataFrame:
    """Registry-driven read of all sources into one canonical table."""
    return _pairs(spark, sf)


@register("s3_declared_schema",
          "SELECT text FROM documents UNION ALL SELECT text FROM benchmark")
def q_s3(spark: SparkSession, sf: str) -> DataFrame:
    """S3: two tables' files read under one declared schema (``text string``)."""
    schema = StructType([StructField("text", StringType())])
    base = sf.rstrip("/")
    return R.read_with_schema(spark, [f"{base}/documents.parquet", f"{base}/benchmark.parquet"], schema)


@register("s4_resolve_splits", f"""WITH {PAIRS}
SELECT s.source, m.split, s.stored_split, s.row_no FROM fx_src s
JOIN fx_map m ON s.source = m.source AND s.stored_split = m.stored_split""")
def q_s4(spark: SparkSession, sf: str) -> DataFrame:
    """Requested split <- stored split; a test row also serves validation."""
    specs = FX.fixture_specs(sf)
    stored = P.concat_sources([R.canonical_source(spark, s) for s in specs])
    mapping = R.split_mapping(spark, specs)
    return R.resolve_splits(stored, mapping, 64).select("source", "split", "stored_split", "row_no")


@register("s5_load_report", f"""WITH {PAIRS}
SELECT source, split, 'ok' AS status, count(*)::BIGINT AS rows, NULL::VARCHAR AS error
FROM fx_pairs GROUP BY source, split
UNION ALL
SELECT 'set_e', split, 'error', 0::BIGINT, 'source ''set_e'': no column mapping registered'
FROM (VALUES ('train'), ('validation'), ('test')) t(split)""")
def q_s5(spark: SparkSession, sf: str) -> DataFrame:
    """The failing source is reported and skipped; the rest is loaded."""
    _pairs_df, report = R.load_with_report(spark, FX.fixture_specs(sf, with_failing=True))
    return report.drop("lost_files")


@register("s6_profile", f"""WITH {PAIRS},
agg AS (SELECT split, source, count(*)::BIGINT AS rows, avg(length(input_text)) AS a_in,
               avg(length(target_text)) AS a_tg FROM fx_pairs GROUP BY ROLLUP (split, source)),
tot AS (SELECT split, rows AS split_rows FROM agg WHERE source IS NULL AND split IS NOT NULL)
SELECT a.split, a.source, a.rows, {S.r6('a.a_in')} AS avg_input_chars, {S.r6('a.a_tg')} AS avg_target_chars,
       CASE WHEN a.source IS NOT NULL THEN {S.r6('a.rows / t.split_rows')} END AS share
FROM agg a LEFT JOIN tot t USING (split)""")
def q_s6(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, mean lengths and share per (split, source) with roll-up totals."""
    p = R.profile(_pairs(spark, sf))
    return p.select("split", "source", "rows", r6(F.col("avg_input_chars")).alias("avg_input_chars"),
                    r6(F.col("avg_target_chars")).alias("avg_target_chars"), r6(F.col("share")).alias("share"))


@register("s7_read_corpus", "SELECT doc_id, lang, length(text)::BIGINT AS chars FROM documents")
def q_s7(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus scan (only the needed columns reach the reader)."""
    c = R.read_corpus(spark, f"{sf.rstrip('/')}/documents.parquet")
    return c.select("doc_id", "lang", F.length("text").cast("bigint").alias("chars"))


@register("p2_canonicalise", f"""WITH {FX.sql_stored()}, {FX.sql_sources()}
SELECT source, row_no, input_text, target_text FROM fx_src""")
def q_p2(spark: SparkSession, sf: str) -> DataFrame:
    """Every source's own columns (document, article, ...) to input_text/target_text."""
    parts = []
    for spec in FX.fixture_specs(sf):
        stored = spec.loader(spark)
        P.require_columns(stored, spec.name, spec.document_col, spec.summary_col)
        one = P.canonicalise(stored, spec.document_col, spec.summary_col, keep=["row_no"])
        parts.append(one.withColumn("source", F.lit(spec.name)))
    return P.concat_sources(parts)


@register("p3_with_prefix", f"WITH {PAIRS} SELECT split, row_key, 'summarize: ' || input_text AS input_text FROM fx_pairs")
def q_p3(spark: SparkSession, sf: str) -> DataFrame:
    """Task prefix in front of every document."""
    return P.with_prefix(_pairs(spark, sf)).select("split", "row_key", "input_text")


def _messy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs with some sides and keys removed, blanked or repeated, by expression."""
    n = F.col("row_no")
    return _pairs(spark, sf).select(
        "source", "split",
        F.when(n % 17 == 0, F.lit(None)).when(n % 10 < 2, F.concat(F.lit("k"), F.floor(n / 10).cast("string")))
        .otherwise(F.col("row_key")).alias("row_key"),
        F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.lit(" \n ")).otherwise(F.col("input_text")).alias("input_text"),
        F.when(n % 13 == 0, F.lit(None)).when(n % 9 == 0, F.lit("")).otherwise(F.col("target_text")).alias("target_text"))


@register("p4_rejects", f"""WITH {PAIRS}, messy AS (SELECT source, split,
  CASE WHEN row_no % 17 = 0 THEN NULL WHEN row_no % 10 < 2 THEN 'k' || CAST(row_no // 10 AS VARCHAR) ELSE row_key END AS row_key,
  CASE WHEN row_no % 7 = 0 THEN NULL WHEN row_no % 11 = 0 THEN ' ' ELSE input_text END AS input_text,
  CASE WHEN row_no % 13 = 0 THEN NULL WHEN row_no % 9 = 0 THEN '' ELSE target_text END AS target_text FROM fx_pairs),
counted AS (SELECT *, count(*) OVER (PARTITION BY split, row_key) AS n FROM messy),
judged AS (SELECT source, split, row_key, CASE WHEN row_key IS NULL THEN 'missing_key' WHEN n > 1 THEN 'duplicate_key'
  WHEN input_text IS NULL THEN 'missing_document' WHEN target_text IS NULL THEN 'missing_summary'
  WHEN {S.strip('input_text')} = '' THEN 'blank_document' WHEN {S.strip('target_text')} = '' THEN 'blank_summary' END AS reason
  FROM counted)
SELECT * FROM judged WHERE reason IS NOT NULL""")
def q_p4_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair that preparation leaves out, with the reason."""
    return P.split_pairs(_messy_pairs(spark, sf))[1]


def _labelled_leads(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_semi").select("doc_id", lead_sentence("text").alias("summary"))


LEADS_SQL = (f"lleads AS (SELECT d.doc_id, {S.lead('d.text')} AS summary FROM documents d "
             f"WHERE d.doc_id IN (SELECT doc_id FROM labels))")


@register("p4_validate_pairs", f"""WITH {LEADS_SQL}
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
  CASE WHEN d.text IS NULL THEN 'missing_document' WHEN l.summary IS NULL THEN 'missing_summary'
       WHEN {S.strip('d.text')} = '' THEN 'blank_document' WHEN {S.strip('l.summary')} = '' THEN 'blank_summary'
       ELSE 'ok' END AS status
FROM documents d FULL OUTER JOIN lleads l ON d.doc_id = l.doc_id""")
def q_p4(spark: SparkSession, sf: str) -> DataFrame:
    """Unequal lists: every document, with or without a summary, gets a status."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"))
    v = P.validate_pairs(docs, _labelled_leads(spark, sf), "doc_id")
    return v.select("doc_id", "status")


@register("j1_align", f"""WITH {LEADS_SQL}
SELECT d.doc_id, length(d.text)::BIGINT AS doc_chars, l.summary FROM documents d JOIN lleads l ON d.doc_id = l.doc_id""")
def q_j1(spark: SparkSession, sf: str) -> DataFrame:
    """Documents aligned with summaries by key (duplicate keys rejected)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    aligned, _rejects = P.align(docs, _labelled_leads(spark, sf), "doc_id")
    return aligned.select("doc_id", F.length("text").cast("bigint").alias("doc_chars"), "summary")


@register("j2_expand_references", f"""WITH {FX.sql_multi()}
SELECT candidate_id, candidate, unnest(refs) AS reference, unnest(range(1, len(refs) + 1))::BIGINT AS ref_no
FROM fx_multi""")
def q_j2(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (candidate, reference) of ragged reference lists."""
    return P.expand_references(FX.fx_multi(spark, sf))


@register("l1_cap", f"WITH {PAIRS}, {FX.sql_capped(100, 10)} SELECT source, split, row_no FROM capped")
def q_l1(spark: SparkSession, sf: str) -> DataFrame:
    """L1: first 100 train / 10 validation / 10 test rows per source."""
    return cap(_pairs(spark, sf), {"train": 100, "validation": 10, "test": 10}).select("source", "split", "row_no")


@register("l2_shuffle", f"""WITH {PAIRS}
SELECT split, row_key, row_number() OVER (PARTITION BY split ORDER BY md5('42|' || row_key), row_key) AS shuffle_rank
FROM fx_pairs""")
def q_l2(spark: SparkSession, sf: str) -> DataFrame:
    """L2: seeded permutation rank per split (sharded, no single-task window)."""
    return shuffle(_pairs(spark, sf).select("split", "row_key")).select("split", "row_key", "shuffle_rank")


@register("u1_concat", f"WITH {PAIRS} SELECT split, source, count(*)::BIGINT AS rows FROM fx_pairs GROUP BY split, source")
def q_u1(spark: SparkSession, sf: str) -> DataFrame:
    """Per-split bag union of the sources (counts per contributing source)."""
    specs = FX.fixture_specs(sf)
    mapping = R.split_mapping(spark, specs)
    parts = [R.resolve_splits(R.canonical_source(spark, s), mapping, 64) for s in specs]
    u = P.concat_sources(parts)
    return u.groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"))
