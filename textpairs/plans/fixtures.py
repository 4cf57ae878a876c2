"""Fixture views over the test tables (FIXTURES.md section 3), in Spark and as
SQL CTE text for the DuckDB oracle. Every fixture is derived from the given
tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpairs.functions.hashing import h
from textpairs.functions.text import lead_sentence, sentences
from textpairs.plans import sqlbits as S
from textpairs.session import read_table
from textpairs.sources.registry import IDENTITY_SPLITS, VALIDATION_FROM_TEST, SourceSpec

# Sources: (name, lang, document column, summary column, split map). The column
# names are fixed values of the reference's sources. One more source has no
# column mapping and must fail.
FIXTURE_SOURCES = [
    ("set_a", "en", "document", "summary", IDENTITY_SPLITS),
    ("set_b", "fr", "article", "summary", VALIDATION_FROM_TEST),
    ("set_c", "de", "text", "summary", VALIDATION_FROM_TEST),
    ("set_d", "es", "body", "summary", IDENTITY_SPLITS),
]
FAILING_SOURCE = ("set_e", "it", "body", "summary")


# ---------------------------------------------------------------- Spark side

def stored_split_col() -> F.Column:
    b = h(42, F.col("doc_id")) % F.lit(100)
    return (F.when(b < 80, F.lit("train")).when(b < 90, F.lit("validation"))
            .otherwise(F.lit("test")))


def fx_stored(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").withColumn("stored_split", stored_split_col())


def _loader(sf: str, lang: str, doc_col: str, sum_col: str):
    def load(spark: SparkSession) -> DataFrame:
        d = fx_stored(spark, sf).filter(F.col("lang") == F.lit(lang))
        return d.select(F.col("doc_id").alias("row_no"), F.col("text").alias(doc_col),
                        lead_sentence("text").alias(sum_col), "stored_split")
    return load


def fixture_specs(sf: str, with_failing: bool = False) -> list[SourceSpec]:
    specs = [SourceSpec(name=n, document_col=d, summary_col=s, split_map=m,
                        loader=_loader(sf, lang, d, s))
             for n, lang, d, s, m in FIXTURE_SOURCES]
    if with_failing:
        n, lang, d, s = FAILING_SOURCE
        specs.append(SourceSpec(name=n, document_col=None, summary_col=None,
                                loader=_loader(sf, lang, d, s)))
    return specs


def fx_pair(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn): candidate = this turn, reference = the next turn."""
    c = read_table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (c.select("conv_id", "turn", F.col("text").alias("candidate"),
                     F.lead("text").over(w).alias("reference"),
                     F.lead("turn").over(w).alias("next_turn"))
            .filter(F.col("next_turn").isNotNull()).drop("next_turn")
            .withColumn("pair_id", F.concat_ws(":", F.col("conv_id").cast("string"),
                                               F.col("turn").cast("string"))))


def fx_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate = first assistant turn of a conversation; references = its
    other assistant turns in turn order (ragged). Conversations with 2+
    assistant turns only."""
    a = read_table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    g = a.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return (g.filter(F.size("_t") >= 2)
            .select(F.col("conv_id").cast("string").alias("candidate_id"),
                    F.element_at("_t", 1)["text"].alias("candidate"),
                    F.transform(F.slice("_t", 2, 1 << 30), lambda s: s["text"]).alias("references")))


def fx_systems(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: system A = first sentence, system B = last sentence."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", sentences("text").alias("_s"))
    d = d.filter(F.size("_s") >= 1)
    return (d.select(F.col("doc_id").cast("string").alias("pair_id"), F.col("text").alias("document"),
                     F.element_at("_s", 1).alias("A"), F.element_at("_s", -1).alias("B")))


def fx_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoint metrics derived from conversations: run = conversation,
    step = turn, loss = ln(1 + characters) to one place (ties occur)."""
    c = read_table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("run"), F.col("turn").alias("step"),
                    F.lit("loss").alias("name"),
                    F.round(F.log(F.length("text").cast("double") + F.lit(1.0)), 1).alias("value"))


# ------------------------------------------------------------------ SQL side

def sql_stored() -> str:
    b = f"({S.h(42, 'doc_id')} % 100)"
    return (f"fx_stored AS (SELECT *, CASE WHEN {b} < 80 THEN 'train' WHEN {b} < 90 THEN 'validation' "
            f"ELSE 'test' END AS stored_split FROM documents)")


def sql_sources() -> str:
    parts = [f"SELECT '{n}' AS source, doc_id AS row_no, text AS input_text, "
             f"{S.lead('text')} AS target_text, stored_split FROM fx_stored WHERE lang = '{lang}'"
             for n, lang, _d, _s, _m in FIXTURE_SOURCES]
    return "fx_src AS (" + " UNION ALL ".join(parts) + ")"


def sql_mapping(splits=("train", "validation", "test")) -> str:
    rows = [f"('{n}', '{sp}', '{m[sp]}')" for n, _l, _d, _s, m in FIXTURE_SOURCES for sp in splits]
    return f"fx_map(source, split, stored_split) AS (VALUES {', '.join(rows)})"


def sql_pairs() -> str:
    """All canonical fixture sources resolved to splits."""
    return ", ".join([
        sql_stored(), sql_sources(), sql_mapping(),
        "fx_pairs AS (SELECT s.source, m.split, s.row_no, s.source || ':' || CAST(s.row_no AS VARCHAR) "
        "AS row_key, s.input_text, s.target_text FROM fx_src s JOIN fx_map m "
        "ON s.source = m.source AND s.stored_split = m.stored_split)"])


def sql_capped(train_cap: int, eval_cap: int, src: str = "fx_pairs", name: str = "capped") -> str:
    return (f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, split "
            f"ORDER BY row_no) AS rn FROM {src}) WHERE rn <= CASE WHEN split = 'train' THEN {train_cap} "
            f"ELSE {eval_cap} END)")


def sql_valid(src: str = "fx_pairs", name: str = "valid") -> str:
    """Pairs with two sides that are not blank and a row key that no other row of the split has."""
    ok = " AND ".join(f"{c} IS NOT NULL AND {S.strip(c)} <> ''" for c in ("input_text", "target_text"))
    return (f"{name} AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY split, row_key) AS n "
            f"FROM {src}) WHERE n = 1 AND {ok})")


def sql_pair() -> str:
    return ("fx_pair AS (SELECT * FROM (SELECT conv_id, turn, text AS candidate, "
            "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference, "
            "lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn, "
            "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS pair_id FROM conversations) "
            "WHERE next_turn IS NOT NULL)")


def sql_multi() -> str:
    return ("fx_multi AS (SELECT CAST(conv_id AS VARCHAR) AS candidate_id, t[1].text AS candidate, "
            "list_transform(list_slice(t, 2, len(t)), lambda x: x.text) AS refs FROM "
            "(SELECT conv_id, list(struct_pack(turn := turn, text := text) ORDER BY turn) AS t "
            "FROM conversations WHERE role = 'assistant' GROUP BY conv_id) WHERE len(t) >= 2)")


def sql_systems() -> str:
    return (f"fx_systems AS (SELECT CAST(doc_id AS VARCHAR) AS pair_id, text AS document, s[1] AS A, "
            f"s[len(s)] AS B FROM (SELECT doc_id, text, {S.sentences('text')} AS s FROM documents) "
            f"WHERE len(s) >= 1)")


def sql_runs() -> str:
    return ("fx_runs AS (SELECT conv_id AS run, turn AS step, 'loss' AS name, "
            "round(ln(length(text)::DOUBLE + 1.0), 1) AS value FROM conversations)")
