"""Registered queries of the operators: thin digests over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.llm import bpe_codec, decontaminate, html_extract, importance, masked_lm, minhash, oracles, prefix_trie, quality_rules, sharding, simhash, token_files, toxicity, url_filters
from textpairs.session import apply_job_conf, cut_lineage, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_job_conf(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return groups.select(F.col("id").alias("doc_id"),
                         F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.fit_and_score(docs)


SHARDS = 24


def op3_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    digest = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(digest, ["doc_id"], SHARDS)
    return sharding.with_slots(placed.withColumn("law", F.lit("key")), SHARDS)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(toxicity.in_training_fold(F.col("doc_id"))))
    scored = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", F.coalesce(~toxicity.in_training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The site rules of the query.
SITE_RULES = [
    url_filters.SiteRule("block", "net", "/"),
    url_filters.SiteRule("allow", "example.net", "/en/"),
    url_filters.SiteRule("block", "example.com", "/de/"),
    url_filters.SiteRule("allow", "org", "/fr/"),
]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def _op5_sql() -> str:
    host = "translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.host}{r.path}'"
                    for r in sorted(SITE_RULES, key=lambda r: -len(r.host + r.path)))
    verdicts = " ".join(f"WHEN '{r.host}{r.path}' THEN '{r.verdict}'" for r in SITE_RULES)

    def any_of(verdict: str) -> str:
        regexes = [url_filters.pattern_regex(p.pattern).replace("'", "''") for p in url_filters.DEFAULT_PATTERNS if p.verdict == verdict]
        return "contains(url, '://') AND (" + " OR ".join(f"regexp_matches(lower(url), '{r}')" for r in regexes) + ")"

    return f"""
WITH parts AS (
  SELECT page_id, url, {host} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {fits} END AS rule FROM parts)
SELECT page_id, host, path, rule,
  coalesce(CASE rule {verdicts} END, CASE WHEN {any_of('allow')} THEN 'allow' WHEN {any_of('block')} THEN 'block' END, 'allow') AS verdict
FROM ruled"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return (decontaminate.contaminated(docs, benchmark)
            .select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "run_words", "item_words"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file (installed on every machine, never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return (token_files.read_token_files(spark, path)
            .select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path("byte_bpe_50k.json")
    out = bpe_codec.round_trip(docs, path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return (html_extract.extract(pages.select("page_id", "url", "html"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut_lineage(quality_rules.measure(_table(spark, sf_dir, "documents")))
    good = quality_rules.good_documents(measured, _table(spark, sf_dir, "labels"))
    judged = quality_rules.verdict(measured, quality_rules.thresholds(good))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return importance.resample(docs, target).withColumnRenamed("id", "doc_id")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicate_groups(_table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return groups.withColumnRenamed("id", "doc_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    nodes = prefix_trie.conversation_trie(
        _table(spark, sf_dir, "conversations"), base=conv - conv % 100,
        shared=(F.crc32(conv.cast("string").cast("binary")) % 6).cast("int"), most_shared=5)
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
                        "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_masked_lm": op2_masked_lm,
    "op3_jump_hash": op3_jump_hash,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_planes": op7_token_planes,
    "op8_bpe": op8_bpe,
    "op9_html": op9_html,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance": op11_importance,
    "op12_minhash": op12_minhash,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op5_url_filters": _op5_sql(),
    "op11_importance": oracles.importance_sql(),
    "op12_minhash": oracles.minhash_sql(3, 85),
    "op13_prefix_trie": oracles.trie_sql(),
}
