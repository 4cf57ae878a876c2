"""Queries for corpus cleaning (C1-C6), near-duplicates (C3) and BPE (T2, T3 bpe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.operators import bpe as BP
from textpairs.operators import clean as C
from textpairs.operators import dedup as D
from textpairs.plans import sqlbits as S
from textpairs.plans.catalog import r6, register
from textpairs.session import read_table


def sql_norm(x: str) -> str:
    t = f"nfc_normalize({x})"
    t = f"regexp_replace({t}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    t = f"regexp_replace({t}, '[ \\t\\r]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' ?\\n ?', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n+', chr(10), 'g')"
    return S.strip(t)


NORM = f"norm AS (SELECT doc_id, {sql_norm('text')} AS text FROM documents)"


def sql_signals(src: str, name: str) -> str:
    lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')"
    sig = (f"{name}_s AS (SELECT doc_id, text, w, lines, len(w)::BIGINT AS n_words, "
           f"CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) END AS mean_word_len, "
           f"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g'))::DOUBLE / length(text) ELSE 0.0 END AS symbol_share, "
           f"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / length(text) ELSE 0.0 END AS digit_share, "
           f"CASE WHEN len(lines) > 0 THEN 1.0 - len(list_distinct(lines))::DOUBLE / len(lines) ELSE 0.0 END AS repeated_line_share "
           f"FROM (SELECT doc_id, text, {S.words('text')} AS w, {lines} AS lines FROM {src})), ")
    reasons = ("list_filter([CASE WHEN n_words < 20 THEN 'too_few_words' END, "
               "CASE WHEN mean_word_len IS NULL OR mean_word_len < 2.0 OR mean_word_len > 12.0 THEN 'word_length' END, "
               "CASE WHEN symbol_share > 0.3 THEN 'symbols' END, CASE WHEN digit_share > 0.2 THEN 'digits' END, "
               "CASE WHEN repeated_line_share > 0.3 THEN 'repeated_lines' END], lambda x: x IS NOT NULL)")
    return sig + f"{name} AS (SELECT *, {reasons} AS reasons, len({reasons}) = 0 AS keep FROM {name}_s)"


def sql_common_lines(src: str, name: str) -> str:
    return (f"{name}_ex AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line "
            f"FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {src})), "
            f"{name}_ek AS (SELECT *, {S.strip('line')} AS key FROM {name}_ex), "
            f"{name}_c AS (SELECT key FROM {name}_ek WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 5), "
            f"{name}_f AS (SELECT e.doc_id, e.pos, e.line, c.key IS NOT NULL AS is_common FROM {name}_ek e "
            f"LEFT JOIN {name}_c c ON e.key = c.key), "
            f"{name} AS (SELECT doc_id, coalesce(string_agg(CASE WHEN NOT is_common THEN line END, chr(10) ORDER BY pos), '') AS text, "
            f"sum(CASE WHEN is_common THEN 1 ELSE 0 END)::BIGINT AS lines_removed FROM {name}_f GROUP BY doc_id)")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text")


@register("c1_normalise", f"WITH {NORM} SELECT doc_id, text FROM norm")
def q_c1(spark: SparkSession, sf: str) -> DataFrame:
    """NFC, control characters out, whitespace runs collapsed, stripped."""
    return C.normalise(_docs(spark, sf))


@register("c2_dedup_exact", f"WITH {NORM} SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM norm GROUP BY md5(text)")
def q_c2(spark: SparkSession, sf: str) -> DataFrame:
    """Exact duplicates of the normalised text; lowest id kept, copies counted."""
    return C.exact_groups(C.normalise(_docs(spark, sf))).select("doc_id", "copies")


@register("c4_quality", f"""WITH {NORM}, {sql_signals('norm', 'sg')}
SELECT doc_id, n_words, {S.r6('mean_word_len')} AS mean_word_len, {S.r6('symbol_share')} AS symbol_share,
       {S.r6('digit_share')} AS digit_share, {S.r6('repeated_line_share')} AS repeated_line_share,
       array_to_string(reasons, ',') AS reasons, keep FROM sg""")
def q_c4(spark: SparkSession, sf: str) -> DataFrame:
    """C4: quality signals and the failed rules of every normalised document."""
    q = C.quality_reasons(C.quality_signals(C.normalise(_docs(spark, sf))))
    return q.select("doc_id", "n_words", *[r6(F.col(c)).alias(c) for c in
                                           ("mean_word_len", "symbol_share", "digit_share", "repeated_line_share")],
                    F.array_join("reasons", ",").alias("reasons"), "keep")


@register("c5_common_lines", f"WITH {sql_common_lines('documents', 'cl')} SELECT doc_id, text, lines_removed FROM cl")
def q_c5(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of 20+ characters found in 5+ documents removed corpus-wide."""
    return C.drop_common_lines(_docs(spark, sf))


def _sql_minhash(source: str = "documents") -> str:
    w = S.words("lower(text)")
    hx = ", ".join(f"list_transform(sh, lambda s: md5('{g}|' || s)) AS h{g}" for g in range(8))
    mins = [f"list_min(list_transform(h{j // 4}, lambda x: substr(x, {8 * (j % 4) + 1}, 8)))" for j in range(32)]
    sep = " || '-' || "
    bands = ", ".join(f"struct_pack(band := {b}, band_key := {sep.join(mins[4 * b:4 * b + 4])})"
                      for b in range(8))
    return (f"sh AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct({S.ngrams('w', 3)}) "
            f"ELSE [array_to_string(w, ' ')] END AS sh FROM (SELECT doc_id, {w} AS w FROM {source})), "
            f"hx AS (SELECT doc_id, {hx} FROM sh), "
            f"bk AS (SELECT doc_id, unnest([{bands}]) AS b FROM hx)")


def _sql_near() -> str:
    """CTEs ending in ``nd(doc_id, component, keep)``: pairs of ``sh``/``bk`` that share a band and reach
    Jaccard 0.7, and their components (needs WITH RECURSIVE)."""
    return (f"bp AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM bk a JOIN bk b ON a.b.band = b.b.band AND a.b.band_key = b.b.band_key "
            f"AND a.doc_id < b.doc_id), "
            f"vp AS (SELECT x, y FROM (SELECT x, y, len(list_intersect(s.sh, t.sh)) AS i, len(s.sh) + len(t.sh) AS n FROM bp "
            f"JOIN sh s ON s.doc_id = x JOIN sh t ON t.doc_id = y) WHERE i::DOUBLE / (n - i) >= {D.THRESHOLD}), "
            f"bo AS (SELECT x, y FROM vp UNION ALL SELECT y, x FROM vp), "
            f"rc AS (SELECT doc_id AS x, doc_id AS y FROM sh UNION SELECT rc.x, bo.y FROM rc JOIN bo ON rc.y = bo.x), "
            f"nd AS (SELECT x AS doc_id, min(y) AS component, min(y) = x AS keep FROM rc GROUP BY x)")


@register("c6_funnel", f"""WITH RECURSIVE {NORM},
dd AS (SELECT n.doc_id, n.text FROM norm n JOIN (SELECT min(doc_id) AS doc_id FROM norm GROUP BY md5(text)) k USING (doc_id)),
{sql_signals('dd', 'sg')}, q AS (SELECT doc_id, text FROM sg WHERE keep), {sql_common_lines('q', 'cl')},
kl AS (SELECT doc_id, text FROM cl WHERE length(text) > 0), {_sql_minhash('kl')}, {_sql_near()},
c AS (SELECT '0_input' AS step, count(*) AS rows FROM documents UNION ALL SELECT '1_normalise', count(*) FROM norm
      UNION ALL SELECT '2_dedup_exact', count(*) FROM dd UNION ALL SELECT '3_quality', count(*) FROM q
      UNION ALL SELECT '4_common_lines', count(*) FROM kl
      UNION ALL SELECT '5_dedup_near', count(*) FROM nd WHERE keep),
l AS (SELECT step, rows, coalesce(lag(rows) OVER (ORDER BY step), rows) AS rows_in FROM c),
rr AS (SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM sg) GROUP BY reason)
SELECT step, 'all' AS reason, rows_in::BIGINT AS rows_in, (rows_in - rows)::BIGINT AS removed, rows::BIGINT AS rows_out FROM l
UNION ALL SELECT '3_quality', reason, (SELECT count(*) FROM dd)::BIGINT, n::BIGINT, ((SELECT count(*) FROM dd) - n)::BIGINT FROM rr""")
def q_c6(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning funnel: rows in, removed and out per step and reason, near duplicates included."""
    return C.funnel(_docs(spark, sf))


@register("c3_minhash", f"WITH {_sql_minhash()} SELECT doc_id, b.band::BIGINT AS band, b.band_key AS band_key FROM bk")
def q_c3m(spark: SparkSession, sf: str) -> DataFrame:
    """C3 (signatures): md5 MinHash, 32 hashes in 8 bands of 4, per document."""
    return D.band_keys(_docs(spark, sf))


@register("c3_dedup_near")
def q_c3(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components (LSH candidates, verified Jaccard >= 0.7)."""
    return D.dedup_near(_docs(spark, sf))


@register("c3_dedup_near_md5", f"WITH RECURSIVE {_sql_minhash()}, {_sql_near()} SELECT doc_id, component, keep FROM nd")
def q_c3_md5(spark: SparkSession, sf: str) -> DataFrame:
    """C3 with repeatable (md5) signatures: the same operator, comparable with SQL."""
    return D.dedup_near(_docs(spark, sf), hash_kind="md5")


@register("t2_pair_counts", f"""WITH wt AS (SELECT regexp_replace(hex(encode(w)), '(..)', '<\\1>', 'g') AS sym, count(*) AS cnt
   FROM (SELECT unnest({S.words('text')}) AS w FROM documents) GROUP BY w),
sy AS (SELECT regexp_extract_all(sym, '<[^>]*>') AS s, cnt FROM wt),
pr AS (SELECT unnest(list_transform(range(1, len(s)), lambda i: s[i] || s[i + 1])) AS pair, cnt FROM sy WHERE len(s) >= 2)
SELECT pair, sum(cnt)::BIGINT AS cnt FROM pr GROUP BY pair""")
def q_t2p(spark: SparkSession, sf: str) -> DataFrame:
    """T2 (round 1): byte-pair counts over word types weighted by frequency."""
    return BP.pair_counts(BP.word_types(_docs(spark, sf)))


@register("t2_learn_bpe")
def q_t2(spark: SparkSession, sf: str) -> DataFrame:
    """The first ``N_MERGES`` exact BPE merges over the corpus's word types."""
    return BP.learn_bpe(BP.counted_types(_docs(spark, sf)), BP.N_MERGES)


@register("t3_encode_bpe")
def q_t3b(spark: SparkSession, sf: str) -> DataFrame:
    """T3 (bpe mode): documents split by the learned merges (first 1022 tokens)."""
    docs = _docs(spark, sf)
    types = BP.counted_types(docs)
    _, segments = BP.learn_segments(types, BP.N_MERGES)
    e = BP.bpe_encode(docs, segments, types, ["doc_id"], max_tokens=1022)
    return e.select("doc_id", F.size("bpe_tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("bpe_tokens", " ").alias("bpe_tokens"))


@register("t3_encode_bpe_ids")
def q_t3b_ids(spark: SparkSession, sf: str) -> DataFrame:
    """T3 (bpe mode) to ids: bytes and ``N_MERGES`` learned merges, at most 1024 ids with
    <s> and </s>; words look up their ids by slices of rows (tested by brute force)."""
    docs = _docs(spark, sf)
    types = BP.counted_types(docs)
    merges, segments = BP.learn_segments(types, BP.N_MERGES)
    e = BP.bpe_encode_ids(docs, segments, types, BP.bpe_vocab(merges), BP.N_MERGES, ["doc_id"])
    return e.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))
