"""Registered queries (one per inventory id) and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLES[name]`` is SQL over the
pre-registered views (documents, labels, conversations, ...). Computed columns
carry the same alias on both sides; arrays are returned as joined strings and
doubles rounded to 6 places so both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.plans import fixtures as FX
from textpairs.plans import sqlbits as S
from textpairs.session import apply_job_conf, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCAB_SIZE = 8000
MIN_FREQ = 2


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            apply_job_conf(spark)
            return fn(spark, sf)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def r6(c) -> F.Column:
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- shared SQL

SPECIALS_SQL = "('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3), ('[MASK]', 4)"


def sql_vocab(size: int = VOCAB_SIZE, min_freq: int = MIN_FREQ, src: str = "documents",
              col: str = "text", name: str = "vocab") -> str:
    n = size - 5
    return (f"{name}_wc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({S.words(col)}) AS token "
            f"FROM {src}) GROUP BY token HAVING count(*) >= {min_freq} AND token NOT IN "
            f"('<s>', '<pad>', '</s>', '<unk>', '[MASK]')), "
            f"{name} AS (SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 4)::BIGINT AS id, "
            f"cnt FROM {name}_wc QUALIFY row_number() OVER (ORDER BY cnt DESC, token) <= {n} "
            f"UNION ALL SELECT token, id::BIGINT, NULL::BIGINT FROM (VALUES {SPECIALS_SQL}) t(token, id))")


def sql_encode_ids(src: str, key: str, text_expr: str, max_len: int, name: str, vocab: str = "vocab") -> str:
    """CTE ``name(key..., ids)``: '<s> ids </s>' as a space-joined string."""
    arr = f"list_slice({S.words(text_expr)}, 1, {max_len - 2})"
    return (f"{name}_t AS (SELECT {key}, unnest(range(1, len({arr}) + 1)) AS pos, unnest({arr}) AS token "
            f"FROM {src}), "
            f"{name}_g AS (SELECT {key}, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ' ' ORDER BY t.pos) AS s "
            f"FROM {name}_t t LEFT JOIN {vocab} v ON t.token = v.token GROUP BY ALL), "
            f"{name} AS (SELECT {key}, '0' || coalesce(' ' || g.s, '') || ' 2' AS ids FROM {src} "
            f"LEFT JOIN {name}_g g USING ({key}))")


# ------------------------------------------------------------------ M0 flagship

def _vocab(spark: SparkSession, sf: str, size: int = VOCAB_SIZE, min_freq: int = MIN_FREQ):
    from textpairs.operators.vocab import build_vocab
    return build_vocab(read_table(spark, sf, "documents"), "text", size, min_freq)


PAIRS_SQL = FX.sql_pairs()
PREP_CTES = f"""{PAIRS_SQL}, {FX.sql_valid()}, {sql_vocab()},
{sql_encode_ids('valid', 'split, row_key', "'summarize: ' || input_text", 1024, 'enc_in')},
{sql_encode_ids('valid', 'split, row_key', 'target_text', 128, 'enc_lab')},
prep AS (SELECT c.split, c.source, c.row_key,
       row_number() OVER (PARTITION BY c.split ORDER BY md5('42|' || c.row_key), c.row_key) AS shuffle_rank,
       i.ids AS input_ids, l.ids AS labels
FROM valid c JOIN enc_in i USING (split, row_key) JOIN enc_lab l USING (split, row_key))"""
PREPARE_SQL = f"WITH {PREP_CTES} SELECT split, source, row_key, shuffle_rank, input_ids, labels FROM prep"


@register("prepare_pairs", PREPARE_SQL)
def q_prepare_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: all sources -> canonical -> rejects out -> prefix -> encode -> concat -> shuffle."""
    from textpairs.plans.prepare import joined_ids, prepare_pairs
    out = prepare_pairs(spark, FX.fixture_specs(sf), _vocab(spark, sf), VOCAB_SIZE)
    return joined_ids(out)


# Query modules register themselves on import.
from textpairs.plans import q_ingest  # noqa: E402,F401
from textpairs.plans import q_tokens  # noqa: E402,F401
from textpairs.plans import q_eval  # noqa: E402,F401
from textpairs.plans import q_score  # noqa: E402,F401
from textpairs.plans import q_clean  # noqa: E402,F401
from textpairs.plans import q_io  # noqa: E402,F401
