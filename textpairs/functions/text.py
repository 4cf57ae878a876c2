"""Text rules shared by the operators, all JVM-side built-ins.

Regexes are Java syntax (Spark); the SQL mirror in ``textpairs.plans.sqlbits``
states the same rules for the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: special tokens in id order (names from the reference's
# tokenizer plan; order ours)
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>", "<unk>", "[MASK]"]
BOS_ID, PAD_ID, EOS_ID, UNK_ID, MASK_ID = 0, 1, 2, 3, 4
LABEL_IGNORE = -100

SENTENCE_END = r"([.!?])\s+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once. An expression that a lambda captures would be
    evaluated anew for every element, even if it stands in a column of its own."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


#: What ``\\s`` matches in a Java pattern.
WHITESPACE = " \t\n\x0B\f\r"


def strip_ws(c) -> Column:
    """Strip all leading and trailing whitespace (``trim`` strips spaces only)."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def words(c) -> Column:
    """Word mode: split on whitespace runs, empties dropped, case kept."""
    return F.array_remove(F.split(col_(c), r"\s+"), "")


def sentences(c) -> Column:
    """Rule-based sentence split: a mark in ``.!?`` followed by whitespace ends a
    sentence; lines are sentences too. Pieces are stripped, empties dropped."""
    marked = F.regexp_replace(strip_ws(c), SENTENCE_END, "$1\n")
    parts = F.split(marked, "\n")
    return F.filter(F.transform(parts, lambda x: strip_ws(x)), lambda x: x != F.lit(""))


def lead_sentence(c) -> Column:
    """First of the ``sentences``; null for a blank text. The text is read as far as that sentence goes."""
    first = F.regexp_extract(F.ltrim(col_(c), F.lit(WHITESPACE)), r"(?s)^(.*?)(?:(?<=[.!?])\s|\n|\z)", 1)
    return F.nullif(strip_ws(first), F.lit(""))


def has_second_sentence(c) -> Column:
    """Whether a text has two ``sentences`` or more: something stands after the first. The text is read as far as that."""
    return F.ltrim(col_(c), F.lit(WHITESPACE)).rlike(r"(?:[.!?]\s|\n)\s*\S")


def rouge_tokens(c, ascii_only: bool = True) -> Column:
    """ROUGE tokens: lower case, every run of other characters becomes a break.

    ``ascii_only=True`` keeps ``[a-z0-9]`` (the public ROUGE package's rule, which
    splits accented letters); ``False`` keeps any Unicode letter or digit.
    """
    pat = "[^a-z0-9]+" if ascii_only else r"[^\p{L}\p{N}]+"
    return F.array_remove(F.split(F.lower(col_(c)), pat), "")


def lm_tokens(c) -> Column:
    """Tokens for the language-model scorer and perplexity: Unicode-aware."""
    return rouge_tokens(c, ascii_only=False)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, in order."""
    if n == 1:
        return tokens
    k = F.size(tokens) - F.lit(n - 1)
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                                     lambda i: F.array_join(F.slice(tokens, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))
