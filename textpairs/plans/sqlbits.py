"""The same text and hash rules as ``textpairs.functions``, as DuckDB SQL text.

Used only to write the oracle queries in ``textpairs.plans.catalog``.
"""

from __future__ import annotations


def h(seed, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


def u(seed, key: str) -> str:
    return f"({h(seed, key)}::DOUBLE / 4294967296.0)"


def poisson1(uexpr: str) -> str:
    return (f"(CASE WHEN {uexpr} < 0.36788 THEN 0 WHEN {uexpr} < 0.73576 THEN 1 "
            f"WHEN {uexpr} < 0.91970 THEN 2 WHEN {uexpr} < 0.98101 THEN 3 "
            f"WHEN {uexpr} < 0.99634 THEN 4 ELSE 5 END)::BIGINT")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '\\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    marked = f"regexp_replace({strip(x)}, '([.!?])\\s+', '\\1' || chr(10), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(10)), "
            f"lambda s: {strip('s')}), lambda s: s <> '')")


def lead(x: str) -> str:
    return f"({sentences(x)})[1]"


def rouge_tokens(x: str, ascii_only: bool = True) -> str:
    pat = "[^a-z0-9]+" if ascii_only else "[^\\p{L}\\p{N}]+"
    return (f"list_filter(string_split(regexp_replace(lower({x}), '{pat}', ' ', 'g'), ' '), "
            f"lambda t: t <> '')")


def lm_tokens(x: str) -> str:
    return rouge_tokens(x, ascii_only=False)


def ngrams(toks: str, n: int) -> str:
    if n == 1:
        return toks
    return (f"(CASE WHEN len({toks}) >= {n} THEN list_transform(range(1, len({toks}) - {n - 2}), "
            f"lambda i: array_to_string(list_slice({toks}, i, i + {n - 1}), ' ')) ELSE [] END)")


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"
