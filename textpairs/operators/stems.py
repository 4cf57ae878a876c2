"""English stems of a table of distinct tokens (Porter, 1980: "An algorithm for
suffix stripping", Program 14(3)), as SQL rules.

Each step rewrites a word ``w`` by a table of suffixes. A second text ``m`` spells
``w`` in consonants and vowels (``toy`` is ``cvc``), so that the number of
vowel-consonant sequences of a stem is the number of ``vc`` in its part of
``m``. The rules are plain SQL text that Spark and DuckDB read alike; the
oracle is written from the same text. Stems are made once a distinct token and
joined back (``stemmed``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from textpairs.functions.multisets import codes, lengths, token_slices
from textpairs.operators.joins import with_key_rows
from textpairs.session import cut_lineage

# fixed values: suffix rules of the published algorithm, steps 2, 3 and 4
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Tokens longer than this are stemmed (the ROUGE convention).
LONGER_THAN = 3


def _ends(suffix: str) -> str:
    return f"right(w, {len(suffix)}) = '{suffix}'"


def _stem(suffix: str) -> str:
    return f"left(w, length(w) - {len(suffix)})"


def _mask(cut: int) -> str:
    return f"left(m, length(m) - {cut})"


def _measure(cut: int) -> str:
    """Vowel-consonant sequences of the word without its last ``cut`` letters."""
    return f"(length({_mask(cut)}) - length(replace({_mask(cut)}, 'vc', ''))) / 2"


def _vowel(cut: int) -> str:
    return f"{_mask(cut)} LIKE '%v%'"


def _cvc(cut: int) -> str:
    """Consonant, vowel, consonant other than w, x, y at the end of the stem."""
    return f"({_mask(cut)} LIKE '%cvc' AND right({_stem('_' * cut)}, 1) NOT IN ('w', 'x', 'y'))"


_DOUBLE = "(m LIKE '%c' AND length(w) >= 2 AND right(w, 1) = left(right(w, 2), 1))"


def _cases(rules: Sequence[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {out}" for cond, out in rules) + " ELSE w END"


def steps() -> list[str]:
    """The steps in order: each an expression for the next ``w`` over ``w`` and its ``m``."""
    plural = _cases([(_ends("sses"), _stem("es")), (_ends("ies"), _stem("es")), (_ends("ss"), "w"), (_ends("s"), _stem("s"))])
    # a mark ("+") tells the next step that -ed or -ing went
    past = _cases([(_ends("eed"), f"CASE WHEN {_measure(3)} > 0 THEN {_stem('d')} ELSE w END"),
                   (f"{_ends('ed')} AND {_vowel(2)}", f"{_stem('ed')} || '+'"),
                   (f"{_ends('ing')} AND {_vowel(3)}", f"{_stem('ing')} || '+'")])
    bare = "left(w, length(w) - 1)"
    ended = lambda *xs: "(" + " OR ".join(f"right({bare}, {len(x)}) = '{x}'" for x in xs) + ")"
    double = f"(right({bare}, 1) = left(right({bare}, 2), 1) AND length(w) >= 3 AND {_mask(1)} LIKE '%c')"
    mend = (f"CASE WHEN right(w, 1) <> '+' THEN w WHEN {ended('at', 'bl', 'iz')} THEN {bare} || 'e' "
            f"WHEN {double} AND right({bare}, 1) NOT IN ('l', 's', 'z') THEN left(w, length(w) - 2) "
            f"WHEN {_measure(1)} = 1 AND {_cvc(1)} THEN {bare} || 'e' ELSE {bare} END")
    y = _cases([(f"{_ends('y')} AND {_vowel(1)}", f"{_stem('y')} || 'i'")])

    def table(rules: Sequence[tuple[str, str]]) -> str:
        return _cases([(_ends(suf), f"CASE WHEN {_measure(len(suf))} > 0 THEN {_stem(suf)} || '{rep}' ELSE w END") for suf, rep in rules])

    def long(suf: str) -> str:
        after = f" AND right({_stem(suf)}, 1) IN ('s', 't')" if suf == "ion" else ""
        return f"CASE WHEN {_measure(len(suf))} > 1{after} THEN {_stem(suf)} ELSE w END"

    step4 = _cases([(_ends(suf), long(suf)) for suf in sorted(STEP4, key=len, reverse=True)])
    step5a = _cases([(f"{_ends('e')} AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT {_cvc(1)}))", _stem("e"))])
    step5b = _cases([(f"{_measure(0)} > 1 AND {_DOUBLE} AND right(w, 1) = 'l'", _stem("l"))])
    return [plural, past, mend, y, table(STEP2), table(STEP3), step4, step5a, step5b]


#: One letter more of a mask: a ``y`` after a consonant is a vowel. ``s`` is the mask so far, ``c`` the letter.
NEXT_LETTER = ("s || CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN 'v' "
               "WHEN c = 'y' AND right(s, 1) = 'c' THEN 'v' ELSE 'c' END")


def stem_table(words: DataFrame, token: str = "token", out: str = "stem") -> DataFrame:
    """``words`` (distinct tokens) with their stems; tokens of two letters or fewer stay."""
    mask = f"aggregate(split(w, ''), '', (s, c) -> CASE WHEN c = '' THEN s ELSE {NEXT_LETTER} END)"
    word = f"`{token}`"
    for step in steps():  # each step binds the word so far and its mask once
        word = f"element_at(transform(array({word}), w -> element_at(transform(array({mask}), m -> {step}), 1)), 1)"
    return words.withColumn(out, F.expr(f"CASE WHEN length(`{token}`) <= 2 THEN `{token}` ELSE {word} END"))


def sql_stem_table(words: str, name: str, token: str = "token") -> str:
    """The same as CTEs for DuckDB: ``name`` (token, stem) from the relation ``words``."""
    mask = f"list_reduce(list_prepend('', string_split(w, '')), lambda s, c: {NEXT_LETTER})"
    ctes, source = [f"{name}_0 AS (SELECT {token}, {token} AS w FROM {words})"], f"{name}_0"
    for k, step in enumerate(steps(), 1):
        ctes.append(f"{name}_{k} AS (SELECT {token}, {step} AS w FROM (SELECT {token}, w, {mask} AS m FROM {source}))")
        source = f"{name}_{k}"
    ctes.append(f"{name} AS (SELECT {token}, CASE WHEN length({token}) <= 2 THEN {token} ELSE w END AS stem FROM {source})")
    return ", ".join(ctes)


def stemmed(df: DataFrame, key_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``df`` with the token arrays ``cols`` stemmed; ``key_cols`` name a row.

    Rows stay whole: tasks cut them into slices of about a million tokens, each distinct token of a slice is a row
    that looks up its stem (each distinct token of the table is stemmed once), and a slice's rows meet its stems again.
    Rows that share a key have their tokens merged by place, those of a null key none."""
    keys, names = list(key_cols), df.columns
    rows = with_key_rows(df, keys, "_rows")
    given = cut_lineage(rows.mapInArrow(_sliced(list(cols)), StructType([
        *rows.schema.fields, StructField("_slice", LongType()), StructField("_tokens", ArrayType(StringType()))])))
    tokens = cut_lineage(given.select("_slice", F.explode("_tokens").alias("token")))
    # (written before it is filtered, or every stem would be made twice)
    stems = cut_lineage(stem_table(tokens.select("token").distinct())).filter("stem <> token")
    found = cut_lineage(tokens.join(stems, "token"))

    schema = StructType([StructField(f.name, ArrayType(StringType())) if f.name in cols else f for f in df.schema])

    def with_stems(part: DataFrame) -> DataFrame:
        return part.select("_slice", *names).groupBy("_slice").cogroup(found.groupBy("_slice")).applyInArrow(_replaced(list(cols), names), schema)

    alone = F.col("_rows") == 1
    for k in keys:
        alone = alone & F.col(k).isNotNull()
    return with_stems(given.filter(alone)).union(_merged(with_stems(given.filter(~alone)), keys, cols))


def _merged(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows that share a key with the tokens of all of them, in the order of their places."""
    all_tokens = F.concat(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _placed(k)) for k, c in enumerate(cols)])
    whole = (df.select(*keys, F.explode(all_tokens).alias("x"))
             .groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("_all")))
    parts = {c: F.when(F.col(c).isNotNull(), F.transform(F.filter(F.coalesce("_all", F.array().cast(whole.schema["_all"].dataType)), _of_side(k)),
                                                         lambda x: x["token"])).alias(c) for k, c in enumerate(cols)}
    return df.join(whole, list(keys), "left").select(*[parts.get(c, F.col(c)) for c in df.columns])


def _sliced(cols: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the number of their slice; a slice's first row has its distinct tokens that may have a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in token_slices([batch.column(c) for c in cols]):
                part = batch.slice(a, b - a)
                distinct = codes([part.column(c) for c in cols])[0]
                long = distinct.filter(pc.fill_null(pc.greater(pc.utf8_length(distinct), LONGER_THAN), False))
                ends = np.full(len(part) + 1, len(long), dtype=np.int32)
                ends[0] = 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), number)),
                                                  pa.ListArray.from_arrays(pa.array(ends), long.cast(pa.string()))],
                                                 [*part.schema.names, "_slice", "_tokens"])
                number += 1

    return run


def _replaced(cols: Sequence[str], names: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of a slice, their tokens replaced by stems."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        token, stem = (found.column(c).combine_chunks().cast(pa.string()) for c in ("token", "stem"))
        out = {}
        for c in cols:
            lists = rows.column(c).combine_chunks()
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            known = pc.coalesce(stem.take(pc.index_in(coded.dictionary, value_set=token)), coded.dictionary)
            ends = np.concatenate([[0], np.cumsum(lengths(lists))]).astype(np.int32)
            out[c] = pa.ListArray.from_arrays(pa.array(ends), known.take(coded.indices), mask=lists.is_null())
        return pa.table([out.get(c, rows.column(c)) for c in names], names=list(names))

    return run


def _placed(side: int) -> Callable:
    return lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("at"), t.alias("token"))


def _of_side(side: int) -> Callable:
    return lambda x: x["side"] == F.lit(side)
