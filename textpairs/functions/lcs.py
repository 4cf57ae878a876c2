"""Longest common subsequences for ROUGE-L and ROUGE-Lsum.

Both are bit-parallel (Allison & Dix 1986, Hyyro 2004). ``lcs_length`` is a
Spark expression: one row of the table is a few 64-bit words. Which positions
of a reference sentence a subsequence takes, as the union over sentences needs, cannot be
read from a length; ``lcs_positions`` is a small helper of an Arrow UDF for that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpairs.functions.text import let

_BITS = 62  # bits of a row kept in one long: a sum with its carry stays positive
_FULL = (1 << _BITS) - 1


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, in JVM expressions.

    The positions of ``b`` are bits, ``_BITS`` to a word. A token of ``a`` has the mask of
    its positions, made once for each token both sides hold. With all bits of ``v`` set at first, each
    token of ``a`` that has a mask ``m`` makes ``v`` into ``(v + (v & m)) | (v & ~m)``; the carry goes
    from word to word. The bits cleared at the end are the length."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def mask_of(chunks: Column, token: Column) -> Column:
        return F.transform(chunks, lambda chunk: F.aggregate(
            F.reverse(chunk), zero, lambda bits, t: F.shiftleft(bits, 1).bitwiseOR(F.when(t == token, one).otherwise(zero))))

    def word(done: Column, x: Column) -> Column:
        v, m = x["v"], x["m"]
        total = v + v.bitwiseAND(m) + done["carry"]
        kept = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(F.lit(_FULL).cast("long"))
        return F.struct(F.concat(done["out"], F.array(kept)).alias("out"), F.shiftright(total, _BITS).alias("carry"))

    def step(row: Column, mask: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("out"), zero.alias("carry"))
        return F.aggregate(F.arrays_zip(row.alias("v"), mask.alias("m")), start, word, lambda done: done["out"])

    def length(chunks: Column, common: Column) -> Column:
        masks = F.map_from_arrays(common, F.transform(common, lambda t: mask_of(chunks, t)))
        steps = let(masks, lambda known: F.transform(F.filter(a, lambda t: F.map_contains_key(known, t)), lambda t: F.element_at(known, t)))
        last = F.aggregate(steps, F.transform(chunks, lambda c: F.lit(_FULL).cast("long")), step)
        return F.aggregate(last, F.lit(0), lambda n, v: n + (_BITS - F.bit_count(v)).cast("int"))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / _BITS).cast("int")),
                      lambda k: F.slice(b, k * _BITS + 1, F.lit(_BITS)))
    found = let(cut, lambda chunks: let(F.array_intersect(a, b), lambda common: length(chunks, common)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(found)


def lcs_positions(ref: Sequence[str], cand: Sequence[str]) -> list[int]:
    """Positions in ``ref`` of one longest common subsequence with ``cand``.

    Rows of the table go over ``ref``; a row is an integer whose bits mark where the length grows
    along ``cand``. Every ``isqrt(len(ref))``-th row is kept; the walk back makes the rows between two kept ones
    anew, so memory grows with the square root of the table's height. Of two ways back, one that drops a
    token of ``cand`` is taken only if it keeps the length and the other does not."""
    n, m = len(ref), len(cand)
    if not n or not m:
        return []
    where: dict[str, int] = {}
    for j, t in enumerate(cand):
        where[t] = where.get(t, 0) | (1 << j)
    full = (1 << m) - 1
    block = isqrt(n) + 1

    def following(v: int, i: int) -> int:
        x = v & where.get(ref[i], 0)
        return ((v + x) | (v - x)) & full

    kept, v = [full], full  # rows 0, block, 2 * block, ... (set bits: no growth)
    for i in range(n):
        v = following(v, i)
        if (i + 1) % block == 0:
            kept.append(v)
    out: list[int] = []
    i, j = n, m
    rows: list[int] = []
    first = n + 1  # number of the first of ``rows``
    while i > 0 and j > 0:
        if i - 1 < first:  # rows first..i of this block
            first = (i - 1) // block * block
            rows = [kept[first // block]]
            for k in range(first, i):
                rows.append(following(rows[-1], k))
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
            continue
        below = (1 << j) - 1
        length = j - (rows[i - first] & below).bit_count()
        above = j - (rows[i - 1 - first] & below).bit_count()
        grows = not rows[i - first] >> (j - 1) & 1
        if length - grows > above:
            j -= 1
        else:
            i -= 1
    out.reverse()
    return out


def prf(hits: int, n_cand: int, n_ref: int) -> tuple[float, float, float]:
    p = hits / n_cand if n_cand else 0.0
    r = hits / n_ref if n_ref else 0.0
    f = 2 * p * r / (p + r) if p + r > 0 else 0.0
    return p, r, f


def rouge_lsum(cand_sents: Sequence[Sequence[str]], ref_sents: Sequence[Sequence[str]]
               ) -> tuple[float, float, float]:
    """Summary-level LCS (Lin 2004): for each reference sentence, the union of
    its LCS positions against every candidate sentence; hits are clipped by the
    remaining token counts on both sides."""
    n_ref = sum(len(s) for s in ref_sents)
    n_cand = sum(len(s) for s in cand_sents)
    if not n_ref or not n_cand:
        return 0.0, 0.0, 0.0
    left_r = Counter(t for s in ref_sents for t in s)
    left_c = Counter(t for s in cand_sents for t in s)
    hits = 0
    for r in ref_sents:
        union = sorted(set().union(*[lcs_positions(r, c) for c in cand_sents]))
        for i in union:
            t = r[i]
            if left_c[t] > 0 and left_r[t] > 0:
                hits += 1
                left_c[t] -= 1
                left_r[t] -= 1
    return prf(hits, n_cand, n_ref)
