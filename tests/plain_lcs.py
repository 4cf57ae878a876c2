"""Longest common subsequences by the plain table: what the bit-parallel forms are tested against."""

from __future__ import annotations

from collections.abc import Sequence

from textpairs.functions.lcs import prf


def lcs_table(a: Sequence[str], b: Sequence[str]) -> list[list[int]]:
    t = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(t[-1][j - 1] + 1 if x == y else max(t[-1][j], row[j - 1]))
        t.append(row)
    return t


def lcs_length_dp(a: Sequence[str], b: Sequence[str]) -> int:
    return lcs_table(a, b)[-1][-1]


def lcs_positions_dp(ref: Sequence[str], cand: Sequence[str]) -> list[int]:
    t, out, i, j = lcs_table(ref, cand), [], len(ref), len(cand)
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def rouge_l(cand: Sequence[str], ref: Sequence[str]) -> tuple[float, float, float]:
    return prf(lcs_length_dp(ref, cand), len(cand), len(ref))
