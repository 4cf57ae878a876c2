"""Repeatable randomness: every random choice is a function of md5(seed|key).

``rand()``, ``hash`` and ``xxhash64`` cannot be repeated outside Spark, so the
operators whose output is checked against SQL use these md5-derived values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def seeded_md5(seed, key: Column) -> Column:
    """md5 hex of ``seed|key``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def h(seed, key: Column) -> Column:
    """First 8 hex digits of md5(seed|key) as a number in [0, 2^32)."""
    return F.conv(F.substring(seeded_md5(seed, key), 1, 8), 16, 10).cast("bigint")


def u(seed, key: Column) -> Column:
    """Uniform in [0, 1): h / 2^32."""
    return h(seed, key).cast("double") / F.lit(TWO_32)


def poisson1(uniform: Column) -> Column:
    """Poisson(1) draw from a uniform by inverse-CDF thresholds (0..5)."""
    # fixed values: cumulative Poisson(1) probabilities for k = 0..4
    cuts = [0.36788, 0.73576, 0.91970, 0.98101, 0.99634]
    expr = F.lit(5)
    for k in reversed(range(len(cuts))):
        expr = F.when(uniform < F.lit(cuts[k]), F.lit(k)).otherwise(expr)
    return expr.cast("bigint")
