"""Rounding and ratio helpers with one definition on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity: -0.5 gives 0, 0.5 gives 1.

    SQL ``round`` rounds halves away from zero and so differs below zero.
    Null stays null.
    """
    k = float(10**digits)
    return F.floor(x * k + 0.5) / F.lit(k) if digits else F.floor(x + 0.5)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null where den is zero or either is null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def fmt_count(n: Column) -> Column:
    """Token counts for reading: 950, 1.2k, 3.4M (one decimal, half up)."""
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", half_up(n / 1e6, 1)), F.lit("M")))
        .when(n >= 1_000, F.concat(F.format_string("%.1f", half_up(n / 1e3, 1)), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def gcd(a: Column, b: Column) -> Column:
    """FN-M01: greatest common divisor of two whole numbers; 0 and x give x. 48 steps are enough for numbers of 32 bits."""
    start = F.struct(F.abs(a).cast("bigint").alias("a"), F.abs(b).cast("bigint").alias("b"))
    step = lambda s, _i: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s["a"].cast("int"))
