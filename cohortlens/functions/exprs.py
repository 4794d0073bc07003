"""Small column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def cents(x: Column) -> Column:
    """A 2-dp amount as an exact integer number of hundredths."""
    return F.round(x * 100).cast("bigint")


def half_even_div(num: str, den: str) -> Column:
    """round-half-even(num / den) for non-negative integer columns, exactly (no float ties)."""
    q = F.expr(f"`{num}` div nullif(`{den}`, 0)")  # zero denominator → NULL, not an ANSI error
    num, den = F.col(num), F.col(den)
    r = num - q * den
    twice = r * 2
    up = (twice > den) | ((twice == den) & (F.pmod(q, F.lit(2)) == 1))
    return F.when(up, q + 1).otherwise(q)


def try_div(a: Column, b: Column) -> Column:
    """Division that yields NULL instead of raising on zero (ANSI mode)."""
    return F.try_divide(a, b)
