"""p-values for the test tables (Student t, F) from the regularised incomplete
beta function, evaluated with the classic continued fraction (modified Lentz).

The columns `p_value_t` and `p_value_f` evaluate it in the JVM, as an `aggregate` over the terms
of the fraction; the plain functions serve single values and check them.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 3e-16
_TINY = 1e-300


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        de = d * c
        h *= de
        if abs(de - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float | None:
    if t is None or df is None or not np.isfinite(t) or not np.isfinite(df) or df <= 0:
        return None
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float | None:
    if f is None or d1 is None or d2 is None or not np.isfinite(f) or d1 <= 0 or d2 <= 0:
        return None
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _log_gamma(z: Column) -> Column:
    """log Gamma(z) for z > 0: Stirling's series at z + 8, less the logs of the eight factors in between."""
    y = z + 8
    series = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
    tail = reduce(lambda a, b: a + b, [F.lit(c) / F.pow(y, 2 * i + 1) for i, c in enumerate(series)])
    steps = reduce(lambda a, b: a + b, [F.ln(z + i) for i in range(8)])
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + tail - steps


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, one pair of its terms for each element of a sequence.

    It needs a number of terms of the order of the root of the larger parameter; once it has settled the rest
    of the sequence passes the state on."""

    def away(v: Column) -> Column:
        return F.when(F.abs(v) > _TINY, v).otherwise(_TINY)

    def state(c: Column, d: Column, h: Column, done: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"), done.alias("done"))

    def term(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))

        # each half step is bound once, as the variable of a one-element transform
        def first(s: Column) -> Column:
            d, c = F.lit(1.0) / away(even * s["d"] + 1), away(even / s["c"] + 1)
            return state(c, d, s["h"] * c * d, s["done"])

        def second(s: Column) -> Column:
            d, c = F.lit(1.0) / away(odd * s["d"] + 1), away(odd / s["c"] + 1)
            return state(c, d, s["h"] * c * d, F.abs(c * d - 1) < _EPS)

        return F.when(acc["done"], acc).otherwise(F.transform(F.transform(F.array(acc), first), second)[0])

    start = F.lit(1.0) / away(F.lit(1.0) - (a + b) * x / (a + 1))
    terms = F.sequence(F.lit(1), (F.least(5 * F.sqrt(F.greatest(a, b)), F.lit(1e6)) + 200).cast("int"))
    return F.aggregate(terms, state(F.lit(1.0), start, start, F.lit(False)), term, lambda acc: acc["h"])


def _log_gamma_rise(z: Column, b: Column) -> Column:
    """log Gamma(z + b) - log Gamma(z): for a large z as one expression, as the difference of two large numbers is inexact."""
    large = (z - 0.5) * F.log1p(b / z) + b * F.ln(z + b) - b + (F.lit(1.0) / (z + b) - F.lit(1.0) / z) / 12
    return F.when(z > 1e5, large).otherwise(_log_gamma(z + b) - _log_gamma(z))


def beta_share(a: Column, b: Column, x: Column, y: Column | None = None) -> Column:
    """Regularised incomplete beta I_x(a, b) as a Column; NULL for NULL, not finite or non-positive parameters.

    `y` is 1 - x, where the caller knows it more exactly."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    y = (F.lit(1.0) - x) if y is None else y.cast("double")
    ln_x, ln_y = F.when(x > 0.5, F.log1p(-y)).otherwise(F.ln(x)), F.when(y > 0.5, F.log1p(-x)).otherwise(F.ln(y))
    front = F.exp(_log_gamma_rise(F.greatest(a, b), F.least(a, b)) - _log_gamma(F.least(a, b)) + a * ln_x + b * ln_y)
    low = front * _fraction(a, b, x) / a
    high = F.lit(1.0) - front * _fraction(b, a, y) / b
    inside = F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)
    valid = (a > 0) & (b > 0) & (a < float("inf")) & (b < float("inf")) & ~F.isnan(x)
    return F.when(valid & (x <= 0), 0.0).when(valid & (x >= 1) & (y <= 0), 1.0).when(valid, inside)


def p_value_t(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    t, df = t.cast("double"), df.cast("double")
    ok = (df > 0) & (F.abs(t) < float("inf"))
    return F.when(ok, beta_share(df / 2, F.lit(0.5), F.try_divide(df, df + t * t), F.try_divide(t * t, df + t * t)))


def p_value_f(f: Column, d1: Column, d2: Column) -> Column:
    """Upper p of F."""
    f, d1, d2 = f.cast("double"), d1.cast("double"), d2.cast("double")
    ok = (d1 > 0) & (d2 > 0) & (F.abs(f) < float("inf"))
    return F.when(ok & (f <= 0), 1.0).when(ok, beta_share(d2 / 2, d1 / 2, F.try_divide(d2, d2 + d1 * f), F.try_divide(d1 * f, d2 + d1 * f)))
