"""Normal distribution, quantile and two-sided power as column expressions.

A lower tail comes from the series of the integral near zero, and beyond ``_NEAR`` from the continued fraction of the ratio of
tail and density, so small tails keep their digits. The quantile starts from a rational approximation and is corrected by
third-order steps with that tail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEAR, _SERIES_TERMS, _FRACTION_TERMS, _STEPS = 2.0, 40, 120, 3
# Rational approximation 26.2.23 of Abramowitz and Stegun, error below 4.5e-4.
_TOP = (2.515517, 0.802853, 0.010328)
_BOTTOM = (1.0, 1.432788, 0.189269, 0.001308)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _polynomial(x: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[-1])
    for term in terms[-2::-1]:
        out = out * x + term
    return out


def _density(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(2 * F.pi())


def _tail(x: Column) -> Column:
    """Chance of more than ``x``, for ``x`` not below zero."""
    first = F.struct(x.alias("term"), x.alias("total"))

    def more(sofar: Column, k: Column) -> Column:
        term = sofar["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (sofar["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_SERIES_TERMS)), first, more, lambda s: s["total"])
    fraction = F.aggregate(F.sequence(F.lit(_FRACTION_TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda below, k: k / (x + below))
    return F.when(x < _NEAR, 0.5 - _density(x) * series).otherwise(_density(x) / (x + fraction))


def normal_cdf(x: Column | str) -> Column:
    """Chance of at most ``x``; null and NaN give null."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    whole = _let(F.abs(x), _tail)
    return F.when(x.isNull() | F.isnan(x), None).when(x < 0, whole).otherwise(1 - whole)


def normal_quantile(p: Column | str) -> Column:
    """The value that is exceeded with a chance of ``1 - p``; null outside (0, 1)."""
    p = (F.col(p) if isinstance(p, str) else p).cast("double")
    side = F.least(p, 1 - p)

    def rough(t: Column) -> Column:
        return t - _polynomial(t, _TOP) / _polynomial(t, _BOTTOM)

    def step(x: Column, _: Column) -> Column:
        return _let((_tail(x) - side) / _density(x), lambda off: F.greatest(F.lit(0.0), x + off / (1 - x * off / 2)))

    start = F.greatest(F.lit(0.0), _let(F.sqrt(-2 * F.ln(side)), rough))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step)
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -found).when(p == 0.5, 0.0).otherwise(found))


def two_sided_power(mde: Column | str, standard_error: Column | str, alpha: Column | str) -> Column:
    """Chance of detecting ``mde``; a zero standard error detects it for certain. Null where an input makes no sense."""
    m, se, a = ((F.col(c) if isinstance(c, str) else c).cast("double") for c in (mde, standard_error, alpha))
    usable = (m > 0) & (se >= 0) & (a > 0) & (a < 1) & ~F.isnan(m) & ~F.isnan(se)
    ends = F.struct(normal_quantile(1 - a / 2).alias("cut"), F.try_divide(m, se).alias("shift"))
    chance = _let(ends, lambda e: normal_cdf(-e["cut"] - e["shift"]) + normal_cdf(e["shift"] - e["cut"]))
    return F.when(usable, F.when(se == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), chance)), 12)))
