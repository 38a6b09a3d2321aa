"""The normal distribution as column expressions, from published rational approximations, and the same as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Chebyshev fit of the complementary error function (relative error below 1.2e-7) and the rational
# approximation of the normal quantile (relative error below 1.2e-9).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661415996e00, 1.0),
)
_LOW = 0.02425
_ROOT2 = 1.4142135623730951


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    """Highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def two_sided(z: Column) -> Column:
    """Probability that a standard normal lies farther from 0 than ``z``."""
    a = F.abs(z) / _ROOT2
    t = 1 / (1 + 0.5 * a)
    return t * F.exp(-a * a + _polynomial(_ERFC[::-1], t))


def below(z: Column) -> Column:
    """Standard normal distribution function."""
    tail = two_sided(z) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def quantile(p: Column) -> Column:
    """Its inverse; null outside (0, 1)."""
    centre, tail = p - 0.5, F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    r = centre * centre
    middle = _polynomial(_MIDDLE[0], r) * centre / _polynomial(_MIDDLE[1], r)
    low = _polynomial(_TAIL[0], tail) / _polynomial(_TAIL[1], tail)
    return F.when((p <= 0) | (p >= 1), None).when(p < _LOW, low).when(p <= 1 - _LOW, middle).otherwise(-low)


def _text(coefficients: tuple[float, ...], x: str) -> str:
    out = f"({coefficients[0]!r}::double)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


def two_sided_sql(z: str) -> str:
    t = f"(1 / (1 + 0.5::double * abs({z}) / {_ROOT2!r}::double))"
    return f"({t} * exp(-({z}) * ({z}) / 2 + {_text(_ERFC[::-1], t)}))"


def quantile_sql(p: str) -> str:
    tail, r = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"(({p} - 0.5) * ({p} - 0.5))"
    low = f"({_text(_TAIL[0], tail)} / {_text(_TAIL[1], tail)})"
    return f"case when {p} <= 0 or {p} >= 1 then null when {p} < {_LOW} then {low} when {p} <= {1 - _LOW} then {_text(_MIDDLE[0], r)} * ({p} - 0.5) / {_text(_MIDDLE[1], r)} else -{low} end"
