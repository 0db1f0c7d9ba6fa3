"""Tail probabilities as SQL expressions over named columns.

Kolmogorov: the limiting series with Stephens' small-sample correction. Chi-square: the
regularised incomplete gamma function for integer and half-integer shape, by its power series
left of the mean and by the finite downward recurrence right of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIR = "named_struct('t', 1.0D, 's', {start})"
_SERIES = ("aggregate(sequence(1, {terms}), " + _PAIR.format(start="1.0D") + ", (acc, n) -> "
           "named_struct('t', acc.t * ({x}) / (({a}) + n), 's', acc.s + acc.t * ({x}) / (({a}) + n)), acc -> acc.s)")


def ks_pvalue(d: str, n0: str, n1: str) -> Column:
    """Two-sided two-sample Kolmogorov-Smirnov p-value."""
    en = f"sqrt(CAST({n0} AS DOUBLE) * ({n1}) / (({n0}) + ({n1})))"
    lam = f"(({en} + 0.12D + 0.11D / {en}) * ({d}))"
    series = ("aggregate(sequence(1, 100), 0.0D, (acc, k) -> acc + "
              "(CASE WHEN k % 2 = 1 THEN 1.0D ELSE -1.0D END) * exp(-2.0D * k * k * l * l))")
    return F.expr(
        f"element_at(transform(array({lam}), l -> CASE WHEN l < 0.2D THEN 1.0D "
        f"ELSE greatest(0.0D, least(1.0D, 2.0D * {series})) END), 1)")


def _ln_gamma(a: str) -> str:
    """ln Gamma(a) for a > 0: Stirling's series ten places further on, less the factors passed over."""
    passed = " * ".join(f"(({a}) + {i})" for i in range(5)), " * ".join(f"(({a}) + {i})" for i in range(5, 10))
    z = f"(({a}) + 10.0D)"
    return (f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + 1.0D / (12.0D * {z}) "
            f"- 1.0D / (360.0D * pow({z}, 3)) + 1.0D / (1260.0D * pow({z}, 5)) "
            f"- 1.0D / (1680.0D * pow({z}, 7)) + 1.0D / (1188.0D * pow({z}, 9)) - ln({passed[0]}) - ln({passed[1]}))")


def _erfc_sqrt(x: str) -> str:
    """erfc(sqrt(x)): power series up to 25, leading asymptotic terms beyond."""
    lower = f"exp(-({x})) * sqrt({x}) * {2.0 / math.sqrt(math.pi)!r}D * " + _SERIES.format(
        terms=120, x=x, a="0.5D")
    tail = f"exp(-({x})) / sqrt(({x}) * {math.pi!r}D) * (1.0D - 0.5D / ({x}) + 0.75D / (({x}) * ({x})))"
    return f"(CASE WHEN ({x}) < 25.0D THEN greatest(0.0D, 1.0D - {lower}) ELSE {tail} END)"


def with_chi2_pvalue(df: DataFrame, stat: str, dof: str, out: str = "p_value") -> DataFrame:
    """Add P(chi-square with ``dof`` degrees of freedom >= ``stat``); 1 where dof is below 1."""
    half = df.withColumns({"_a": F.expr(f"{dof} / 2.0D"), "_x": F.expr(f"{stat} / 2.0D")})
    left = ("1.0D - exp(-_x + _a * ln(_x) - " + _ln_gamma("(_a + 1.0D)") + ") * "
            + _SERIES.format(terms="80 + CAST(12 * sqrt(_a) AS INT)", x="_x", a="_a"))
    # right of the mean the terms fall off within a few standard deviations
    downward = ("CASE WHEN _a >= 1 THEN aggregate(sequence(1, CAST(least(floor(_a), 100 + 12 * sqrt(_a)) AS INT)), "
                + _PAIR.format(start="0.0D")
                + ", (acc, n) -> named_struct('t', acc.t * (_a - n) / _x, 's', acc.s + acc.t), acc -> acc.s) ELSE 0.0D END")
    right = (f"exp((_a - 1.0D) * ln(_x) - _x - {_ln_gamma('_a')}) * ({downward}) + "
             f"CASE WHEN _a = floor(_a) THEN 0.0D ELSE {_erfc_sqrt('_x')} END")
    p = (f"CASE WHEN {dof} < 1 OR {stat} <= 0 THEN 1.0D "
         f"WHEN _x <= _a + 1.0D THEN {left} ELSE {right} END")
    return half.withColumn(out, F.expr(f"greatest(0.0D, least(1.0D, {p}))")).drop("_a", "_x")
