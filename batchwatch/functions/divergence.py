"""PSI and Jensen-Shannon divergence, as SQL expressions over named columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EPSILON

_EPS = f"{EPSILON:.4f}D"


def psi_term(expected: str, actual: str) -> str:
    return f"(({actual}) - ({expected})) * ln(({actual}) / ({expected}))"


def jsd_term(p: str, q: str) -> str:
    """One cell of 0.5*KL(p|m) + 0.5*KL(q|m) in bits, m being the mean of p and q."""
    mean = f"((({p}) + ({q})) / 2.0D)"
    return f"0.5D * (({p}) * log2(({p}) / {mean}) + ({q}) * log2(({q}) / {mean}))"


def clamp_unit(c: str) -> str:
    return f"greatest(0.0D, least(1.0D, {c}))"


def _total(counts: str) -> str:
    return f"aggregate({counts}, 0.0D, (acc, x) -> acc + x)"


def _smoothed(counts: str) -> str:
    """Proportions plus epsilon, renormalised; all-zero counts have proportions of zero.

    The total is bound once by transforming a one-element array, not once per bin.
    """
    return (
        f"flatten(transform(array({_total(counts)}), t -> transform({counts}, x -> "
        f"((CASE WHEN t > 0 THEN x / t ELSE 0.0D END) + {_EPS}) "
        f"/ ((CASE WHEN t > 0 THEN 1.0D ELSE 0.0D END) + size({counts}) * {_EPS}))))")


def _measure(baseline: str, current: str, term: str) -> str:
    cells = f"zip_with({_smoothed(baseline)}, {_smoothed(current)}, (e, a) -> {term})"
    return f"aggregate({cells}, 0.0D, (acc, x) -> acc + x)"


def _checked(baseline: str, current: str, value: str) -> Column:
    return F.expr(
        f"CASE WHEN {baseline} IS NULL OR {current} IS NULL THEN NULL "
        f"WHEN size({baseline}) <> size({current}) THEN "
        "CAST(raise_error('both sides need the same number of bins') AS DOUBLE) "
        f"WHEN size({baseline}) <= 0 THEN 0.0D ELSE {value} END")


def psi(baseline: str, current: str) -> Column:
    """Population stability index of two count arrays over the same bins."""
    return _checked(baseline, current, _measure(baseline, current, psi_term("e", "a")))


def jsd(baseline: str, current: str) -> Column:
    """Base-2 Jensen-Shannon divergence of two count arrays, between 0 and 1."""
    return _checked(baseline, current, clamp_unit(_measure(baseline, current, jsd_term("e", "a"))))
