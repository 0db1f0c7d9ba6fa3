"""Tail probabilities, divergences, status rules and health scalars against known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwatch import schemas as S
from batchwatch.functions import divergence as D
from batchwatch.functions import pvalues as P
from batchwatch.functions import status as St


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()])


@pytest.mark.parametrize("stat,dof,p", [
    (3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05),
    (124.342113, 100, 0.05), (1074.679, 1000, 0.05), (0.0, 3, 1.0), (4000.0, 4, 0.0)])
def test_chi_square_critical_values(spark, stat, dof, p):
    df = one(spark, stat=F.lit(stat), dof=F.lit(float(dof)))
    got = P.with_chi2_pvalue(df, "stat", "dof").first()["p_value"]
    assert got == pytest.approx(p, abs=1e-5)


def test_chi_square_even_dof_has_a_closed_form(spark):
    for stat in (0.3, 2.0, 9.0, 30.0):
        df = one(spark, stat=F.lit(stat), dof=F.lit(6.0))
        x = stat / 2
        want = math.exp(-x) * sum(x**j / math.factorial(j) for j in range(3))
        assert P.with_chi2_pvalue(df, "stat", "dof").first()["p_value"] == pytest.approx(want, abs=1e-12)


def test_chi_square_odd_dof_agrees_with_erfc(spark):
    for stat in (0.2, 3.0, 12.0, 70.0):
        df = one(spark, stat=F.lit(stat), dof=F.lit(1.0))
        want = math.erfc(math.sqrt(stat / 2))
        assert P.with_chi2_pvalue(df, "stat", "dof").first()["p_value"] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("dof", [3999.0, 4000.0, 4001.0, 5000.0, 200000.0])
@pytest.mark.parametrize("z", [-1.5, 0.3, 1.6448536269514722])
def test_one_formula_for_every_dof(spark, dof, z):
    # the cube root of chi-square / dof is normal up to terms of the order of 1 / dof
    stat = dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3
    got = P.with_chi2_pvalue(one(spark, stat=F.lit(stat), dof=F.lit(dof)), "stat", "dof").first()["p_value"]
    assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=2e-5)


def test_kolmogorov_critical_value(spark):
    n = 10**6
    d = 1.3581 / math.sqrt(n / 2)
    got = one(spark, d=F.lit(d), a=F.lit(n), b=F.lit(n)).select(P.ks_pvalue("d", "a", "b").alias("p")).first()["p"]
    assert got == pytest.approx(0.05, abs=1e-3)


def _divergences(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    row = df.select(D.psi("a", "b").alias("psi"), D.jsd("a", "b").alias("jsd")).first()
    return row["psi"], row["jsd"]


def _numpy_divergences(a, b):
    def smooth(x):
        x = np.asarray(x, float)
        x = x / x.sum() if x.sum() else x
        return (x + 1e-4) / (x + 1e-4).sum()

    e, c = smooth(a), smooth(b)
    m = (e + c) / 2
    return float(((c - e) * np.log(c / e)).sum()), float(
        0.5 * (e * np.log2(e / m)).sum() + 0.5 * (c * np.log2(c / m)).sum())


def test_divergences_match_numpy_and_their_bounds(spark):
    rng = np.random.default_rng(7)
    for _ in range(8):
        a, b = rng.integers(0, 50, 6).tolist(), rng.integers(0, 50, 6).tolist()
        psi, jsd = _divergences(spark, a, b)
        want = _numpy_divergences(a, b)
        assert psi == pytest.approx(want[0], abs=1e-12) and jsd == pytest.approx(want[1], abs=1e-12)
        assert psi >= 0 and 0 <= jsd <= 1
        assert _divergences(spark, b, a)[1] == pytest.approx(jsd, abs=1e-12)


def test_divergence_edge_cases(spark):
    assert _divergences(spark, [3, 4], [3, 4]) == (pytest.approx(0, abs=1e-15), pytest.approx(0, abs=1e-15))
    assert _divergences(spark, [], []) == (0.0, 0.0)
    assert _divergences(spark, [10, 0], [0, 0])[0] > 0
    with pytest.raises(Exception, match="same number of bins"):
        _divergences(spark, [1, 2], [1, 2, 3])


@pytest.mark.parametrize("psi,jsd,p,n0,n1,want", [
    (0.25, 0.0, 0.0, 100, 100, "MODERATE"), (0.2501, 0.0, 0.0, 100, 100, "HIGH"),
    (0.0999, 0.0, 0.0, 100, 100, "NONE"), (0.0, 0.21, 0.01, 100, 100, "HIGH"),
    (0.5, 0.0, 0.05, 100, 100, "MODERATE"), (0.12, 0.0, 0.3, 100, 100, "NONE"),
    (0.0, 0.0, 0.0001, 50000, 50000, "NONE"), (9.0, 1.0, 0.0, 29, 100, "INSUFFICIENT_DATA"),
    (9.0, 1.0, 0.0, 100, 29, "INSUFFICIENT_DATA"), (9.0, 1.0, 0.0, 30, 30, "HIGH")])
def test_classification(spark, psi, jsd, p, n0, n1, want):
    got = one(spark, s=St.classify_feature(
        F.lit(psi), F.lit(jsd), F.lit(p), F.lit(n0), F.lit(n1), St.literal_thresholds())).first()["s"]
    assert got == want


@pytest.mark.parametrize("high,moderate,evaluated,want", [
    (0, 3, 10, "HIGH"), (0, 2, 10, "MODERATE"), (1, 0, 10, "HIGH"), (0, 2, 4, "HIGH"),
    (0, 0, 10, "NONE"), (0, 0, 0, "NONE")])
def test_rollup(spark, high, moderate, evaluated, want):
    got = one(spark, s=St.rollup(F.lit(high), F.lit(moderate), F.lit(evaluated), St.literal_thresholds()))
    assert got.first()["s"] == want


def _health(spark, acc, ref, high, moderate, quality, jsd, labelled):
    c = St.performance_component(F.lit(acc).cast("double"), F.lit(ref).cast("double"))
    raw = St.weighted_health(c, St.drift_component(F.lit(high), F.lit(moderate)), F.lit(float(quality)),
                             St.stability_component(F.lit(jsd).cast("double")), F.lit(labelled))
    return one(spark, c=c, raw=raw).first()


def test_health_scores(spark):
    assert _health(spark, 0.9, 0.9, 0, 0, 100, 0.0, True)["raw"] == 100
    assert _health(spark, 0.95, 0.9, 0, 0, 100, None, True)["c"] == 100.0
    assert _health(spark, 0.5, None, 0, 0, 100, None, True)["c"] == 100.0
    # unlabelled weights when accuracy is unknown although labels were claimed
    row = _health(spark, None, 0.9, 2, 0, 80, 0.0, True)
    assert row["c"] is None and row["raw"] == round((70 * 50 + 80 * 35 + 100 * 15) / 100)
    assert _health(spark, 0.71, 0.7523, 3, 0, 87, 0.0, True)["raw"] == 81


def test_rounding_is_half_to_even(spark):
    from batchwatch.functions.values import half_even
    row = one(spark, a=half_even(F.lit(2.5)), b=half_even(F.lit(3.5))).first()
    assert (row["a"], row["b"]) == (2, 4)


def test_cap_and_bands(spark):
    row = one(spark, a=St.coherence_cap(F.lit(81), F.lit(S.HIGH)), b=St.coherence_cap(F.lit(81), F.lit("MODERATE")),
              c=St.coherence_cap(F.lit(50), F.lit(S.HIGH)), d=St.health_band(F.lit(80)),
              e=St.health_band(F.lit(79)), f=St.health_band(F.lit(59))).first()
    assert tuple(row) == (79, 81, 50, "HEALTHY", "WARNING", "CRITICAL")


def test_unknown_values_stay_unknown(spark):
    row = one(spark, a=St.clamp(F.lit(None).cast("double")), b=St.clamp(F.lit(130)), c=St.clamp(F.lit(-3)),
              d=St.stability_component(F.lit(None).cast("double"))).first()
    assert tuple(row) == (None, 100.0, 0.0, 100.0)
    df = spark.createDataFrame([(None, [1, 2])], "a array<bigint>, b array<bigint>")
    assert df.select(D.jsd("a", "b").alias("x")).first()["x"] is None
