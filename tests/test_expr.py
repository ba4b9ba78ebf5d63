"""Column functions: rounding, levels, lgamma, binomial tail, Wilson interval."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from replaylab.functions import expr as X


def _col(spark, values, typ, fn):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_minutes_rounding_ties(spark):
    # FIXTURES §5 "rounding": half-up in integers, not the binary double.
    assert _col(spark, [300, 900, 1500, 8700, 17100, 0, None], "bigint", X.minutes) == \
        [0.01, 0.02, 0.03, 0.15, 0.29, 0.0, None]


def test_hours_days(spark):
    assert _col(spark, [18_000, 3_600_000, 43_200_000], "bigint", X.hours) == [0.01, 1.0, 12.0]
    assert _col(spark, [432_000, 86_400_000], "bigint", X.days) == [0.01, 1.0]


def test_activity_levels(spark):
    # FIXTURES §5 "levels": 0, 1, 8, 9, 20, 21, 40, 41
    got = _col(spark, [0, 1, 8, 9, 20, 21, 40, 41], "bigint", X.activity_level)
    assert got == [0, 1, 1, 2, 2, 3, 3, 4]


def test_lgamma_matches_math(spark):
    xs = [1.0, 1.5, 2.0, 7.5, 10.0, 123.25, 1e4, 2.5e6]
    got = _col(spark, xs, "double", X.lgamma)
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def _binom_tail(k: int, n: int, p: float) -> float:
    if k <= 0:
        return 1.0
    if p <= 0.0:
        return 0.0
    if p >= 1.0:
        return 1.0
    lf = math.lgamma(n + 1)
    return math.fsum(math.exp(lf - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                              + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


@pytest.mark.parametrize("n", [1, 5, 20, 200])
def test_binom_sf_brute_force(spark, n):
    ps = [0.05, 0.3, 0.5, 0.93]
    rows = [(k, n, p) for p in ps for k in range(0, n + 1, max(1, n // 10))]
    df = spark.createDataFrame(rows, "k long, n long, p double")
    got = X.with_binom_sf(df, "k", "n", "p").collect()
    for r in got:
        want = _binom_tail(r.k, r.n, r.p)
        assert r.p_value == pytest.approx(want, rel=1e-9, abs=1e-15), (r.k, r.n, r.p)
    # the plain column form agrees with the staged one
    plain = df.select("k", "n", "p", X.binom_sf("k", "n", "p").alias("q")).collect()
    staged = {(r.k, r.n, r.p): r.p_value for r in got}
    for r in plain:
        assert r.q == pytest.approx(staged[(r.k, r.n, r.p)], rel=1e-12, abs=1e-300)


def test_binom_sf_edges(spark):
    df = spark.createDataFrame([(0, 10, 0.3), (11, 10, 0.3), (3, 10, 0.0), (3, 10, 1.0), (10, 10, 0.5)],
                               "k long, n long, p double")
    got = [r.p_value for r in X.with_binom_sf(df, "k", "n", "p").collect()]
    assert got[:4] == [1.0, 0.0, 0.0, 1.0]
    assert got[4] == pytest.approx(0.5 ** 10, rel=1e-12)


def test_binom_sf_decreasing_in_k(spark):
    df = spark.createDataFrame([(k, 2000, 0.35) for k in range(600, 900, 20)], "k long, n long, p double")
    vals = [r.p_value for r in X.with_binom_sf(df, "k", "n", "p").orderBy("k").collect()]
    assert all(a >= b for a, b in zip(vals, vals[1:]))
    assert vals[-1] == pytest.approx(_binom_tail(880, 2000, 0.35), rel=1e-9)


def test_wilson_closed_form(spark):
    z = X.Z_95
    rows = [(0, 10), (10, 10), (3, 10), (50, 400), (1, 1)]
    df = spark.createDataFrame(rows, "k long, n long")
    low, high = X.wilson_bounds("k", "n")
    got = df.select("k", "n", low.alias("lo"), high.alias("hi")).collect()
    for r in got:
        p = r.k / r.n
        d = 1 + z * z / r.n
        c = (p + z * z / (2 * r.n)) / d
        h = z * math.sqrt(p * (1 - p) / r.n + z * z / (4 * r.n * r.n)) / d
        assert r.lo == pytest.approx(c - h, abs=1e-12)
        assert r.hi == pytest.approx(c + h, abs=1e-12)
        assert r.lo <= p + 1e-12 and p <= r.hi + 1e-12


def test_neg_log_p(spark):
    got = _col(spark, [1.0, 0.01, 0.0], "double", X.neg_log10_p)
    assert got[0] == 0.0 and math.copysign(1, got[0]) == 1.0
    assert got[1] == pytest.approx(2.0)
    assert got[2] == pytest.approx(300.0)
