"""Special functions against known values, the prior against a search, intervals and densities against direct sums."""

import math
import time

import pytest
from pyspark.sql import functions as F

from gridsurvey.functions.special import beta_cdf, beta_quantile, digamma, ln_gamma, trigamma
from gridsurvey.operators import expected, histogram


def test_gamma_family(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 7.25, 30.0, 1e4, 1e8]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ln_gamma(F.col("x")), digamma(F.col("x")), trigamma(F.col("x"))).collect()
    for x, lg, di, tri in rows:
        assert lg == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
        # the recurrences and the derivative of ln gamma
        h = 1e-5 * x
        assert di == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-4, abs=1e-4)
        assert tri > 0
    by = {r[0]: r for r in rows}
    assert by[1.0][2] == pytest.approx(-0.5772156649015329, abs=1e-13) and by[1.0][3] == pytest.approx(math.pi ** 2 / 6, abs=1e-12)
    assert by[0.5][2] == pytest.approx(-0.5772156649015329 - 2 * math.log(2), abs=1e-13) and by[0.5][3] == pytest.approx(math.pi ** 2 / 2, abs=1e-12)


def test_beta_has_closed_forms(spark):
    """Power functions, a polynomial and the arc sine law, at both sides of the mean."""
    cases = [(x, a, b, f(x)) for x in (0.0, 0.001, 0.1, 0.4, 0.5, 0.73, 0.999, 1.0) for a, b, f in [
        (1.0, 1.0, lambda x: x), (3.5, 1.0, lambda x: x ** 3.5), (1.0, 40.0, lambda x: 1 - (1 - x) ** 40),
        (2.0, 2.0, lambda x: 3 * x ** 2 - 2 * x ** 3), (0.5, 0.5, lambda x: 2 / math.pi * math.asin(math.sqrt(x)))]]
    cases += [(0.5, 20_000.0, 20_000.0, 0.5)]
    df = spark.createDataFrame(cases, "x double, a double, b double, known double")
    for x, a, b, known, got in df.withColumn("got", beta_cdf(F.col("x"), F.col("a"), F.col("b"))).collect():
        assert got == pytest.approx(known, abs=1e-11), (x, a, b)
    pairs = spark.createDataFrame([(0.3, 900.0), (2.0, 5.0), (40.0, 3.0), (1500.0, 800.0)], "a double, b double")
    for level in (0.025, 0.5, 0.975):
        q = pairs.withColumn("q", beta_quantile(level, F.col("a"), F.col("b")))
        for r in q.withColumn("back", beta_cdf(F.col("q"), F.col("a"), F.col("b"))).collect():
            assert r.back == pytest.approx(level, abs=1e-9)


def likelihood(rows, a, b):
    beta = lambda p, q: math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)
    return sum(beta(x + a, n - x + b) - beta(a, b) for x, n in rows)


def test_prior_is_the_best_of_its_neighbours(spark):
    rows = [(x % (n + 1), n) for k in range(300) for x, n in [((k * k) % 7, 3 + k % 11)]]
    df = spark.createDataFrame([*rows, (None, 3), (2, None), (0, 0), (-1, 4)], "observations int, checklist_count int")
    prior = expected.fit_beta_likelihood(df)
    best = likelihood(rows, prior.alpha, prior.beta)
    for da in (-1e-3, 0, 1e-3):
        for db in (-1e-3, 0, 1e-3):
            assert likelihood(rows, prior.alpha + da, prior.beta + db) <= best + 1e-9
    assert prior.steps < 50 and 0 < prior.mean < 1
    for bad in ([], [(0, 5), (0, 9)], [(5, 5)], [(None, None)]):
        with pytest.raises(ValueError):
            expected.fit_beta_likelihood(spark.createDataFrame(bad, "observations int, checklist_count int"))


def test_intervals_hold_rates_and_keep_rows(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (5, 10), (10, 10), (None, 3), (3, None), (0, 0)], "observations int, checklist_count int")
    got = expected.rate_intervals(df, expected.BetaPrior(2.0, 3.0, 1)).collect()
    assert len(got) == 7
    for r in got:
        if r.observations is None or r.checklist_count is None:
            assert r[".low"] is None
        else:
            assert r[".low"] < r[".fitted"] < r[".high"] and r[".alpha1"] == 2 + r.observations
    # Beta(2, 13): its upper tail is a polynomial
    x = next(r for r in got if r.observations == 0 and r.checklist_count == 10)[".low"]
    assert 1 - (1 - x) ** 14 - 14 * x * (1 - x) ** 13 == pytest.approx(0.025, abs=1e-9)


def test_density_adds_up_and_meets_the_direct_sum(spark):
    values = [(g, float((k * k) % 23) / 7 + g) for g in (1, 2) for k in range(200)] + [(3, 5.0)] * 4 + [(4, 1.0), (5, None), (None, 1.0), (None, 2.0)]
    got = histogram.density(spark.createDataFrame(values, "g int, v double"), "v", ["g"]).collect()
    assert {r.g for r in got} == {1, 2, None}  # a group of equal or lacking values has no bandwidth
    for g in (1, 2):
        curve = sorted((r.x, r.density, r.bandwidth) for r in got if r.g == g)
        step, h = curve[1][0] - curve[0][0], curve[0][2]
        assert len(curve) == 512 and sum(d for _, d, _ in curve) * step == pytest.approx(1, abs=5e-3)
        own = [v for k, v in values if k == g]
        for x, d, _ in curve[::37]:
            direct = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in own) / (len(own) * h * math.sqrt(2 * math.pi))
            assert d == pytest.approx(direct, abs=1e-4)
    assert histogram.density(spark.createDataFrame([], "g int, v double"), "v", ["g"]).count() == 0


def test_quantiles_of_large_shapes_cost_no_more(spark):
    """Closed forms and the normal limit, in the time that small shapes take."""

    def timed(rows):
        df = spark.createDataFrame(rows, "a double, b double")
        began = time.time()
        got = df.select("a", "b", beta_quantile(0.025, F.col("a"), F.col("b")), beta_quantile(0.975, F.col("a"), F.col("b"))).collect()
        return got, time.time() - began

    timed([(2.0, 2.0)])  # the first call compiles
    small, usual = timed([(0.5 + k, 1.0) for k in range(8)])
    large, took = timed([(1e6 + k, 1.0) for k in range(4)] + [(1e8 + k, 3e8) for k in range(4)])
    assert took < 3 * usual + 5
    for a, b, low, high in small + large[:4]:
        assert low == pytest.approx(0.025 ** (1 / a), rel=1e-9) and high == pytest.approx(0.975 ** (1 / a), rel=1e-9)
    for a, b, low, high in large[4:]:
        spread = 1.959963984540054 * math.sqrt(a * b / (a + b + 1)) / (a + b)
        assert low == pytest.approx(a / (a + b) - spread, abs=1e-8) and high == pytest.approx(a / (a + b) + spread, abs=1e-8)
