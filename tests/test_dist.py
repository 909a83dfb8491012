"""Distribution functions against an independent library that ships with Spark."""

import math

import numpy as np
import pytest

from statloom.functions import dist


@pytest.fixture(scope="module")
def math3(spark):
    return spark._jvm.org.apache.commons.math3


def test_t(math3):
    for df in (1, 2.5, 7, 40, 5000):
        d = math3.distribution.TDistribution(float(df))
        for t in (-6.0, -1.3, 0.0, 0.4, 2.2, 9.0):
            assert dist.t_sf(t, df) == pytest.approx(1 - d.cumulativeProbability(t), abs=1e-10)
        assert dist.t_ppf(0.975, df) == pytest.approx(d.inverseCumulativeProbability(0.975), rel=1e-7)


def test_f_chi2_beta_normal(math3):
    f = math3.distribution.FDistribution(3.0, 17.0)
    c = math3.distribution.ChiSquaredDistribution(4.0)
    b = math3.distribution.BetaDistribution(3.0, 8.0)
    n = math3.distribution.NormalDistribution(0.0, 1.0)
    for x in (0.2, 1.0, 3.5, 12.0):
        assert dist.f_sf(x, 3, 17) == pytest.approx(1 - f.cumulativeProbability(x), abs=1e-10)
        assert dist.chi2_sf(x, 4) == pytest.approx(1 - c.cumulativeProbability(x), abs=1e-10)
    for p in (0.001, 0.025, 0.5, 0.9, 0.999):
        assert dist.beta_ppf(p, 3, 8) == pytest.approx(b.inverseCumulativeProbability(p), abs=1e-8)
        assert dist.norm_ppf(p) == pytest.approx(n.inverseCumulativeProbability(p), abs=1e-8)
        assert dist.norm_ppf_array(np.array([p]))[0] == pytest.approx(dist.norm_ppf(p), abs=1e-14)


def test_binomial_and_fisher(math3):
    d = math3.distribution.BinomialDistribution(21, 0.5)
    assert dist.binom_tail(15, 21) == pytest.approx(1 - d.cumulativeProbability(14), abs=1e-12)
    assert dist.sign_p(15, 21, "two-sided") == pytest.approx(2 * (1 - d.cumulativeProbability(14)), abs=1e-12)
    # The lady tasting tea, and a table with a known two-sided value.
    assert dist.fisher_p(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert dist.fisher_p(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)


def test_small_sample_rank_laws_by_enumeration():
    from itertools import combinations, permutations, product

    ranks = range(1, 8)
    us = [sum(c) - 6 for c in combinations(ranks, 3)]
    for u in (0, 2, 5, 9):
        upper, lower = np.mean([x >= u for x in us]), np.mean([x <= u for x in us])
        assert dist.mannwhitney_p(u, 3, 4, 0, "greater") == pytest.approx(upper)
        assert dist.mannwhitney_p(u, 3, 4, 0, "two-sided") == pytest.approx(min(1, 2 * min(upper, lower)))
    ts = [sum(r for r, s in zip(range(1, 7), signs) if s) for signs in product((0, 1), repeat=6)]
    assert dist.wilcoxon_p(17, 6, 0, 0, "greater") == pytest.approx(np.mean([t >= 17 for t in ts]))
    inversions = [sum(p[i] > p[j] for i, j in combinations(range(5), 2)) for p in permutations(range(5))]
    assert dist.kendall_p(10 - 2 * 2, 2, 5, 1, 0) == pytest.approx(min(1, 2 * np.mean([i <= 2 for i in inversions])))
    # Two-sample Kolmogorov-Smirnov, every arrangement of 3 and 4 observations.
    ds = []
    for c in combinations(range(7), 3):
        a = np.array([i in c for i in range(7)])
        ds.append(np.abs(np.cumsum(a) / 3 - np.cumsum(~a) / 4).max())
    for d in (0.5, 0.75, 1.0):
        assert dist.ks_p(d, 3, 4, "two-sided") == pytest.approx(np.mean([x >= d - 1e-9 for x in ds]))


def test_large_sample_rank_laws(math3, spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=40), rng.normal(0.4, size=55)
    u = sum((x > b).sum() for x in a)
    mean, sd = 40 * 55 / 2, math.sqrt(40 * 55 * 96 / 12)
    z = (abs(u - mean) - 0.5) / sd
    assert dist.mannwhitney_p(float(u), 40, 55, 0, "two-sided") == pytest.approx(math.erfc(z / math.sqrt(2)))
    gw = spark.sparkContext._gateway
    ja, jb = gw.new_array(gw.jvm.double, 40), gw.new_array(gw.jvm.double, 55)
    for i, v in enumerate(a):
        ja[i] = float(v)
    for i, v in enumerate(b):
        jb[i] = float(v)
    ks = math3.stat.inference.KolmogorovSmirnovTest()
    d = ks.kolmogorovSmirnovStatistic(ja, jb)
    assert dist.ks_p(d, 40, 55, "two-sided") == pytest.approx(ks.exactP(d, 40, 55, False), abs=1e-6)


def test_shapiro_known_values():
    # Published example: weights of 11 men (Shapiro & Wilk 1965), W = 0.79, p below 0.01.
    w, p = dist.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005)
    assert 0.004 < p < 0.01
    w, p = dist.shapiro(np.array([dist.norm_ppf((i - 0.5) / 200) for i in range(1, 201)]))
    assert w > 0.998 and p > 0.99


def test_anderson_tables():
    assert dist.anderson_critical(1e9, 0.05) == 0.752
    assert dist.anderson_p(0.752, 1e9) == pytest.approx(0.05)
    assert dist.anderson_p(99, 50) == 0.01
