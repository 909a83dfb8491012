"""Statistics that SQL cannot express, against brute force on small samples, and their laws."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators import categorical as K
from statloom.operators import compare as C
from statloom.operators import correlation as R
from statloom.operators import groups as G
from statloom.operators import normality as N
from statloom.operators import resample as B
from statloom.operators import summary as S


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    n = 240
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.5, 0.3, 0.2]), "x": np.round(rng.gamma(2, 3, n), 1)})
    pdf["y"] = np.round(pdf["x"] * 0.5 + rng.normal(size=n), 1)
    pdf["z"] = np.round(rng.normal(size=n), 1)
    return pdf, spark.createDataFrame(pdf).cache()


def ranks(v):
    return pd.Series(v).rank().to_numpy()


def test_kendall_brute_force(spark, sample):
    pdf, df = sample
    got = R.correlation_test(df, ["x", "y", "z"], method="kendall").toPandas().set_index(["x", "y"])
    for a, b in itertools.combinations(["x", "y", "z"], 2):
        s = tx = ty = 0
        for (x1, y1), (x2, y2) in itertools.combinations(zip(pdf[a], pdf[b]), 2):
            s += np.sign(x1 - x2) * np.sign(y1 - y2)
            tx += x1 == x2
            ty += y1 == y2
        t = len(pdf) * (len(pdf) - 1) / 2
        assert got.loc[(a, b), "r"] == pytest.approx(s / np.sqrt((t - tx) * (t - ty)))
        assert 0 <= got.loc[(a, b), "p_value"] <= 1


def test_spearman_and_partial(spark, sample):
    pdf, df = sample
    got = R.correlation_test(df, pairs=[("x", "y")], method="spearman").first()
    assert got["r"] == pytest.approx(np.corrcoef(ranks(pdf["x"]), ranks(pdf["y"]))[0, 1])
    part = R.partial_correlation(df, "x", "y", ["z", "g"]).first()
    design = np.column_stack([np.ones(len(pdf)), pdf["z"], pdf["g"] == "b", pdf["g"] == "c"]).astype(float)
    rx, ry = (pdf[c] - design @ np.linalg.lstsq(design, pdf[c], rcond=None)[0] for c in ("x", "y"))
    r = np.corrcoef(rx, ry)[0, 1]
    assert part["r"] == pytest.approx(r)
    assert part["n_covar_terms"] == 3
    dof = len(pdf) - 5
    assert part["p_value"] == pytest.approx(2 * dist.t_sf(abs(r) * np.sqrt(dof / (1 - r * r)), dof), rel=1e-6)
    with pytest.raises(ValueError):
        R.partial_correlation(df, "x", "y", [])


def test_pairwise_deletion_and_skipped_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 1.0, 5.0), (4.0, 9.0, 5.0), (5.0, 3.0, 5.0)], "a double, b double, c double")
    got = R.correlation_test(df).toPandas().set_index(["x", "y"])
    assert got.loc[("a", "b"), "n"] == 4
    assert "one value only" in got.loc[("a", "c"), "flags"]
    assert pd.isna(got.loc[("b", "c"), "r"])


def test_levene_trimmed_and_fligner(spark, sample):
    pdf, df = sample
    groups = [p["x"].to_numpy() for _, p in pdf.groupby("g")]
    cut = [np.sort(v)[int(0.05 * len(v)) : len(v) - int(0.05 * len(v))] for v in groups]
    z = [np.abs(v - v.mean()) for v in cut]
    n, k = sum(map(len, z)), len(z)
    grand = np.concatenate(z).mean()
    w = (n - k) / (k - 1) * sum(len(v) * (v.mean() - grand) ** 2 for v in z) / sum(((v - v.mean()) ** 2).sum() for v in z)
    got = G.variance_test(df, "g", "x", "levene", "trimmed").first()
    assert got["statistic"] == pytest.approx(w)
    dev = np.concatenate([np.abs(v - np.median(v)) for v in groups])
    a = np.array([dist.norm_ppf(0.5 + r / (2 * (len(dev) + 1))) for r in ranks(dev)])
    parts = np.split(a, np.cumsum([len(v) for v in groups])[:-1])
    x2 = sum(len(p) * (p.mean() - a.mean()) ** 2 for p in parts) / a.var(ddof=1)
    got = G.variance_test(df, "g", "x", "fligner").first()
    assert got["statistic"] == pytest.approx(x2)
    assert got["p_value"] == pytest.approx(dist.chi2_sf(x2, 2))


def test_normality(spark, sample):
    pdf, df = sample
    x = pdf["x"].to_numpy()
    n = len(x)
    got = {m: N.normality_test(df, ["x"], method=m).first() for m in ("shapiro", "dagostino", "jarque_bera", "anderson")}
    assert got["shapiro"]["statistic"] == pytest.approx(dist.shapiro(x)[0])
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    i = np.arange(1, n + 1)
    a2 = -n - np.mean((2 * i - 1) * (np.log([dist.norm_cdf(v) for v in z]) + np.log([dist.norm_sf(v) for v in z[::-1]])))
    assert got["anderson"]["statistic"] == pytest.approx(a2)
    m2, m3, m4 = (((x - x.mean()) ** p).mean() for p in (2, 3, 4))
    g1, g2 = m3 / m2**1.5, m4 / m2**2 - 3
    assert got["jarque_bera"]["statistic"] == pytest.approx(n / 6 * (g1**2 + g2**2 / 4))
    assert got["dagostino"]["p_value"] < 0.001 and got["dagostino"]["decision"] == "reject H₀"
    assert got["shapiro"]["skew"] == pytest.approx(pdf["x"].skew())
    assert got["shapiro"]["excess_kurtosis"] == pytest.approx(pdf["x"].kurt())


def test_dagostino_published_example(spark):
    # Cholesterol data of D'Agostino, Belanger & D'Agostino (1990): n = 62, √b1 = 1.02, b2 = 4.58, K² = 14.75.
    one = spark.range(1).select(F.lit(62).alias("n"), F.lit(1.02).alias("g1"), F.lit(1.58).alias("g2"))
    k2 = one.select(N._dagostino(F.col("n"), F.col("g1"), F.col("g2"))).first()[0]
    assert k2 == pytest.approx(14.75, abs=0.15)


def test_shapiro_subsample_is_exact_in_size_and_repeatable(spark):
    df = spark.range(20_000).select((F.col("id") % 977).cast("double").alias("v"))
    a = N.normality_test(df, ["v"], max_n=500).first()
    b = N.normality_test(df.repartition(7), ["v"], max_n=500).first()
    assert a["n_used"] == 500 and a["statistic"] == b["statistic"]
    assert "sampled values" in a["flags"]


def test_bootstrap_laws(spark, sample):
    pdf, df = sample
    for stat, est in (("mean", np.mean), ("median", np.median), ("std", lambda v: v.std(ddof=1)), ("sum", np.sum), ("max", np.max)):
        got = B.bootstrap_ci(df, "x", "g", stat, n_resamples=799, method="percentile").toPandas().set_index("group")
        again = B.bootstrap_ci(df.repartition(5), "x", "g", stat, n_resamples=799, method="percentile").toPandas().set_index("group")
        assert np.allclose(got["ci_low"], again.loc[got.index, "ci_low"])
        for g, part in pdf.groupby("g"):
            v = part["x"].to_numpy()
            assert got.loc[g, "estimate"] == pytest.approx(est(v))
            assert got.loc[g, "ci_low"] <= got.loc[g, "estimate"] <= got.loc[g, "ci_high"] + 1e-9
            if stat == "mean":
                assert got.loc[g, "se"] == pytest.approx(v.std(ddof=0) / np.sqrt(len(v)), rel=0.12)
            if stat == "median":
                rng = np.random.default_rng(0)
                sim = np.median(rng.choice(v, (4000, len(v))), axis=1)
                assert got.loc[g, "se"] == pytest.approx(sim.std(), rel=0.25)


def test_bootstrap_blocks_do_not_change_the_law(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.round(rng.exponential(size=900), 3)
    df = spark.createDataFrame(pd.DataFrame({"x": v}))
    monkeypatch.setattr(B, "BLOCK_ROWS", 20)
    monkeypatch.setattr(B, "MAX_BLOCKS", 5)  # a tree of depth 3
    for stat, se in (("mean", v.std() / 30), ("median", np.median(rng.choice(v, (3000, 900)), axis=1).std())):
        got = B.bootstrap_ci(df, "x", statistic=stat, n_resamples=999, method="BCa").first()
        assert got["se"] == pytest.approx(se, rel=0.15)
        assert got["ci_low"] < got["estimate"] < got["ci_high"]


def test_bca_acceleration_matches_the_jackknife(spark):
    v = np.round(np.random.default_rng(6).gamma(1.5, size=41), 2)
    df = spark.createDataFrame(pd.DataFrame({"value": v}))
    for part in (v, v[:40]):
        ranked = B.cumulate(B.histogram(spark.createDataFrame(pd.DataFrame({"value": part})), "value"), "value")
        for stat, fn in (("mean", np.mean), ("var", lambda a: a.var(ddof=1)), ("median", np.median), ("min", np.min), ("max", np.max)):
            got = B.estimates_and_jackknife(ranked, stat).first()
            jack = np.array([fn(np.delete(part, i)) for i in range(len(part))])
            d = (len(part) - 1) * (jack.mean() - jack)
            assert got["theta_hat"] == pytest.approx(fn(part))
            assert got["u2"] == pytest.approx((d**2).sum() / len(part) ** 2, abs=1e-12)
            assert got["u3"] == pytest.approx((d**3).sum() / len(part) ** 3, abs=1e-12)
    assert df.count() == 41


def test_bootstrap_callable_and_limits(spark, sample, monkeypatch):
    pdf, df = sample
    got = B.bootstrap_ci(df, "x", "g", lambda a: float(np.percentile(a, 75)), n_resamples=99).toPandas()
    assert len(got) == 3 and (got["ci_low"] <= got["ci_high"]).all()
    monkeypatch.setattr(B, "CALLABLE_MAX", 10)
    with pytest.raises(ValueError):
        B.bootstrap_ci(df, "x", "g", lambda a: 0.0, n_resamples=9)
    flat = spark.createDataFrame([(1.0,)] * 30, "x double")
    assert "gives no interval" in B.bootstrap_ci(flat, "x", n_resamples=99).first()["flags"]


def test_permutation_against_enumeration(spark):
    a, b = [1.1, 2.3, 2.9, 4.0], [3.1, 4.2, 5.0, 6.6, 3.3]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    pool = np.array(a + b)
    obs = np.mean(a) - np.mean(b)
    diffs = []
    for c in itertools.combinations(range(9), 4):
        m = np.isin(np.arange(9), c)
        diffs.append(pool[m].mean() - pool[~m].mean())
    exact = min(1, 2 * min(np.mean(np.array(diffs) <= obs + 1e-12), np.mean(np.array(diffs) >= obs - 1e-12)))
    got = C.compare_groups(df, "g", "v", "permutation", n_resamples=4999).first()
    assert got["statistic"] == pytest.approx(obs)
    assert got["p_value"] == pytest.approx(exact, abs=0.02)


def test_sign_flips_against_enumeration(spark):
    d = np.array([0.5, 1.5, -0.2, 2.0, 0.9, -0.4, 1.1])
    df = spark.createDataFrame([(float(v), 0.0) for v in d], "a double, b double")
    sums = [np.dot(s, np.abs(d)) for s in itertools.product((-1, 1), repeat=7)]
    exact = min(1, 2 * np.mean(np.array(sums) >= d.sum() - 1e-12))
    assert C.compare_paired(df, "a", "b", "permutation", n_resamples=4999).first()["p_value"] == pytest.approx(exact, abs=0.02)


def test_two_group_relations(spark, sample):
    pdf, df = sample
    two = df.filter("g <> 'c'")
    ab = C.compare_groups(two, "g", "x", "mannwhitney").first()
    ba = C.compare_groups(two, "g", "x", "mannwhitney", order=["b", "a"]).first()
    n1, n2 = (pdf["g"] == "a").sum(), (pdf["g"] == "b").sum()
    assert ab["statistic"] + ba["statistic"] == n1 * n2
    assert ab["effect_size"] == pytest.approx(-ba["effect_size"])
    assert ba["comparison"] == "b vs a"
    less, greater = (C.compare_groups(two, "g", "x", "welch", alternative=s).first()["p_value"] for s in ("less", "greater"))
    assert less + greater == pytest.approx(1)
    bm = [C.compare_groups(two, "g", "x", "brunnermunzel", alternative=s).first() for s in ("less", "greater")]
    assert bm[0]["p_value"] + bm[1]["p_value"] == pytest.approx(1)
    with pytest.raises(ValueError):
        C.compare_groups(df, "g", "x", "anova", alternative="less")
    with pytest.raises(Exception, match="exactly 2 groups"):
        C.compare_groups(df, "g", "x", "welch").collect()


def test_dropped_groups_are_named(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 5.0), ("c", 9.0), (None, 1.0)], "g string, v double")
    got = C.compare_groups(df, "g", "v", "welch").first()
    assert "groups left out as too small: c(n=1)" in got["flags"]
    assert "smallest group has 2 values" in got["flags"]
    assert got["group_sizes"] == "a=2; b=2"


def test_auto_choice(spark):
    rng = np.random.default_rng(2)
    normal = pd.DataFrame({"g": ["a"] * 60 + ["b"] * 60, "v": np.r_[rng.normal(size=60), rng.normal(1, 1, 60)]})
    skewed = pd.DataFrame({"g": ["a"] * 200 + ["b"] * 200, "v": np.r_[rng.exponential(size=200), 6 * rng.exponential(size=200)]})
    got = C.compare_groups(spark.createDataFrame(normal), "g", "v").first()
    assert got["test"] == "welch" and got["chosen_because"].startswith("auto: normal 2/2")
    got = C.compare_groups(spark.createDataFrame(skewed), "g", "v").first()
    assert got["test"] == "brunnermunzel" and "variances unequal" in got["chosen_because"]


def test_pairwise_and_adjustments(spark, sample):
    pdf, df = sample
    got = C.pairwise_comparisons(df, "g", "x", "welch").toPandas()
    assert len(got) == 3 and (got["p_adj"] >= got["p_value"] - 1e-12).all()
    assert got["p_adj"].is_monotonic_increasing
    ref = C.pairwise_comparisons(df, "g", "x", "ks", ref_group="b").toPandas()
    assert set(ref["group_a"]) == {"b"} and len(ref) == 2
    with pytest.raises(Exception, match="is absent or below min_group_n"):
        C.pairwise_comparisons(df, "g", "x", "ks", ref_group="zz").collect()
    p = [0.01, 0.04, 0.03, None, 0.005, 0.04]
    fam = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    want = {"holm": [0.04, 0.09, 0.09, None, 0.025, 0.09], "bonferroni": [0.05, 0.2, 0.15, None, 0.025, 0.2], "fdr_bh": [0.025, 0.04, 0.04, None, 0.025, 0.04]}
    for method, expected in want.items():
        for fn in (lambda d: C.p_adjust(d, "p", method), lambda d: C.adjust_family(d, "p", method, "p_adj", [])):
            out = [r["p_adj"] for r in fn(fam).orderBy("i").collect()]
            assert [None if v is None else round(v, 6) for v in out] == expected, method


def test_paired(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 2.0), (4.0, 3.0), (7.0, 3.0), (None, 1.0), (6.0, 6.5)], "a double, b double")
    got = C.compare_paired(df, "a", "b", "wilcoxon").first()
    assert got["n_dropped"] == 1 and got["n_pairs"] == 5
    assert "ranks leave out 1 pairs without a difference" in got["flags"]
    # Ranks of |d|: 3 → 3, 1 → 2, 4 → 4, 0.5 → 1 (negative).
    assert got["statistic"] == 1.0 and got["effect_size"] == pytest.approx(0.8)
    with pytest.raises(Exception, match="three pairs or more"):
        C.compare_paired(df.limit(2), "a", "b", "ttest").collect()


def test_contingency(spark):
    df = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] + [("b", "y")] * 5, "r string, c string")
    got = K.association_test(df, "r", "c").first()
    assert got["test"] == "fisher_exact" and got["p_value"] == pytest.approx(0.034965, abs=1e-6)
    assert got["odds_ratio"] == 20.0
    grid = K.contingency_table(df.union(spark.createDataFrame([("c", "z")], "r string, c string")), "r", "c")
    assert grid.count() == 9 and grid.filter("observed = 0").count() == 4
    total = K.contingency_residuals(df, "r", "c", "contribution").agg(F.sum("residual")).first()[0]
    assert total == pytest.approx(100)
    wide = K.contingency_residuals(df, "r", "c", long=False)
    assert wide.columns == ["row", "x", "y"]
    with pytest.raises(Exception, match="two levels or more"):
        K.association_test(df.filter("c = 'x'"), "r", "c").collect()


def test_proportions(spark):
    df = spark.createDataFrame([(0, 10), (7, 10), (10, 10), (0, 0)], "k int, n int")
    got = S.proportion_ci(df, "k", "n", method="clopper_pearson").toPandas()
    assert got["ci_low"][0] == 0 and got["ci_high"][2] == 1 and pd.isna(got["ci_low"][3])
    assert got["ci_low"][1] == pytest.approx(0.34755, abs=1e-5) and got["ci_high"][1] == pytest.approx(0.93326, abs=1e-5)
    with pytest.raises(Exception, match="between 0 and the number of trials"):
        S.proportion_ci(spark.createDataFrame([(5, 3)], "k int, n int"), "k", "n").collect()


def test_summary_edge_cases(spark):
    df = spark.createDataFrame([(1.0, "1", True), (float("nan"), "2", False), (3.0, "4", None)], "a double, b string, c boolean")
    got = S.summary_stats(df).toPandas().set_index("column")
    assert list(sorted(got.index)) == ["a", "b"]
    assert got.loc["a", "n"] == 2 and got.loc["a", "n_missing"] == 1
    assert got.loc["a", "ci_high"] - got.loc["a", "mean"] == pytest.approx(dist.t_ppf(0.975, 1) * 2**0.5 / 2**0.5)
    assert pd.isna(got.loc["a", "skew"])
    flags = S.outlier_flags(spark.createDataFrame([(v,) for v in [1.0] * 3 + [2.0] * 5 + [99.0, None]], "v double"))
    assert flags.filter("any_outlier").count() == 1 and flags.filter("v is null and not any_outlier").count() == 1
