"""Mergeable statistics, permutation trees, absorbed controls and sparse tables, against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import categorical as K
from statloom.operators import compare as C
from statloom.operators import correlation as R
from statloom.operators import mergeable as M
from statloom.operators import ranks
from statloom.operators import resample as B


def small_tree(monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 20)
    monkeypatch.setattr(B, "MAX_BLOCKS", 5)
    monkeypatch.setattr(M, "_RUN", 7)


MEAN = M.of_moments("mean", lambda n, mean, m2, m3: mean)
VAR = M.of_moments("var", lambda n, mean, m2, m3: M._ratio(m2, n - 1))


@pytest.mark.parametrize("deep", [False, True])
def test_mergeable_gives_what_the_named_statistic_gives(spark, monkeypatch, deep):
    """Same seeds, same draws, same leave-one-out values: the same interval, over one block or a tree."""
    if deep:
        small_tree(monkeypatch)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(500) < 0.7, "a", "b"), "x": np.round(rng.gamma(2, 3, 500), 1) + 1000})
    df = spark.createDataFrame(pdf)
    for own, named in ((MEAN, "mean"), (VAR, "var")):
        got = B.bootstrap_ci(df, "x", "g", own, n_resamples=199).toPandas().set_index("group")
        want = B.bootstrap_ci(df, "x", "g", named, n_resamples=199).toPandas().set_index("group").loc[got.index]
        for c in ("n", "estimate", "se"):
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8), (named, c)
        # Replicates that tie with the estimate may fall on either side of it by rounding.
        for c in ("ci_low", "ci_high"):
            assert (np.abs(got[c] - want[c]) < 0.05 * want["se"]).all(), (named, c)
        assert (got["statistic"] == named).all()


def test_mergeable_states_do_not_depend_on_the_cuts():
    rng = np.random.default_rng(5)
    values, counts = rng.normal(50, 2, 60), rng.integers(0, 4, (9, 60))
    counts[3] = 0
    for s in (M.variation, M.skewness, M.geometric_mean, M.share_above(50)):
        whole = s.partial(values, counts)
        for cut in (1, 17, 59):
            parts = s.merge(s.partial(values[:cut], counts[:, :cut]), s.partial(values[cut:], counts[:, cut:]))
            assert np.allclose(s.finish(parts)[counts.sum(1) > 0], s.finish(whole)[counts.sum(1) > 0], rtol=1e-9)
    v = np.repeat(values, counts[0])
    assert M.variation.finish(M.variation.partial(values, counts[:1]))[0] == pytest.approx(v.std(ddof=1) / v.mean())
    assert M.skewness.finish(M.skewness.partial(values, counts[:1]))[0] == pytest.approx(((v - v.mean()) ** 3).mean() / v.std() ** 3)
    assert M.geometric_mean.finish(M.geometric_mean.partial(values, counts[:1]))[0] == pytest.approx(math.exp(np.log(v).mean()))
    assert np.isnan(M.geometric_mean.finish(M.geometric_mean.partial(np.array([-1.0, 2.0]), np.array([[1, 1]])))[0])


def test_mergeable_leave_one_out(spark, monkeypatch):
    small_tree(monkeypatch)
    v = np.round(np.random.default_rng(6).gamma(1.5, size=203), 1) + 0.1
    ranked = B.settle(B.cumulate(B.histogram(spark.createDataFrame(pd.DataFrame({"g": "a", "value": v})), "value", ["g"]), "value", by=["g"]))
    fn = lambda a: a.std(ddof=1) / a.mean()
    est, reps = M.estimates_and_replicates(ranked, M.variation, 30, 1, ["g"])
    got = est.first()
    jack = np.array([fn(np.delete(v, i)) for i in range(len(v))])
    d = (len(v) - 1) * (jack.mean() - jack)
    assert got["theta_hat"] == pytest.approx(fn(v)) and got["n"] == 203
    assert got["u2"] == pytest.approx((d**2).sum() / len(v) ** 2) and got["u3"] == pytest.approx((d**3).sum() / len(v) ** 3)
    assert reps.count() == 30


def test_mergeable_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("b", 2.0), ("c", None), ("d", float("nan"))], "g string, x double")
    got = {r.group: r for r in B.bootstrap_ci(df, "x", "g", M.variation, n_resamples=49, min_group_n=1).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].ci_low is None and "n < 2" in got["a"].flags
    assert got["b"].estimate == 0 and got["b"].se == 0
    assert B.bootstrap_ci(df.limit(0), "x", "g", M.variation, n_resamples=49).count() == 0


def test_hypergeometric_law():
    """Large populations follow the same law: against the exact probabilities by chi-square."""
    rng = np.random.default_rng(7)
    lf = math.lgamma
    for good, bad, draws in ((3 * 10**9, 7 * 10**9, 40), (10**10, 5 * 10**9, 12), (2 * 10**9, 10**12, 5000), (40, 10**10, 10**9), (10**9, 10**9, 6), (10**10, 60, 10**10)):
        x = B.hypergeometric(rng, good, bad, np.full(40_000, draws))
        assert x.min() >= max(0, draws - bad) and x.max() <= min(good, draws)
        lo, hi = int(x.min()), int(x.max())
        # Binomial-coefficient ratios by neighbours, which stay exact where factorials would not.
        k = np.arange(lo, hi)
        log_step = np.log((good - k) / (k + 1.0)) + np.log((draws - k) / (bad - draws + k + 1.0))
        logp = np.concatenate([[0.0], np.cumsum(log_step)])
        p = np.exp(logp - logp.max())
        p /= p.sum()
        seen = np.bincount(x - lo, minlength=len(p))
        wide = p * len(x) >= 5
        stat, dof = (((seen - p * len(x)) ** 2 / (p * len(x)))[wide]).sum(), wide.sum() - 1
        assert dof < 1 or stat < dof + 5 * math.sqrt(2 * dof) + 10, (good, bad, draws, stat, dof)
    assert lf(5) == pytest.approx(math.log(24))


def test_split_without_replacement_is_a_shuffle():
    rng = np.random.default_rng(8)
    sizes = np.array([5, 1, 0, 14])
    table = B._without_replacement(rng, sizes, np.full(20_000, 8))
    assert (table.sum(axis=1) == 8).all() and (table <= sizes).all() and table.min() >= 0
    assert np.allclose(table.mean(axis=0), 8 * sizes / 20, atol=0.05)
    cov = np.cov(table[:, 0], table[:, 3])
    f = 8 / 20 * 12 / 20 * 20 / 19
    assert cov[0, 0] == pytest.approx(f * 5 * 15 / 20, rel=0.05) and cov[0, 1] == pytest.approx(-f * 5 * 14 / 20, rel=0.05)
    big = np.array([4 * 10**9, 6 * 10**9, 10**10])
    table = B._without_replacement(rng, big, np.full(2000, 10**10))
    assert (table.sum(axis=1) == 10**10).all() and np.allclose(table.mean(axis=0), big / 2, rtol=1e-4)


def shuffled_p(a, b):
    pool = np.concatenate([a, b])
    sums = np.array([pool[list(c)].sum() for c in itertools.combinations(range(len(pool)), len(a))])
    eps = 1e-9
    return {"greater": np.mean(sums >= sum(a) - eps), "less": np.mean(sums <= sum(a) + eps)}


def test_few_relabellings_are_gone_through(spark):
    a, b = [1.1, 2.3, 2.9, 4.0], [3.1, 4.2, 5.0, 6.6, 3.1]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    p = shuffled_p(a, b)
    for side, want in (("two-sided", min(1, 2 * min(p.values()))), ("greater", p["greater"]), ("less", p["less"])):
        got = C.compare_groups(df, "g", "v", "permutation", n_resamples=126, alternative=side).first()["p_value"]
        assert got == pytest.approx(want, abs=1e-12)
    d = np.array([0.5, 1.5, -0.2, 2.0, 0.9, -0.4, 1.1])
    pairs = spark.createDataFrame([(float(v), 0.0) for v in d], "a double, b double")
    sums = np.array([np.dot(s, np.abs(d)) for s in itertools.product((-1, 1), repeat=7)])
    got = C.compare_paired(pairs, "a", "b", "permutation", n_resamples=128).first()["p_value"]
    assert got == pytest.approx(min(1, 2 * min(np.mean(sums >= d.sum() - 1e-9), np.mean(sums <= d.sum() + 1e-9))), abs=1e-12)


def test_permutation_over_a_tree_of_blocks(spark, monkeypatch):
    """A tree of depth 3 gives the normal limit of the law, whatever the cuts."""
    rng = np.random.default_rng(9)
    a, b = np.round(rng.normal(0.25, 1, 300), 2), np.round(rng.normal(0, 1, 400), 2)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    pool = np.concatenate([a, b])
    z = (a.mean() - b.mean()) / math.sqrt(pool.var(ddof=1) * (1 / 300 + 1 / 400))
    want = math.erfc(abs(z) / math.sqrt(2))
    small_tree(monkeypatch)
    got = C.compare_groups(df, "g", "v", "permutation", n_resamples=3999).first()["p_value"]
    assert got == pytest.approx(want, abs=4 * math.sqrt(want / 3999) + 1e-3)
    d = np.round(rng.normal(0.1, 1, 500), 2)
    pairs = spark.createDataFrame([(float(v), 0.0) for v in d], "a double, b double")
    want = math.erfc(abs(d.sum() / math.sqrt((d**2).sum())) / math.sqrt(2))
    got = C.compare_paired(pairs, "a", "b", "permutation", n_resamples=3999).first()["p_value"]
    assert got == pytest.approx(want, abs=4 * math.sqrt(want / 3999) + 1e-3)


def test_absorbed_controls(spark):
    rng = np.random.default_rng(10)
    n = 1500
    pdf = pd.DataFrame({"z": rng.normal(size=n)})
    f, h = rng.integers(0, 30, n), rng.integers(0, 12, n)
    pdf["f"], pdf["h"], shift = [f"f{i}" for i in f], [f"h{i}" for i in h], f * 0.3 + h * 0.5
    pdf["x"] = shift + rng.normal(size=n) + 1e3
    pdf["y"] = shift + 0.4 * pdf["x"] + pdf["z"] + rng.normal(size=n)
    pdf.loc[5, "f"] = None
    df, kept = spark.createDataFrame(pdf), pdf.dropna()
    for covars in (["f"], ["f", "h"], ["f", "z"], ["h", "z", "f"]):
        for method in ("pearson", "spearman"):
            got = R.partial_correlation(df, "x", "y", covars, method).first()
            num = {c: (kept[c].rank() if method == "spearman" else kept[c]) for c in ("x", "y", "z")}
            design = np.column_stack([np.ones(len(kept))] + [num[c] if c == "z" else pd.get_dummies(kept[c], drop_first=True) for c in covars]).astype(float)
            rx, ry = (num[c] - design @ np.linalg.lstsq(design, num[c], rcond=None)[0] for c in ("x", "y"))
            assert got["r"] == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-7), (covars, method)
            assert got["n_covar_terms"] == design.shape[1] - 1 and got["n"] == len(kept)
            assert got["r_zero_order"] == pytest.approx(np.corrcoef(num["x"], num["y"])[0, 1], abs=1e-9)


def test_absorbing_leaves_nothing(spark):
    df = spark.createDataFrame([(f"f{i % 4}", float(i % 4), float(i)) for i in range(40)], "f string, x double, y double")
    with pytest.raises(ValueError, match="follows from the controls alone"):
        R.partial_correlation(df, "x", "y", ["f"])


def test_sparse_tables(spark):
    rng = np.random.default_rng(12)
    for r, c, n in ((2, 2, 30), (2, 2, 400), (5, 3, 60), (40, 30, 200), (1500, 3, 4000)):
        pdf = pd.DataFrame({"a": [f"a{v}" for v in (r * rng.random(n) ** 2).astype(int)], "b": [f"b{v}" for v in (c * rng.random(n) ** 2).astype(int)]})
        df = spark.createDataFrame(pdf)
        o = pd.crosstab(pdf["a"], pdf["b"]).to_numpy().astype(float)
        e = np.outer(o.sum(1), o.sum(0)) / o.sum()
        got = K.table_summary(K.observed_cells(df, "a", "b")).first()
        assert (got["r"], got["c"], got["n"]) == (*o.shape, n)
        assert got["chi2"] == pytest.approx(((o - e) ** 2 / e).sum(), rel=1e-9)
        assert got["min_expected"] == pytest.approx(e.min()) and got["pct_below"] == pytest.approx(100 * np.mean(e < 5))
        if o.shape == (2, 2):
            gap = np.abs(o - e)
            assert got["chi2_yates"] == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / e).sum())
            assert [got[k] for k in ("n11", "n12", "n21", "n22")] == o.ravel().tolist()
        sparse = K.contingency_residuals(df, "a", "b", "contribution", zeros=False)
        assert sparse.count() == (o > 0).sum()
        full = K.contingency_table(df, "a", "b")
        assert full.count() == o.size and full.filter("observed = 0").count() == (o == 0).sum()
        assert K.contingency_residuals(df, "a", "b", "contribution").agg(F.sum("residual")).first()[0] == pytest.approx(100)
    flat = spark.createDataFrame([("a", "x")] * 3, "a string, b string")
    with pytest.raises(Exception, match="two levels or more"):
        K.association_test(flat, "a", "b").collect()


def test_sizes_of_branches_travel_once_a_block(spark, monkeypatch):
    """Rows of a block carry no lists of sizes; there is one path for each leaf, of at most MAX_BLOCKS a level."""
    small_tree(monkeypatch)
    v = np.round(np.random.default_rng(13).gamma(1.5, size=900), 2)
    ranked = B.settle(B.cumulate(B.histogram(spark.createDataFrame(pd.DataFrame({"g": "a", "value": v})), "value", ["g"]), "value", by=["g"]))
    rows, paths, depth = B._tree_blocks(ranked, ["g"])
    assert not [f.name for f in rows.schema if f.dataType.typeName() == "array"] and depth == 3
    found = paths.toPandas()
    assert len(found) == found["block"].nunique() == rows.select("block").distinct().count() > 25
    assert max(len(x) for level in range(depth) for x in found[f"sizes{level}"]) <= 5


@pytest.mark.parametrize("sent", [50_000, 1])
def test_attach_keeps_a_key_that_holds_most_spread(spark, monkeypatch, sent):
    monkeypatch.setattr(ranks, "SENT_ALONG", sent)
    rows = spark.range(2000).select(F.when(F.col("id") < 1900, "a").when(F.col("id") < 1990, "b").otherwise("c").alias("k"), "id").repartition(8)
    few = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, m long")
    got = ranks.attach(rows, few, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted([("a", i, 1) for i in range(1900)] + [("b", i, 2) for i in range(1900, 1990)])
    assert sorted(r.id for r in ranks.attach(rows, few.select("k"), ["k"], "left_semi").collect()) == list(range(1990))
    if sent > 1:
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
