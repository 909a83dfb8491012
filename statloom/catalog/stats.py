"""Queries for the statistics operators.

The SQL side computes statistics and effect sizes; p-values are tested against an independent
library in the unit tests, since SQL has no distribution functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import longs, query, rounded, table
from statloom.functions import labels as L
from statloom.functions.numeric import finite, numeric_columns
from statloom.operators import categorical as K
from statloom.operators import compare as C
from statloom.operators import correlation as R
from statloom.operators import groups as G
from statloom.operators import normality as N
from statloom.operators import ranks
from statloom.operators import resample as B
from statloom.operators import summary as S
from statloom.operators.mergeable import share_above, skewness, variation


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


# ---------------------------------------------------------------- shared machinery


@query(
    "t01_finite_filter",
    "SELECT count(*) FILTER (WHERE l_discount > 0) AS n_finite, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0), 2) AS total FROM lineitem",
)
def t01(spark, sf):
    # Rows without a discount get a value no statistic may use.
    bad = F.when(F.col("l_tax") > 0.04, float("nan")).when(F.col("l_tax") > 0.02, float("inf")).otherwise(None)
    v = finite(F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).otherwise(bad))
    return _lines(spark, sf).agg(F.count(v).alias("n_finite"), F.round(F.sum(v), 2).alias("total"))


@query(
    "t02_numeric_columns",
    "SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'digits']) AS \"column\"",
)
def t02(spark, sf):
    df = table(spark, sf, "orders").withColumns(
        {"digits": F.expr("left(o_orderpriority, 1)"), "is_open": F.col("o_orderstatus") == "O"}
    )
    return spark.createDataFrame([(c,) for c in numeric_columns(df)], "column string")


@query(
    "t03_group_split",
    """WITH g AS (SELECT CASE WHEN o_custkey % 7 = 3 AND o_totalprice <= 495000 THEN '7' ELSE o_custkey % 7 || '' END AS grp, o_totalprice AS v FROM orders)
    SELECT grp, count(*) AS n, round(avg(v), 4) AS mean, round(var_samp(v), 2) AS "var", row_number() OVER (ORDER BY grp) AS pos FROM g GROUP BY 1 HAVING count(*) >= 100""",
)
def t03(spark, sf):
    sevenths = F.col("o_custkey") % 7
    group = F.when((sevenths == 3) & (F.col("o_totalprice") <= 495000), "7").otherwise(sevenths.cast("string"))
    rows = G.samples(table(spark, sf, "orders").withColumn("g", group), "g", "o_totalprice")
    out, _ = G.group_levels(rows, 100)
    return longs(out.select("grp", "n", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"), "pos"))


@query(
    "t04_magnitude_labels",
    """SELECT l_suppkey, round(d, 6) AS d, CASE WHEN d IS NULL THEN '' WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude
    FROM (SELECT l_suppkey, (avg(l_quantity) - 25) / stddev_samp(l_quantity) * 4 AS d FROM lineitem GROUP BY 1)""",
)
def t04(spark, sf):
    out = _lines(spark, sf).groupBy("l_suppkey").agg(((F.avg("l_quantity") - 25) / F.stddev_samp("l_quantity") * 4).alias("d"))
    return rounded(out.withColumn("magnitude", L.magnitude(F.col("d"), L.D_LEVELS)))


@query(
    "t05_size_flags",
    """SELECT o_custkey, n, CASE WHEN n < 8 THEN 'smallest group has ' || n || ' values: only strong effects can show' WHEN n < 20 THEN 'smallest group has ' || n || ' values' END AS flag
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def t05(spark, sf):
    out = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("flag", L.size_flag(F.col("n")))


@query("t06_auto_test")
def t06(spark, sf):
    return C.compare_groups(_lines(spark, sf), "l_returnflag", "l_quantity")


@query("t07_fisher_interval")
def t07(spark, sf):
    pairs = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
    return R.correlation_test(_lines(spark, sf), pairs=pairs).select("x", "y", "n", "r", "ci_low", "ci_high")


@query(
    "t08_average_rank",
    """SELECT l_returnflag, l_quantity, max(r)::double AS mid, count(*) AS n FROM (SELECT l_returnflag, l_quantity,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS r FROM lineitem) GROUP BY 1, 2""",
)
def t08(spark, sf):
    hist = ranks.histogram(_lines(spark, sf), "l_quantity", ["l_returnflag"])
    out = ranks.cumulate(hist, "l_quantity", by=["l_returnflag"])
    return out.select("l_returnflag", "l_quantity", ranks.mid_rank().alias("mid"), "n")


# ---------------------------------------------------------------- columns


_SUMMARY = """WITH v AS (SELECT {c} AS x FROM {t}), m AS (SELECT median(x) AS med FROM v),
    o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM v WHERE x IS NOT NULL)
    SELECT '{c}' AS "column", count(x) AS n, count(*) - count(x) AS n_missing, count(DISTINCT x) AS n_unique, round(avg(x), 7) AS mean,
    (SELECT round(avg(x), 7) FROM o WHERE i >= floor(0.1 * n) AND i < n - floor(0.1 * n)) AS trimmed_mean, round(median(x), 7) AS median,
    round(stddev_samp(x), 7) AS std, (SELECT round(median(abs(x - med)) / 0.6744897501960817, 7) FROM v, m) AS mad,
    round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 7) AS iqr, round(stddev_samp(x) / avg(x), 7) AS cv, round(skewness(x), 7) AS skew,
    round(kurtosis(x), 7) AS excess_kurtosis, min(x) AS min, round(quantile_cont(x, 0.25), 7) AS q1, round(quantile_cont(x, 0.75), 7) AS q3, max(x) AS max FROM v"""
_BOTH = " UNION ALL ".join


@query(
    "t10_summary_stats",
    "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_SUMMARY.format(c=c, t="lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")) + ")",
)
def t10(spark, sf):
    out = S.summary_stats(_lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(out.drop("ci_low", "ci_high", "pct_missing"), 7)


@query("t11_shapiro")
def t11(spark, sf):
    return N.normality_test(table(spark, sf, "orders"), ["o_totalprice"], method="shapiro")


@query("t12_dagostino")
def t12(spark, sf):
    return N.normality_test(_lines(spark, sf), ["l_quantity", "l_extendedprice"], method="dagostino")


def _jb(c: str) -> str:
    """Jarque-Bera from central moments."""
    return f"""SELECT '{c}' AS "column", n, round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 4) AS statistic FROM (
    SELECT count(*) AS n, avg(power({c} - m, 2)) AS m2, avg(power({c} - m, 3)) AS m3, avg(power({c} - m, 4)) AS m4
    FROM lineitem, (SELECT avg({c}) AS m FROM lineitem))"""


@query("t13_jarque_bera", _BOTH(_jb(c) for c in ("l_quantity", "l_extendedprice")))
def t13(spark, sf):
    out = N.normality_test(_lines(spark, sf), ["l_quantity", "l_extendedprice"], method="jarque_bera")
    return rounded(out.select("column", "n", "statistic"), 4)


@query("t14_anderson")
def t14(spark, sf):
    return N.normality_test(_lines(spark, sf), ["l_quantity", "l_extendedprice"], method="anderson")


def _levene(centre: str) -> str:
    return f"""WITH c AS (SELECT l_returnflag AS g, {centre}(l_extendedprice) AS c FROM lineitem GROUP BY 1),
    z AS (SELECT l_returnflag AS g, abs(l_extendedprice - c) AS z FROM lineitem JOIN c ON g = l_returnflag),
    s AS (SELECT g, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm FROM s),
    w AS (SELECT l_returnflag, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1)
    SELECT sum(n)::bigint AS n, round((sum(n) - count(*)) / (count(*) - 1) * sum(n * (m - gm) ** 2) / sum((n - 1) * v), 6) AS statistic,
    (SELECT round(max(v) / min(v), 6) FROM w) AS max_var_ratio FROM s, t"""


@query("t15_levene_median", _levene("median"))
def t15(spark, sf):
    return rounded(G.variance_test(_lines(spark, sf), "l_returnflag", "l_extendedprice").select("n", "statistic", "max_var_ratio"))


@query("t15_levene_mean", _levene("avg"))
def t15_mean(spark, sf):
    return rounded(G.variance_test(_lines(spark, sf), "l_returnflag", "l_extendedprice", center="mean").select("n", "statistic", "max_var_ratio"))


@query("t15_levene_trimmed")
def t15_trimmed(spark, sf):
    return G.variance_test(_lines(spark, sf), "l_returnflag", "l_extendedprice", center="trimmed")


@query(
    "t15_bartlett",
    """WITH s AS (SELECT l_returnflag, count(*) - 1 AS f, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1)
    SELECT round((sum(f) * ln(sum(f * v) / sum(f)) - sum(f * ln(v))) / (1 + (sum(1.0 / f) - 1.0 / sum(f)) / (3 * (count(*) - 1))), 6) AS statistic FROM s""",
)
def t15_bartlett(spark, sf):
    return rounded(G.variance_test(_lines(spark, sf), "l_returnflag", "l_extendedprice", method="bartlett").select("statistic"))


@query("t15_fligner")
def t15_fligner(spark, sf):
    return G.variance_test(_lines(spark, sf), "l_returnflag", "l_extendedprice", method="fligner")


def _outliers(method: str, c: str) -> str:
    bounds = {
        "iqr": "quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lo, quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS hi FROM v",
        "zscore": "avg(x) - 1.5 * stddev_samp(x) AS lo, avg(x) + 1.5 * stddev_samp(x) AS hi FROM v",
        "modified_zscore": "med - 2 * mad / 0.6745 AS lo, med + 2 * mad / 0.6745 AS hi FROM (SELECT median(x) AS med, mad(x) AS mad FROM v)",
    }[method]
    return f"""SELECT * FROM (WITH v AS (SELECT {c} AS x FROM events), b AS (SELECT {bounds})
    SELECT '{c}' AS "column", count(*) AS n, round(max(lo), 6) AS lower_bound, round(max(hi), 6) AS upper_bound, count(*) FILTER (WHERE x < lo OR x > hi) AS n_outliers,
    count(*) FILTER (WHERE x < lo) AS n_below, count(*) FILTER (WHERE x > hi) AS n_above, min(x) FILTER (WHERE x < lo OR x > hi) AS min_outlier,
    max(x) FILTER (WHERE x < lo OR x > hi) AS max_outlier FROM v, b)"""


def _outlier_query(method: str, threshold: float | None):
    def run(spark, sf):
        out = S.outlier_summary(table(spark, sf, "events"), ["value"], method=method, threshold=threshold)
        return rounded(out.select("column", "n", "lower_bound", "upper_bound", "n_outliers", "n_below", "n_above", "min_outlier", "max_outlier"))

    return run


query("t16_outliers_iqr", _outliers("iqr", "value"))(_outlier_query("iqr", None))
query("t16_outliers_zscore", _outliers("zscore", "value"))(_outlier_query("zscore", 1.5))
query("t16_outliers_modified_zscore", _outliers("modified_zscore", "value"))(_outlier_query("modified_zscore", 2))


@query(
    "t17_outlier_flags",
    """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS value_outlier, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS any_outlier FROM events, b""",
)
def t17(spark, sf):
    return S.outlier_flags(table(spark, sf, "events"), ["value"]).select("event_id", "value_outlier", "any_outlier")


# ---------------------------------------------------------------- intervals


@query("t18_bootstrap_mean")
def t18(spark, sf):
    return B.bootstrap_ci(_lines(spark, sf), "l_extendedprice", "l_returnflag", "mean", n_resamples=999)


@query("t18_bootstrap_median")
def t18_median(spark, sf):
    return B.bootstrap_ci(_lines(spark, sf), "l_extendedprice", "l_returnflag", "median", n_resamples=999)


@query("t18_bootstrap_std_percentile")
def t18_std(spark, sf):
    return B.bootstrap_ci(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "std", n_resamples=999, method="percentile")


@query("t18_bootstrap_variation")
def t18_variation(spark, sf):
    return B.bootstrap_ci(_lines(spark, sf), "l_extendedprice", "l_returnflag", variation, n_resamples=999)


@query(
    "t18_mergeable_estimates",
    """WITH m AS (SELECT l_returnflag AS "group", l_extendedprice AS v, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
    SELECT "group", count(*) AS n, round(avg((v - m) * (v - m) * (v - m)) / pow(avg((v - m) * (v - m)), 1.5), 6) AS estimate, round(avg((v > 50000)::INT), 6) AS share FROM m GROUP BY 1""",
)
def t18_estimates(spark, sf):
    skew = B.bootstrap_ci(_lines(spark, sf), "l_extendedprice", "l_returnflag", skewness, n_resamples=99)
    above = B.bootstrap_ci(_lines(spark, sf), "l_extendedprice", "l_returnflag", share_above(50_000), n_resamples=99)
    return rounded(skew.select("group", "n", "estimate").join(above.select("group", F.col("estimate").alias("share")), "group"))


_Z = 1.959963984540054
_PROPORTION = "WITH g AS (SELECT l_suppkey AS k, count(*) FILTER (WHERE l_returnflag = 'R') AS s, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, s / n AS p FROM g) SELECT cast(k AS varchar) AS label, s AS successes, n, round(p, 6) AS proportion, {0} FROM p"
_WALD = f"round(greatest(0, p - {_Z} * sqrt(p * (1 - p) / n)), 6) AS ci_low, round(least(1, p + {_Z} * sqrt(p * (1 - p) / n)), 6) AS ci_high"
_WILSON = f"""round(greatest(0, (p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n)), 6) AS ci_low,
    round(least(1, (p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n)), 6) AS ci_high"""
_PT = f"((s + {_Z * _Z / 2}) / (n + {_Z * _Z}))"
_AGRESTI = f"""round(greatest(0, {_PT} - {_Z} * sqrt({_PT} * (1 - {_PT}) / (n + {_Z * _Z}))), 6) AS ci_low,
    round(least(1, {_PT} + {_Z} * sqrt({_PT} * (1 - {_PT}) / (n + {_Z * _Z}))), 6) AS ci_high"""


def _proportion(method: str):
    def run(spark, sf):
        g = _lines(spark, sf).groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("s"), F.count(F.lit(1)).alias("m"))
        return rounded(S.proportion_ci(g, "s", "m", method=method, label="l_suppkey").drop("method", "width"))

    return run


query("t19_proportion_wilson", _PROPORTION.format(_WILSON))(_proportion("wilson"))
query("t19_proportion_wald", _PROPORTION.format(_WALD))(_proportion("wald"))
query("t19_proportion_agresti_coull", _PROPORTION.format(_AGRESTI))(_proportion("agresti_coull"))
query("t19_proportion_clopper_pearson")(_proportion("clopper_pearson"))


# ---------------------------------------------------------------- two groups

_AB = """WITH s AS (SELECT count(*) FILTER (WHERE l_linestatus = 'F') AS na, count(*) FILTER (WHERE l_linestatus = 'O') AS nb,
    avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS ma, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS mb,
    var_samp(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS va, var_samp(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS vb,
    median(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS da, median(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS db FROM lineitem)"""
_G = "(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3 / (4.0 * (na + nb - 2) - 1))"
_HEAD = "'F vs O' AS comparison, na + nb AS n"


def _two(test: str, columns: tuple[str, ...] = ("comparison", "n", "statistic", "estimate", "effect_size"), **opts):
    def run(spark, sf):
        out = C.compare_groups(_lines(spark, sf), "l_linestatus", "l_extendedprice", test, **opts)
        return rounded(out.select(*columns), 4)

    return run


query("t20_welch", f"{_AB} SELECT {_HEAD}, round((ma - mb) / sqrt(va / na + vb / nb), 4) AS statistic, round(ma - mb, 4) AS estimate, round({_G}, 4) AS effect_size FROM s")(_two("welch"))
query(
    "t21_student",
    f"""{_AB} SELECT {_HEAD}, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 4) AS statistic,
    round(ma - mb, 4) AS estimate, round({_G}, 4) AS effect_size FROM s""",
)(_two("student"))

_U = """, r AS (SELECT l_linestatus, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r,
    rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0 AS w FROM lineitem),
    u AS (SELECT sum(r) FILTER (WHERE l_linestatus = 'F') - na * (na + 1) / 2 AS u FROM r, s GROUP BY na)"""
query(
    "t22_mannwhitney",
    f"{_AB}{_U} SELECT {_HEAD}, round(u::double, 4) AS statistic, round(da - db, 4) AS estimate, round(2 * u::double / (na::double * nb) - 1, 4) AS effect_size FROM s, u",
)(_two("mannwhitney"))
query(
    "t23_brunnermunzel",
    f"""{_AB}{_U}, b AS (SELECT avg(r) FILTER (WHERE l_linestatus = 'F') AS ra, avg(r) FILTER (WHERE l_linestatus = 'O') AS rb,
    var_samp(r - w) FILTER (WHERE l_linestatus = 'F') AS sa, var_samp(r - w) FILTER (WHERE l_linestatus = 'O') AS sb FROM r)
    SELECT {_HEAD}, round(na::double * nb * (rb - ra) / ((na + nb) * sqrt(na * sa + nb * sb)), 4) AS statistic, round(da - db, 4) AS estimate,
    round(2 * u::double / (na::double * nb) - 1, 4) AS effect_size FROM s, u, b""",
)(_two("brunnermunzel"))
query(
    "t24_kolmogorov_smirnov",
    f"""{_AB}, h AS (SELECT l_extendedprice AS v, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1),
    e AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM h)
    SELECT na + nb AS n, round(max(abs(ca / na - cb / nb)), 4) AS statistic FROM e, s GROUP BY na, nb""",
)(_two("ks", ("n", "statistic")))
query("t25_permutation")(_two("permutation", ("comparison", "n", "statistic", "p_value", "effect_size"), n_resamples=499))


# ---------------------------------------------------------------- many groups

_K = "WITH s AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS ssw FROM s)"


def _many(test: str):
    def run(spark, sf):
        out = C.compare_groups(_lines(spark, sf), "l_returnflag", "l_extendedprice", test)
        return rounded(out.select("comparison", "n_groups", "n", "statistic", "effect_size"))

    return run


_KHEAD = "'A | N | R' AS comparison, 3::bigint AS n_groups"
query(
    "t26_anova",
    f"""{_K}, b AS (SELECT sum(n * (m - gm) ** 2) AS ssb FROM s, t)
    SELECT {_KHEAD}, nn::bigint AS n, round(ssb / (k - 1) / (ssw / (nn - k)), 6) AS statistic, round(ssb / (ssb + ssw), 6) AS effect_size FROM t, b""",
)(_many("anova"))
query(
    "t27_welch_anova",
    f"""{_K}, b AS (SELECT sum(n * (m - gm) ** 2) AS ssb FROM s, t), w AS (SELECT g, n, m, n / v AS w FROM s), x AS (SELECT sum(w) AS ws, sum(w * m) / sum(w) AS wm FROM w),
    y AS (SELECT sum((1 - w / ws) ** 2 / (n - 1)) AS lam, sum(w * (m - wm) ** 2) AS num FROM w, x)
    SELECT {_KHEAD}, nn::bigint AS n, round(num / (k - 1) / (1 + 2.0 * (k - 2) / (k * k - 1) * lam), 6) AS statistic, round(ssb / (ssb + ssw), 6) AS effect_size FROM t, b, y""",
)(_many("welch_anova"))
query(
    "t28_kruskal",
    f"""{_K}, r AS (SELECT l_returnflag AS g, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0)::double AS r FROM lineitem),
    q AS (SELECT g, count(*) AS n, avg(r) AS m FROM r GROUP BY 1), c AS (SELECT sum(n::double ** 3 - n) AS ties FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_extendedprice)),
    h AS (SELECT 12 / (nn * (nn + 1)) * sum(q.n * (q.m - (nn + 1) / 2) ** 2) / (1 - max(ties) / (nn::double ** 3 - nn)) AS h, nn, k FROM q, t, c GROUP BY nn, k)
    SELECT {_KHEAD}, nn::bigint AS n, round(h, 6) AS statistic, round((h - k + 1) / (nn - k), 6) AS effect_size FROM h""",
)(_many("kruskal"))


@query(
    "t29_compare_groups",
    """SELECT o_orderstatus, n_groups, group_sizes, 'anova' AS test, flags FROM (SELECT o_orderstatus, count(*) AS n_groups, string_agg(o_orderpriority || '=' || n, '; ' ORDER BY o_orderpriority) AS group_sizes,
    'says that groups differ, not which: see pairwise_comparisons' AS flags
    FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)""",
)
def t29(spark, sf):
    out = C.compare_groups(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "anova", by=["o_orderstatus"])
    return out.select("o_orderstatus", "n_groups", "group_sizes", "test", "flags")


# ---------------------------------------------------------------- paired


def _pairs(spark, sf):
    return _lines(spark, sf).select("l_quantity", (F.col("l_discount") * 1000 / 3).alias("rate"))


def _paired(test: str, columns: tuple[str, ...], **opts):
    def run(spark, sf):
        return rounded(C.compare_paired(_pairs(spark, sf), "l_quantity", "rate", test, **opts).select(*columns))

    return run


_D = "WITH d AS (SELECT l_quantity - l_discount * 1000 / 3 AS d FROM lineitem)"
query(
    "t30_paired_t",
    f"""{_D} SELECT count(*) AS n_pairs, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS statistic, round(avg(d), 6) AS estimate,
    round(avg(d) / stddev_samp(d) * (1 - 3 / (4.0 * (count(*) - 1) - 1)), 6) AS effect_size FROM d""",
)(_paired("ttest", ("n_pairs", "statistic", "estimate", "effect_size")))
query(
    "t30_wilcoxon",
    f"""{_D}, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
    t AS (SELECT sum(r) FILTER (WHERE d > 0)::double AS p, sum(r) FILTER (WHERE d < 0)::double AS m FROM r)
    SELECT (SELECT count(*) FROM d) AS n_pairs, round(least(p, m), 6) AS statistic, (SELECT round(median(d), 6) FROM d) AS estimate, round((p - m) / (p + m), 6) AS effect_size FROM t""",
)(_paired("wilcoxon", ("n_pairs", "statistic", "estimate", "effect_size")))
query(
    "t30_sign",
    f"""{_D} SELECT count(*) AS n_pairs, (count(*) FILTER (WHERE d > 0))::double AS statistic, round(median(d), 6) AS estimate,
    round(2.0::double * count(*) FILTER (WHERE d > 0) / count(*) FILTER (WHERE d <> 0) - 1, 6) AS effect_size FROM d""",
)(_paired("sign", ("n_pairs", "statistic", "estimate", "effect_size")))
query("t30_paired_permutation")(_paired("permutation", ("n_pairs", "statistic", "p_value", "effect_size"), n_resamples=999))


# ---------------------------------------------------------------- pairs of groups


@query(
    "t31_pairwise_mannwhitney",
    """WITH h AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders), p AS (SELECT DISTINCT a.g AS ga, b.g AS gb FROM h a, h b WHERE a.g < b.g),
    l AS (SELECT ga, gb, g, v FROM p JOIN h ON g = ga OR g = gb),
    r AS (SELECT *, rank() OVER (PARTITION BY ga, gb ORDER BY v) + (count(*) OVER (PARTITION BY ga, gb, v) - 1) / 2.0 AS r FROM l),
    s AS (SELECT ga, gb, count(*) FILTER (WHERE g = ga) AS na, count(*) FILTER (WHERE g = gb) AS nb, sum(r) FILTER (WHERE g = ga) AS ra,
    median(v) FILTER (WHERE g = ga) AS da, median(v) FILTER (WHERE g = gb) AS db FROM r GROUP BY 1, 2)
    SELECT ga AS group_a, gb AS group_b, na AS n_a, nb AS n_b, round(da, 4) AS median_a, round(db, 4) AS median_b, round((ra - na * (na + 1) / 2)::double, 4) AS statistic,
    round(2 * (ra - na * (na + 1) / 2)::double / (na * nb) - 1, 4) AS effect_size, 10::bigint AS n_comparisons FROM s""",
)
def t31(spark, sf):
    out = C.pairwise_comparisons(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "mannwhitney")
    return rounded(out.select("group_a", "group_b", "n_a", "n_b", "median_a", "median_b", "statistic", "effect_size", "n_comparisons"), 4)


@query(
    "t31_pairwise_reference",
    """WITH s AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT a.g AS group_a, b.g AS group_b, round(a.m, 4) AS mean_a, round(b.m, 4) AS mean_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS statistic,
    4::bigint AS n_comparisons FROM s a JOIN s b ON b.g <> a.g WHERE a.g = '5-LOW'""",
)
def t31_reference(spark, sf):
    out = C.pairwise_comparisons(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "welch", ref_group="5-LOW")
    return rounded(out.select("group_a", "group_b", "mean_a", "mean_b", "statistic", "n_comparisons"), 4)


_P = "WITH p AS (SELECT l_suppkey AS k, 1 / (1 + sum(l_quantity) / 500) AS p FROM lineitem GROUP BY 1), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM p)"
_ADJUST = {
    "holm": "max(p * (n - i + 1)) OVER (ORDER BY i)",
    "bonferroni": "p * n",
    "fdr_bh": "min(p * n / i) OVER (ORDER BY i DESC)",
    "fdr_by": "min(p * n / i * (SELECT sum(1.0::double / j) FROM range(1, (SELECT count(*) + 1 FROM p)) t(j))) OVER (ORDER BY i DESC)",
    "none": "p",
}


def _adjusted(method: str):
    def run(spark, sf):
        p = _lines(spark, sf).groupBy(F.col("l_suppkey").alias("k")).agg((1 / (1 + F.sum("l_quantity") / 500)).alias("p"))
        return rounded(C.p_adjust(p, "p", method), 8)

    return run


for _method, _sql in _ADJUST.items():
    query(f"t32_p_adjust_{_method}", f"{_P} SELECT k, round(p, 8) AS p, round(least(1, {_sql}), 8) AS p_adj FROM r")(_adjusted(_method))


# ---------------------------------------------------------------- categorical


def _table_sql(t: str, a: str, b: str) -> str:
    return f"""WITH n AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
    ra AS (SELECT a, sum(o) AS r FROM n GROUP BY 1), cb AS (SELECT b, sum(o) AS c FROM n GROUP BY 1), tt AS (SELECT sum(o) AS t FROM n),
    g AS (SELECT ra.a, cb.b, coalesce(o, 0) AS o, r, c, t, r * c / t::double AS e FROM ra CROSS JOIN cb CROSS JOIN tt LEFT JOIN n ON n.a = ra.a AND n.b = cb.b),
    x AS (SELECT count(DISTINCT a) AS nr, count(DISTINCT b) AS nc, max(t) AS t, sum((o - e) ** 2 / e) AS chi2, sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) AS yates,
    min(e) AS mine, 100.0 * count(*) FILTER (WHERE e < 5) / count(*) AS below FROM g)"""


_VB = "sqrt(greatest(0, chi2 / t - (nr - 1) * (nc - 1) / (t - 1)) / (least(nr - (nr - 1) ** 2 / (t - 1), nc - (nc - 1) ** 2 / (t - 1)) - 1))"


@query(
    "t33_chi_square",
    f"""{_table_sql('documents', 'lang', 'source')} SELECT 'lang × source' AS variables, nr || '×' || nc AS shape, t::bigint AS n, ((nr - 1) * (nc - 1))::bigint AS dof, round(chi2, 6) AS statistic,
    round({_VB}, 6) AS effect_size, round(mine, 6) AS min_expected, round(below::double, 1) AS pct_cells_below_min FROM x""",
)
def t33(spark, sf):
    out = K.association_test(table(spark, sf, "documents"), "lang", "source")
    return rounded(out.select("variables", "shape", "n", "dof", "statistic", "effect_size", "min_expected", "pct_cells_below_min"))


@query(
    "t33_yates",
    f"""{_table_sql('labels', 'quality', 'toxic')}, d AS (SELECT max(o) FILTER (WHERE a = 0 AND b = 0)::double * max(o) FILTER (WHERE a = 1 AND b = 1)
    / (max(o) FILTER (WHERE a = 0 AND b = 1) * max(o) FILTER (WHERE a = 1 AND b = 0)) AS odds FROM g)
    SELECT CASE WHEN below > 20 OR mine < 1 THEN 'fisher_exact' ELSE 'chi_square' END AS test, t::bigint AS n,
    round(CASE WHEN below > 20 OR mine < 1 THEN odds ELSE yates END, 6) AS statistic, round(chi2, 6) AS chi2_uncorrected, round(odds, 6) AS odds_ratio FROM x, d""",
)
def t33_yates(spark, sf):
    out = K.association_test(table(spark, sf, "labels"), "quality", "toxic")
    return rounded(out.select("test", "n", "statistic", "chi2_uncorrected", "odds_ratio"))


@query(
    "t33_fisher",
    """WITH d AS (SELECT n_chars > 100000 AS a, quality = 1 AS b FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT count(*) FILTER (WHERE NOT a AND NOT b)::double AS n11, count(*) FILTER (WHERE NOT a AND b)::double AS n12, count(*) FILTER (WHERE a AND NOT b)::double AS n21, count(*) FILTER (WHERE a AND b)::double AS n22 FROM d)
    SELECT (n11 + n12 + n21 + n22)::bigint AS n, round(n11 * n22 / (n12 * n21), 6) AS odds_ratio FROM k""",
)
def t33_fisher(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 100000).alias("long"))
    df = docs.join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    return rounded(K.association_test(df, "long", "good").select("n", "odds_ratio"))


@query(
    "t33_many_levels",
    """WITH o AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(o) AS r FROM o GROUP BY 1), c AS (SELECT b, sum(o) AS c FROM o GROUP BY 1),
    t AS (SELECT sum(o)::double AS t FROM o), rn AS (SELECT r, count(*) AS m FROM r GROUP BY 1), cn AS (SELECT c, count(*) AS k FROM c GROUP BY 1),
    s AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM c) AS nc, (SELECT sum(m * k) FROM rn, cn, t WHERE r * c / t < 5) AS below, (SELECT t * (sum(o * o / (r::double * c)) - 1) FROM o JOIN r USING (a) JOIN c USING (b), t GROUP BY t) AS chi2)
    SELECT t::bigint AS n, ((nr - 1) * (nc - 1))::bigint AS dof, round(chi2, 4) AS statistic, round((SELECT min(r) FROM r) * (SELECT min(c) FROM c) / t, 6) AS min_expected, round(100.0 * below / (nr * nc), 1)::double AS pct_cells_below_min,
    round(sqrt(chi2 / t / (least(nr, nc) - 1)), 6) AS effect_size FROM s, t""",
)
def t33_many_levels(spark, sf):
    out = K.association_test(_lines(spark, sf), "l_partkey", "l_suppkey", bias_correction=False)
    return rounded(out.select("n", "dof", F.round("statistic", 4).alias("statistic"), "min_expected", "pct_cells_below_min", "effect_size"))


@query(
    "t34_residuals_observed_cells",
    """WITH o AS (SELECT l_partkey AS row, l_suppkey AS col, count(*) AS observed FROM lineitem GROUP BY 1, 2)
    SELECT row, col, observed, round(e, 6) AS expected, round((observed - e) / sqrt(e), 6) AS residual FROM (SELECT *, sum(observed) OVER (PARTITION BY row) * sum(observed) OVER (PARTITION BY col) / sum(observed) OVER ()::double AS e FROM o)""",
)
def t34_observed_cells(spark, sf):
    return rounded(K.contingency_residuals(_lines(spark, sf), "l_partkey", "l_suppkey", "standardized", zeros=False).drop("kind"))


def _residual_sql(expr: str, kind: str) -> str:
    return f"{_table_sql('documents', 'lang', 'source')} SELECT a AS row, b AS col, o::bigint AS observed, round(e, 6) AS expected, round({expr}, 6) AS residual, '{kind}' AS kind FROM g, x"


def _residuals(kind: str):
    def run(spark, sf):
        return rounded(K.contingency_residuals(table(spark, sf, "documents"), "lang", "source", kind))

    return run


query("t34_residuals_adjusted", _residual_sql("(o - e) / sqrt(e) / sqrt((1 - r / g.t) * (1 - c / g.t))", "adjusted"))(_residuals("adjusted"))
query("t34_residuals_standardized", _residual_sql("(o - e) / sqrt(e)", "standardized"))(_residuals("standardized"))
query("t34_residuals_contribution", _residual_sql("100 * (o - e) ** 2 / e / chi2", "contribution"))(_residuals("contribution"))


# ---------------------------------------------------------------- correlation

_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_CPAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(
    "t35_pearson",
    " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _CPAIRS),
)
def t35(spark, sf):
    return rounded(R.correlation_test(_lines(spark, sf), _COLS).select("x", "y", "n", "r"))


def _ranked(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::double"


@query(
    "t36_spearman",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr(ra, rb), 6) AS r FROM (SELECT {_ranked(a)} AS ra, {_ranked(b)} AS rb FROM lineitem)" for a, b in _CPAIRS
    ),
)
def t36(spark, sf):
    return rounded(R.correlation_test(_lines(spark, sf), _COLS, method="spearman").select("x", "y", "n", "r"))


# Over the 50 × 11 distinct (quantity, discount) pairs the quadratic definition stays small.
@query(
    "t37_kendall",
    """WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*)::double AS n FROM lineitem GROUP BY 1, 2),
    s AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS t FROM c),
    tx AS (SELECT sum(n * (n - 1) / 2) AS tx FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS ty FROM (SELECT sum(n) AS n FROM c GROUP BY y))
    SELECT 'l_quantity' AS x, 'l_discount' AS y, (SELECT count(*) FROM lineitem) AS n, round(s / sqrt((t - tx) * (t - ty)), 6) AS r FROM s, t, tx, ty""",
)
def t37(spark, sf):
    return rounded(R.correlation_test(_lines(spark, sf), pairs=[("l_quantity", "l_discount")], method="kendall").select("x", "y", "n", "r"))


@query(
    "t38_partial_pearson",
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz, count(*) AS n FROM lineitem)
    SELECT n, round(xy, 6) AS r_zero_order, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c""",
)
def t38(spark, sf):
    return rounded(R.partial_correlation(_lines(spark, sf), "l_quantity", "l_extendedprice", "l_discount").select("n", "r_zero_order", "r"))


@query(
    "t38_partial_spearman",
    f"""WITH k AS (SELECT {_ranked('l_quantity')} AS x, {_ranked('l_extendedprice')} AS y, {_ranked('l_discount')} AS z FROM lineitem),
    c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n FROM k)
    SELECT n, round(xy, 6) AS r_zero_order, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c""",
)
def t38_spearman(spark, sf):
    return rounded(R.partial_correlation(_lines(spark, sf), "l_quantity", "l_extendedprice", "l_discount", "spearman").select("n", "r_zero_order", "r"))


@query(
    "t38_partial_many_levels",
    """WITH d AS (SELECT l_quantity - avg(l_quantity) OVER k AS x, l_extendedprice - avg(l_extendedprice) OVER k AS y FROM lineitem WINDOW k AS (PARTITION BY l_orderkey))
    SELECT count(*) AS n, (SELECT count(DISTINCT l_orderkey) - 1 FROM lineitem)::int AS n_covar_terms, round(corr(x, y), 6) AS r, (SELECT round(corr(l_quantity, l_extendedprice), 6) FROM lineitem) AS r_zero_order FROM d""",
)
def t38_many_levels(spark, sf):
    lines = _lines(spark, sf).withColumn("order", F.concat(F.lit("order "), "l_orderkey"))
    return rounded(R.partial_correlation(lines, "l_quantity", "l_extendedprice", "order").select("n", "n_covar_terms", "r", "r_zero_order"))


@query("t38_partial_two_factors")
def t38_two_factors(spark, sf):
    lines = _lines(spark, sf).select("l_quantity", "l_extendedprice", "l_discount", F.concat(F.lit("s"), "l_suppkey").alias("supplier"), "l_returnflag")
    return R.partial_correlation(lines, "l_quantity", "l_extendedprice", ["l_discount", "supplier", "l_returnflag"])


@query("t38_partial_categorical")
def t38_categorical(spark, sf):
    return R.partial_correlation(_lines(spark, sf), "l_quantity", "l_extendedprice", ["l_discount", "l_returnflag"])


# ---------------------------------------------------------------- effect sizes


@query(
    "t39_cohens_d",
    "SELECT round((avg(l_discount) - avg(l_tax)) / sqrt((var_samp(l_discount) + var_samp(l_tax)) / 2) * (1 - 3 / (4.0 * (2 * count(*) - 2) - 1)), 6) AS cohens_d FROM lineitem",
)
def t39(spark, sf):
    return rounded(C.cohens_d(_lines(spark, sf), "l_discount", "l_tax"))


@query(
    "t39_cohens_dz",
    "SELECT round(avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax), 6) AS cohens_d FROM lineitem",
)
def t39_paired(spark, sf):
    return rounded(C.cohens_d(_lines(spark, sf), "l_discount", "l_tax", paired=True, hedges=False))


@query(
    "t40_cliffs_delta",
    """WITH h AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT l_discount AS v, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT l_tax, 0, 1 FROM lineitem) GROUP BY 1)
    SELECT round(sum(x.a::double * y.b * sign(x.v - y.v)) / ((SELECT count(*) FROM lineitem)::double ** 2), 6) AS cliffs_delta FROM h x, h y""",
)
def t40(spark, sf):
    return rounded(C.cliffs_delta(_lines(spark, sf), "l_discount", "l_tax"))


@query("t41_cramers_v", f"{_table_sql('documents', 'lang', 'source')} SELECT round({_VB}, 6) AS cramers_v FROM x")
def t41(spark, sf):
    return rounded(K.cramers_v(table(spark, sf, "documents"), "lang", "source"))


@query("t41_cramers_v_plain", f"{_table_sql('documents', 'lang', 'source')} SELECT round(sqrt(chi2 / t / (least(nr, nc) - 1)), 6) AS cramers_v FROM x")
def t41_plain(spark, sf):
    return rounded(K.cramers_v(table(spark, sf, "documents"), "lang", "source", bias_correction=False))


@query("t42_mean_difference_interval")
def t42(spark, sf):
    out = C.compare_groups(_lines(spark, sf), "l_linestatus", "l_extendedprice", "welch", ci="bootstrap", n_resamples=999)
    return out.select("comparison", "n", "estimate", "ci_low", "ci_high")


@query("t42_median_difference_interval")
def t42_median(spark, sf):
    out = C.compare_groups(_lines(spark, sf), "l_linestatus", "l_extendedprice", "mannwhitney", ci="bootstrap", n_resamples=999)
    return out.select("comparison", "n", "estimate", "ci_low", "ci_high")
