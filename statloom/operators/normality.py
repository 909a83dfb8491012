"""Normality tests of columns and of group samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.labels import KEEP, REJECT, decision, join_flags, say
from statloom.functions.numeric import melt, numeric_columns
from statloom.operators.ranks import attach, cumulate, histogram, settle
from statloom.operators.resample import fixed_size_sample

# Fixed value: most observations the Shapiro-Wilk approximation is defined for.
SHAPIRO_MAX_N = 5000


def skew_kurtosis(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis from the population ones."""
    n = n.cast("double")
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return skew, kurt


def shapiro_by(rows: DataFrame, value: str, keys: list[str], max_n: int, seed: int) -> DataFrame:
    """(keys…, n_used, statistic, p_value): Shapiro-Wilk on at most ``max_n`` values per key."""
    ranked = settle(cumulate(histogram(rows, value, keys).withColumnRenamed(value, "value"), "value", by=keys))
    drawn = fixed_size_sample(ranked, max_n, seed, keys)
    types = {f.name: f.dataType.simpleString() for f in drawn.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["n_used long, statistic double, p_value double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.repeat(pdf["value"].to_numpy(float), pdf["k"].to_numpy(int))
        w, p = dist.shapiro(x)
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([row | {"n_used": len(x), "statistic": w, "p_value": p}])

    out = drawn.groupBy(*keys).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("statistic", "p_value")})


def count_normal(rows: DataFrame, keys: list[str], alpha: float, seed: int) -> int:
    """How many keys pass the Shapiro-Wilk screen (untestable ones do not)."""
    tested = shapiro_by(rows, "value", keys, SHAPIRO_MAX_N, seed)
    return tested.agg(F.count_if(F.col("p_value") > alpha)).first()[0]


def _dagostino(n: Column, g1: Column, g2: Column) -> Column:
    """D'Agostino-Pearson K² from the population skewness and excess kurtosis."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    a = F.sqrt(2 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    z1 = F.log(y / a + F.sqrt((y / a) ** 2 + 1)) / F.sqrt(0.5 * F.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    sqb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    s = 6 + 8 / sqb * (2 / sqb + F.sqrt(1 + 4 / (sqb * sqb)))
    d = 1 + x * F.sqrt(2 / (s - 4))
    root = F.signum(d) * F.when(d != 0, F.pow((1 - 2 / s) / F.abs(d), F.lit(1 / 3)))
    z2 = (1 - 2 / (9 * s) - root) / F.sqrt(2 / (9 * s))
    return z1 * z1 + z2 * z2


def _anderson(long: DataFrame, moments: DataFrame) -> DataFrame:
    """(column, statistic): Anderson-Darling A² of the standardised values.

    Ties take consecutive order numbers, so a value with t copies after b smaller ones
    contributes its log terms with the summed weights Σ(2i-1) over i = b+1 … b+t.
    """
    ranked = cumulate(histogram(long, "value", ["column"]), "value", by=["column"])
    rows = attach(ranked, settle(moments.select("column", "mean", "std")), ["column"])
    z = (F.col("value") - F.col("mean")) / F.col("std")
    phi, upper = dist.normal_cdf(z), dist.normal_tail(z)
    b, t, n = (F.col(c).cast("double") for c in ("n_below", "n_tied", "n_total"))
    w_low = (b + t) ** 2 - b**2
    w_up = (n - b) ** 2 - (n - b - t) ** 2
    return rows.groupBy("column").agg(
        (-F.max("n_total") - F.sum(w_low * F.log(phi) + w_up * F.log(upper)) / F.max("n_total")).alias("statistic")
    )


def normality_test(
    df: DataFrame,
    cols: list[str] | None = None,
    ignore_cols: list[str] | None = None,
    method: str = "shapiro",
    alpha: float = 0.05,
    max_n: int = SHAPIRO_MAX_N,
    random_state: int = 0,
) -> DataFrame:
    """Is each numeric column consistent with a normal distribution? One row per column."""
    if method not in ("shapiro", "dagostino", "jarque_bera", "anderson"):
        raise ValueError(f"unknown method '{method}'")
    columns = numeric_columns(df, cols, ignore_cols)
    long = melt(df, columns)
    m = long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.skewness("value").alias("g1"),
        F.kurtosis("value").alias("g2"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    n = F.col("n")
    flat = F.col("lo") == F.col("hi")
    usable = (n >= 3) & ~flat
    critical = F.lit(None).cast("double")
    notes: list[Column] = [
        say(n < 3, "fewer than 3 values: no test"),
        say((n >= 3) & flat, "all values are equal: no test"),
    ]
    if method == "shapiro":
        out = m.join(shapiro_by(long, "value", ["column"], max_n, random_state), "column", "left")
        out = out.withColumn("n_used", F.coalesce(F.when(usable, F.col("n_used")), n))
        notes.append(say(F.col("n_used") < n, f"tested on {max_n} sampled values, seed {random_state}"))
        stat, p = F.col("statistic"), F.col("p_value")
    elif method == "dagostino":
        out = m.withColumn("statistic", F.when(n >= 8, _dagostino(n, F.col("g1"), F.col("g2"))))
        stat, p = F.col("statistic"), dist.chi2_tail(F.col("statistic"), F.lit(2))
        notes += [say(usable & (n < 8), "fewer than 8 values: no D'Agostino test")]
        notes += [say(usable & (n >= 8) & (n < 20), "fewer than 20 values: p is rough")]
    elif method == "jarque_bera":
        out = m.withColumn("statistic", n / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4))
        stat, p = F.col("statistic"), dist.chi2_tail(F.col("statistic"), F.lit(2))
        notes.append(say(usable & (n < 2000), "fewer than 2000 values: the chi-square law of Jarque-Bera is rough"))
    else:
        out = m.join(_anderson(long, m.filter("std > 0")), "column", "left")
        stat, p = F.col("statistic"), dist.column_function(dist.anderson_p)(F.col("statistic"), n)
        critical = dist.column_function(dist.anderson_critical)(n, F.lit(alpha))
    if "n_used" not in out.columns:
        out = out.withColumn("n_used", n)
    out = out.withColumns({"statistic": F.when(usable, stat), "p_value": F.when(usable, p)})
    out = out.withColumn("critical_value", F.when(usable, critical))
    verdict = (
        F.when(F.col("p_value").isNotNull(), decision(F.col("p_value"), alpha))
        .when(F.col("statistic") > F.col("critical_value"), REJECT)
        .when(F.col("statistic").isNotNull() & F.col("critical_value").isNotNull(), KEEP)
        .otherwise("")
    )
    notes += [
        say(n > 5000, "many values: even harmless deviations are found"),
        say((n > 0) & (n < 20), "few values: only gross deviations are found"),
    ]
    skew, kurt = skew_kurtosis(n, F.col("g1"), F.col("g2"))
    return out.select(
        "column",
        F.lit(method).alias("method"),
        "n",
        "n_used",
        "statistic",
        "p_value",
        "critical_value",
        verdict.alias("decision"),
        F.when(~flat, skew).alias("skew"),
        F.when(~flat, kurt).alias("excess_kurtosis"),
        join_flags(*notes).alias("flags"),
    )
