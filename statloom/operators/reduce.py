"""Chart-ready reductions: everything a chart needs computed as a small result frame."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions import dist
from statloom.functions.calendar import frequency
from statloom.functions.numeric import correlation, finite, melt, numeric_columns
from statloom.operators import resample
from statloom.operators.ranks import attach, cumulate, histogram, quantile_at, settle
from statloom.operators.resample import _attach_row


def _numbers(df: DataFrame, cols: list[str] | None) -> list[str]:
    return numeric_columns(df, cols)


def column_kinds(df: DataFrame, threshold: int = 10, ignore_cols: list[str] | None = None) -> DataFrame:
    """numerical = a number with at least ``threshold`` distinct values; everything else categorical."""
    cols = [c for c in df.columns if c not in (ignore_cols or [])]
    kinds = {f.name: f.dataType for f in df.schema}
    # One row per distinct value instead of a count-distinct per column, which would expand the rows.
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    counts = text.dropna().groupBy("column", "value").count().groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    listed = df.sparkSession.createDataFrame(
        [(c, isinstance(kinds[c], T.NumericType), i) for i, c in enumerate(cols)], "column string, is_number boolean, pos int"
    )
    out = listed.join(counts, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    kind = F.when(F.col("is_number") & (F.col("n_unique") >= threshold), "numerical").otherwise("categorical")
    return out.select("column", "n_unique", kind.alias("kind"), "pos")


def _bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed on the right."""
    width = (hi - lo) / bins
    raw = F.floor((v - lo) / F.when(width > 0, width))
    return F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram_bins(df: DataFrame, cols: list[str] | None = None, bins: int = 20, density: bool = False) -> DataFrame:
    """(column, bin, lower, upper, n[, density]) of every numeric column; empty bins are kept."""
    columns = _numbers(df, cols)
    long = melt(df, columns).dropna()
    ends = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("total"))
    # One row per column name.
    counted = (
        long.join(F.broadcast(ends), "column")
        .withColumn("bin", _bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    out = grid.join(counted, ["column", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.select(
        "column", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), "n", "total",
    )
    if density:
        step = F.col("upper") - F.col("lower")
        out = out.withColumn("density", F.col("n") / (F.col("total") * F.when(step > 0, step)))
    return out.drop("total")


def mean_median_lines(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The mean and median markers of a histogram panel."""
    long = melt(df, _numbers(df, cols)).dropna()
    ranked = cumulate(histogram(long, "value", ["column"]), "value", by=["column"])
    n = F.col("n")
    return ranked.groupBy("column").agg(
        (F.sum(n * F.col("value")) / F.sum(n)).alias("mean"), quantile_at(0.5, "value").alias("median")
    )


#: Bins of the density estimate per bandwidth, terms of its series, and bandwidths that a bin reaches.
_KDE_BINS, _KDE_TERMS, _KDE_REACH = 2, 13, 9


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients, by power, of the first polynomials with He(k+1) = t He(k) - k He(k-1)."""
    rows = [[1], [0, 1]]
    for k in range(1, terms - 1):
        up, down = [0, *rows[k]], [*rows[k - 1], 0, 0]
        rows.append([a - k * b for a, b in zip(up, down)])
    return rows[:terms]


def kde_curve(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on a grid, Scott bandwidth; empty below 5 distinct values or without spread.

    One estimator at every size: values fall into bins of half a bandwidth, each of which keeps the
    sums of powers of their offsets. A bin's kernels are a series in these (Hermite polynomials),
    whose remainder after 13 terms is below 1e-12 of the kernel's height; a bin reaches the points
    within nine bandwidths, beyond which a kernel is below 1e-17 of its height.
    """
    rows = settle(histogram(df, value).withColumnRenamed(value, "value"))
    n, v = F.col("n"), F.col("value")
    base = rows.agg(
        F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.count(F.lit(1)).alias("d"), (F.sum(n * v) / F.sum("n")).alias("m"),
    )
    rows = _attach_row(rows, base)
    var = rows.agg((F.sum(n * (v - F.col("m")) ** 2) / (F.max("total") - 1)).alias("var"))
    rows = _attach_row(rows, var).filter((F.col("d") >= 5) & (F.col("var") > 0))
    h = F.sqrt("var") * F.pow("total", F.lit(-0.2))
    rows = rows.withColumn("h", h).withColumn("bin", F.floor((v - F.col("lo")) / F.col("h") * _KDE_BINS))
    rows = rows.withColumn("s", (v - F.col("lo")) / F.col("h") - (F.col("bin") + 0.5) / _KDE_BINS)
    shape = ["total", "lo", "hi", "h"]
    sums = rows.groupBy("bin", *shape).agg(*[(F.sum(n * F.pow("s", F.lit(k))) / math.factorial(k)).alias(f"m{k}") for k in range(_KDE_TERMS)])
    polynomials = _hermite(_KDE_TERMS)
    for j in range(_KDE_TERMS):
        sums = sums.withColumn(f"c{j}", sum(F.col(f"m{k}") * F.lit(float(p[j])) for k, p in enumerate(polynomials) if j < len(p) and p[j]))
    centre = (F.col("bin") + 0.5) / _KDE_BINS  # from the smallest value, in bandwidths
    step = (F.col("hi") - F.col("lo")) / (points - 1) / F.col("h")
    first = F.greatest(F.ceil((centre - _KDE_REACH) / step), F.lit(0))
    last = F.least(F.floor((centre + _KDE_REACH) / step), F.lit(points - 1))
    # A bin meets at most all points, and only bins with values exist: at most some 7,000 rows in all.
    met = sums.filter(first <= last).withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    t = F.col("point") * step - centre
    met = met.withColumn("t", t)
    series = reduce(lambda total, j: total * F.col("t") + F.col(f"c{j}"), range(_KDE_TERMS - 2, -1, -1), F.col(f"c{_KDE_TERMS - 1}"))
    found = met.groupBy("point").agg((F.sum(series * F.exp(-0.5 * F.col("t") * F.col("t"))) / F.first(F.col("total") * F.col("h") * 2.5066282746310002)).alias("density"))
    ends = sums.agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo is not null")
    grid = ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    return grid.join(found, "point", "left").select("point", x.alias("x"), F.greatest(F.coalesce("density", F.lit(0.0)), F.lit(0.0)).alias("density"))


def top_categories(df: DataFrame, col: str, top_n: int = 10, other: str = "Other") -> DataFrame:
    """(category, n, pct): the most frequent categories, the tail folded into one row."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    levels = counts.agg(F.count(F.lit(1))).scalar()
    top = counts.orderBy(F.col("n").desc(), "category").limit(top_n)
    rest = top.agg(F.sum("n").alias("kept")).select(
        F.lit(other).alias("category"), (total - F.col("kept")).alias("n"), (levels > top_n).alias("folded")
    )
    out = top.withColumn("folded", F.lit(True)).unionByName(rest).filter("folded")
    return out.select("category", "n", F.round(F.col("n") / total * 100, 2).alias("pct")).orderBy(F.col("n").desc(), "category")


def box_stats(df: DataFrame, value: str, group: str | None = None, whis: float = 1.5) -> DataFrame:
    """Tukey box per group: quartiles, mean, whiskers on data points, outliers beyond them."""
    rows = df.select(*([F.col(group).alias("group")] if group else [F.lit("all").alias("group")]), finite(value).alias("value"))
    rows = rows.filter(F.col("value").isNotNull() & F.col("group").isNotNull())
    ranked = settle(cumulate(histogram(rows, "value", ["group"]), "value", by=["group"]))
    n, v = F.col("n"), F.col("value")
    q = ranked.groupBy("group").agg(
        F.sum("n").alias("n_rows"), (F.sum(n * v) / F.sum("n")).alias("mean"),
        quantile_at(0.25, "value").alias("q1"), quantile_at(0.5, "value").alias("median"), quantile_at(0.75, "value").alias("q3"),
    )
    reach = whis * (F.col("q3") - F.col("q1"))
    joined = attach(ranked.select("group", "value", "n"), settle(q), ["group"])
    low, high = v >= F.col("q1") - reach, v <= F.col("q3") + reach
    out = joined.groupBy("group").agg(
        F.first("n_rows").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("mean").alias("mean"), F.min(F.when(low, v)).alias("whisker_low"), F.max(F.when(high, v)).alias("whisker_high"),
        F.sum(F.when(low & high, 0).otherwise(n)).alias("n_outliers"),
    )
    return out.withColumn("pct_outliers", F.col("n_outliers") / F.col("n") * 100)


def ecdf(df: DataFrame, value: str, group: str | None = None, top_groups: int | None = None) -> DataFrame:
    """(group, value, n, cum, ecdf): one step per distinct value; ``top_groups`` asks for the largest groups only."""
    rows = df.select((F.col(group) if group else F.lit("all")).cast("string").alias("group"), finite(value).alias("value"))
    if group:
        rows = rows.filter(F.col("group").isNotNull())
    if group and top_groups is not None:
        sizes = rows.groupBy("group").count()
        largest = sizes.orderBy(F.col("count").desc(), "group").limit(top_groups).select("group")
        rows = rows.join(F.broadcast(largest), "group", "left_semi")
    ranked = cumulate(histogram(rows, "value", ["group"]), "value", by=["group"])
    cum = F.col("n_below") + F.col("n")
    return ranked.select("group", "value", "n", cum.alias("cum"), (cum / F.col("n_total")).alias("ecdf"))


def marked_quantiles(df: DataFrame, value: str, probs: list[float], group: str | None = None) -> DataFrame:
    """(group, p, value): the quantiles marked on an ECDF."""
    rows = df.select((F.col(group) if group else F.lit("all")).cast("string").alias("group"), finite(value).alias("value"))
    ranked = cumulate(histogram(rows.dropna(subset=["group"]), "value", ["group"]), "value", by=["group"])
    aggs = [quantile_at(p, "value").alias(f"q{i}") for i, p in enumerate(probs)]
    wide = ranked.groupBy("group").agg(*aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("value")) for i, p in enumerate(probs)]))
    return wide.select("group", pairs.alias("q")).select("group", "q.p", "q.value")


def _filliben(i: Column, n: Column) -> Column:
    end = F.pow(F.lit(0.5), 1 / n)
    return F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))


def qq_points(df: DataFrame, value: str) -> DataFrame:
    """(place, theoretical, sample): every observation against its normal order-statistic median."""
    ranked = cumulate(histogram(df, value).withColumnRenamed(value, "sample"), "sample")
    # A hot value stands for many points: it is split into runs of 10,000, which are spread
    # over the tasks before the points themselves are written out.
    run = 10_000
    last = F.col("n") - 1
    rows = ranked.withColumn("far", F.explode(F.sequence(F.lit(0), (last / (run * run)).cast("long"))))
    left = last - F.col("far") * run * run
    rows = rows.withColumn("near", F.explode(F.sequence(F.lit(0), F.least((left / run).cast("long"), F.lit(run - 1)))))
    rows = rows.repartition("sample", "far", "near")
    start = (F.col("far") * run + F.col("near")) * run
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.least(last - start, F.lit(run - 1)))))
    rows = rows.withColumn("place", F.col("n_below") + start + F.col("step") + 1)
    p = _filliben(F.col("place").cast("double"), F.col("n_total").cast("double"))
    return rows.select("place", dist.normal_quantile(p).alias("theoretical"), "sample")


#: Points at each end of a run of equal values whose scores are summed one by one.
_RUN_ENDS = 64


def run_scores(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the normal scores, and of their squares, of the places from ``first`` to ``last`` of n.

    Longer runs are summed at both ends; between, the sum is the integral of the normal quantile
    (closed: its antiderivative is minus the density) with the first two corrections of Euler and
    Maclaurin. What is left out is below 1e-8 for the sum and 1e-7 for the squares, as the ends lie
    64 places inside the run.
    """
    def score(i, n):
        end = 0.5 ** (1 / n)
        return dist.norm_ppf_array(np.where(i == n, end, np.where(i == 1, 1 - end, (i - 0.3175) / (n + 0.365))))

    size = last - first + 1
    long = size > 2 * _RUN_ENDS
    one, two = np.zeros(len(first)), np.zeros(len(first))
    for start, stop in ((first, np.where(long, first + _RUN_ENDS, last + 1)), (np.where(long, last - _RUN_ENDS + 1, last + 1), last + 1)):
        length = (stop - start).astype(np.int64)
        owner = np.repeat(np.arange(len(first)), length)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + start[owner]
        z = score(place, n[owner])
        one += np.bincount(owner, z, len(first))
        two += np.bincount(owner, z * z, len(first))
    at = np.flatnonzero(long)
    if len(at):
        m = n[at] + 0.365
        a, b = (first[at] + _RUN_ENDS - 0.3175) / m, (last[at] - _RUN_ENDS - 0.3175) / m
        za, zb = dist.norm_ppf_array(a), dist.norm_ppf_array(b)
        fa, fb = (np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) for z in (za, zb))
        one[at] += m * (fa - fb) + (za + zb) / 2 + (1 / (m * fb) - 1 / (m * fa)) / 12
        two[at] += m * ((b - zb * fb) - (a - za * fa)) + (za * za + zb * zb) / 2 + (2 * zb / (m * fb) - 2 * za / (m * fa)) / 12
    return one, two


def qq_line(df: DataFrame, value: str) -> DataFrame:
    """(slope, intercept, r) of the straight line through the Q-Q points.

    Read off the ranked histogram: a value's points share it, so only the sums of their scores are needed.
    """
    ranked = cumulate(histogram(df, value).withColumnRenamed(value, "sample"), "sample")

    @F.pandas_udf("one double, two double")
    def scores(first: pd.Series, last: pd.Series, n: pd.Series) -> pd.DataFrame:
        one, two = run_scores(*(x.to_numpy(float) for x in (first, last, n)))
        return pd.DataFrame({"one": one, "two": two})

    n, x = F.col("n").cast("double"), F.col("sample")
    rows = ranked.withColumn("z", scores(F.col("n_below") + 1, F.col("n_below") + F.col("n"), F.col("n_total")))
    rows = settle(rows.select("sample", "n", "z.one", "z.two"))
    rows = _attach_row(rows, rows.agg((F.sum(n * x) / F.sum("n")).alias("mean")))
    c = x - F.col("mean")
    s = rows.agg(
        F.sum("n").alias("n"), F.first("mean").alias("mean"), F.sum(n * c).alias("sx"), F.sum(n * c * c).alias("sxx"),
        F.sum("one").alias("sz"), F.sum("two").alias("szz"), F.sum(c * F.col("one")).alias("sxz"),
    )
    n = F.col("n")
    xz, zz, xx = F.col("sxz") - F.col("sx") * F.col("sz") / n, F.col("szz") - F.col("sz") ** 2 / n, F.col("sxx") - F.col("sx") ** 2 / n
    slope = xz / F.when(zz > 0, zz)
    middle = F.col("mean") + F.col("sx") / n
    return s.select(slope.alias("slope"), (middle - slope * F.col("sz") / n).alias("intercept"), (xz / F.sqrt(F.when(xx * zz > 0, xx * zz))).alias("r"))


def missing_bar(df: DataFrame, ignore_cols: list[str] | None = None, include_complete: bool = True) -> DataFrame:
    """(column, n_missing, n_rows, pct_missing, overall_pct), most incomplete first; one pass."""
    cols = [c for c in df.columns if c not in (ignore_cols or [])]
    if not cols:
        raise ValueError("no columns are left to describe")
    kinds = {f.name: f.dataType for f in df.schema}

    def absent(c: str) -> Column:
        gone = F.col(c).isNull()
        return gone | F.isnan(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else gone

    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(absent(c)).alias(f"m_{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("n_missing")) for i, c in enumerate(cols)])
    cells = sum(F.col(f"m_{i}") for i in range(len(cols)))
    rows = F.when(F.col("n_rows") > 0, F.col("n_rows"))
    out = one.select("n_rows", (cells / (rows * len(cols)) * 100).alias("overall_pct"), F.explode(each).alias("e"))
    pct = F.coalesce(F.col("e.n_missing") / F.when(F.col("n_rows") > 0, F.col("n_rows")) * 100, F.lit(0.0))
    out = out.select("e.column", "e.n_missing", "n_rows", pct.alias("pct_missing"), F.coalesce("overall_pct", F.lit(0.0)).alias("overall_pct"))
    if not include_complete:
        out = out.filter("n_missing > 0")
    return out.orderBy(F.col("pct_missing").desc(), "column")


def missing_matrix(df: DataFrame, order_col: str, sample_n: int | None = None, cols: list[str] | None = None) -> DataFrame:
    """(row, column, missing) of all rows in the order of ``order_col`` (a unique key), or of ``sample_n`` evenly spaced ones."""
    cols = cols or [c for c in df.columns if c != order_col]
    flags = df.select(order_col, F.lit(1).alias("_w"), *[F.col(c).isNull().alias(f"m_{i}") for i, c in enumerate(cols)])
    placed = cumulate(flags, order_col, ["_w"])
    kept = placed
    if sample_n is not None:
        # floor(i·(n-1)/(m-1)) for i = 0 … m-1, or every row when there are few.
        n, m = F.col("_w_total"), sample_n
        slot = F.ceil(F.col("_w_below") * (m - 1) / F.greatest(n - 1, F.lit(1)))
        kept = placed.filter((n <= m) | (F.floor(slot * (n - 1) / (m - 1)) == F.col("_w_below")))
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing")) for i, c in enumerate(cols)])
    return kept.select(F.col("_w_below").alias("row"), F.explode(each).alias("e")).select("row", "e.column", "e.missing")


def trendline(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """OLS line per group: n, slope, intercept, r_squared and its p-value; groups under 3 points are left out."""
    rows = df.select((F.col(group) if group else F.lit("all")).cast("string").alias("group"), finite(x).alias("x"), finite(y).alias("y")).dropna()
    s = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        correlation(F.col("x"), F.col("y")).alias("r"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    ).filter("n >= 3")
    r = F.col("r")
    t = r * F.sqrt((F.col("n") - 2) / F.when(F.abs(r) < 1, 1 - r * r))
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(dist.sided_t_p(t, F.col("n") - 2))
    return s.select("group", "n", "slope", "intercept", (r * r).alias("r_squared"), p.alias("p_value"), "x_min", "x_max")


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 80) -> DataFrame:
    """(x_bin, y_bin, n): the non-empty cells of an equal-width grid."""
    rows = df.select(finite(x).alias("x"), finite(y).alias("y")).dropna()
    ends = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = _attach_row(rows, ends)
    xb = _bin_index(F.col("x"), F.col("x0"), F.col("x1"), bins)
    yb = _bin_index(F.col("y"), F.col("y0"), F.col("y1"), bins)
    return rows.groupBy(xb.alias("x_bin"), yb.alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def bubble_sizes(df: DataFrame, size: str, lo: float = 5.0, hi: float = 50.0) -> DataFrame:
    """The rows with ``bubble_size``: min-max scaled to [lo, hi], the midpoint if constant."""
    if isinstance(df.schema[size].dataType, T.StringType):
        raise TypeError(f"bubble sizes must be numbers; '{size}' holds none")
    v = finite(size)
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b")).select(F.struct("a", "b")).scalar()
    rows = df.withColumn("_ends", ends)
    span = F.col("_ends.b") - F.col("_ends.a")
    scaled = lo + (v - F.col("_ends.a")) / F.when(span > 0, span) * (hi - lo)
    return rows.withColumn("bubble_size", F.when(span == 0, (lo + hi) / 2).otherwise(scaled)).drop("_ends")


def bubble_legend(df: DataFrame, size: str) -> DataFrame:
    return marked_quantiles(df, size, [0.25, 0.75, 1.0]).drop("group")


def top_labels(df: DataFrame, size: str, label: str, top_n: int = 10) -> DataFrame:
    """The rows to label: the largest by ``size``, ties by label."""
    return df.orderBy(F.col(size).desc_nulls_last(), label).limit(top_n)


def ranked_bars(
    df: DataFrame,
    group: str,
    value: str,
    agg: str = "mean",
    ci_method: str | None = "sem",
    confidence: float = 0.95,
    n_boot: int = 2000,
    split: str | None = None,
    min_n_flag: int = 5,
    top_n: int | None = None,
    ascending: bool = False,
    random_state: int = 0,
) -> DataFrame:
    """Ranked group means or medians with intervals; optionally split by a second column (≤ 8 levels)."""
    keys = ["group"] + (["split"] if split else [])
    rows = df.select(
        F.col(group).cast("string").alias("group"), *([F.col(split).cast("string").alias("split")] if split else []), finite(value).alias("value")
    ).dropna()
    if split:
        levels = rows.groupBy("split").count().agg(F.count(F.lit(1))).scalar()
        rows = rows.filter(F.when(levels <= 8, True).otherwise(F.raise_error(F.lit(f"split_col '{split}' has more than 8 levels")).cast("boolean")))
    if agg == "median" and ci_method == "sem":
        ci_method = "bootstrap"
    n, v = F.col("n"), F.col("value")
    need_ranks = agg == "median" or ci_method == "bootstrap"
    if need_ranks:
        whole = cumulate(histogram(rows, "value", ["group"]), "value", by=["group"])
        point = quantile_at(0.5, "value") if agg == "median" else F.sum(n * v) / F.sum("n")
        overall = whole.groupBy("group").agg(point.alias("key"))
    else:
        overall = rows.groupBy("group").agg(F.avg("value").alias("key"))
    order = F.col("key").asc() if ascending else F.col("key").desc()
    if top_n is not None:
        overall = overall.orderBy(order, "group").limit(top_n)
    if ci_method == "bootstrap":
        ranked = settle(cumulate(histogram(rows, "value", keys), "value", by=keys))
        est = resample.estimates_and_jackknife(ranked, agg, keys)
        reps = resample.bootstrap_replicates(ranked, agg, n_boot, random_state, keys)
        out = resample.intervals(reps, est, "basic", confidence, keys).withColumnRenamed("theta_hat", "point")
        out = out.withColumns({c: F.when(F.col("n") >= 2, F.col(c)) for c in ("ci_low", "ci_high")}).drop("se")
    elif agg == "median":
        ranked = cumulate(histogram(rows, "value", keys), "value", by=keys)
        out = ranked.groupBy(*keys).agg(quantile_at(0.5, "value").alias("point"), F.sum("n").alias("n"))
        out = out.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    else:
        out = rows.groupBy(*keys).agg(F.avg("value").alias("point"), F.count("value").alias("n"), F.stddev_samp("value").alias("sd"))
        half = dist.norm_ppf(0.5 + confidence / 2) * F.col("sd") / F.sqrt("n")
        if ci_method is None:
            half = F.lit(None).cast("double")
        out = out.withColumns({"ci_low": F.col("point") - half, "ci_high": F.col("point") + half}).drop("sd")
    out = out.join(overall, "group").withColumn("low_n", F.col("n") < min_n_flag)
    return out.orderBy(order, *keys)


def grouped_boxes(
    df: DataFrame, group: str, value: str, sort_by: str = "median", ascending: bool = False, min_n_flag: int = 30, top_n: int | None = None
) -> DataFrame:
    """Box statistics of every group in order of median, mean or n, small groups flagged."""
    if sort_by not in ("median", "mean", "n"):
        raise ValueError("unknown sort_by; known are median, mean and n")
    out = box_stats(df, value, group).withColumn("low_n", F.col("n") < min_n_flag)
    out = out.orderBy(F.col(sort_by).asc() if ascending else F.col(sort_by).desc(), "group")
    return out.limit(top_n) if top_n is not None else out


def dumbbell(
    df: DataFrame, category: str, start: str, end: str, sort_by: str = "abs_diff", ascending: bool = False, top_n: int | None = None
) -> DataFrame:
    """Mean start and end value per category with their difference, sorted."""
    out = df.dropna(subset=[category, start, end]).groupBy(F.col(category).alias("category")).agg(F.avg(start).alias("start"), F.avg(end).alias("end"))
    out = out.withColumn("diff", F.col("end") - F.col("start")).withColumn("abs_diff", F.abs("diff"))
    out = out.orderBy(F.col(sort_by).asc() if ascending else F.col(sort_by).desc(), "category")
    return out.limit(top_n) if top_n is not None else out


def radar(
    df: DataFrame, category: str, values: list[str], scale: str = "minmax", rank_by: str | None = None, top_n: int | None = None, entities: list[str] | None = None
) -> DataFrame:
    """(category, metric, mean, scaled): entity means scaled over all entities, for at most six of them."""
    if len(values) < 3:
        raise ValueError("a radar has three metrics or more")
    take = len(entities) if entities else 6 if top_n is None else top_n
    if take > 6:
        raise ValueError(f"radar_plot caps at 6 entities for readability; got {take}.")
    means = df.groupBy(F.col(category).cast("string").alias("category")).agg(*[F.avg(finite(c)).alias(c) for c in values])
    means = means.filter(F.col("category").isNotNull())
    ends = means.agg(*[F.min(c).alias(f"{c}_lo") for c in values], *[F.max(c).alias(f"{c}_hi") for c in values])
    packed = ends.select(F.struct("*")).scalar()
    if entities:
        chosen = means.filter(F.col("category").isin(entities))
    else:
        chosen = means.orderBy(F.col(rank_by or values[0]).desc_nulls_last(), "category").limit(take)
    chosen = chosen.withColumn("_ends", packed)
    items = []
    for c in values:
        lo, hi = F.col(f"_ends.{c}_lo"), F.col(f"_ends.{c}_hi")
        between = F.coalesce((F.col(c) - lo) / F.when(hi > lo, hi - lo), F.lit(0.5))
        items.append(F.struct(F.lit(c).alias("metric"), F.col(c).alias("mean"), (between if scale == "minmax" else F.col(c)).alias("scaled")))
    return chosen.select("category", F.explode(F.array(*items)).alias("e")).select("category", "e.*")


def time_resample(
    df: DataFrame, date_col: str, value: str | None = None, freq: str = "D", agg: str = "mean", group: str | None = None, top_groups: int | None = None
) -> DataFrame:
    """(group, period, value): one row per calendar period from first to last; empty periods stay NULL.

    ``freq`` is anything :func:`statloom.functions.calendar.frequency` reads: units, multiples,
    anchors and business days. ``top_groups`` asks for the largest groups only.
    """
    if value is None and agg != "count":
        raise ValueError("without a value column only rows can be counted")
    if agg not in ("mean", "median", "sum", "count"):
        raise ValueError(f"unknown agg '{agg}'")
    calendar = frequency(freq)
    stamp = F.col(date_col).try_cast("timestamp")
    rows = df.select(
        (F.col(group) if group else F.lit("all")).cast("string").alias("group"), stamp.alias("stamp"),
        (finite(value) if value else F.lit(1.0)).alias("value"),
    ).dropna()
    if group and top_groups is not None:
        largest = rows.groupBy("group").count().orderBy(F.col("count").desc(), "group").limit(top_groups).select("group")
        rows = rows.join(F.broadcast(largest), "group", "left_semi")
    rows = rows.withColumn("unit", calendar.unit_number(F.col("stamp")))
    origin = F.lit(0).cast("long")
    if calendar.multiple > 1:
        # Multiples are counted from each group's first unit, parts of a day from its first midnight.
        first = rows.groupBy("group").agg(calendar.origin(F.min("stamp")).alias("origin"))
        rows, origin = rows.join(first, "group"), F.col("origin")
    rows = rows.select("group", "value", origin.alias("origin"), calendar.period_number(F.col("unit"), origin).alias("number"))
    keys = ["group", "number", "origin"]
    if agg == "median":
        ranked = cumulate(histogram(rows, "value", keys), "value", by=keys)
        point = ranked.groupBy(*keys).agg(quantile_at(0.5, "value").alias("value"))
    else:
        how = {"mean": F.avg("value"), "sum": F.sum("value"), "count": F.count("value").cast("double")}[agg]
        point = rows.groupBy(*keys).agg(how.alias("value"))
    span = point.groupBy("group", "origin").agg(F.min("number").alias("a"), F.max("number").alias("b"))
    periods = span.select("group", "origin", F.explode(F.sequence("a", "b")).alias("number"))
    found = periods.join(point.drop("origin"), ["group", "number"], "left")
    return found.select("group", calendar.label(F.col("number"), F.col("origin")).alias("period"), "value")


def rolling_mean(series: DataFrame, window: int) -> DataFrame:
    """Mean of the last ``window`` periods of each group, gaps skipped.

    ``series`` is the output of ``time_resample``: one row per calendar period.
    """
    w = Window.partitionBy("group").orderBy("period").rowsBetween(-(window - 1), Window.currentRow)
    return series.withColumn("rolling", F.avg("value").over(w))


def pareto(
    df: DataFrame, category: str, value: str | None = None, agg: str = "sum", cutoff: float | None = 0.8, top_n: int | None = None
) -> DataFrame:
    """Categories by descending aggregate with running share and how many reach the cutoff.

    The running sum goes over ordered buckets, so millions of categories are no problem.
    """
    if cutoff is not None and not 0.0 < cutoff <= 1.0:
        raise ValueError(f"cutoff {cutoff} is not above 0 and up to 1")
    how = F.count(F.lit(1)) if value is None else F.count(value) if agg == "count" else F.sum(finite(value))
    totals = df.filter(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(how.cast("double").alias("value"))
    totals = totals.filter("value > 0")
    # Ordered by (descending total, name): a unique key, so even a long tail of equal totals spreads out.
    totals = totals.withColumns({"key": F.struct((-F.col("value")).alias("neg"), "category"), "c": F.lit(1), "v": F.col("value")})
    out = cumulate(totals, "key", ["c", "v"])
    out = out.withColumns({"place": F.col("c_below") + 1, "cum_value": F.col("v_below") + F.col("v")})
    out = out.withColumns({"share": F.col("value") / F.col("v_total"), "cum_share": F.col("cum_value") / F.col("v_total")})
    if cutoff is not None:
        covered = out.agg(F.least(F.count_if(F.col("cum_share") < cutoff) + 1, F.count(F.lit(1)))).scalar()
        out = out.withColumn("n_cover", covered)
    else:
        out = out.withColumn("n_cover", F.lit(None).cast("long"))
    out = out.select("place", "category", "value", "share", "cum_share", "n_cover")
    return out.filter(F.col("place") <= top_n) if top_n is not None else out
