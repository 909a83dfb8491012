"""Resampling spread over blocks of the value histogram.

Every task repeats the same replicate-by-block draws from the seed, so it knows how many of
the drawn observations fall into its own block without any exchange; it then draws inside
the block only. What leaves a task is one row per replicate (or per order statistic that
falls into the block), whatever the number of observations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.labels import DEGENERATE_CI, check_confidence, join_flags, say
from statloom.functions.numeric import finite
from statloom.operators.ranks import attach, bucket_count, cumulate, histogram, quantile_at, settle

# Observations per leaf block, and the branches of the tree of blocks above them.
BLOCK_ROWS = 20_000
MAX_BLOCKS = 256
# Cells of the in-block draw held in memory at a time.
_CELLS = 2_000_000
# A Python statistic needs its sample in one piece; beyond this it is refused, not cut.
CALLABLE_MAX = 1_000_000

STATISTICS = ("mean", "median", "std", "var", "min", "max", "sum")


def _seed(*parts) -> list[int]:
    return [abs(hash_text(str(p))) for p in parts]


def hash_text(s: str) -> int:
    """Process-independent text hash for seeding."""
    h = 1469598103934665603
    for b in s.encode():
        h = ((h ^ b) * 1099511628211) % (1 << 64)
    return h


def _chunks(total: int, width: int):
    step = max(1, _CELLS // max(width, 1))
    for start in range(0, total, step):
        yield start, min(total, start + step)


def _draw_counts(rng: np.random.Generator, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of multinomial counts: ``sizes[r]`` draws with replacement from the block."""
    total, width = int(counts.sum()), len(counts)
    if total > 8 * width:
        return rng.multinomial(sizes, counts / total)
    # Few copies per value: picking observations is cheaper than one binomial per value.
    owner = np.repeat(np.arange(width), counts)
    picked = owner[rng.integers(0, total, int(sizes.sum()))]
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(row * width + picked, minlength=len(sizes) * width).reshape(len(sizes), width)


def _order_indexes(statistic: str, n: int) -> list[int]:
    if statistic == "min":
        return [0]
    if statistic == "max":
        return [n - 1]
    return sorted({(n - 1) // 2, n // 2})


def _tree_blocks(ranked: DataFrame, keys: list[str], whole: Column | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Blocks of about BLOCK_ROWS observations as leaves of a tree with MAX_BLOCKS branches.

    Returns the rows with their leaf, the path of every leaf and the depth. A path, one row per
    leaf, holds for each level the sizes of the branches that were chosen from: enough to repeat
    the draws that lead to the leaf. Keys that are ``whole`` get one block.
    """
    largest = ranked.agg(F.max("n_total")).first()[0] or 1
    depth = 1
    while MAX_BLOCKS**depth * BLOCK_ROWS < largest:
        depth += 1
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_total") / BLOCK_ROWS))
    parts = parts if whole is None else F.when(whole, 1).otherwise(parts)
    leaf = F.floor(F.col("n_below").cast("decimal(38,0)") * parts / F.col("n_total")).cast("long")
    rows = ranked.withColumn("block", leaf)
    sizes = settle(rows.groupBy(*keys, "block").agg(F.sum("n").alias("m")))
    paths = sizes.drop("m")
    for level in range(depth):
        branch = (F.col("block") / MAX_BLOCKS ** (depth - 1 - level)).cast("long")
        parent = (F.col("block") / MAX_BLOCKS ** (depth - level)).cast("long") if level else F.lit(0).cast("long")
        at = sizes.select(*keys, parent.alias("_parent"), branch.alias("branch"), "m")
        at = at.groupBy(*keys, "_parent", "branch").agg(F.sum("m").alias("m"))
        at = at.groupBy(*keys, "_parent").agg(F.sort_array(F.collect_list(F.struct("branch", "m"))).alias(f"sizes{level}"))
        paths = paths.withColumn("_parent", parent).join(at, [*keys, "_parent"]).drop("_parent")
    # A fixed partition count: the blocks are heavy to draw from but small in bytes, and would
    # otherwise be coalesced into one task.
    tasks = bucket_count(rows)
    return rows.repartition(tasks, *keys, "block"), paths.repartition(tasks, *keys, "block"), depth


def per_block(rows: DataFrame, paths: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(rows of a block, its path)`` for every block: sizes of branches travel once a block, not with every row."""
    # New names of the same columns, as both sides may come from one frame.
    return rows.groupBy(*keys, "block").cogroup(paths.toDF(*paths.columns).groupBy(*keys, "block")).applyInPandas(run, schema)


def _with_replacement(rng: np.random.Generator, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    return rng.multinomial(draws, sizes / sizes.sum())


def _without_replacement(rng: np.random.Generator, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rows of how ``draws[r]`` observations taken without replacement fall on parts of these sizes."""
    out, left, rest = np.empty((len(draws), len(sizes)), np.int64), draws.astype(np.int64), int(sizes.sum())
    for j, size in enumerate(sizes.tolist()):
        rest -= size
        out[:, j] = left if not rest else hypergeometric(rng, size, rest, left)
        left = left - out[:, j]
    return out


# The library's generator takes populations below this.
_LIBRARY_POPULATION = 1_000_000_000
_LOG_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1024)))])


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: np.ndarray) -> np.ndarray:
    """Good ones among ``draws[r]`` taken without replacement, for populations of any size."""
    if good + bad < _LIBRARY_POPULATION:
        return rng.hypergeometric(good, bad, draws)
    few, total = min(good, bad), good + bad
    # Taking the smaller side of the draw gives the same law from the other end.
    side = np.minimum(draws, total - draws)
    found = np.zeros(len(draws), np.int64)
    for i in range(10):
        found += (side < 10) & (side > i) & (rng.random(len(draws)) * (total - i) < few - found)
    many = np.flatnonzero(side >= 10)
    found[many] = _by_ratio(rng, few, total, side[many])
    found = np.where(side == draws, found, few - found)
    return found if few == good else draws - found


def _by_ratio(rng: np.random.Generator, few: int, total: int, draws: np.ndarray) -> np.ndarray:
    """Hypergeometric numbers by the ratio of uniforms, accepted by their exact log-probability."""
    out, share = np.zeros(len(draws), np.int64), few / total
    middle = draws * share + 0.5
    spread = np.sqrt((total - draws) / (total - 1) * draws * share * (1 - share) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = np.floor((draws + 1.0) * (few + 1.0) / (total + 2.0))
    top = np.minimum(np.minimum(draws, few) + 1.0, np.floor(middle + 16 * spread))
    open_ = np.arange(len(draws))
    while len(open_):
        u, v = 1 - rng.random(len(open_)), rng.random(len(open_))
        at = middle[open_] + width[open_] * (v - 0.5) / u
        inside = (at >= 0) & (at < top[open_])
        z, m, k = np.floor(np.where(inside, at, mode[open_])), mode[open_], draws[open_].astype(float)
        log_ratio = -(_log_rise(m, z) + _log_rise(few - m, few - z) + _log_rise(k - m, k - z) + _log_rise(total - few - k + m, total - few - k + z))
        taken = inside & (2 * np.log(u) <= log_ratio)
        out[open_[taken]] = z[taken].astype(np.int64)
        open_ = open_[~taken]
    return out


def _log_rise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(b! / a!), in one piece where both are large so that nothing cancels."""
    def log_factorial(x):
        large = np.maximum(x, 1023.0)
        series = (large + 0.5) * np.log(large) - large + 0.5 * math.log(2 * math.pi) + 1 / (12 * large) - 1 / (360 * large**3)
        return np.where(x < 1024, _LOG_FACTORIALS[np.minimum(x, 1023).astype(np.int64)], series)

    x, y = np.maximum(a, 1.0), np.maximum(b, 1.0)
    step = (y + 0.5) * np.log1p((y - x) / x) + (y - x) * (np.log(x) - 1) + (1 / y - 1 / x) / 12 - (1 / y**3 - 1 / x**3) / 360
    return np.where((a >= 1024) & (b >= 1024), step, log_factorial(b) - log_factorial(a))


def _leaf_counts(
    path: pd.DataFrame, depth: int, n_resamples: int, seed: int, label: list[str], draws: int | None = None,
    split: Callable = _with_replacement, name: str = "level",
) -> tuple[np.ndarray, np.ndarray]:
    """(draws that fall into this leaf, draws that fall before it) for every replicate.

    ``draws`` observations are drawn per replicate, by default as many as there are.
    """
    leaf = int(path["block"].iloc[0])
    mine = before = None
    for level in range(depth):
        sizes = [(s["branch"], s["m"]) for s in path[f"sizes{level}"].iloc[0]]
        weights = np.array([m for _, m in sizes], np.int64)
        branch = leaf // MAX_BLOCKS ** (depth - 1 - level)
        me = [b for b, _ in sizes].index(branch)
        if level == 0:
            mine, before = np.full(n_resamples, int(weights.sum()) if draws is None else draws), np.zeros(n_resamples, dtype=np.int64)
        rng = np.random.default_rng(_seed(seed, *label, name, level, branch // MAX_BLOCKS if level else 0))
        table = split(rng, weights, mine)
        before = before + table[:, :me].sum(axis=1)
        mine = table[:, me]
    return mine, before


def _bootstrap_block(statistic: str, n_resamples: int, seed: int, keys: list[str], depth: int) -> Callable:
    def run(pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        values = pdf["value"].to_numpy(float)
        counts = pdf["n"].to_numpy(np.int64)
        n = int(pdf["n_total"].iloc[0])
        label = [str(pdf[k].iloc[0]) for k in keys]
        mine, before = _leaf_counts(path, depth, n_resamples, seed, label)
        own = np.random.default_rng(_seed(seed, *label, "block", int(pdf["block"].iloc[0])))
        out = []
        for lo, hi in _chunks(n_resamples, max(len(values), int(mine.max(initial=0)))):
            draw = _draw_counts(own, counts, mine[lo:hi])
            reps = np.arange(lo, hi)
            if statistic in ("mean", "sum", "var", "std"):
                part = pd.DataFrame({"rep": reps, "idx": 0, "w": mine[lo:hi].astype(float)})
                part["s1"] = draw @ values
                part["s2"] = draw @ (values * values)
                out.append(part)
                continue
            upto = before[lo:hi, None] + np.cumsum(draw, axis=1)
            for idx in _order_indexes(statistic, n):
                inside = (before[lo:hi] <= idx) & (idx < before[lo:hi] + mine[lo:hi])
                at = (upto[inside] <= idx).sum(axis=1)
                part = pd.DataFrame({"rep": reps[inside], "idx": idx, "w": 1.0})
                part["s1"] = values[at]
                part["s2"] = 0.0
                out.append(part)
        res = pd.concat(out, ignore_index=True)
        for k in reversed(keys):
            res.insert(0, k, pdf[k].iloc[0])
        return res

    return run


def bootstrap_replicates(
    ranked: DataFrame, statistic: str, n_resamples: int, seed: int, keys: list[str] = ()
) -> DataFrame:
    """(keys…, rep, theta): the statistic of every bootstrap replicate of every key.

    ``ranked`` is a cumulated histogram (value, n, n_below, n_tied, n_total) per key.
    """
    keys = list(keys)
    # Sums of squares are taken around the key's mean, or large offsets would cancel.
    centre = ranked.groupBy(*keys).agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("c"))
    if keys:
        centre = settle(centre)
    ranked = attach(ranked, centre, keys) if keys else ranked.withColumn("c", centre.scalar())
    rows, paths, depth = _tree_blocks(ranked, keys)
    linear = statistic in ("mean", "sum", "var", "std")
    if linear:
        rows = rows.withColumn("value", F.col("value") - F.col("c"))
    types = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["rep int, idx long, w double, s1 double, s2 double"])
    parts = per_block(rows, paths, keys, _bootstrap_block(statistic, n_resamples, seed, keys, depth), schema)
    if not linear:
        return parts.groupBy(*keys, "rep").agg(F.avg("s1").alias("theta"))
    sums = parts.groupBy(*keys, "rep").agg(F.sum("w").alias("w"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    sums = sums.join(centre, keys) if keys else sums.withColumn("c", centre.scalar())
    w, mean = F.col("w"), F.col("s1") / F.col("w")
    var = (F.col("s2") - w * mean * mean) / F.when(w > 1, w - 1)
    theta = {
        "mean": mean + F.col("c"),
        "sum": F.col("s1") + w * F.col("c"),
        "var": F.greatest(var, F.lit(0.0)),
        "std": F.sqrt(F.greatest(var, F.lit(0.0))),
    }[statistic]
    return sums.select(*keys, "rep", theta.alias("theta"))


def _value_at(index: Column) -> Column:
    below, upto = F.col("n_below"), F.col("n_below") + F.col("n_tied")
    return F.max(F.when((below <= index) & (index < upto), F.col("value")))


def estimates_and_jackknife(ranked: DataFrame, statistic: str, keys: list[str] = ()) -> DataFrame:
    """(keys…, n, theta, u2, u3): estimate and the sums of squared and cubed influence values.

    u2 = Σ((n-1)·d)²/n² and u3 = Σ((n-1)·d)³/n³ with d the deviation of a delete-one value
    from the mean of all of them, so a = (Σu3)/6/(Σu2)^1.5 for any number of samples.
    """
    keys = list(keys)
    n, v = F.col("n"), F.col("value")
    total = F.col("n_total")
    base = ranked.groupBy(*keys).agg(
        F.max("n_total").cast("double").alias("nn"),
        (F.sum(n * v) / F.sum("n")).alias("m"),
        quantile_at(0.5, "value").alias("med"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        # Order statistics around the middle and next to the ends, for the delete-one values.
        _value_at(F.floor((total - 2) / 2)).alias("a1"),
        _value_at(F.floor((total - 1) / 2)).alias("a2"),
        _value_at(F.floor(total / 2)).alias("a3"),
        _value_at(F.floor((total + 1) / 2)).alias("a4"),
        _value_at(F.lit(1)).alias("lo2"),
        _value_at(total - 2).alias("hi2"),
    )
    rows = attach(ranked, settle(base), keys) if keys else _attach_row(ranked, base)
    c = v - F.col("m")
    spread = F.sum(n * c * c)
    ss = rows.groupBy(*keys).agg(spread.alias("ss"))
    rows = attach(rows, settle(ss), keys) if keys else _attach_row(rows, ss)
    nn, med = F.col("nn"), F.col("med")
    # Rows at the middle position count as deletions from within; copies of one value are alike.
    even = F.pmod(nn, F.lit(2)) == 0
    median_without = F.when(
        even, F.when(F.col("n_below") <= (nn / 2 - 1), F.col("a3")).otherwise(F.col("a2"))
    ).otherwise(
        F.when(v < F.col("a2"), (F.col("a3") + F.col("a4")) / 2)
        .when(v > F.col("a2"), (F.col("a1") + F.col("a3")) / 2)
        .otherwise((F.col("a1") + F.col("a4")) / 2)
    )
    var_without = (F.col("ss") - nn / (nn - 1) * c * c) / (nn - 2)
    without = {
        "mean": (nn * F.col("m") - v) / (nn - 1),
        "sum": nn * F.col("m") - v,
        "var": var_without,
        "std": F.sqrt(F.greatest(var_without, F.lit(0.0))),
        "median": median_without,
        "min": F.when((v == F.col("lo")) & (n == 1), F.col("lo2")).otherwise(F.col("lo")),
        "max": F.when((v == F.col("hi")) & (n == 1), F.col("hi2")).otherwise(F.col("hi")),
    }[statistic]
    rows = rows.withColumn("theta_i", without)
    mid = rows.groupBy(*keys).agg((F.sum(n * F.col("theta_i")) / F.sum("n")).alias("mid"))
    rows = attach(rows, settle(mid), keys) if keys else _attach_row(rows, mid)
    d = (nn - 1) * (F.col("mid") - F.col("theta_i"))
    theta = {
        "mean": F.first("m"),
        "sum": F.first(nn * F.col("m")),
        "var": F.first(F.col("ss") / F.when(nn > 1, nn - 1)),
        "std": F.sqrt(F.first(F.col("ss") / F.when(nn > 1, nn - 1))),
        "median": F.first("med"),
        "min": F.first("lo"),
        "max": F.first("hi"),
    }[statistic]
    return rows.groupBy(*keys).agg(
        F.first("nn").cast("long").alias("n"),
        theta.alias("theta_hat"),
        F.sum(n * d**2 / nn**2).alias("u2"),
        F.sum(n * d**3 / nn**3).alias("u3"),
    )


def _attach_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row as a scalar subquery."""
    packed = one.select(F.struct(*one.columns)).scalar()
    out = rows.withColumn("_one", packed)
    return out.select(*rows.columns, *[F.col(f"_one.{c}").alias(c) for c in one.columns])


def intervals(
    reps: DataFrame, estimates: DataFrame, method: str, confidence: float, keys: list[str] = ()
) -> DataFrame:
    """(keys…, theta_hat, n, ci_low, ci_high, se) from replicates and (u2, u3) of the estimate."""
    keys = list(keys)
    joined = attach(reps, settle(estimates), keys) if keys else _attach_row(reps, estimates)
    alpha = (1 - confidence) / 2
    share = F.avg(
        F.when(F.col("theta") < F.col("theta_hat"), 1.0).when(F.col("theta") == F.col("theta_hat"), 0.5).otherwise(0.0)
    )
    packed = joined.groupBy(*keys).agg(
        F.first("theta_hat").alias("theta_hat"),
        F.first("n").alias("n"),
        F.first("u2").alias("u2"),
        F.first("u3").alias("u3"),
        share.alias("share"),
        F.stddev_samp("theta").alias("se"),
        # One value per replicate: bounded by n_resamples, not by the data.
        F.sort_array(F.collect_list("theta")).alias("all"),
        F.count("theta").alias("b"),
    )
    if method == "BCa":
        inner = F.when((F.col("share") > 0) & (F.col("share") < 1), F.col("share"))
        accel = F.col("u3") / 6 / F.when(F.col("u2") > 0, F.col("u2") ** 1.5)
        packed = packed.withColumns({"z0": dist.normal_quantile(inner), "a": accel})
        z0, a = F.when(~F.isnan("z0"), F.col("z0")), F.col("a")

        def level(z: float) -> Column:
            shifted = z0 + z
            return dist.normal_cdf(z0 + shifted / (1 - a * shifted))

        packed = packed.withColumns(
            {"p1": level(dist.norm_ppf(alpha)), "p2": level(dist.norm_ppf(1 - alpha))}
        )
    else:
        packed = packed.withColumns({"p1": F.lit(alpha), "p2": F.lit(1 - alpha)})

    def pick(p: str) -> Column:
        pos = F.col(p) * (F.col("b") - 1)
        low = F.get("all", F.floor(pos).cast("int"))
        high = F.get("all", F.ceil(pos).cast("int"))
        return low + (high - low) * (pos - F.floor(pos))

    q1, q2 = pick("p1"), pick("p2")
    if method == "basic":
        q1, q2 = 2 * F.col("theta_hat") - pick("p2"), 2 * F.col("theta_hat") - pick("p1")
    return packed.select(*keys, "theta_hat", "n", q1.alias("ci_low"), q2.alias("ci_high"), "se")


def _callable_ci(
    rows: DataFrame, keys: list[str], func: Callable, confidence: float, n_resamples: int, method: str, seed: int
) -> DataFrame:
    """Bootstrap of a Python statistic: one task per key, refused above CALLABLE_MAX values."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["theta_hat double, n long, ci_low double, ci_high double, se double"])
    alpha = (1 - confidence) / 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["value"].to_numpy(float))
        n = len(x)
        rng = np.random.default_rng(_seed(seed, *[pdf[k].iloc[0] for k in keys]))
        est = float(func(x))
        thetas = np.sort([float(func(x[rng.integers(0, n, n)])) for _ in range(n_resamples)])
        p1, p2 = alpha, 1 - alpha
        if method == "BCa":
            share = (np.mean(thetas < est) + np.mean(thetas <= est)) / 2
            jack = np.array([float(func(np.delete(x, i))) for i in range(n)])
            d = jack.mean() - jack
            den = (d**2).sum() ** 1.5
            if 0 < share < 1 and den > 0:
                a, z0 = (d**3).sum() / 6 / den, dist.norm_ppf(share)
                p1, p2 = (
                    dist.norm_cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
                    for z in (dist.norm_ppf(alpha), dist.norm_ppf(1 - alpha))
                )
            else:
                p1 = p2 = math.nan
        q1, q2 = (math.nan, math.nan) if math.isnan(p1) else np.quantile(thetas, [p1, p2])
        if method == "basic":
            q1, q2 = 2 * est - q2, 2 * est - q1
        row = {k: pdf[k].iloc[0] for k in keys}
        row |= {"theta_hat": est, "n": n, "ci_low": q1, "ci_high": q2, "se": thetas.std(ddof=1)}
        return pd.DataFrame([row])

    size = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if size > CALLABLE_MAX:
        raise ValueError(
            f"A Python statistic needs each group in one task; the largest has {size} values "
            f"(limit {CALLABLE_MAX}). Use a named statistic."
        )
    return rows.select(*keys, "value").groupBy(*keys).applyInPandas(run, schema)


def bootstrap_ci(
    df: DataFrame,
    value_col: str,
    group_col: str | None = None,
    statistic: str | Callable = "mean",
    confidence: float = 0.95,
    n_resamples: int = 9999,
    method: str = "BCa",
    min_group_n: int = 2,
    random_state: int = 0,
) -> DataFrame:
    """Bootstrap interval of a statistic, one row per group.

    ``statistic`` is one of ``STATISTICS`` or a :class:`~statloom.operators.mergeable.Mergeable`,
    both of which work on groups of any size, or a plain callable, which needs each group whole.
    """
    from statloom.operators.mergeable import Mergeable, estimates_and_replicates

    check_confidence(confidence)
    named = isinstance(statistic, str)
    parts = isinstance(statistic, Mergeable)
    if named and statistic not in STATISTICS:
        raise ValueError(f"unknown statistic '{statistic}'; give a Mergeable, a function or one of {STATISTICS}")
    group = F.col(group_col).cast("string") if group_col else F.lit("all")
    rows = df.select(group.alias("group"), finite(value_col).alias("value"))
    rows = rows.filter(F.col("group").isNotNull() & F.col("value").isNotNull())
    if named or parts:
        ranked = settle(cumulate(histogram(rows, "value", ["group"]), "value", by=["group"]))
        ranked = ranked.filter(F.col("n_total") >= (min_group_n if group_col else 1))
        if parts:
            est, reps = estimates_and_replicates(ranked, statistic, n_resamples, random_state, ["group"])
        else:
            est = estimates_and_jackknife(ranked, statistic, ["group"])
            reps = bootstrap_replicates(ranked, statistic, n_resamples, random_state, ["group"])
        out = intervals(reps, est, method, confidence, ["group"])
    else:
        sizes = rows.groupBy("group").count().filter(F.col("count") >= min_group_n)
        rows = rows.join(sizes.select("group"), "group", "left_semi")
        out = _callable_ci(rows, ["group"], statistic, confidence, n_resamples, method, random_state)
        out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ci_low", "ci_high")})
    ok = F.col("n") >= 2
    flags = join_flags(
        say(~ok, "one value: no interval"),
        say(ok & (F.col("ci_low").isNull() | F.col("ci_high").isNull()), f"{method} {DEGENERATE_CI}"),
        say(ok & (F.col("n") < 20), "%d values only: the true interval is wider", F.col("n")),
    )
    return out.select(
        "group",
        F.lit(statistic if named else statistic.name if parts else getattr(statistic, "__name__", "custom")).alias("statistic"),
        "n",
        F.col("theta_hat").alias("estimate"),
        F.when(ok, F.col("ci_low")).alias("ci_low"),
        F.when(ok, F.col("ci_high")).alias("ci_high"),
        F.when(ok, F.col("se")).alias("se"),
        F.lit(method).alias("method"),
        F.lit(confidence).alias("confidence"),
        flags.alias("flags"),
    )


def difference_ci(
    rows: DataFrame,
    pairs: DataFrame,
    statistic: str,
    confidence: float,
    n_resamples: int,
    seed: int,
    keys: list[str],
) -> DataFrame:
    """BCa interval of the difference of two groups' means or medians, for each (group_a, group_b)."""
    gkeys = [*keys, "grp"]
    ranked = settle(cumulate(histogram(rows, "value", gkeys), "value", by=gkeys))
    est = estimates_and_jackknife(ranked, statistic, gkeys)
    reps = bootstrap_replicates(ranked, statistic, n_resamples, seed, gkeys)
    slots = pairs.select(*keys, "group_a", "group_b")

    def side(frame: DataFrame, s: str, cols: list[str]) -> DataFrame:
        return frame.select(*keys, F.col("grp").alias(f"group_{s}"), *[c for c in ("rep",) if c in frame.columns],
                            *[F.col(c).alias(f"{c}_{s}") for c in cols])

    both = slots.join(side(est, "a", ["theta_hat", "u2", "u3", "n"]), [*keys, "group_a"])
    both = both.join(side(est, "b", ["theta_hat", "u2", "u3", "n"]), [*keys, "group_b"])
    est2 = both.select(
        *keys, "group_a", "group_b", (F.col("theta_hat_a") - F.col("theta_hat_b")).alias("theta_hat"),
        (F.col("u2_a") + F.col("u2_b")).alias("u2"), (F.col("u3_a") - F.col("u3_b")).alias("u3"),
        (F.col("n_a") + F.col("n_b")).alias("n"),
    )
    drawn = slots.join(side(reps, "a", ["theta"]), [*keys, "group_a"])
    drawn = drawn.join(side(reps, "b", ["theta"]), [*keys, "group_b", "rep"])
    reps2 = drawn.select(*keys, "group_a", "group_b", "rep", (F.col("theta_a") - F.col("theta_b")).alias("theta"))
    return intervals(reps2, est2, "BCa", confidence, [*keys, "group_a", "group_b"]).select(
        *keys, "group_a", "group_b", "ci_low", "ci_high"
    )


def _shuffle_block(n_resamples: int, seed: int, keys: list[str], depth: int) -> Callable:
    def run(pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        values = pdf["value"].to_numpy(float)
        counts = pdf["n"].to_numpy(np.int64)
        n_draw, total = int(pdf["n_draw"].iloc[0]), int(counts.sum())
        if pdf["ways"].iloc[0] <= n_resamples:
            # Few enough relabellings to go through them all.
            every = np.repeat(values, counts)
            sums = np.array([every[list(c)].sum() for c in itertools.combinations(range(total), n_draw)])
        else:
            label = [str(pdf[k].iloc[0]) for k in keys]
            mine, _ = _leaf_counts(path, depth, n_resamples, seed, label, n_draw, _without_replacement, "shuffle")
            own = np.random.default_rng(_seed(seed, *label, "shuffle", "block", int(pdf["block"].iloc[0])))
            if total <= 8 * len(counts):
                # Few copies per value: picking observations is cheaper than one draw per value.
                every = np.repeat(values, counts)
                sums = np.array([every[own.choice(total, take, replace=False, shuffle=False)].sum() for take in mine.tolist()])
            else:
                sums = np.concatenate([_without_replacement(own, counts, mine[lo:hi]) @ values for lo, hi in _chunks(n_resamples, len(counts))])
        res = pd.DataFrame({"rep": np.arange(len(sums)), "s": sums})
        for k in reversed(keys):
            res.insert(0, k, pdf[k].iloc[0])
        return res

    return run


def _ways(n: Column, k: Column) -> Column:
    """How many ways there are to take k of n; from 2^63 on it only says that there are many."""
    few = F.least(k, n - k)
    product = F.aggregate(F.sequence(F.lit(1), F.least(few, F.lit(64)).cast("int")), F.lit(1.0), lambda t, i: t * (n - few + i) / i)
    return F.when(few == 0, 1.0).otherwise(product)


def _tail_p(reps: DataFrame, alternative: str, keys: list[str]) -> DataFrame:
    """(keys…, p_perm) from the sums ``s``, the observed one, and whether all ways were gone through."""
    # Sums of the same numbers in another order may differ in the last digits.
    eps = F.greatest(F.abs("obs") * 1e-12, F.lit(1e-12))
    tails = reps.groupBy(*keys).agg(
        F.count_if(F.col("s") >= F.col("obs") - eps).alias("up"),
        F.count_if(F.col("s") <= F.col("obs") + eps).alias("down"),
        F.count(F.lit(1)).alias("b"),
        F.max((~F.col("exact")).cast("int")).alias("own"),
    )
    # Of drawn relabellings the observed one is counted as one more.
    up, down = ((F.col(c) + F.col("own")) / (F.col("b") + F.col("own")) for c in ("up", "down"))
    p = {"greater": up, "less": down}.get(alternative, F.least(F.lit(1.0), 2 * F.least(up, down)))
    return tails.select(*keys, p.alias("p_perm"))


def permutation_p(
    pooled: DataFrame, n_resamples: int, seed: int, alternative: str, keys: list[str]
) -> DataFrame:
    """Permutation p-value of the difference in means per pair, at every size.

    ``pooled`` is the ranked histogram of both groups with n, n_a (first group's count). A
    relabelling takes the first group's number of observations without replacement; how many come
    from each block follows from splits down the tree of block sizes, so no block needs another.
    If there are at most ``n_resamples`` relabellings, all are gone through and the p-value is exact.
    """
    keys = list(keys)
    shape = pooled.groupBy(*keys).agg(
        F.sum("n_a").alias("n_draw"), F.sum(F.col("n_a") * F.col("value")).alias("s_obs"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("c"), F.sum("n").alias("nn"),
    )
    shape = shape.withColumn("ways", _ways(F.col("nn"), F.col("n_draw")))
    shape = settle(shape)
    rows = attach(pooled, shape.select(*keys, "n_draw", "c", "ways"), keys)
    exact = F.col("ways") <= n_resamples
    rows, paths, depth = _tree_blocks(rows.withColumn("value", F.col("value") - F.col("c")), keys, exact)
    types = {f.name: f.dataType.simpleString() for f in pooled.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["rep int, s double"])
    parts = per_block(rows, paths, keys, _shuffle_block(n_resamples, seed, keys, depth), schema)
    reps = parts.groupBy(*keys, "rep").agg(F.sum("s").alias("s"))
    shape = shape.withColumns({"obs": F.col("s_obs") - F.col("n_draw") * F.col("c"), "exact": exact})
    return _tail_p(reps.join(shape.select(*keys, "obs", "exact"), keys), alternative, keys)


def sign_flip_p(hist: DataFrame, n_resamples: int, seed: int, alternative: str) -> DataFrame:
    """Permutation p-value of a mean difference of zero: random signs for every pair.

    ``hist`` holds the absolute differences (dev) with their count n and signed sum. Signs are
    independent, so the leaves of the tree need nothing from above. If there are at most
    ``n_resamples`` ways to set the signs, all are gone through and the p-value is exact.
    """
    exact = F.pow(F.lit(2.0), F.col("n_total")) <= n_resamples
    ranked = cumulate(hist.select("dev", "n"), "dev")
    rows, _, _ = _tree_blocks(ranked, [], exact)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dev")
        dev, n = pdf["dev"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        total = int(pdf["n_total"].iloc[0])
        if total < 63 and 1 << total <= n_resamples:
            signs = np.array(list(itertools.product((-1, 1), repeat=total)))
            sums = signs @ np.repeat(dev, n)
        else:
            rng = np.random.default_rng(_seed(seed, "signs", int(pdf["block"].iloc[0])))
            sums = np.concatenate([(2 * rng.binomial(n, 0.5, size=(hi - lo, len(dev))) - n) @ dev for lo, hi in _chunks(n_resamples, len(dev))])
        return pd.DataFrame({"rep": np.arange(len(sums)), "s": sums})

    reps = rows.groupBy("block").applyInPandas(run, "rep int, s double").groupBy("rep").agg(F.sum("s").alias("s"))
    reps = _attach_row(reps, hist.agg(F.sum("signed").alias("obs"), F.sum("n").alias("n_total")))
    return _tail_p(reps.withColumn("exact", exact), alternative, [])


def fixed_size_sample(ranked: DataFrame, size: int, seed: int, keys: list[str]) -> DataFrame:
    """(keys…, value, k): ``size`` observations drawn without replacement, all of a smaller key.

    The drawn positions follow from the seed and the key's total, so every batch of the
    ranked histogram can tell by itself how many of them fall on each of its values.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys] + ["value double, k long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            pdf["k"] = pdf["n"]
            for label, part in pdf.groupby([*keys, "n_total"], dropna=False, sort=False):
                total = int(label[-1])
                if total <= size:
                    continue
                if label not in drawn:
                    rng = np.random.default_rng(_seed(seed, *label[:-1], "sample"))
                    drawn[label] = np.sort(rng.choice(total, size=size, replace=False))
                start = part["n_below"].to_numpy(np.int64)
                ends = start + part["n"].to_numpy(np.int64)
                pdf.loc[part.index, "k"] = np.searchsorted(drawn[label], ends) - np.searchsorted(drawn[label], start)
            yield pdf.loc[pdf["k"] > 0, [*keys, "value", "k"]]

    return ranked.select(*keys, "value", "n", "n_below", "n_total").mapInPandas(run, schema)
