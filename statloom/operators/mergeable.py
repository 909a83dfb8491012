"""Statistics in three parts - partial, merge, finish - and their bootstrap at any size.

A custom statistic says what it needs of a block of values (``partial``), how the states of two
blocks become one (``merge``), and what it is (``finish``). Every part works on many replicates at
once. Each block of the value histogram then makes its partial states by itself, weighted by the
replicates' draws; states are merged up the tree of blocks, one row per replicate and branch, and
no task sees more than one block or the children of one branch.

Delete-one values, for the acceleration of BCa intervals, come back down the same tree: a block
gets the merged state of everything outside it, and inside, values are left out one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.ranks import settle
from statloom.operators import resample

#: Values that are left out together when one of them is left out.
_RUN = 128


@dataclass(frozen=True)
class Mergeable:
    """A statistic for :func:`statloom.operators.resample.bootstrap_ci`.

    ``partial(values, counts)`` takes w values and an r x w array of how often each is drawn, and
    returns an r x s array of states; a row without draws must be neutral for ``merge``.
    ``merge(a, b)`` takes two r x s arrays and must not depend on order; by default states add.
    ``finish(states)`` returns r numbers.
    """

    name: str
    partial: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add


def _moments(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number, mean, and sums of squared and cubed deviations of every row's draws."""
    n = counts.sum(axis=1, dtype=float)
    centre = float(values.mean()) if len(values) else 0.0
    off = values - centre
    some = np.maximum(n, 1)
    m = counts @ off / some
    s2, s3 = counts @ (off * off), counts @ (off * off * off)
    m2 = s2 - n * m * m
    m3 = s3 - 3 * m * s2 + 2 * n * m**3
    return np.column_stack([n, np.where(n > 0, centre + m, 0.0), np.maximum(m2, 0.0), m3])


def _merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (na, ma, a2, a3), (nb, mb, b2, b3) = a.T, b.T
    n = na + nb
    some = np.maximum(n, 1)
    gap = np.where((na > 0) & (nb > 0), mb - ma, 0.0)
    mean = (na * ma + nb * mb) / some
    m2 = a2 + b2 + gap**2 * na * nb / some
    m3 = a3 + b3 + gap**3 * na * nb * (na - nb) / some**2 + 3 * gap * (na * b2 - nb * a2) / some
    return np.column_stack([n, mean, m2, m3])


def of_moments(name: str, finish: Callable[..., np.ndarray]) -> Mergeable:
    """A statistic of ``(n, mean, sum of squared deviations, sum of cubed deviations)``."""
    return Mergeable(name, _moments, lambda states: finish(*states.T), _merge_moments)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.shape(a), np.nan), where=np.asarray(b) != 0)


#: Standard deviation over mean.
variation = of_moments("variation", lambda n, mean, m2, m3: _ratio(np.sqrt(_ratio(m2, n - 1)), mean))
#: Third standardised moment of the sample itself.
skewness = of_moments("skewness", lambda n, mean, m2, m3: _ratio(_ratio(m3, n), _ratio(m2, n) ** 1.5))
#: Geometric mean of positive values; undefined with others.
geometric_mean = Mergeable(
    "geometric_mean",
    lambda values, counts: np.column_stack([counts.sum(axis=1), counts @ np.log(np.where(values > 0, values, 1.0)), counts @ (values <= 0)]).astype(float),
    lambda states: np.where(states[:, 2] > 0, np.nan, np.exp(_ratio(states[:, 1], states[:, 0]))),
)


def share_above(bound: float) -> Mergeable:
    """The share of values above ``bound``."""
    return Mergeable(
        f"share_above_{bound:g}", lambda values, counts: np.column_stack([counts @ (values > bound), counts.sum(axis=1)]).astype(float),
        lambda states: _ratio(states[:, 0], states[:, 1]),
    )


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _merged(statistic: Mergeable, states: np.ndarray) -> np.ndarray:
    """One state of many (n, s), pair by pair."""
    while len(states) > 1:
        odd = states[len(states) // 2 * 2 :]
        states = np.concatenate([statistic.merge(states[0 : len(states) // 2 * 2 : 2], states[1::2]), odd])
    return states[0]


def _around(statistic: Mergeable, states: np.ndarray, outside: np.ndarray | None) -> list[np.ndarray | None]:
    """For each of the states all others, and ``outside``, merged; None where there is nothing."""
    def both(a, b):
        return b if a is None else a if b is None else statistic.merge(a[None], b[None])[0]

    before, after = [outside], [None]
    for x in states[:-1]:
        before.append(both(before[-1], x))
    for x in states[:0:-1]:
        after.append(both(x, after[-1]))
    return [both(a, b) for a, b in zip(before, after[::-1])]


def _block_states(statistic: Mergeable, n_resamples: int, seed: int, keys: list[str], depth: int) -> Callable:
    """States of one block: replicate -1 is the sample itself."""

    def run(pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        values, counts = pdf["value"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        label, block = [str(pdf[k].iloc[0]) for k in keys], int(pdf["block"].iloc[0])
        mine, _ = resample._leaf_counts(path, depth, n_resamples, seed, label)
        own = np.random.default_rng(resample._seed(seed, *label, "block", block))
        states = [statistic.partial(values, counts[None])]
        for lo, hi in resample._chunks(n_resamples, max(len(values), int(mine.max(initial=0)))):
            states.append(statistic.partial(values, resample._draw_counts(own, counts, mine[lo:hi])))
        res = pd.DataFrame({"block": block, "rep": np.arange(-1, n_resamples), "state": list(np.concatenate(states).astype(float))})
        for k in reversed(keys):
            res.insert(0, k, pdf[k].iloc[0])
        return res

    return run


def _merge_children(statistic: Mergeable, keys: list[str]) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for rep, part in pdf.sort_values(["rep", "block"]).groupby("rep", sort=True):
            rows.append({**{k: pdf[k].iloc[0] for k in keys}, "block": pdf["parent"].iloc[0], "rep": rep, "state": _merged(statistic, _stacked(part["state"]))})
        return pd.DataFrame(rows)

    return run


def _leave_children(statistic: Mergeable, keys: list[str]) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        outside = pdf["outside"].iloc[0]
        around = _around(statistic, _stacked(pdf["state"]), None if outside is None else np.asarray(outside, float))
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "block": pdf["block"], "outside": around})

    return run


def _leave_values(statistic: Mergeable, keys: list[str]) -> Callable:
    """(n, mean, m2, m3) of a block's delete-one values: moments instead of a row per value."""

    def run(pdf: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        values, counts = pdf["value"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        outside = others["outside"].iloc[0]
        runs = [slice(i, i + _RUN) for i in range(0, len(values), _RUN)]
        states = np.concatenate([statistic.partial(values[r], counts[r][None]) for r in runs])
        without = []
        for r, rest in zip(runs, _around(statistic, states, None if outside is None else np.asarray(outside, float))):
            left = statistic.partial(values[r], counts[r] - np.eye(len(values[r]), dtype=np.int64))
            without.append(statistic.finish(left if rest is None else statistic.merge(left, np.broadcast_to(rest, left.shape))))
        n, mean, m2, m3 = _moments(np.concatenate(without), counts[None])[0]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": n, "n_total": pdf["n_total"].iloc[0], "mean": mean, "m2": m2, "m3": m3}])

    return run


def estimates_and_replicates(
    ranked: DataFrame, statistic: Mergeable, n_resamples: int, seed: int, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(keys…, n, theta_hat, u2, u3) and (keys…, rep, theta), as for the named statistics.

    ``ranked`` is a cumulated histogram (value, n, n_below, n_tied, n_total) per key.
    """
    types = {f.name: f.dataType.simpleString() for f in ranked.schema}
    key = ", ".join(f"`{k}` {types[k]}" for k in keys)
    rows, paths, depth = resample._tree_blocks(ranked.select(*keys, "value", "n", "n_below", "n_total"), keys)
    schema = f"{key}, block long, rep long, state array<double>"
    levels = [settle(resample.per_block(rows, paths, keys, _block_states(statistic, n_resamples, seed, keys, depth), schema))]
    for _ in range(depth):
        up = levels[-1].withColumns({"parent": F.expr(f"block div {resample.MAX_BLOCKS}"), "_reps": F.expr("rep div 100")})
        levels.append(settle(up.groupBy(*keys, "parent", "_reps").applyInPandas(_merge_children(statistic, keys), schema)))

    def finished(batches):
        for pdf in batches:
            yield pdf[[*keys, "rep"]].assign(theta=statistic.finish(_stacked(pdf["state"])) if len(pdf) else np.zeros(0))

    thetas = settle(levels[-1].mapInPandas(finished, f"{key}, rep long, theta double"))
    outside = levels[-1].filter("rep = -1").select(*keys, "block", F.lit(None).cast("array<double>").alias("outside"))
    for level in reversed(levels[:-1]):
        down = level.filter("rep = -1").withColumn("parent", F.expr(f"block div {resample.MAX_BLOCKS}"))
        down = down.join(outside.withColumnRenamed("block", "parent"), [*keys, "parent"])
        outside = down.groupBy(*keys, "parent").applyInPandas(_leave_children(statistic, keys), f"{key}, block long, outside array<double>")
    moments = f"{key}, n double, n_total long, mean double, m2 double, m3 double"
    left = settle(resample.per_block(rows, outside, keys, _leave_values(statistic, keys), moments))
    n, total = F.col("n"), F.col("n_total").cast("double")
    middle = left.groupBy(*keys).agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("middle"))
    off = F.col("mean") - F.col("middle")
    # The sums are taken around each block's mean and moved to the mean of all.
    square = F.col("m2") + n * off**2
    cube = F.col("m3") + 3 * off * F.col("m2") + n * off**3
    share = (total - 1) / total
    bent = left.join(middle, keys).groupBy(*keys).agg(F.max("n_total").alias("n"), F.sum(share**2 * square).alias("u2"), F.sum(-(share**3) * cube).alias("u3"))
    found = thetas.filter("rep = -1").select(*keys, F.col("theta").alias("theta_hat"))
    return bent.join(found, keys), thetas.filter("rep >= 0")
