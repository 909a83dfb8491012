"""Verdicts, effect-size labels and caveat texts that travel with a test result."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdict texts and conventional effect-size cut-points.
REJECT = "reject H₀"
KEEP = "fail to reject H₀"
D_LEVELS = (0.2, 0.5, 0.8)
DELTA_LEVELS = (0.147, 0.33, 0.474)
R_LEVELS = (0.1, 0.3, 0.5)
ETA_LEVELS = (0.01, 0.06, 0.14)
DEGENERATE_CI = "gives no interval: nearly all replicates have one value; the percentile method still works"


def decision(p: Column, alpha: float) -> Column:
    return F.when(p < alpha, REJECT).when(p.isNotNull(), KEEP).otherwise("")


def magnitude(effect: Column, levels: tuple[float, float, float], scale: Column | float = 1.0) -> Column:
    """negligible / small / medium / large; '' when there is no effect size."""
    size = F.abs(effect) * scale
    small, medium, large = levels
    return (
        F.when(size < small, "negligible")
        .when(size < medium, "small")
        .when(size < large, "medium")
        .when(size.isNotNull(), "large")
        .otherwise("")
    )


def magnitude_v(v: Column, min_dim: Column) -> Column:
    """Cramér's V, with the cut-points divided by sqrt(min dimension - 1)."""
    return magnitude(v, R_LEVELS, F.sqrt(F.greatest(min_dim - 1, F.lit(1))))


def join_flags(*flags: Column) -> Column:
    """One text out of the flags that apply (NULL and '' are skipped)."""
    return F.array_join(F.filter(F.array(*flags), lambda f: f.isNotNull() & (f != "")), "; ")


def say(condition: Column, text: str, *values: Column) -> Column:
    return F.when(condition, F.format_string(text, *values) if values else F.lit(text))


def size_flag(smallest: Column) -> Column:
    n = smallest.cast("long")
    return F.when(
        n < 8, F.format_string("smallest group has %d values: only strong effects can show", n)
    ).when(n < 20, F.format_string("smallest group has %d values", n))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def fisher_interval(r: Column, n: Column, method: str, z: float, n_covar: int = 0) -> tuple[Column, Column]:
    """Fisher-z interval of a correlation; NULL at |r| = 1 or where n is too small."""
    used = n - n_covar
    spare = 4 if method == "kendall" else 3
    factor = {"pearson": 1.0, "spearman": 1.06, "kendall": 0.437}[method]
    ok = (F.abs(r) < 1) & (used > spare)
    se = F.sqrt(F.lit(factor) / F.when(ok, used - spare))
    mid = F.atanh(F.when(ok, r))
    return F.tanh(mid - z * se), F.tanh(mid + z * se)


def check_confidence(confidence: float) -> None:
    if not 0.0 < confidence < 1.0 or math.isnan(confidence):
        raise ValueError(f"confidence {confidence} is not between 0 and 1")
