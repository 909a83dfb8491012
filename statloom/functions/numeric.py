"""Numeric helpers shared by the operators: finite values, safe ratios, column resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


NUDGE = 1 + 1e-12


def finite(c: Column | str) -> Column:
    """The value as a double, NULL where it is missing, unparseable, NaN or infinite."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_ratio(num: Column, den: Column, digits: int, scale: float = 1) -> Column:
    """num / den * scale rounded half-up as decimals are; NULL instead of a division by zero.

    A decimal half such as 3174.735 is often a hair smaller in binary; the nudge is far below
    any digit the inputs carry and puts it back on the half.
    """
    den = den.cast("double")
    ratio = num.cast("double") / F.when(den != 0, den) * scale
    return F.round(ratio * NUDGE, digits)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Decimal columns count as numbers everywhere, so they become doubles on entry."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}; the table starts with {df.columns[:20]}")


def numeric_columns(
    df: DataFrame, cols: list[str] | None = None, ignore_cols: list[str] | None = None
) -> list[str]:
    """Columns that hold numbers: numeric types, and text whose every value parses. Never booleans."""
    ignore = set(ignore_cols or [])
    if cols is not None:
        require_columns(df, cols)
    chosen = [c for c in (cols or df.columns) if c not in ignore]
    kinds = {f.name: f.dataType for f in df.schema}
    text = [c for c in chosen if isinstance(kinds[c], T.StringType)]
    if text:
        # One pass over all text columns: some value present and none that fails to parse.
        probe = df.agg(
            *[
                (
                    (F.count(c) > 0) & (F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) == 0)
                ).alias(c)
                for c in text
            ]
        ).first()
        text = [c for c in text if probe[c]]
    numeric = [c for c in chosen if isinstance(kinds[c], T.NumericType) or c in text]
    if not numeric:
        raise ValueError("no numeric columns to work on")
    return numeric


def melt(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Long form (column, value) of the finite values of several columns."""
    wide = df.select(*keep, *[finite(c).alias(c) for c in cols])
    return wide.unpivot(list(keep), cols, "column", "value")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; NULL (where Spark's own corr fails) if a column is constant."""
    both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(both_x) * F.stddev_pop(both_y)
    return F.covar_pop(both_x, both_y) / F.when(spread > 0, spread)
