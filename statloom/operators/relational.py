"""Relational building blocks of the analyses: reports, labels, rankings, reconciliation, re-weighting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.numeric import finite
from statloom.operators.ranks import row_place


def coverage_report(tables: dict[str, tuple[DataFrame, str | None, str | None]]) -> DataFrame:
    """(relation, n_rows, first_period, last_period, n_entities); relations without a column get typed NULLs."""
    parts = []
    for name, (df, period, entity) in tables.items():
        parts.append(
            df.agg(
                F.lit(name).alias("relation"),
                F.count(F.lit(1)).alias("n_rows"),
                (F.min(period) if period else F.lit(None)).cast("long").alias("first_period"),
                (F.max(period) if period else F.lit(None)).cast("long").alias("last_period"),
                (F.countDistinct(entity) if entity else F.lit(None)).cast("long").alias("n_entities"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def count_distinct_rows(*cols: str) -> Column:
    """Distinct value combinations, counting those with NULL parts (plain countDistinct drops them)."""
    return F.countDistinct(F.struct(*cols))


def missing_report(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, n_rows, n_known, n_missing, pct_missing)."""
    n, known = F.count(F.lit(1)), F.count(column)
    return df.groupBy(group).agg(
        n.alias("n_rows"), known.alias("n_known"), (n - known).alias("n_missing"), F.round(100.0 * (n - known) / n, 1).alias("pct_missing")
    )


def rank_within(df: DataFrame, by: list[str], measure: str, tie_break: list[str], out: str = "points_rank") -> DataFrame:
    """Place by descending measure within each key, ties in the order of ``tie_break`` (unique together)."""
    order = [(-F.col(measure)).alias("m"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie_break)]]
    return row_place(df, order, by, out)


def label_populations(df: DataFrame, labels: dict[str, Column], out: str = "population") -> DataFrame:
    """One row per label a row belongs to; a row may carry several labels. One scan."""
    each = F.array(*[F.when(cond, F.lit(name)) for name, cond in labels.items()])
    return df.withColumn(out, F.explode(F.filter(each, lambda x: x.isNotNull())))


def set_composition(df: DataFrame, entity: str, a: Column, b: Column) -> DataFrame:
    """(part, n_rows, n_entities) for A, B, A∩B and A−B."""
    parts = label_populations(df, {"A": a, "B": b, "A and B": a & b, "A only": a & ~F.coalesce(b, F.lit(False))}, "part")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("n_entities"))


def composite_ranking(df: DataFrame, entity: str, rank: str, top_n: int) -> DataFrame:
    """(place, entity, appearances, mean_rank, best_rank): most appearances, then best mean rank, then name."""
    per = df.groupBy(F.col(entity).alias("entity")).agg(
        F.count(F.lit(1)).alias("appearances"), F.avg(rank).alias("mean_rank"), F.min(rank).alias("best_rank")
    )
    order = [F.col("appearances").desc(), F.col("mean_rank").asc(), F.col("entity").asc()]
    top = per.orderBy(*order).limit(top_n)
    # Numbering runs over the N kept rows only.
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def cut(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], …; NULL outside."""
    out = F.when((c > edges[0]) & (c <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:], edges[2:], labels[1:]):
        out = out.when((c > low) & (c <= high), label)
    return out


def disagreement(df: DataFrame, entity: str, first: Column, second: Column) -> DataFrame:
    """Entities for which two readings of a rule count differently."""
    per = df.groupBy(entity).agg(F.count_if(first).alias("n_first"), F.count_if(second).alias("n_second"))
    return per.filter(F.col("n_first") != F.col("n_second"))


def reconcile(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """(comparable, agree, mismatch, missing_a, missing_b, n_rows) between two sources of one fact."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.groupBy(*by).agg(
        F.count_if(both).alias("comparable"),
        F.count_if(both & (F.col(a) == F.col(b))).alias("agree"),
        F.count_if(both & (F.col(a) != F.col(b))).alias("mismatch"),
        F.count_if(F.col(a).isNull()).alias("missing_a"),
        F.count_if(F.col(b).isNull()).alias("missing_b"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def align(keys: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Values attached to a key list; keys without a value get NULL, values without a key are left out."""
    return keys.join(values, key, "left")


def pivot_table(df: DataFrame, index: str, column: str, levels: list, aggs: dict[str, Column], thresh: int | None = None) -> DataFrame:
    """index × column table of aggregates; ``thresh`` keeps rows with at least that many filled cells."""
    out = df.groupBy(index).pivot(column, levels).agg(*[c.alias(n) for n, c in aggs.items()])
    if thresh is None:
        return out
    cells = [c for c in out.columns if c != index]
    return out.filter(sum(F.col(c).isNotNull().cast("int") for c in cells) >= thresh)


def standardised_gap(df: DataFrame, group: str, stratum: str, value: str, a: str, b: str) -> DataFrame:
    """Mean gap of a and b split into within-stratum and mix effects.

    The standardised mean of ``a`` weights its stratum means by the stratum shares of ``b``.
    """
    rows = df.filter(F.col(group).isin(a, b)).select(F.col(group).alias("g"), F.col(stratum).alias("s"), finite(value).alias("v")).dropna()
    is_a, v = F.col("g") == a, F.col("v")
    per = rows.groupBy("s").agg(
        F.avg(F.when(is_a, v)).alias("ma"), F.avg(F.when(~is_a, v)).alias("mb"),
        F.count_if(is_a).alias("na"), F.count_if(~is_a).alias("nb"),
    )
    both = F.col("ma").isNotNull() & F.col("mb").isNotNull()
    weight = F.when(both, F.col("nb"))
    crude_a = F.sum(F.col("ma") * F.col("na")) / F.sum("na")
    crude_b = F.sum(F.col("mb") * F.col("nb")) / F.sum("nb")
    std_a = F.sum(F.col("ma") * weight) / F.sum(weight)
    std_b = F.sum(F.col("mb") * weight) / F.sum(weight)
    out = per.agg(crude_a.alias("mean_a"), crude_b.alias("mean_b"), std_a.alias("std_a"), std_b.alias("std_b"))
    out = out.withColumns({"gap": F.col("mean_a") - F.col("mean_b"), "within_gap": F.col("std_a") - F.col("std_b")})
    return out.withColumn("mix_gap", F.col("gap") - F.col("within_gap")).select("mean_a", "mean_b", "gap", "within_gap", "mix_gap")


def overlap(df: DataFrame, entity: str, group: str) -> DataFrame:
    """(group, n_rows, n_shared_rows, pct_shared): rows of entities seen in more than one group."""
    # Counted per (entity, group) first; an entity then has one row per group it appears in.
    per = df.groupBy(entity, group).agg(F.count(F.lit(1)).alias("_n"))
    spread = per.groupBy(entity).agg(F.count(F.lit(1)).alias("_groups"))
    rows = per.join(spread, entity)
    shared = F.sum(F.when(F.col("_groups") > 1, F.col("_n")).otherwise(0))
    return rows.groupBy(F.col(group).alias("group")).agg(
        F.sum("_n").alias("n_rows"), shared.alias("n_shared_rows"), (shared / F.sum("_n") * 100).alias("pct_shared")
    )


def shared_entities(df: DataFrame, entity: str, group: str) -> DataFrame:
    """Entities present in more than one group."""
    per = df.select(entity, group).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n_groups"))
    return per.filter("n_groups > 1")


def inconstant_entities(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Entities whose value is not the same in all their rows."""
    per = df.filter(F.col(value).isNotNull()).select(entity, value).distinct().groupBy(entity)
    return per.agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")


def threshold_share(df: DataFrame, group: str, value: str, cut_point: float, entity: str) -> DataFrame:
    """(group, n_rows, n_at_least, share, n_entities) at or above a cut point."""
    hit = F.col(value) >= cut_point
    return df.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_at_least"),
        (F.count_if(hit) / F.count(F.lit(1))).alias("share"), F.countDistinct(F.when(hit, F.col(entity))).alias("n_entities"),
    )


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.sum(sum(F.col(c).isNull().cast("int") for c in columns)).alias("n_missing_cells"))
