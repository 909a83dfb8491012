"""Declarative data-quality checks; every check returns a small report frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expected_tables(spark: SparkSession, found: list[str], expected: list[str]) -> DataFrame:
    """(table, status): missing and unexpected names; empty when all is well."""
    rows = [(t, "missing") for t in sorted(set(expected) - set(found))]
    rows += [(t, "unexpected") for t in sorted(set(found) - set(expected))]
    return spark.createDataFrame(rows, "table string, status string")


def orphan_count(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_keys: list[str], name: str = "") -> DataFrame:
    """(constraint, n_orphans): child rows whose complete key has no parent.

    The child is counted per key before the join, so a key that fills a third of the table
    travels once.
    """
    rows = child.dropna(subset=child_keys).groupBy(*child_keys).agg(F.count(F.lit(1)).alias("_n"))
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, child_keys)]).distinct()
    lost = rows.join(keys, child_keys, "left_anti")
    label = name or ",".join(child_keys)
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_orphans")).select(F.lit(label).alias("constraint"), "n_orphans")


def foreign_key_report(tables: dict[str, DataFrame], keys: list[tuple[str, list[str], str, list[str]]]) -> DataFrame:
    parts = [
        orphan_count(tables[c], ck, tables[p], pk, f"{c}({','.join(ck)}) -> {p}({','.join(pk)})") for c, ck, p, pk in keys
    ]
    return reduce(DataFrame.unionByName, parts)


def key_check(df: DataFrame, keys: list[str], table: str = "") -> DataFrame:
    """(table, n_duplicates, n_null_keys): rows beyond the first per key, rows with an incomplete key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    gone = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return counts.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum(F.when(gone, F.col("_n")).otherwise(0)), F.lit(0)).alias("n_null_keys"),
    ).select(F.lit(table).alias("table"), "n_duplicates", "n_null_keys")


def row_floors(tables: dict[str, DataFrame], floors: dict[str, int]) -> DataFrame:
    """(table, rows, floor, delta, ok) for every table with a floor."""
    parts = [
        tables[t].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows", F.lit(f).cast("long").alias("floor"))
        for t, f in floors.items()
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumns({"delta": F.col("rows") - F.col("floor"), "ok": F.col("rows") >= F.col("floor")})


def domain_offenders(df: DataFrame, column: str, allowed: list, top: int = 3) -> DataFrame:
    """(column, value, n): the most frequent values outside the allowed set."""
    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed))
    counted = bad.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "value").limit(top).select(F.lit(column).alias("column"), "value", "n")


def domain_check(df: DataFrame, domains: dict[str, list]) -> DataFrame:
    """(column, n_outside) for every column with a vocabulary, in one pass."""
    rules = {c: f"{c} in vocabulary" for c in domains}
    bad = {c: F.col(c).isNotNull() & ~F.col(c).isin(v) for c, v in domains.items()}
    out = _counts(df, {rules[c]: bad[c] for c in domains})
    return out.select(F.regexp_replace("rule", " in vocabulary$", "").alias("column"), F.col("n_violations").alias("n_outside"))


def _counts(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    names = list(broken)
    one = df.agg(*[F.count_if(broken[n]).alias(f"c{i}") for i, n in enumerate(names)])
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("n_violations")) for i, n in enumerate(names)])
    return one.select(F.explode(each).alias("e")).select("e.*")


def check_rules(
    df: DataFrame, checks: dict[str, str] | None = None, not_null: list[str] = (), widths: dict[str, int] | None = None
) -> DataFrame:
    """(rule, n_violations) of all CHECK, NOT NULL and width rules of a table, in one pass.

    A CHECK fails only where its predicate is false; unknown (NULL) passes.
    """
    broken: dict[str, Column] = {}
    for name, predicate in (checks or {}).items():
        broken[name] = ~F.expr(predicate)
    for c in not_null:
        broken[f"{c} not null"] = F.col(c).isNull()
    for c, width in (widths or {}).items():
        broken[f"length({c}) <= {width}"] = F.length(F.col(c).cast("string")) > width
    return _counts(df, broken)


def assert_grain(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Fail the build if a mart has more than one row per key or an incomplete key; returns it unchanged."""
    bad = key_check(df, keys, table).first()
    if bad["n_duplicates"] or bad["n_null_keys"]:
        raise ValueError(f"{table}: {bad['n_duplicates']} duplicate and {bad['n_null_keys']} incomplete keys on {keys}")
    return df


def change_report(before: DataFrame, after: DataFrame, key: list[str], column: str) -> DataFrame:
    """The rows whose text differs between two versions: (key…, before, after)."""
    old = before.select(*key, F.col(column).alias("before"))
    new = after.select(*key, F.col(column).alias("after"))
    return old.join(new, key).filter(~F.col("before").eqNullSafe(F.col("after")))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Grouped counts for a spot check."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def stint_profile(df: DataFrame, season: str, player: str) -> DataFrame:
    """(n_keys, n_with_total, n_multi_club, n_bad_primary) of a table with stint and is_primary."""
    per = df.groupBy(season, player).agg(
        F.count_if(F.col("stint") == 0).alias("totals"), F.max("stint").alias("clubs"), F.count_if("is_primary").alias("primary")
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("totals") > 0).alias("n_with_total"),
        F.count_if(F.col("clubs") > 1).alias("n_multi_club"), F.count_if(F.col("primary") != 1).alias("n_bad_primary"),
    )


def verdict(checks: dict[str, DataFrame]) -> DataFrame:
    """(n_checks, failures, verdict) over reports given as one-column failure counts."""
    parts = [c.select(F.lit(name).alias("check"), F.col(c.columns[-1]).cast("long").alias("failures")) for name, c in checks.items()]
    total = reduce(DataFrame.unionByName, parts).groupBy("check").agg(F.sum("failures").alias("failures"))
    return total.agg(F.count(F.lit(1)).alias("n_checks"), F.sum("failures").alias("failures")).withColumn(
        "verdict", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL")
    )
