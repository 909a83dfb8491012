"""Group levels, group moments, and the variance tests built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.labels import decision, join_flags, say, size_flag
from statloom.functions.numeric import finite, require_columns
from statloom.operators.ranks import attach, cumulate, histogram, quantile_at, settle


def by_key(df: DataFrame, by: list[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def samples(df: DataFrame, group: str, value: str, order: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """Finite observations as (by…, grp, value) with the group as text."""
    require_columns(df, [group, value, *by])
    rows = df.select(*by, F.col(group).cast("string").alias("grp"), finite(value).alias("value"))
    rows = rows.filter(F.col("grp").isNotNull() & F.col("value").isNotNull())
    return rows.filter(F.col("grp").isin([str(o) for o in order])) if order else rows


def group_levels(rows: DataFrame, min_group_n: int, order: list[str] | None = None, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(levels, summary): one row per kept group, and one row per key.

    levels: grp, n, mean, var, and the group's position in the given or alphabetical order.
    summary: n_groups, n_min, n_max, group_sizes, comparison, and ``dropped``, the groups
    with fewer than ``min_group_n`` values by name.
    """
    stats = rows.groupBy(*by, "grp").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )
    place = F.array_position(F.array(*[F.lit(str(o)) for o in order]), F.col("grp")) if order else F.col("grp")
    stats = stats.withColumn("p", place)
    low = F.col("n") < min_group_n

    def names(keep: Column, text: Column) -> Column:
        found = F.sort_array(F.collect_list(F.when(keep, F.struct("p", text.alias("t")))))
        return F.transform(found, lambda x: x["t"])

    dropped = names(low, F.format_string("%s(n=%d)", "grp", "n"))
    summary = stats.groupBy(*by).agg(
        F.count_if(~low).alias("n_groups"),
        F.min(F.when(~low, F.col("n"))).alias("n_min"),
        F.max(F.when(~low, F.col("n"))).alias("n_max"),
        F.array_join(names(~low, F.format_string("%s=%d", "grp", "n")), "; ").alias("group_sizes"),
        F.array_join(names(~low, F.col("grp")), " | ").alias("comparison"),
        F.when(F.size(dropped) > 0, F.concat(F.lit("groups left out as too small: "), F.array_join(dropped, ", "))).alias("dropped"),
    )
    levels = stats.filter(~low).withColumn("pos", F.row_number().over(by_key(stats, by).orderBy("p"))).drop("p")
    return levels, summary


def keep_groups(rows: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    return attach(rows, levels.select(*by, "grp"), [*by, "grp"], "left_semi")


def trim_weight(share: float) -> Column:
    """How many of a ranked value's observations survive cutting ``share`` off both tails."""
    cut = F.floor(F.lit(share) * F.col("n_total"))
    upper = F.least(F.col("n_below") + F.col("n_tied"), F.col("n_total") - cut)
    return F.greatest(F.lit(0), upper - F.greatest(F.col("n_below"), cut))


def centred_deviations(rows: DataFrame, center: str, by: list[str] = ()) -> DataFrame:
    """(by…, grp, dev, w): absolute distances to the group centre with their counts."""
    keys = [*by, "grp"]
    hist = histogram(rows, "value", keys)
    if center == "mean":
        ranked = settle(hist).withColumn("w", F.col("n"))
    else:
        ranked = settle(cumulate(hist, "value", by=keys))
        # Trimmed centring cuts 5 % off both tails of the sample itself.
        ranked = ranked.withColumn("w", trim_weight(0.05) if center == "trimmed" else F.col("n"))
    mid = quantile_at(0.5, "value") if center == "median" else F.sum(F.col("w") * F.col("value")) / F.sum("w")
    centres = settle(ranked.groupBy(*keys).agg(mid.alias("centre")))
    out = attach(ranked, centres, keys).withColumn("dev", F.abs(F.col("value") - F.col("centre")))
    return out.filter("w > 0").select(*keys, "dev", "w")


def levene(rows: DataFrame, center: str, by: list[str] = ()) -> DataFrame:
    """(by…, statistic, p_value): one-way F test on the deviations from the group centres."""
    w, dev = F.col("w"), F.col("dev")
    each = (
        centred_deviations(rows, center, by)
        .groupBy(*by, "grp")
        .agg(F.sum("w").alias("m"), (F.sum(w * dev) / F.sum("w")).alias("z"), F.sum(w * dev * dev).alias("q"))
    )
    each = each.withColumn("ss", F.col("q") - F.col("m") * F.col("z") * F.col("z"))
    grand = F.sum(F.col("m") * F.col("z")) / F.sum("m")
    tot = each.groupBy(*by).agg(
        F.sum("m").alias("nn"), F.count(F.lit(1)).alias("k"), F.sum("ss").alias("ssw"), grand.alias("g"),
        F.sum(F.col("m") * F.col("z") * F.col("z")).alias("mz"),
    )
    ssb = F.col("mz") - F.col("nn") * F.col("g") * F.col("g")
    stat = (F.col("nn") - F.col("k")) / (F.col("k") - 1) * ssb / F.when(F.col("ssw") > 0, F.col("ssw"))
    tot = tot.withColumn("statistic", stat)
    p = dist.f_tail(F.col("statistic"), F.col("k") - 1, F.col("nn") - F.col("k"))
    return tot.withColumn("p_value", p).select(*by, "statistic", "p_value")


def fligner(rows: DataFrame, center: str, by: list[str] = ()) -> DataFrame:
    """Fligner-Killeen: normal scores of the ranked deviations, compared between the groups."""
    devs = settle(centred_deviations(rows, center, by).groupBy(*by, "grp", "dev").agg(F.sum("w").alias("n")))
    ranked = cumulate(devs, "dev", by=by, unique=False)
    rank = F.col("n_below") + (F.col("n_tied") + 1) / 2
    score = dist.normal_quantile(0.5 + rank / (2 * (F.col("n_total") + 1)))
    scored = ranked.withColumn("a", score)
    each = scored.groupBy(*by, "grp").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.col("a")).alias("s"), F.sum(F.col("n") * F.col("a") ** 2).alias("q")
    )
    tot = each.groupBy(*by).agg(
        F.sum("m").alias("nn"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") ** 2 / F.col("m")).alias("b"),
    )
    shift = F.col("s") ** 2 / F.col("nn")
    tot = tot.withColumn("statistic", (F.col("b") - shift) / ((F.col("q") - shift) / (F.col("nn") - 1)))
    p = dist.chi2_tail(F.col("statistic"), F.col("k") - 1)
    return tot.withColumn("p_value", p).select(*by, "statistic", "p_value")


def bartlett(levels: DataFrame, by: list[str] = ()) -> DataFrame:
    free = F.col("n") - 1
    tot = levels.groupBy(*by).agg(
        F.sum(free).alias("f"), F.count(F.lit(1)).alias("k"), F.sum(free * F.col("var")).alias("ss"),
        F.sum(free * F.log("var")).alias("lv"), F.sum(1 / free).alias("inv"), F.min("var").alias("lo"),
    )
    pooled = F.col("ss") / F.col("f")
    top = F.col("f") * F.log(pooled) - F.col("lv")
    bottom = 1 + (F.col("inv") - 1 / F.col("f")) / (3 * (F.col("k") - 1))
    tot = tot.withColumn("statistic", F.when(F.col("lo") > 0, top / bottom))
    p = dist.chi2_tail(F.col("statistic"), F.col("k") - 1)
    return tot.withColumn("p_value", p).select(*by, "statistic", "p_value")


def join_by(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join two per-key result frames; without keys both hold a single row."""
    if by:
        return left.join(right, list(by))
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def variance_test(
    df: DataFrame,
    group_col: str,
    value_col: str,
    method: str = "levene",
    center: str = "median",
    alpha: float = 0.05,
    min_group_n: int = 2,
    order: list[str] | None = None,
    by: list[str] = (),
) -> DataFrame:
    """Test whether groups share a common variance: levene, bartlett or fligner."""
    if method not in ("levene", "bartlett", "fligner"):
        raise ValueError(f"unknown method '{method}'")
    by = list(by)
    rows = samples(df, group_col, value_col, order, by)
    levels, summary = map(settle, group_levels(rows, min_group_n, order, by))
    if method == "bartlett":
        test = bartlett(levels, by)
    else:
        test = (levene if method == "levene" else fligner)(keep_groups(rows, levels, by), center, by)
    shape = levels.groupBy(*by).agg(F.sum("n").alias("n"), F.max("var").alias("vmax"), F.min("var").alias("vmin"))
    out = join_by(join_by(shape, summary, by), test, by).withColumn(
        "max_var_ratio", F.when(F.col("vmin") > 0, F.col("vmax") / F.col("vmin"))
    )
    ratio = F.col("max_var_ratio")
    enough = F.when(F.col("n_groups") >= 2, F.col("n_groups")).otherwise(
        F.raise_error(F.lit(f"two groups or more must have {min_group_n} values"))
    )
    note = {
        "bartlett": F.lit("Bartlett takes long tails for spread; Levene does not"),
        "levene": F.lit(f"deviations from the {center}: sharper, but outliers weigh more") if center != "median" else F.lit(None),
    }.get(method, F.lit(None))
    flags = join_flags(
        F.col("dropped"),
        note.cast("string"),
        say(ratio > 4, "largest variance is %.1f times the smallest: compare by welch or welch_anova", ratio),
        say(
            (F.col("n_max") / F.col("n_min") > 1.5) & (ratio > 2),
            "groups differ in size and in spread: plain anova misjudges its p here",
        ),
        size_flag(F.col("n_min")),
    )
    return out.select(
        *by,
        F.lit("bartlett" if method == "bartlett" else f"{method}({center})").alias("test"),
        enough.alias("n_groups"),
        "n",
        "group_sizes",
        "statistic",
        "p_value",
        decision(F.col("p_value"), alpha).alias("decision"),
        "max_var_ratio",
        flags.alias("flags"),
    )
