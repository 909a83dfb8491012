"""Distributed order statistics: running counts, mid-ranks and exact quantiles.

A window without a partition would sort all rows in one task. Here equal values are first
counted (map-side combined), the distinct values are cut into ordered buckets by points
taken from a small hash sample, each bucket is summed in its own task, and the bucket
totals - at most one row per bucket and key - carry the running count across buckets.
The cut points are taken over (key, value), so one key that holds most of the data is
spread over the buckets like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.numeric import finite
from statloom.operators.stage import shared_folder

MAX_BUCKETS = 1024
SAMPLE_PER_BUCKET = 64
#: Rows of a per-key frame up to which each task gets all of it, and the parts of a key beyond.
SENT_ALONG = 50_000
PARTS_OF_KEY = 16
#: Keys are counted by so many parts of their hash; a part with more rows than this, and than twice
#: the usual beside, is busy. Which parts are busy changes no result.
KEY_PARTS = 16_384
BUSY_ROWS = 100_000


def histogram(df: DataFrame, value: str, by: list[str] = (), **counts: Column) -> DataFrame:
    """Distinct finite values per key with their counts (default: one count ``n``)."""
    counts = counts or {"n": F.count(F.lit(1))}
    rows = df.withColumn(value, finite(value)).filter(F.col(value).isNotNull())
    return rows.groupBy(*by, value).agg(*[c.alias(name) for name, c in counts.items()])


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate that several later steps read to the shared checkpoint folder.

    The folder is the one the session names; only a local session without one gets its own.
    """
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def attach(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a settled frame of one row per key to rows of which one key may hold most.

    A join by key would sort a key's rows in one task, and adaptive execution keeps to it where few
    partitions hold rows. A small frame is sent to every task instead; beside a larger one the rows
    of a key are spread by their hash over parts that each meet a copy of the key's row.
    """
    if few.limit(SENT_ALONG + 1).count() <= SENT_ALONG:
        return rows.join(F.broadcast(few), keys, how)
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS_OF_KEY - 1))).alias("_part")
    spread = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS_OF_KEY)).cast("int"))
    return spread.join(few.select("*", parts), [*keys, "_part"], how).drop("_part")


def split_busy(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose keys one task can sort, rows of parts of the key hash that hold too many or None).

    Only the counts per part are shuffled, so a table without a large key is read once more and no
    wide row moves for it.
    """
    part = F.pmod(F.xxhash64(*by), F.lit(KEY_PARTS)).cast("int")
    sizes = rows.groupBy(part.alias("part")).count().agg(F.sum("count").alias("n"), F.collect_list(F.struct("part", "count")).alias("all"))
    limit = BUSY_ROWS + 2 * F.col("n") / KEY_PARTS
    large = sizes.select(F.filter("all", lambda x: x["count"] > limit)["part"].alias("large")).first()["large"]
    if not large:
        return rows, None
    busy = part.isin(large)
    return rows.filter(~busy), rows.filter(busy)


def bucket_count(df: DataFrame) -> int:
    parts = max(1, min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return 2 ** math.ceil(math.log2(parts))


def with_bucket(hist: DataFrame, value: str, by: list[str], weights: list[str]) -> DataFrame:
    """Ordered bucket number of each (key, value) row, from deterministic cut points."""
    parts = bucket_count(hist)
    if parts == 1:
        return hist.withColumn("_bucket", F.lit(0))
    key = F.struct(*by, value) if by else F.col(value)
    # Every count takes part in both helpers so that all of them read the same exchange.
    size = hist.agg(F.count_if(sum(F.col(w) for w in weights) >= 0).alias("d")).scalar()
    every = F.greatest(F.lit(1), (size / (parts * SAMPLE_PER_BUCKET)).cast("long"))
    sampled = hist.filter(F.pmod(F.xxhash64(*by, value, *weights), every) == 0)
    cuts = sampled.agg(F.sort_array(F.collect_list(key)).alias("s")).select(
        F.transform(
            F.sequence(F.lit(1), F.lit(parts - 1)),
            lambda i: F.get("s", (i * F.size("s") / parts).cast("int")),
        )
    ).scalar()
    # Binary search in the 2^k - 1 cut points, one generated comparison per step.
    out = hist.withColumns({"_cuts": cuts, "_at0": F.lit(0)})
    step, at = parts // 2, 0
    while step:
        here = F.col(f"_at{at}")
        above = F.coalesce(F.get("_cuts", here + (step - 1)) < key, F.lit(False))
        out = out.withColumn(f"_at{at + 1}", here + F.when(above, step).otherwise(0))
        step, at = step // 2, at + 1
    bucket = F.col(f"_at{at}")
    # Never NULL, or the join below would push a NULL test down into the scan and split the exchange.
    out = out.withColumn("_bucket", F.coalesce(bucket, F.lit(0)))
    return out.drop("_cuts", *[f"_at{i}" for i in range(at + 1)])


def cumulate(
    hist: DataFrame, value: str, weights: list[str] = ("n",), by: list[str] = (), unique: bool = True, write: bool = True
) -> DataFrame:
    """Add ``<w>_below``, ``<w>_tied`` and ``<w>_total`` for every count column.

    below = count on smaller values of the same key, tied = count on this value,
    total = count of the whole key. With ``unique=False`` a value may have several rows
    (for instance one per group) and ties are summed over them. The counts are read four
    times, so they are written out first unless ``write=False``.
    """
    by, weights = list(by), list(weights)
    if write:
        hist = settle(hist)
    rows = with_bucket(hist, value, by, weights)
    sums = rows.groupBy(*by, "_bucket").agg(*[F.sum(w).alias(f"_{w}_sum") for w in weights])
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        F.col("_bucket").alias("_kb"),
        *[F.coalesce(F.sum(f"_{w}_sum").over(before), F.lit(0)).alias(f"_{w}_off") for w in weights],
        *[F.sum(f"_{w}_sum").over(whole).alias(f"{w}_total") for w in weights],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*by, "_bucket", value)
    rows = rows.withColumns({f"_{w}_le": F.sum(w).over(upto) for w in weights})
    tied = {w: F.col(w) if unique else F.sum(w).over(same) for w in weights}
    rows = rows.withColumns({f"{w}_tied": tied[w] for w in weights})
    match = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(by):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(offsets, match)
    joined = joined.withColumns(
        {f"{w}_below": F.col(f"_{w}_off") + F.col(f"_{w}_le") - F.col(f"{w}_tied") for w in weights}
    )
    junk = ["_bucket", "_kb", *[f"_k{i}" for i in range(len(by))]]
    junk += [f"_{w}_{s}" for w in weights for s in ("off", "le")]
    return joined.drop(*junk)


def mid_rank(w: str = "n") -> Column:
    return F.col(f"{w}_below") + (F.col(f"{w}_tied") + 1) / 2


def tie_term(w: str = "n") -> Column:
    """Aggregate Σ(t³ - t) over the tied runs of a unique ranked histogram."""
    t = F.col(f"{w}_tied").cast("double")
    return F.sum(t * t * t - t)


def quantile_at(p: float, value: str, w: str = "n") -> Column:
    """Aggregate: the linearly interpolated quantile of a ranked histogram."""
    pos = F.lit(p) * (F.col(f"{w}_total") - 1)
    below, upto = F.col(f"{w}_below"), F.col(f"{w}_below") + F.col(f"{w}_tied")

    def at(index: Column) -> Column:
        return F.max(F.when((F.col(w) > 0) & (below <= index) & (index < upto), F.col(value)))

    share = F.max(pos - F.floor(pos))
    low = at(F.floor(pos))
    return low + F.when(share > 0, (at(F.ceil(pos)) - low) * share).otherwise(F.lit(0.0))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Exact quantiles per key, one column per name, without gathering a key in one task."""
    ranked = cumulate(histogram(df, value, by), value, by=by)
    aggs = [quantile_at(p, value).alias(name) for name, p in probs.items()]
    return ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)


def rank_table(df: DataFrame, value: str, out: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """(by…, value, out): average rank of every distinct value within its key, to be joined on the value."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    ranked = cumulate(histogram(df, value, by, n=n), value, by=by)
    return ranked.select(*by, value, mid_rank().alias(out))


def add_dense_rank(cells: DataFrame, value: str, out: str, by: list[str] = ()) -> DataFrame:
    """0-based position of each value among the distinct values of its key."""
    distinct = histogram(cells, value, by, n=F.lit(1) * F.max(F.lit(1)))
    ranks = cumulate(distinct, value, by=by).select(*by, value, F.col("n_below").alias(out))
    return cells.join(ranks, [*by, value])


def row_place(df: DataFrame, order: list[Column], by: list[str] = (), out: str = "place") -> DataFrame:
    """1-based place of every row within its key, spread over ordered buckets; no two rows share one.

    Rows tied in the order are placed by a hash of their values, which is part of what the buckets
    are cut by: a tie of any length spreads like distinct values. Only rows alike in every column
    stay together, and they are interchangeable.
    """
    by = list(by)
    rows = df.withColumns({"_key": F.struct(*order, F.xxhash64(*df.columns)), "_w": F.lit(1)})
    rows = with_bucket(rows, "_key", by, ["_w"])
    sizes = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = by_window(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_bucket").alias("_kb"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"),
    )
    match = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(by):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key")
    placed = rows.withColumn("_at", F.row_number().over(inside)).join(offsets, match)
    return placed.select(*df.columns, (F.col("_off") + F.col("_at")).alias(out))


def by_window(by: list[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def running_extreme(
    rows: DataFrame, value: str, measure: str, out: str, by: list[str] = (), smallest_above: bool = False
) -> DataFrame:
    """Running maximum of ``measure`` up to each value, or its minimum from each value on.

    Like ``cumulate``: inside ordered buckets first, then over one row per bucket.
    """
    by = list(by)
    placed = with_bucket(rows, value, by, ["n"])
    agg = F.min if smallest_above else F.max
    frame = (Window.currentRow, Window.unboundedFollowing) if smallest_above else (Window.unboundedPreceding, Window.currentRow)
    rest = (1, Window.unboundedFollowing) if smallest_above else (Window.unboundedPreceding, -1)
    ends = placed.groupBy(*by, "_bucket").agg(agg(measure).alias("_end"))
    chain = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_bucket").rowsBetween(*rest)
    ends = ends.withColumn("_outside", agg("_end").over(chain)).drop("_end")
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(*frame)
    joined = placed.withColumn("_inside", agg(measure).over(inside)).join(ends, [*by, "_bucket"])
    both = F.least("_inside", "_outside") if smallest_above else F.greatest("_inside", "_outside")
    return joined.withColumn(out, both).drop("_bucket", "_inside", "_outside")


def smallest_gap(df: DataFrame, value: str) -> DataFrame:
    """(n_distinct, min_gap): distinct values and the smallest step between neighbours."""
    rows = with_bucket(histogram(df, value).withColumnRenamed(value, "value"), "value", [], ["n"])
    inside = Window.partitionBy("_bucket").orderBy("value")
    gaps = rows.withColumn("gap", F.lead("value").over(inside) - F.col("value"))
    per = gaps.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("d"), F.min("gap").alias("gap"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    # One row per bucket: the steps across bucket borders.
    chain = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    per = per.withColumn("gap", F.least("gap", F.lead("lo").over(chain) - F.col("hi")))
    return per.agg(F.sum("d").alias("n_distinct"), F.min("gap").alias("min_gap"))
