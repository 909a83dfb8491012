"""Row-level cleaning: filters with audits, stints, complete dimensions, child tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.text import TOTAL_TEAM_ID, clean_id, position_code, split_positions, strip
from statloom.operators.ranks import row_place, split_busy

SOURCE_ROW = "_src_row"


def with_source_row(df: DataFrame, name: str = SOURCE_ROW, from_files: bool = False) -> DataFrame:
    """Remember the order rows were read in; call it right after the scan.

    Splits of several files are not scanned in name order, so for a file scan the order is
    (file, position of the split, row).
    """
    row = F.monotonically_increasing_id()
    if from_files:
        row = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), row.alias("row"))
    return df.withColumn(name, row)


def drop_blank_key(df: DataFrame, key: str) -> DataFrame:
    """Keep the rows whose key is neither missing nor blank."""
    return df.filter(F.col(key).isNotNull() & (strip(F.col(key).cast("string")) != ""))


def drop_league_average_rows(df: DataFrame, player_id: str) -> tuple[DataFrame, DataFrame]:
    """The table without its summary lines, and a one-row frame with the number dropped."""
    ident = strip(F.col(player_id).cast("string"))
    dropped = df.agg(F.count_if(ident.isNull() | (ident == "")).alias("n_dropped"))
    return drop_blank_key(df, player_id), dropped


def add_stint_columns(
    df: DataFrame, season: str, player: str, team: str, source_row: list[str] = (SOURCE_ROW,), tie: str | None = None
) -> DataFrame:
    """Number a player's clubs within a season and mark one row per player-season as primary.

    The combined line (team 'tot') gets stint 0 and is primary where it exists; otherwise the
    first club is. ``source_row`` gives the order the source lists the rows in; rows tied in it are
    ordered by a hash of their values (or by the column ``tie``), so that every club has a stint of its own.
    """
    rows = df.withColumn("_combined", F.coalesce(F.col(team) == TOTAL_TEAM_ID, F.lit(False)))
    usual, busy = split_busy(rows, [season, player])
    # The combined line comes first, so running values know of it on every row: one exchange, one sort,
    # which compares players first as they differ more than seasons.
    order = [F.desc("_combined"), *[F.col(c) for c in source_row], F.col(tie) if tie else F.xxhash64(*rows.columns)]
    upto = Window.partitionBy(player, season).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = usual.withColumns({"_has": F.max("_combined").over(upto), "_place": F.sum((~F.col("_combined")).cast("int")).over(upto)})
    if busy is not None:
        placed = placed.unionByName(_placed_in_buckets(busy, season, player, [*source_row, *([tie] if tie else [])]))
    out = placed.withColumn("stint", F.when(F.col("_combined"), F.lit(0)).otherwise(F.col("_place").cast("int")))
    primary = F.col("_combined") | (~F.col("_has") & (F.col("stint") == 1))
    return out.withColumn("is_primary", primary).drop("_combined", "_has", "_place")


def _placed_in_buckets(rows: DataFrame, season: str, player: str, source_row: list[str]) -> DataFrame:
    """Rows of keys of any size with ``_has`` and ``_place``: ordered buckets over (key, order) spread them."""
    order = [F.col(c).alias(f"o{i}") for i, c in enumerate(source_row)]
    placed = row_place(rows, order, [season, player, "_combined"], "_place")
    has = rows.groupBy(F.col(season).alias("_s"), F.col(player).alias("_p")).agg(F.max("_combined").alias("_has"))
    same = F.col(season).eqNullSafe(F.col("_s")) & F.col(player).eqNullSafe(F.col("_p"))
    return placed.join(has, same).drop("_s", "_p")


def collect_keys(tables: list[DataFrame], key: str, out: str | None = None) -> DataFrame:
    """Distinct non-null keys over all tables that carry the column."""
    parts = [t.select(F.col(key).alias(out or key)) for t in tables if key in t.columns]
    if not parts:
        raise KeyError(f"No table carries '{key}'")
    return reduce(DataFrame.unionByName, parts).dropna().distinct()


def complete_dimension(
    detail: DataFrame, key: str, referenced: DataFrame, flag: str, sentinels: list = ()
) -> DataFrame:
    """Every key that is described or referenced anywhere, with the attributes known for it."""
    keys = detail.select(key).dropna().unionByName(referenced.select(key).dropna())
    if sentinels:
        kind = detail.schema[key].dataType
        fixed = detail.sparkSession.createDataFrame([(s,) for s in sentinels], "k string")
        keys = keys.unionByName(fixed.select(F.col("k").cast(kind).alias(key)))
    known = detail.withColumn("_known", F.lit(True))
    out = keys.distinct().join(known, key, "left")
    return out.withColumn(flag, F.col("_known").isNotNull()).drop("_known")


def latest_value(df: DataFrame, key: str, order: str, value: str, out: str | None = None) -> DataFrame:
    """Last non-null value per key; a tie in the order goes to the larger value."""
    known = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull())
    return known.groupBy(key).agg(F.max(F.struct(order, value))[value].alias(out or value))


def first_value(df: DataFrame, key: str, order: list[str], value: str, out: str | None = None) -> DataFrame:
    """First non-null value per key in the given order."""
    known = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull())
    return known.groupBy(key).agg(F.min(F.struct(*order, value))[value].alias(out or value))


def fill_from_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """Missing values taken from a lookup table; a value that is there wins."""
    other = lookup.select(key, F.col(value).alias("_fill"))
    return df.join(other, key, "left").withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


def merge_sources(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key out of several sources, column by column: the first source with a value gives it.

    A source may lack columns; of several rows of one key in it the smallest value counts. Added are
    ``n_sources``, how many know the key, and ``n_conflicts``, in how many columns values differ.
    Rows without a whole key are left out. One aggregation, combined before the shuffle.
    """
    columns = list(dict.fromkeys(c for s in sources for c in s.columns if c not in keys))
    parts = [
        s.select(*keys, F.lit(i).alias("_source"), *[F.col(c).alias(c) for c in s.columns if c not in keys]) for i, s in enumerate(sources)
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).dropna(subset=keys)
    first = {c: F.min(F.when(F.col(c).isNotNull(), F.struct("_source", F.col(c).alias("v")))).alias(c) for c in columns}
    differ = [F.coalesce(F.min(c) < F.max(c), F.lit(False)).cast("int") for c in columns]
    out = rows.groupBy(*keys).agg(*first.values(), F.size(F.collect_set("_source")).alias("n_sources"), reduce(Column.__add__, differ, F.lit(0)).alias("n_conflicts"))
    return out.select(*keys, *[F.col(f"{c}.v").alias(c) for c in columns], "n_sources", "n_conflicts")


def distinct_lookup(df: DataFrame, columns: list[str], required: list[str]) -> DataFrame:
    return df.select(*columns).dropna(subset=required).distinct()


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on several keys; unmatched rows stay with NULLs."""
    return df.join(lookup.distinct(), keys, "left")


def unresolved_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_unresolved"))


def explode_positions(df: DataFrame, key: str, cell: str) -> DataFrame:
    """(key, slot, position, position_code) with slots numbered after empty tokens are gone."""
    out = df.select(key, F.posexplode(split_positions(F.col(cell))).alias("slot", "position"))
    out = out.withColumn("slot", F.col("slot") + 1)
    return out.withColumn("position_code", position_code(F.col("position")))


def first_child(children: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The child in slot 1 as an attribute of its parent."""
    return children.filter("slot = 1").select(key, F.col(value).alias(out))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key in an explicit order (``dropDuplicates`` keeps an arbitrary one).

    An aggregate rather than a window: rows of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def project_sorted(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return df.select(*columns).orderBy(*keys)


def audit(table: str, before: DataFrame, after: DataFrame, reason: str) -> DataFrame:
    """(table, rows_in, rows_out, rows_dropped, rows_added, reason): one row."""
    sizes = before.agg(F.count(F.lit(1)).alias("rows_in"), F.lit(None).cast("long").alias("rows_out")).unionByName(
        after.agg(F.lit(None).cast("long").alias("rows_in"), F.count(F.lit(1)).alias("rows_out"))
    )
    one = sizes.agg(F.max("rows_in").alias("rows_in"), F.max("rows_out").alias("rows_out"))
    gap = F.col("rows_in") - F.col("rows_out")
    return one.select(
        F.lit(table).alias("table"), "rows_in", "rows_out", F.greatest(gap, F.lit(0)).alias("rows_dropped"),
        F.greatest(-gap, F.lit(0)).alias("rows_added"), F.lit(reason).alias("reason"),
    )


def referenced_ids(tables: list[DataFrame], key: str) -> DataFrame:
    """Referenced identifiers, cleaned the way the dimensions clean theirs."""
    return collect_keys([t.select(clean_id(F.col(key)).alias(key)) for t in tables if key in t.columns], key).filter(F.col(key) != "")
