"""Reading raw and declared tables, writing results, and staged rebuilds."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators.rows import with_source_row
from statloom.operators.stage import Stage


def _path(spark: SparkSession, path: str):
    """Hadoop path and its file system, so local disks and object stores work alike."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hpath, fs = _path(spark, path)
    return fs.exists(hpath)


def read_table(spark: SparkSession, path: str, source_row: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column as text (types are decided by the cleaning, not guessed).

    A quoted cell may hold line breaks, so one file is one task; ``multi_line=False`` splits
    files between tasks and is for files known to have a row on every line.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8")
    df = reader.option("multiLine", multi_line).option("inferSchema", False).csv(path)
    return with_source_row(df, from_files=True) if source_row else df


def read_source(spark: SparkSession, folder: str, stem: str, **opts) -> DataFrame:
    """The table saved under ``stem``: a CSV file or folder, else a parquet one."""
    for suffix in (".csv", ".parquet"):
        path = posixpath.join(folder, stem + suffix)
        if exists(spark, path):
            return read_table(spark, path, **opts) if suffix == ".csv" else spark.read.parquet(path)
    raise FileNotFoundError(f"No .csv/.parquet source named {stem!r} in {folder}")


def write_table(df: DataFrame, path: str, keys: list[str] = (), fmt: str = "parquet") -> None:
    """Write rows in key order: parquet by default, or UTF-8 CSV with a header."""
    out = (df.orderBy(*keys) if keys else df).write.mode("overwrite")
    out.option("header", True).option("escape", '"').option("lineSep", "\n").csv(path) if fmt == "csv" else out.parquet(path)


def load_declared(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", encoding: str = "UTF-8", null_token: str = "", multi_line: bool = True
) -> DataFrame:
    """Load a CSV against a declared schema, matching columns by header name; a bad value fails the load.

    ``multi_line`` as in ``read_table``.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", multi_line)
    header = raw.option("escape", '"').csv(path).columns
    declared = {f.name: f for f in schema}
    unknown = [c for c in header if c not in declared]
    if unknown:
        raise ValueError(f"{path}: columns not in the declared schema: {unknown}")
    in_file = T.StructType([T.StructField(c, declared[c].dataType) for c in header])
    reader = spark.read.schema(in_file).option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", multi_line)
    df = reader.option("nullValue", null_token).option("mode", "FAILFAST").option("escape", '"').csv(path)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in header]
    return df.select("*", *missing).select(*[f.name for f in schema])


def restore_integers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn double columns that hold only whole numbers back into integers; all-NULL ones stay."""
    cols = columns or [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not cols:
        return df
    whole = [((F.count(c) > 0) & (F.count_if(F.col(c) % 1 != 0) == 0) & (F.count_if(F.isnan(c)) == 0)).alias(c) for c in cols]
    probe = df.agg(*whole).first()
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols if probe[c]})


def load_all(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], order: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load tables parents first; a missing or empty file is skipped and says so in the report.

    Each table is parsed once, into the session's shared folder, and counted there: a bad value
    in any column fails the load, whatever columns are read later.
    """
    tables, report = {}, []
    stage = Stage(spark, "load")
    for name in order:
        path = posixpath.join(folder, f"{name}.csv")
        if not exists(spark, path):
            report.append((name, 0, "missing"))
            continue
        df = stage.put(load_declared(spark, path, schemas[name]), name)
        rows = df.count()
        report.append((name, rows, "loaded" if rows else "empty"))
        if rows:
            tables[name] = df
    return tables, spark.createDataFrame(report, "table string, rows long, status string")


def rebuild(
    spark: SparkSession,
    target: str,
    builders: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]],
    base: dict[str, DataFrame],
    protected: list[str] = (),
) -> dict[str, DataFrame]:
    """Build a layer in order, all or nothing: into a staging folder first, swapped in when complete.

    The old layer is moved aside and only deleted once the new one is in its place; if the move
    of the new one fails, the old one is moved back.
    """
    target = target.rstrip("/")
    if any(target == p.rstrip("/") or p.rstrip("/").startswith(target + "/") for p in protected):
        raise ValueError(f"refusing to rebuild over the protected layer {target}")
    for name, df in base.items():
        if df.isEmpty():
            raise ValueError(f"base table '{name}' is empty; nothing to rebuild from")
    staging = f"{target}__staging_{uuid.uuid4().hex[:8]}"
    built = dict(base)
    try:
        for name, build in builders:
            build(built).write.parquet(f"{staging}/{name}")
            # Read back: later builders and readers use the written table, not a long lineage.
            built[name] = spark.read.parquet(f"{staging}/{name}")
    except Exception:
        hpath, fs = _path(spark, staging)
        fs.delete(hpath, True)
        raise
    hstaging, fs = _path(spark, staging)
    htarget, _ = _path(spark, target)
    hold, _ = _path(spark, f"{staging}_old")
    had = fs.exists(htarget)
    if had and not fs.rename(htarget, hold):
        raise OSError(f"could not move {target} aside; the new layer is in {staging}")
    if not fs.rename(hstaging, htarget):
        if had:
            fs.rename(hold, htarget)
        raise OSError(f"could not move {staging} to {target}")
    if had:
        fs.delete(hold, True)
    return {name: spark.read.parquet(f"{target}/{name}") for name, _ in builders}


def list_tables(spark: SparkSession) -> DataFrame:
    """(name, kind) of the tables and views in the catalog."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string")


def run_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """SQL with named ``:parameters``; an error is raised, not swallowed."""
    return spark.sql(sql, args=params or {})


def execute_ddl(spark: SparkSession, statement: str, params: dict | None = None) -> None:
    spark.sql(statement, args=params or {})
