"""The queries this repository offers on the given tables, each with its SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators.stage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; one without SQL is tested against brute force on small fixtures."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), so that two engines print the same value."""
    cols = {
        f.name: F.round(f.name, digits) + F.lit(0.0)
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(cols) if cols else df


def longs(df: DataFrame) -> DataFrame:
    """Integers as bigint, the type counts have in SQL."""
    cols = {f.name: F.col(f.name).cast("long") for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.ShortType))}
    return df.withColumns(cols) if cols else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the session names; a local session gets a folder of its own."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:10]}"
