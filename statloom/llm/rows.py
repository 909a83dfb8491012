"""Rows carried whole beside working columns, so that no column of theirs can clash; memory of workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """One column ``row`` with all columns of ``df``, and the named working columns."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, like: DataFrame, **results: Column) -> DataFrame:
    """The columns of ``row`` again with the results; results replace columns of the same name."""
    kept = [F.col("row").getField(c).alias(c) for c in like.columns if c not in results]
    return df.select(*kept, *[c.alias(name) for name, c in results.items()])


def give_back() -> None:
    """Return to the machine what Arrow and Python have freed but the allocators still hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # other C libraries have no such call
        trim(0)


def giving_back(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives its memory back at its end: a worker waits, and may serve
    other stages, with all that it ever held."""

    @wraps(fn)
    def run(batches: Iterator) -> Iterator:
        give_back()
        yield from fn(batches)
        give_back()

    return run
