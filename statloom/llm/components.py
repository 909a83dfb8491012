"""Connected components of a link table, in rounds of large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.stage import Stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row.n, row.s


def components(links: DataFrame, a: str, b: str, stage: Stage, step: str = "components") -> DataFrame:
    """``(node, component)`` of every node in ``links``: the smallest node reachable from it.

    Each round joins every node's neighbours to its smallest one, first the larger neighbours,
    then the smaller; the links become stars whose centres are the answer, after a number of
    rounds that grows with the logarithm of a component's size. Only links move, aggregated
    before each shuffle; nothing is gathered per component.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = stage.put(edges, f"{step}-0")
    seen, turn = _signature(edges), 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct()
        )
        turn += 1
        edges = stage.put(small, f"{step}-{turn}")
        stage.drop(f"{step}-{turn - 1}")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
