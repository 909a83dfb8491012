"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells.

Equal vectors count once. Every vector has a home, the cell of the nearest centroid, and visits
the cells whose border with its home passes within ``margin`` of it. Two unit vectors with cosine
0.95 are at most 0.3163 apart, so one of them lies within 0.1582 of the border between their
homes: that margin loses no pair, whatever the vectors' true dimension, and ``margin_of`` derives
it from the threshold.

Within a cell, blocks of bounded size are multiplied pairwise; a task hands on one row per linked
vector - how many it links to, and the smallest vector it hangs together with there - and no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.components import components
from statloom.operators.stage import Stage

THRESHOLD = 0.95
#: Cells: the root of the number of distinct vectors, to this bound; fitted on so many vectors per
#: cell, those with the smallest hashes. Larger cells are compared in more blocks.
MAX_CELLS, FIT_PER_CELL, FIT_ROUNDS = 16_384, 16, 6
BLOCK = 1024


def margin_of(threshold: float) -> float:
    """Half the greatest distance of two linked unit vectors, rounded up in the fourth place."""
    return (math.floor(math.sqrt(max(1 - threshold, 0) / 2) * 1e4) + 1) / 1e4


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares within range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(sample: np.ndarray, cells: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centroids of a sample of unit vectors; an empty cell keeps its centre."""
    centre = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(part @ centre.T).argmax(1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        total = np.zeros_like(centre)
        np.add.at(total, home, sample)
        length = np.sqrt((total * total).sum(1))
        centre[length > 1e-9] = (total / np.maximum(length, 1e-9)[:, None])[length > 1e-9]
    return centre


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of one length as doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _assign(centre: np.ndarray, margin: float):
    dims = centre.shape[1]
    apart = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 1e-18))

    def assign(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                lengths = np.asarray(part.column("dim"))
                out = []
                for dim in np.unique(lengths):
                    rows = part.filter(pa.array(lengths == dim))
                    x = _unit(_matrix(rows.column("vector"), dim))
                    # Vectors of another length are dealt by what they share with the centroids.
                    seen = np.zeros((len(x), dims))
                    seen[:, : min(dim, dims)] = x[:, :dims]
                    near = seen @ centre.T
                    home = near.argmax(1)
                    best = near[np.arange(len(x)), home]
                    gap = (best[:, None] - near) / apart[home]
                    gap[np.arange(len(x)), home] = np.inf
                    row, cell = np.nonzero(gap <= margin)
                    count = np.bincount(row, minlength=len(x))
                    ends = np.concatenate([[0], np.cumsum(count)])
                    visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))
                    out.append(rows.append_column("home", pa.array(home, pa.int32())).append_column("visits", visits))
                yield from out

    return assign


def _linked(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        """Links between the two blocks of a group, a row per linked vector."""
        b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
        block, cell = np.asarray(table.column("block")), table.column("cell")[0].as_py()
        ids, weight, home = (np.asarray(table.column(c)) for c in ("id", "k", "home"))
        x = _unit(_matrix(table.column("vector").combine_chunks(), table.column("dim")[0].as_py()))
        order = np.argsort(ids, kind="stable")
        left, right = order[block[order] == b1], order[block[order] == b2]
        link = x[left] @ x[right].T >= threshold
        if b1 == b2:
            link &= np.triu(np.ones(link.shape, bool), 1)
        link &= (home[left] == cell)[:, None] | (home[right] == cell)[None, :]
        # Two vectors that visit each other's homes meet twice; the smaller cell counts them.
        visits = table.column("visits").combine_chunks()
        flat, ends = np.asarray(visits.flatten()), np.concatenate([[0], np.cumsum(np.asarray(visits.value_lengths()))])
        for other in np.unique(home[home < cell]):
            meets = np.add.reduceat(np.append(flat == other, False), ends[:-1]) > 0
            meets &= np.diff(ends) > 0
            link &= ~((home[left] == other)[:, None] & (meets & (home == cell))[right][None, :])
            link &= ~((meets & (home == cell))[left][:, None] & (home[right] == other)[None, :])
        i, j = np.nonzero(link)
        i, j = left[i], right[j]
        n_links = np.zeros(len(ids), np.int64)
        np.add.at(n_links, i, weight[j])
        np.add.at(n_links, j, weight[i])
        root, before = ids.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        some = n_links > 0
        return pa.table({"id": ids[some], "links": n_links[some], "root": root[some]})

    return compare


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    margin: float | None = None,
) -> DataFrame:
    """A row per vector: ``key``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows at a cosine of ``threshold`` or more, ``component_id`` is the
    smallest key reachable by links, and ``kept`` marks its own row. Vectors that are null, zero
    or hold null or non-finite components link with nothing, nor do rows without a key; vectors
    of different lengths are not compared. Rows of one key belong to one component. ``margin`` is
    ``margin_of(threshold)`` unless given; a smaller one loses links.
    """
    margin = margin_of(threshold) if margin is None else margin
    spark = df.sparkSession
    stage = Stage(spark, "embeddings")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", usable(F.col("vector")) & F.col("id").isNotNull())
    digest = [F.when(F.col("usable"), F.xxhash64(F.lit(i), "vector")).alias(f"d{i}") for i in (1, 2)]
    rows = stage.put(rows.select("id", "usable", *digest, F.when(F.col("usable"), F.col("vector")).alias("vector")), "rows")
    good = rows.filter("usable")
    one = good.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k"), F.first("vector").alias("vector"))
    one = stage.put(one.withColumn("dim", F.size("vector")), "distinct")
    n = one.count()
    if n == 0:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    dim = one.groupBy("dim").count().orderBy(F.desc("count"), "dim").first().dim
    cells = min(MAX_CELLS, math.ceil(math.sqrt(n)))
    fitted = one.filter(F.col("dim") == dim).orderBy("d1", "d2").limit(cells * FIT_PER_CELL).select("vector").toArrow()
    centre = centroids(_unit(_matrix(fitted.column("vector").combine_chunks(), dim)), cells)

    fields = "d1 long, d2 long, id long, k long, vector array<double>, dim int, home int, visits array<int>"
    dealt = stage.put(one.mapInArrow(_assign(centre, margin), fields), "dealt")
    members = dealt.select("id", "k", "vector", "dim", "home", "visits", F.explode(F.concat(F.array("home"), F.col("visits"))).alias("cell"))
    # The numbers of blocks of each cell, of those at home and of its visitors; a row per cell and
    # length, bounded by the number of cells. Two visitors are compared elsewhere, if at all.
    at_home = F.col("cell") == F.col("home")
    sizes = {"own": F.count_if(at_home), "guests": F.count_if(~at_home)}
    blocks = members.groupBy("cell", "dim").agg(*[F.ceil(n / BLOCK).cast("int").alias(c) for c, n in sizes.items()]).filter("own > 0")
    members = members.join(F.broadcast(blocks) if cells <= MAX_CELLS else blocks, ["cell", "dim"])
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    members = members.withColumn("block", F.when(at_home, deal(F.col("own"))).otherwise(F.col("own") + deal(F.greatest("guests", F.lit(1)))))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("own") - 1 + F.when(at_home, F.col("guests")).otherwise(0))))
    members = members.withColumns({"b1": F.least("block", "with"), "b2": F.greatest("block", "with")})
    found = members.drop("with", "own", "guests").groupBy("cell", "dim", "b1", "b2").applyInArrow(_linked(threshold), "id long, links long, root long")
    found = stage.put(found, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = good.join(one.select("d1", "d2", F.col("id").alias("rep"), "k"), ["d1", "d2"]).select("id", "rep", "k")
    member = stage.put(member, "member")
    spread = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(spread.select("a", "b"))
    labels = components(edges, "a", "b", stage).withColumnRenamed("node", "rep")
    summed = one.select(F.col("id").alias("rep")).distinct().join(links.withColumnRenamed("id", "rep"), "rep", "left").join(labels, "rep", "left")
    summed = stage.put(summed, "summed")
    out = member.join(summed, "rep", "left").select(
        "id", (F.col("k") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    alone = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
