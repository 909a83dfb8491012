"""Hard negatives by exact integer scores from tables of subset sums (the Four Russians' way).

Components become integers. Candidates are packed in blocks as bit planes: for each plane and each
group of eight dimensions one byte per candidate. For a few anchors at a time the sums of all 256
subsets of each group of eight components are tabled once; a candidate's byte looks its sum up,
the sums of a plane's groups are added, and the planes are put together by doubling from the sign
plane down. That gives every full score exactly, without a product.

Anchors (the stated query set) meet all candidates block by block: first those of their own label,
for the positives, then the others, within the window that each positive sets. Only the best of a
pair of blocks leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.stage import Stage

#: Rows of a block of candidates and of a block of anchors, about.
CANDIDATES, ANCHORS = 2048, 1024
#: Anchors whose tables are held at a time: 512 KB at 64 dimensions.
TILE = 64
#: Components are below this in magnitude, so that no score leaves 64 bits up to 1,024 dimensions.
LARGEST = 1 << 23
_BLOCK = "block long, ids binary, rows binary, labels array<string>, width int, depth int, body binary"


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, filled with zeros to a common multiple of eight."""
    rows = lists.combine_chunks()
    size = np.diff(rows.offsets.to_numpy())
    values = rows.flatten().to_numpy().astype(np.int64)
    out = np.zeros((len(size), max(8, -(-int(size.max(initial=0)) // 8) * 8)), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def _block(key, table: pa.Table, order: np.ndarray, width: int, depth: int, body: bytes) -> pa.Table:
    table = table.take(pa.array(order))
    return pa.table({
        "block": pa.array([key[0].as_py()], pa.int64()), "ids": [table["id"].to_numpy().astype(np.int64).tobytes()],
        "rows": [table["row"].to_numpy().astype(np.int64).tobytes()], "labels": pa.array([table["label"].to_pylist()], pa.list_(pa.string())),
        "width": pa.array([width], pa.int32()), "depth": pa.array([depth], pa.int32()), "body": pa.array([body], pa.binary()),
    })


def _planes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Candidates by label and id, as planes of packed bits; the last plane is the sign's."""
    order = np.lexsort((table["row"].to_numpy(), table["id"].to_numpy(), table["label"].to_numpy(zero_copy_only=False).astype(str)))
    q = _matrix(table["q"])[order]
    depth = 1 + max(int(q.max()).bit_length(), int(~q.min()).bit_length())
    planes = [np.packbits((q >> b) & 1, axis=1, bitorder="little").T for b in range(depth)]
    return _block(key, table, order, q.shape[1] // 8, depth, np.ascontiguousarray(planes, np.uint8).tobytes())


def _plain(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Anchors as they are."""
    order = np.lexsort((table["row"].to_numpy(), table["id"].to_numpy()))
    q = _matrix(table["q"])[order]
    return _block(key, table, order, q.shape[1] // 8, 0, q.tobytes())


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """(group, byte, anchor): the sum of the components that the byte's bits name."""
    groups = anchors.reshape(len(anchors), -1, 8).transpose(1, 2, 0).astype(kind)
    out = np.zeros((len(groups), 256, len(anchors)), kind)
    for k in range(8):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + groups[:, k, None]
    return out


def scores(planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(candidate, anchor): inner products from ``planes`` (plane, group, candidate) by look-up."""
    groups = min(planes.shape[1], anchors.shape[1] // 8)
    anchors = anchors[:, : groups * 8]
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << planes.shape[0]
    kind = np.int32 if most < 1 << 31 else np.int64
    sums = subset_sums(anchors, kind)
    total = np.zeros((planes.shape[2], len(anchors)), kind)
    found = np.empty_like(total)
    for depth in reversed(range(len(planes))):
        total += total
        for group in range(groups):
            np.take(sums[group], planes[depth, group], axis=0, out=found, mode="clip")
            if depth == len(planes) - 1:
                total -= found
            else:
                total += found
    return total


class _Cell:
    """A block of anchors and a block of candidates."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table):
        a, c = anchors.to_pylist()[0], candidates.to_pylist()[0]
        self.a_id, self.a_row = (np.frombuffer(a[k], np.int64) for k in ("ids", "rows"))
        self.c_id, self.c_row = (np.frombuffer(c[k], np.int64) for k in ("ids", "rows"))
        self.anchors = np.frombuffer(a["body"], np.int64).reshape(len(self.a_id), -1)
        self.planes = np.frombuffer(c["body"], np.uint8).reshape(c["depth"], c["width"], -1)
        labels = pd.factorize(pd.Series(a["labels"] + c["labels"], dtype=object))[0]
        self.a_label, self.c_label = labels[: len(self.a_id)], labels[len(self.a_id) :]

    def best_alike(self, most: int) -> pa.Table:
        """Each anchor's best other candidates of its label."""
        out = []
        for label in np.unique(self.a_label):
            same = np.flatnonzero(self.c_label == label)
            if not len(same):
                continue
            planes = np.ascontiguousarray(self.planes[:, :, same[0] : same[-1] + 1])  # neighbours, as the block is sorted
            mine = np.flatnonzero(self.a_label == label)
            for tile in np.array_split(mine, -(-len(mine) // TILE)):
                total = scores(planes, self.anchors[tile])
                for k, i in enumerate(tile):
                    other = np.flatnonzero((self.c_id[same] != self.a_id[i]) | (self.c_row[same] != self.a_row[i]))
                    value = total[other, k].astype(np.int64)
                    if len(value) > most:
                        least = np.partition(value, len(value) - most)[len(value) - most]
                        other, value = other[value >= least], value[value >= least]
                    order = np.lexsort((self.c_row[same[other]], self.c_id[same[other]], -value))[:most]
                    out.append((np.full(len(order), i), same[other[order]], value[order]))
        a, c, value = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"anchor": self.a_id[a], "anchor_row": self.a_row[a], "id": self.c_id[c], "row": self.c_row[c], "score": value})

    def best_within(self, windows: list[list[dict]], most: int) -> pa.Table:
        """For each anchor and positive the best candidates of other labels within its window."""
        out = []
        for first in range(0, len(self.a_id), TILE):
            tile = range(first, min(first + TILE, len(self.a_id)))
            low = np.array([min((w["low"] for w in windows[i]), default=1) for i in tile])
            high = np.array([max((w["high"] for w in windows[i]), default=0) for i in tile])
            total = scores(self.planes, self.anchors[first : tile.stop])
            inside = (total >= low) & (total <= high) & (self.c_label[:, None] != self.a_label[None, first : tile.stop])
            c, a = np.nonzero(inside)
            value = total[c, a].astype(np.int64)
            order = np.lexsort((self.c_row[c], self.c_id[c], -value, a))
            c, a, value = c[order], a[order], value[order]
            edges = np.searchsorted(a, np.arange(len(tile) + 1))
            for k, i in enumerate(tile):
                lo, hi = edges[k], edges[k + 1]
                for place, w in enumerate(windows[i]):
                    start = lo + np.searchsorted(-value[lo:hi], -w["high"])
                    for j in range(start, min(start + most, hi)):
                        if value[j] >= w["low"]:
                            out.append((self.a_id[i], self.a_row[i], place, w["id"], w["score"], self.c_id[c[j]], self.c_row[c[j]], value[j]))
        names = ["anchor", "anchor_row", "place", "positive", "positive_score", "id", "row", "score"]
        kinds = [pa.int32() if n == "place" else pa.int64() for n in names]
        return pa.table([pa.array([int(r[k]) for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def _cells(blocks: DataFrame, mine: str, other: str, n: int, parts: int) -> DataFrame:
    """Each block once for every block of the other side."""
    met = blocks.withColumnRenamed("block", mine).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return met.repartition(parts, "a_block", "c_block")


def mine(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """Each anchor's positives with the hard negatives of each.

    ``anchor`` is a condition on the columns of ``df``. Components become ``floor(scale * x)``; a
    score is the integer inner product with the anchor, where a shorter vector counts as filled
    with zeros. An anchor's positives are its best ``positives`` other rows of the same label; for
    each of them come the best ``negatives`` rows of other labels whose score lies from ``low`` to
    ``high`` percent of the positive's. Higher scores first, ties by the smaller key.

    Rows with a null key, label or vector, a null or non-finite component, or one whose integer
    reaches 2^23 take no part. Rows alike in key, label and vector count once; others that share a
    key are rows of their own. An anchor without positives, or a window without rows, gives no
    row; an empty table gives an empty result. Returns ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``; other columns of ``df`` play no part.
    """
    spark, stage = df.sparkSession, Stage(df.sparkSession, "negatives")
    scaled = lambda x: F.floor(x.cast("double") * scale)
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    known = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(fits, F.lit(False)))
    rows = known.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.transform(vector, scaled).cast("array<int>").alias("q"), F.coalesce(anchor, F.lit(False)).alias("asks"),
    ).distinct()
    rows = stage.put(rows.withColumn("row", F.xxhash64("label", "q")), "rows")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    n_c, n_a = max(1, -(-n // CANDIDATES)), max(1, -(-n_anchors // ANCHORS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_c * n_a, 20_000))

    def blocks(of: DataFrame, count: int, pack) -> DataFrame:
        dealt = of.select(F.pmod(F.xxhash64("id", "row"), F.lit(count)).alias("block"), "id", "row", "label", "q")
        return dealt.groupBy("block").applyInArrow(pack, _BLOCK)

    candidates = stage.put(blocks(rows, n_c, _planes), "candidates")
    asking = stage.put(blocks(rows.filter("asks"), n_a, _plain), "anchors")
    candidates = _cells(candidates, "c_block", "a_block", n_a, parts)

    def alike(key, a: pa.Table, c: pa.Table) -> pa.Table:
        if not len(a) or not len(c):
            return _nothing("anchor anchor_row id row score")
        return _Cell(a, c).best_alike(positives)

    def within(key, a: pa.Table, c: pa.Table) -> pa.Table:
        if not len(a) or not len(c):
            return _nothing("anchor anchor_row place positive positive_score id row score")
        of = {(r["anchor"], r["anchor_row"]): r["windows"] for r in a["of"].to_pylist()[0]}
        cell = _Cell(a.drop_columns("of"), c)
        return cell.best_within([of.get((int(i), int(r)), []) for i, r in zip(cell.a_id, cell.a_row)], negatives)

    best = Window.partitionBy("anchor", "anchor_row").orderBy(F.desc("score"), "id", "row")
    by_cell = lambda blocks, fn, schema: blocks.groupBy("a_block", "c_block").cogroup(candidates.groupBy("a_block", "c_block")).applyInArrow(fn, schema)
    found = by_cell(_cells(asking, "a_block", "c_block", n_c, parts), alike, "anchor long, anchor_row long, id long, row long, score long")
    found = stage.put(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives), "positives")
    # 100 * score from low to high times the positive's, in whole numbers.
    down = lambda x: f"(({x} - pmod({x}, 100)) div 100)"
    window = F.struct("place", "id", "score", F.expr(f"-{down(f'(-{low} * score)')}").alias("low"), F.expr(down(f"({high} * score)")).alias("high"))
    windows = found.groupBy("anchor", "anchor_row").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    windows = windows.withColumn("block", F.pmod(F.xxhash64(F.col("anchor"), F.col("anchor_row")), F.lit(n_a)))
    windows = windows.groupBy("block").agg(F.collect_list(F.struct("anchor", "anchor_row", "windows")).alias("of"))
    hard = by_cell(
        _cells(asking.join(windows, "block"), "a_block", "c_block", n_c, parts), within,
        "anchor long, anchor_row long, place int, positive long, positive_score long, id long, row long, score long",
    )
    best = Window.partitionBy("anchor", "anchor_row", "place").orderBy(F.desc("score"), "id", "row")
    hard = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return hard.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _nothing(names: str) -> pa.Table:
    return pa.table({n: pa.array([], pa.int32() if n == "place" else pa.int64()) for n in names.split()})


def mine_sql() -> str:
    """The query on ``embeddings`` in DuckDB SQL."""
    return """
    WITH k AS (
      SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
      SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ),
    p AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    ),
    n AS (
      SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
        AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """
