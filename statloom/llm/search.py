"""Ranked lexical search: item bundles carry sparse document accumulators past the owners of terms.

One pass over the documents counts terms and writes, for the terms that items may ask for, one
chunk of postings per term and block of documents. Terms are then dealt to a few owners by the
share of documents that hold them, the rarest first. Items travel in bundles: at each owner a
bundle's accumulators of a block meet that owner's chunks of the block by cogroup, integer
contributions are added, and the accumulators move on to the next owner.

An accumulator is left behind once its score and all that later owners could add stay below the
tenth best score of its item in the same block: those ten documents only gain, so it cannot be in
the result. After the last owner each block gives its best documents of an item, and the best of
those are the answer. All is exact; no group is larger than a block of documents and a bundle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.cuts import runs
from statloom.llm.hashing import NO_TERM, WordHasher
from statloom.operators.stage import Stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block of documents ends at so many bytes of text or so many documents.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 16_384
#: Items of a bundle, about.
BUNDLE = 128
#: Bits of the map of terms that items ask for; all that a counting task receives of them.
BITS = 1 << 20
#: An owner keeps the terms that more than its share of documents hold, up to the next one's.
OWNERS = (0.0, 0.001, 0.01, 0.1)
#: No occurrence of a term adds more than its weight times this.
MOST = 1_000_000
_STATE = "bundle long, block long, slots binary, docs binary, scores binary"


def terms_of(text: Column) -> Column:
    """The terms of a text in order, only A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _asked_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(NO_TERM)
    for batch in batches:
        for texts in runs(pc.fill_null(batch.column("text"), ""), BLOCK_BYTES):
            bits = np.unique(hasher(texts).hash % np.uint64(BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits)], ["bit"])


def _term_map(items: DataFrame) -> bytes:
    """A bit for each hash value that a term of the items has: ``BITS`` bits whatever their number."""
    bits = items.select("text").mapInArrow(_asked_bits, "bit long").distinct().toPandas()["bit"]
    held = np.zeros(BITS, bool)
    held[bits.to_numpy(np.int64)] = True
    return np.packbits(held).tobytes()


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    done = 0
    for run in runs(texts, BLOCK_BYTES):
        for a in range(0, len(run), BLOCK_DOCS):
            yield done + a, min(BLOCK_DOCS, len(run) - a)
        done += len(run)


def _index(asked: bytes, schema: pa.Schema):
    """Rows of one block: its documents in order of their ids (term null), and a chunk per asked term."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(asked, np.uint8)).astype(bool)
        hasher, number = WordHasher(NO_TERM), TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, texts = batch.column("key"), pc.fill_null(batch.column("text"), "")
            for first, size in _blocks(texts):
                order = pc.sort_indices(keys.slice(first, size), null_placement="at_end")
                place = np.empty(size, np.int64)
                place[order.to_numpy()] = np.arange(size)
                words = hasher(texts.slice(first, size))
                n = np.bincount(words.text, minlength=size)
                ids = keys.slice(first, size).take(order).to_pylist()
                rows = [(None, number, int((n > 0).sum()), int(n.sum()), ids, None, None, None)]
                at = np.flatnonzero(held[(words.hash % np.uint64(BITS)).astype(np.int64)])
                if len(at):
                    _, one, code = np.unique(words.hash[at], return_index=True, return_inverse=True)
                    pairs, tf = np.unique(code * size + place[words.text[at]], return_counts=True)
                    code, doc = np.divmod(pairs, size)
                    length = np.empty(size, np.int64)
                    length[place] = n
                    ends = np.searchsorted(code, np.arange(len(one) + 1))
                    for i, (a, b) in enumerate(zip(ends, ends[1:])):
                        word = words.raw[words.start[at[one[i]]] : words.end[at[one[i]]]].tobytes().lower().decode()
                        rows.append((
                            word, number, int(b - a), None, None, doc[a:b].astype(np.uint16).tobytes(),
                            tf[a:b].astype(np.int32).tobytes(), length[doc[a:b]].astype(np.int32).tobytes(),
                        ))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                number += 1

    return index


def _owner(n_docs: int, n_terms: int, top: int, last: bool):
    """One owner's work on a bundle and a block: add, leave behind, pass on (or select, at the last)."""

    def add(key, held: pa.Table, given: pa.Table) -> pa.Table:
        slots, docs, scores, room = [], [], [], {}
        for row in held.to_pylist():
            slots.append(np.frombuffer(row["slots"], np.int32))
            docs.append(np.frombuffer(row["docs"], np.int32))
            scores.append(np.frombuffer(row["scores"], np.int64))
        given = given.select(["weight", "asked", "docs", "tf", "n"]).to_pylist()
        for row in given:
            doc = np.frombuffer(row["docs"], np.uint16).astype(np.int32)
            tf, n = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("tf", "n"))
            m = 25 + (75 * n * n_docs) // n_terms
            part = row["weight"] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            for ask in row["asked"]:
                slots.append(np.full(len(doc), ask["slot"], np.int32))
                docs.append(doc)
                scores.append(part * ask["repeats"])
                room[ask["slot"]] = ask["room"]
        width = 1 + max((int(d.max()) for d in docs if len(d)), default=0)
        by_slot: dict[int, np.ndarray] = {}
        for slot, doc, score in zip(slots, docs, scores):
            # What arrives holds many items one after another, a chunk's part only one.
            edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    total = by_slot.setdefault(int(slot[a]), np.zeros(width, np.int64))
                    total[doc[a:b]] += score[a:b]
        out_slots, out_docs, out_scores = [], [], []
        for slot in sorted(by_slot):
            total = by_slot[slot]
            doc = np.flatnonzero(total)
            if len(doc) > top:
                least = np.partition(total[doc], len(doc) - top)[len(doc) - top]
                doc = doc[total[doc] + (0 if last else room.get(slot, 1 << 62)) >= least]
            if last:
                doc = doc[np.lexsort((doc, -total[doc]))[:top]]
            out_slots.append(np.full(len(doc), slot, np.int32))
            out_docs.append(doc.astype(np.int32))
            out_scores.append(total[doc])
        if not out_docs:
            out_slots, out_docs, out_scores = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        slots, docs, scores = map(np.concatenate, (out_slots, out_docs, out_scores))
        bundle, block = (k.as_py() for k in key)
        if last:
            return pa.table({"bundle": pa.array([bundle] * len(docs), pa.int64()), "block": pa.array([block] * len(docs), pa.int64()), "slot": slots, "doc": docs, "score": scores})
        return pa.table({"bundle": pa.array([bundle], pa.int64()), "block": pa.array([block], pa.int64()), "slots": pa.array([slots.tobytes()], pa.binary()), "docs": pa.array([docs.tobytes()], pa.binary()), "scores": pa.array([scores.tobytes()], pa.binary())})

    return add


def search(
    documents: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(item, rank, document, score)`` of each item's ``top`` documents with a score above 0.

    The columns are named like ``item_key`` and ``key``, with ``rank`` int and ``score`` long.
    Equal scores go by ascending key, null keys last. Every row of ``documents`` is a document of
    its own, also one that repeats another; a null text has no terms. Items are distinct pairs of
    key and text: a repeated row counts once, and texts that share a key (null included) each get
    a list of their own. Items without a term, or without a document, give no rows; empty tables
    give an empty result. Other columns of the two tables play no part.
    """
    spark = documents.sparkSession
    stage = Stage(spark, "search")
    items = stage.put(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).distinct(), "items")
    kind = documents.schema[key].dataType.simpleString()
    schema = f"term string, block long, size long, terms long, ids array<{kind}>, docs binary, tf binary, n binary"
    empty = spark.createDataFrame([], schema)
    index = _index(_term_map(items), pa.schema([(f.name, _arrow(f.dataType)) for f in empty.schema]))
    parts = stage.put(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(index, schema), "index")
    blocks, chunks = parts.filter("term is null"), parts.filter("term is not null")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    asked, items, owners = _bundles(chunks, items, n_docs, stage)
    state = spark.createDataFrame([], _STATE)
    for i, owner in enumerate(owners):
        here = asked.filter(F.col("owner") == owner).select("term", "bundle", "weight", "asked")
        given = chunks.join(here, "term").select("bundle", "block", "weight", "asked", "docs", "tf", "n")
        last = i == len(owners) - 1
        state = state.groupBy("bundle", "block").cogroup(given.groupBy("bundle", "block")).applyInArrow(
            _owner(n_docs, n_terms, top, last), "bundle long, block long, slot int, doc int, score long" if last else _STATE
        )
    if not owners:
        state = spark.createDataFrame([], "bundle long, block long, slot int, doc int, score long")
    of_item = Window.partitionBy("bundle", "slot")
    # Ties of the last place stay until the documents' own keys are known.
    best = state.withColumn("at", F.rank().over(of_item.orderBy(F.desc("score")))).filter(F.col("at") <= top)
    named = best.join(blocks.select("block", "ids"), "block").select("bundle", "slot", "score", F.get("ids", F.col("doc")).alias("document"))
    ranked = named.withColumn("rank", F.row_number().over(of_item.orderBy(F.desc("score"), F.asc_nulls_last("document"))))
    ranked = ranked.filter(F.col("rank") <= top).join(items.select("bundle", "slot", "item"), ["bundle", "slot"])
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("document").alias(key), "score")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _bundles(chunks: DataFrame, items: DataFrame, n_docs: int, stage: Stage) -> tuple[DataFrame, DataFrame, list[int]]:
    """Who asks for a term, at which owner and weight; the items with their places; the owners asked."""
    n_bundles = max(1, -(-items.count() // BUNDLE))
    items = items.withColumn("bundle", F.pmod(F.xxhash64("item", "text"), F.lit(n_bundles)))
    items = stage.put(items.withColumn("slot", F.row_number().over(Window.partitionBy("bundle").orderBy("item", "text"))), "bundles")
    df = chunks.groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs) + 2.0) / (F.col("df") * 2.0 + 1.0)))
    owner = sum((F.col("df") > F.lit(share * n_docs)).cast("int") for share in OWNERS) - 1
    known = df.select("term", weight.cast("long").alias("weight"), owner.alias("owner"))
    wanted = items.select("bundle", "slot", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("bundle", "slot", "term").agg(F.count(F.lit(1)).alias("repeats"))
    wanted = stage.put(wanted.join(known, "term").filter("weight > 0"), "wanted")
    worth = F.col("weight") * F.col("repeats") * MOST
    later = wanted.groupBy("bundle", "slot").agg(
        *[F.coalesce(F.sum(F.when(F.col("owner") > i, worth)), F.lit(0)).alias(f"room_{i}") for i in range(len(OWNERS))]
    )
    room = F.coalesce(*[F.when(F.col("owner") == i, F.col(f"room_{i}")) for i in range(len(OWNERS))])
    ask = F.struct("slot", "repeats", room.alias("room"))
    asked = wanted.join(later, ["bundle", "slot"]).groupBy("owner", "bundle", "term").agg(F.first("weight").alias("weight"), F.collect_list(ask).alias("asked"))
    asked = stage.put(asked, "asked")
    return asked, items, sorted(r.owner for r in asked.select("owner").distinct().collect())


def search_sql() -> str:
    """The same on ``documents`` and ``benchmark`` in DuckDB SQL."""
    def terms(tab: str) -> str:
        return f"regexp_extract_all(translate(coalesce({tab}.text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"

    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row, {terms('documents')} AS ts FROM documents),
    l AS (SELECT row, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM l),
    p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(ts) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * max(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
    q AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item_id, unnest({terms('i')}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark) i) GROUP BY ALL),
    r AS (
      SELECT item_id, doc_id, row, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN l USING (row), s GROUP BY ALL
    ),
    o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
    SELECT * FROM o WHERE rank <= 10
    """
