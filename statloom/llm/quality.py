"""Document quality by attention over passages, learnt from document labels alone.

A document is a bag of passages of ``PASSAGE`` words. Each passage becomes a vector of what its
characters and words look like, is encoded by a small layer, and receives a gated attention
weight, softmax over the bag of ``w . (tanh(V h) * sigmoid(U h))``; the weighted sum of its
document's passages is scored. All layers are learnt together from the document labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.cuts import runs
from statloom.llm.hashing import WordHasher, mix, shingles
from statloom.llm.rows import give_back, giving_back, packed, unpacked

PASSAGE = 64
HIDDEN, GATE = 24, 12
#: The model is fitted on so many labelled documents at most, those with the smallest hashes of their ids.
FIT_DOCUMENTS = 6_000
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.01, 1e-4
BATCH_BYTES = 512 << 10
_CLASSES = 7  # white space, lower case, upper case, digit, other ASCII, beyond ASCII, line break
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 11, 12, 13, 32]], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[10] = 0, 1, 2, 3, 5, 6
WIDTH = _CLASSES**2 + 8


def passages(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(text of each passage, its vector), in order; a text without words is one passage of its own."""
    n = len(texts)
    words = hasher(texts)
    count = np.bincount(words.text, minlength=n)
    n_passages = np.maximum(1, -(-count // PASSAGE))
    base = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    owner = np.repeat(np.arange(n), n_passages)
    place = np.arange(len(words.text)) - np.repeat(np.cumsum(count) - count, count)
    passage = base[words.text] + place // PASSAGE
    # Bytes belong to the passage of the last word that starts at or before them.
    size = len(words.raw)
    starts = np.zeros(total, np.int64)
    lead = place % PASSAGE == 0
    starts[passage[lead]] = words.start[lead]
    starts[base] = words.first[:-1]
    byte_of = np.repeat(np.arange(total), np.diff(np.concatenate([starts, [size]])))
    out = np.zeros((total, WIDTH), np.float32)
    if size > 1:
        kind = _CLASS[words.raw].astype(np.int64)
        same = byte_of[:-1] == byte_of[1:]
        code = byte_of[:-1] * _CLASSES**2 + kind[:-1] * _CLASSES + kind[1:]
        moves = np.bincount(code[same], minlength=total * _CLASSES**2).reshape(total, -1)
        out[:, : _CLASSES**2] = moves / np.maximum(1, moves.sum(1, keepdims=True))
    n_words = np.bincount(passage, minlength=total)
    per = np.maximum(1, n_words)
    length = np.bincount(passage, words.end - words.start, minlength=total)
    again = np.zeros(len(passage), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])

    def distinct(group, values, groups):
        keys = np.unique(mix(values + mix(group.astype(np.uint64))), return_index=True)[1]
        return np.bincount(group[keys], minlength=groups)

    run, three = shingles(words, n, 3)
    rest = _CLASSES**2
    out[:, rest] = np.log1p(length / per)
    out[:, rest + 1] = np.bincount(passage, again, minlength=total) / per
    out[:, rest + 2] = distinct(passage, words.hash, total) / per
    out[:, rest + 3] = np.log1p(n_words) / 5
    out[:, rest + 4] = (distinct(words.text, words.hash, n) / np.maximum(1, count))[owner]
    out[:, rest + 5] = (distinct(run, three, n) / np.maximum(1, np.bincount(run, minlength=n)))[owner]
    out[:, rest + 6] = np.log1p(count)[owner] / 10
    out[:, rest + 7] = (count == 0)[owner]
    return owner, out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, first: np.ndarray, owner: np.ndarray):
    """Scores of the bags whose passages start at ``first``; ``owner`` numbers them from 0."""
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    s = np.exp(s - np.maximum.reduceat(s, first)[owner])
    a = s / np.add.reduceat(s, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    return _sigmoid(z @ p["c"] + p["b"]), (h, t, g, a, z)


def fit(owner: np.ndarray, x: np.ndarray, label: np.ndarray, seed: int = 0) -> dict:
    """Weights learnt from bags (passage rows sorted by bag) and their 0/1 labels, by Adam."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    rate = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    p = {"E": draw(x.shape[1], HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN) * 0.1, "b": np.log(rate / (1 - rate))}
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    count = np.bincount(owner, minlength=len(label))
    start = np.cumsum(count) - count
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            bags = order[lo : lo + BATCH]
            n = count[bags]
            rows = np.concatenate([np.arange(start[b], start[b] + count[b]) for b in bags])
            first, own = np.cumsum(n) - n, np.repeat(np.arange(len(bags)), n)
            xb = x[rows]
            y, (h, t, g, a, z) = _forward(p, xb, first, own)
            d = (y - label[bags]) / len(bags)
            dz = d[:, None] * p["c"]
            da = (dz[own] * h).sum(1)
            ds = a * (da - np.add.reduceat(a * da, first)[own])
            dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz[own] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"E": xb.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": d.sum()}
            step += 1
            for k in p:
                gk = grad[k] + DECAY * p[k] * (k not in ("b", "e"))
                m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "scale": scale}


def score(model: dict | None, text: Column | str) -> Column:
    """Probability of label 1 for each text; 0.5 where nothing was there to learn from."""

    @giving_back
    def scores(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for array in arrays:
            out = []
            for run in runs(pc.fill_null(array, ""), BATCH_BYTES):
                if model is None:
                    out.append(np.full(len(run), 0.5))
                    continue
                owner, x = passages(run, hasher)
                first = np.searchsorted(owner, np.arange(len(run)))
                out.append(_forward(model, (x - model["mean"]) / model["scale"], first, owner)[0])
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(scores, "double")(text)


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    fit_documents: int = FIT_DOCUMENTS, seed: int = 0,
) -> dict | None:
    """The model from documents with a 0/1 label; None without any.

    At most ``fit_documents`` keys take part, those with the smallest hashes. Several labels of
    one key count as their rounded mean; rows without key or label are left out.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("key")).agg(F.round(F.avg(label)).alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(fit_documents)
    )

    @giving_back
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                owner, x = passages(pc.fill_null(part.column("text"), ""), hasher)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1)) * x.shape[1]
                vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), vectors], ["key", "label", "x"])

    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")
    kind = docs.schema[key].dataType.simpleString()
    rows = joined.select("key", "label", "text").mapInArrow(bags, f"key {kind}, label double, x array<float>").toArrow()
    if rows.num_rows == 0:
        return None
    rows = rows.sort_by([("key", "ascending")])
    vectors = [np.asarray(v.values, np.float32).reshape(-1, WIDTH) for v in rows.column("x")]
    # Repeated keys may differ in their texts; an order of their own keeps the fit repeatable.
    order = sorted(range(len(vectors)), key=lambda i: (rows.column("key")[i].as_py(), vectors[i].tobytes()))
    vectors = [vectors[i] for i in order]
    label_values = rows.column("label").to_numpy()[order]
    owner = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    x = np.concatenate(vectors).astype(np.float64)
    del rows, vectors
    model = fit(owner, x, label_values, seed)
    give_back()  # the driver's process goes on
    return model


def classify(df: DataFrame, model: dict | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All rows and columns with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Null and empty texts are one passage without words and are scored like any other. Columns of
    these names are replaced; repeated rows stay and score alike; an empty table stays empty.
    """
    rows = packed(df, score=score(model, F.col(text)))
    return unpacked(rows, df, score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))


def held_out(key: Column | str, folds: int = 5) -> Column:
    """Whether a row is kept back from learning: crc32 of its key as text divides by ``folds``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))
