"""Ranked search, hard negatives and licence scans against brute force, on given and odd rows."""

import collections
import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from statloom.llm import licenses, negatives, search

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"Rare{i % 700} common ünder_the MIT-license {i}" for i in range(6000))


def terms(text):
    return licenses.words_of(text or "")


def ranked(documents, items, top=10):
    """[(item, rank, doc, score)] by scoring every document for every item."""
    held = [(d, collections.Counter(terms(t))) for d, t in documents]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in held:
            score, m = 0, 25 + 75 * sum(c.values()) * n_docs // n_terms
            for term, repeats in collections.Counter(terms(text)).items():
                if term in c:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += repeats * weight * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_search_given_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted(map(tuple, search.search(docs, items).collect()), key=str)
    assert got == ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_search_odd_rows_small_blocks_and_bundles(spark, monkeypatch):
    """Copies, ties, nulls, a hot term, a very long text; many blocks and bundles, so that owners leave much behind."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 40)
    monkeypatch.setattr(search, "BUNDLE", 3)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(["hot"] * rng.randint(1, 4) + [words[int(300 * rng.random() ** 3)] for _ in range(rng.randint(0, 30))]) for _ in range(700)]
    texts += [texts[0]] * 150 + ["", None, "  ... ", "É é W1-w2", LONG, "漢字 w3"]
    documents = [(i, t) for i, t in enumerate(texts)] + [(3, "w1 w2 hot"), (None, texts[0]), (None, "w1 w1"), (5, texts[5])]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) + " hot HOT") for i in range(12)]
    items += [(0, "w1 w2"), (0, "w1 w2"), (None, "w9 common rare5"), (20, None), (21, "nowhere"), (22, texts[0]), (23, "É")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in documents], "doc_id long, text string, score int, term string").repartition(3)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, search.search(df, asked).collect()), key=str)
    assert got == ranked(documents, items)
    assert search.search(df.limit(0), asked).count() == 0
    assert search.search(df, asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(df, asked.limit(0)).count() == 0


def test_an_owner_leaves_only_what_cannot_win():
    """Whatever an owner leaves behind scores below the tenth best of the block in the end."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for trial in range(50):
        n, first = 60, rng.integers(0, 400, 60)
        given = lambda weight, tf, room: pa.table({
            "weight": [weight], "asked": [[{"slot": 0, "repeats": 1, "room": room}]], "docs": [np.flatnonzero(tf).astype(np.uint16).tobytes()],
            "tf": [tf[tf > 0].astype(np.int32).tobytes()], "n": [np.full((tf > 0).sum(), 50, np.int32).tobytes()],
        })
        key = (pa.scalar(0), pa.scalar(0))
        empty = pa.table({"slots": pa.array([], pa.binary()), "docs": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
        second = rng.integers(0, 3, n)
        one = search._owner(100, 5000, 10, False)(key, empty, given(900, first * (first > 200), 300 * search.MOST))
        two = search._owner(100, 5000, 10, True)(key, one, given(300, second, 0))
        m = 25 + 75 * 50 * 100 // 5000
        part = lambda w, tf: w * (10**9 * tf // (1000 * tf + 8 * m))
        want = part(900, first * (first > 200)) + part(300, second)
        order = sorted((-s, i) for i, s in enumerate(want.tolist()) if s)[:10]
        assert list(zip(two["score"].to_pylist(), two["doc"].to_pylist())) == [(-s, i) for s, i in order], trial


def hard(rows, anchors, positives=5, negatives=3):
    """The same by scoring every pair; ``rows`` are distinct (id, label, integers)."""
    out = []
    for a in anchors:
        scored = sorted(
            ((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r is not a),
        )
        for p in [s for s in scored if s[2] == a[1]][:positives]:
            inside = [s for s in scored if s[2] != a[1] and -50 * p[0] <= -100 * s[0] <= -95 * p[0]]
            out += [(a[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(inside[:negatives])]
    return sorted(out)


def test_scores_by_subset_sums_are_inner_products():
    rng = np.random.default_rng(0)
    for spread, width in ((3, 8), (300, 64), (1 << 22, 24)):
        a, c = rng.integers(-spread, spread, (5, width)), rng.integers(-spread, spread, (70, width))
        depth = 1 + max(int(c.max()).bit_length(), int(~c.min()).bit_length())
        planes = np.array([np.packbits((c >> b) & 1, axis=1, bitorder="little").T for b in range(depth)])
        assert (negatives.scores(planes, a) == c @ a.T).all()
    table = negatives.subset_sums(np.arange(8)[None, :])
    assert all(table[0, b, 0] == sum(k for k in range(8) if b >> k & 1) for b in range(256))


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "TILE", 4)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 20)) + 0.4
    vectors[200:260] = vectors[200]  # ties
    labels = np.where(rng.random(400) < 0.4, 0, rng.integers(1, 6, 400))
    rows = [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, labels))]
    odd = [
        (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 20, 1), (503, [float("inf")] + [0.0] * 19, 1), (504, rows[0][1], None),
        (None, rows[0][1], 1), (505, [], 2), (506, [1.0, -2.0, 0.5], 2), (507, [0.0] * 20, 3), rows[10], rows[10], (508, [1e9] * 20, 2),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, id int, score string")
    whole = [(i, k, [math.floor(256 * x) for x in v]) for i, v, k in rows + [odd[6], odd[7], odd[8]]]
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0).collect()))
    want = hard(whole, [r for r in whole if r[0] % 10 == 0])
    assert len(want) > 300
    assert got == want
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def scanned(texts):
    """(words, places, first, last, labels, all labels, score) of each text, template by template."""
    split = [terms(t) for t in texts]
    df = collections.Counter(w for ws in split for w in set(ws))
    idf = lambda w: math.log((len(texts) + 1) / (df[w] + 0.5))
    out = []
    for words in split:
        at = {label: places(words, p.split()) for label, p in licenses.PHRASES.items()}
        starts, base = sorted(i for x in at.values() for i in x), {label for label, x in at.items() if x}
        more, score = set(base), 1.0 if base else 0.0
        for label, ts in licenses.TEMPLATES.items():
            for t in ts:
                line = t.text.split()
                rare = sorted(set(line), key=lambda w: (-idf(w), w))[: licenses.RARE]
                weight = {w: max(idf(w), 1e-9) for w in rare}
                total = sum(weight.values())
                for shift in (0, licenses.SLACK):
                    agree = collections.defaultdict(lambda: collections.defaultdict(set))
                    for i, w in enumerate(words):
                        for j, x in enumerate(line):
                            if w == x and w in weight:
                                agree[(i - j + shift) // (2 * licenses.SLACK)][w].add(i - j)
                    for found in agree.values():
                        share, offset = sum(weight[w] for w in found) / total, min(o for x in found.values() for o in x)
                        score = max(score, share)
                        low, high = max(offset - licenses.SLACK, 0), min(offset + len(line) + 2 * licenses.SLACK, len(words))
                        if share >= licenses.AGREEING and all(any(low <= i <= high - len(m.split()) for i in places(words, m.split())) for m in t.mandatory):
                            more.add(label)
        out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(more)), min(1.0, round(score, 6))))
    return out


def test_license_scan(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    planted = [
        "This work is licensed under the GNU General Public License, version 3.", "Under the MIT License under the mit license", "CC BY-NC", "cc by n c",
        "x " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "the mit licensed, license mit", "Licensed under the Apache License, Version 2.0 (the \"License\")", "ünder the mit license", "version 2 apache license version 3",
        "", None, " . ", "mit", "license " * 300, LONG, LONG, "Released under the (new) BSD 3-Clause License", "under the\nmit_license", "Apache License,\tVersion 2",
    ]
    rows += [(i, t) for i, t in enumerate(planted, 10_000)] + [(None, "cc by nc"), (10_000, planted[0])]
    df = spark.createDataFrame([(i, t, "mine", 5) for i, t in rows], "doc_id long, text string, labels string, found int").coalesce(3)
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "found", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    got = out.collect()
    want = dict(zip([(i, t) for i, t in rows], scanned([t or "" for _, t in rows])))
    assert len(got) == len(rows)
    for r in got:
        have = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        w = want[(r.doc_id, r.text)]
        assert have[:-1] == w[:-1] and abs(have[-1] - w[-1]) < 2e-6, (r.doc_id, have, w)
    by_id = {r.doc_id: r for r in got}
    assert by_id[10_000].labels == "gpl-3" and by_id[10_004].labels == "mit" and by_id[10_005].labels == ""
    assert licenses.scan(df.limit(0)).count() == 0
    assert all("license" not in (r.text or "").lower() or r.labels for r in got if r.doc_id is not None and r.doc_id < 10_000)


def test_license_scan_without_templates(spark):
    df = spark.createDataFrame([(1, "a b a b a"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(df, phrases={"x": "a b"}, templates={}).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].labels) == (2, 0, 2, "x")
    assert rows[2].n_words == 0
    assert licenses.scan(df, phrases={}, templates={}).filter("score > 0").count() == 0
