"""License scans by a positional index on rare words.

The words of all phrases and templates are few and fixed by the parameters. A first pass counts in
how many documents each of them stands; the index then keys every phrase by its word of highest
inverse document frequency, and every template by its ``RARE`` such words, each with the word's
place. A second pass looks up the places of these words in each text. A phrase stands where the
other words follow at their relative places; a template is aligned where enough weight of its rare
words agrees on one relative position (give or take ``SLACK`` words), and it is found if its
mandatory phrases also stand there. Both passes read whole texts and move no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.cuts import runs
from statloom.llm.hashing import NO_TERM, WordHasher
from statloom.llm.rows import packed, unpacked

BATCH_BYTES = 4 << 20
#: Words that a template is looked up by, the words it may shift by, and the weight that must agree.
RARE, SLACK, AGREEING = 8, 4, 0.6
# Phrases that give their label wherever they stand.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


class Template(NamedTuple):
    text: str
    mandatory: tuple[str, ...]


# What well-known licences say of themselves, and the words that must not be missing.
TEMPLATES = {
    "apache-2": [
        Template("licensed under the apache license version 2 0", ("apache license", "version 2")),
        Template("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ],
    "bsd": [
        Template("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
        Template("released under the bsd 3 clause license", ("bsd 3 clause",)),
    ],
    "cc-by-nc": [
        Template("licensed under cc by nc 4 0", ("cc by nc",)),
        Template("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ],
    "cc-by-sa": [
        Template("licensed under cc by sa 4 0", ("cc by sa",)),
        Template("this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ],
    "gpl-2": [Template("free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2"))],
    "gpl-3": [
        Template("this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
        Template("free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ],
    "isc": [Template("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "permission to use"))],
    "mit": [
        Template("released under the mit license", ("mit license",)),
        Template("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "to deal in the software without restriction")),
    ],
    "mpl-2": [Template("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",))],
}
Templates = Mapping[str, list[Template]]
_FOUND = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,spans:array<struct<label:string,start:bigint,end:bigint,share:double>>>"


def words_of(text: str) -> list[str]:
    """The words of a text, only A-Z lower-cased."""
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Vocabulary:
    """The words of phrases and templates, numbered in order; which of them a batch of texts holds."""

    def __init__(self, phrases: Mapping[str, str], templates: Templates):
        texts = [*phrases.values(), *(x for ts in templates.values() for t in ts for x in (t.text, *t.mandatory))]
        self.words = sorted({w for t in texts for w in words_of(t)})
        self.number = {w: i for i, w in enumerate(self.words)}

    def __call__(self, hasher: WordHasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word or -1) of every place in order, and each text's number of words."""
        if not hasattr(self, "hashes"):
            hashes = np.array([hasher(pa.array([w])).hash[0] for w in self.words], np.uint64)
            self.order = np.argsort(hashes)
            self.hashes = hashes[self.order]
        words = hasher(texts)
        at = np.minimum(np.searchsorted(self.hashes, words.hash), max(len(self.words) - 1, 0))
        word = np.where(self.hashes[at] == words.hash, self.order[at], -1) if self.words else np.full(len(words.hash), -1)
        return words.text, word, np.bincount(words.text, minlength=len(texts))

    def __getstate__(self):
        return {"words": self.words, "number": self.number}


def document_frequencies(texts: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that hold each word of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, size = WordHasher(NO_TERM), len(vocabulary.words)
        held, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for run in runs(pc.fill_null(batch.column("text"), ""), BATCH_BYTES):
                text, word, _ = vocabulary(hasher, run)
                pairs = np.unique(text[word >= 0] * size + word[word >= 0])
                held[:size] += np.bincount(pairs % size, minlength=size) if size else 0
                n += len(run)
        held[size] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(held)], ["word", "n"])

    counted = texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary.words) + 1, np.int64)
    out[counted["word"].to_numpy(int)] = counted["n"]
    return int(out[-1]), out[:-1]


class _Index:
    """Phrases by their rarest word, templates by their rarest words, with places."""

    def __init__(self, phrases: Mapping[str, str], templates: Templates, vocabulary: Vocabulary, n: int, df: np.ndarray):
        self.vocabulary = vocabulary
        idf = [math.log((n + 1) / (int(x) + 0.5)) for x in df]
        numbers = lambda text: [vocabulary.number[w] for w in words_of(text)]
        self.base = [(label, numbers(p)) for label, p in phrases.items()]
        self.templates = [(label, numbers(t.text), [numbers(m) for m in t.mandatory]) for label, ts in templates.items() for t in ts]
        checked = [m for _, _, ms in self.templates for m in ms]
        distinct = {tuple(p): None for p in [p for _, p in self.base] + checked if p}
        self.phrases = list(distinct)
        self.rarest = {p: max(range(len(p)), key=lambda i: (idf[p[i]], -i)) for p in self.phrases}
        self.postings: dict[int, list[tuple[int, int, int]]] = {}  # word: (template, its rare word, place)
        self.weights, self.lengths = [], []
        for t, (_, words, _) in enumerate(self.templates):
            rare = sorted(set(words), key=lambda w: (-idf[w], w))[:RARE]
            weight = np.array([max(idf[w], 1e-9) for w in rare])
            self.weights.append(weight / weight.sum())
            self.lengths.append(len(words))
            for place, w in enumerate(words):
                if w in rare:
                    self.postings.setdefault(w, []).append((t, rare.index(w), place))

    def phrase_starts(self, text: np.ndarray, word: np.ndarray) -> dict[tuple, np.ndarray]:
        """Where each phrase starts, looked up by its rarest word, every other word checked at its place."""
        out = {}
        for p, k in self.rarest.items():
            start = np.flatnonzero(word == p[k]) - k
            start = start[(start >= 0) & (start + len(p) <= len(word))]
            start = start[text[start] == text[start + len(p) - 1]]
            for i, w in enumerate(p):
                start = start[word[start + i] == w]
            out[p] = start
        return out

    def alignments(self, text: np.ndarray, word: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        """(template, text, offset, share) of the relative positions that rare words agree on.

        An offset is where the template would start in its text, whose first place is ``first``.
        """
        parts = []
        for w, postings in self.postings.items():
            at = np.flatnonzero(word == w)
            for t, slot, place in postings if len(at) else ():
                parts.append((np.full(len(at), t), text[at], at - first[text[at]] - place, np.full(len(at), slot)))
        if not parts:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("template", "text", "offset")} | {"share": pd.Series(dtype="float64")})
        template, owner, offset, slot = (np.concatenate(x) for x in zip(*parts))
        weight = np.zeros((len(self.weights), RARE))
        for t, x in enumerate(self.weights):
            weight[t, : len(x)] = x
        grids = []
        # Two grids, half a step apart: offsets that differ by the slack share a step of one of them.
        for shift in (0, SLACK):
            step = (offset + shift) // (2 * SLACK)
            one = pd.DataFrame({"template": template, "text": owner, "step": step, "slot": slot, "offset": offset})
            one["weight"] = weight[template, slot]
            one = one.groupby(["template", "text", "step", "slot"], sort=False).agg(weight=("weight", "first"), offset=("offset", "min"))
            grids.append(one.groupby(["template", "text", "step"], sort=False).agg(share=("weight", "sum"), offset=("offset", "min")).reset_index())
        return pd.concat(grids)[["template", "text", "offset", "share"]]


def _scan(index: _Index):
    def scan(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher(NO_TERM)
        for array in arrays:
            out = []
            for run in runs(pc.fill_null(array, ""), BATCH_BYTES):
                out.extend(_found(index, *index.vocabulary(hasher, run)))
            yield pa.array(out, _TYPE)

    return scan


_TYPE = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
])


def _found(index: _Index, text: np.ndarray, word: np.ndarray, n_words: np.ndarray) -> list[dict]:
    first = np.cumsum(n_words) - n_words
    starts = index.phrase_starts(text, word)
    n_base, low, high = np.zeros(len(n_words), np.int64), np.full(len(n_words), 1 << 62), np.full(len(n_words), -1)
    base: dict[int, set[str]] = {}
    spans: dict[int, set[tuple]] = {}
    for label, phrase in index.base:
        at = starts.get(tuple(phrase), np.zeros(0, np.int64))
        owner = text[at]
        np.add.at(n_base, owner, 1)
        np.minimum.at(low, owner, at - first[owner])
        np.maximum.at(high, owner, at - first[owner])
        for i, a in zip(owner.tolist(), (at - first[owner]).tolist()):
            base.setdefault(i, set()).add(label)
            spans.setdefault(i, set()).add((label, a, a + len(phrase), 1.0))
    score = np.zeros(len(n_words))
    aligned = index.alignments(text, word, first)
    np.maximum.at(score, aligned["text"].to_numpy(np.int64), aligned["share"].to_numpy(float))
    score[n_base > 0] = 1.0
    more: dict[int, set[str]] = {}
    for t, i, offset, share in aligned[aligned["share"] >= AGREEING].itertuples(index=False):
        label, _, mandatory = index.templates[t]
        lo, hi = max(offset - SLACK, 0), min(offset + index.lengths[t] + 2 * SLACK, n_words[i])
        if all(_stands(starts[tuple(m)], first[i] + lo, first[i] + hi - len(m)) for m in mandatory):
            more.setdefault(i, set()).add(label)
            start = max(offset, 0)
            spans.setdefault(i, set()).add((label, int(start), int(min(start + index.lengths[t], n_words[i])), round(float(share), 6)))
    out = []
    for i, n in enumerate(n_words.tolist()):
        kept, all_labels = base.get(i, set()), base.get(i, set()) | more.get(i, set())
        out.append({
            "n_words": n, "n_base": int(n_base[i]), "first_word": int(low[i]) if n_base[i] else None, "last_word": int(high[i]) if n_base[i] else None,
            "base_labels": ",".join(sorted(kept)), "labels": ",".join(sorted(all_labels)), "score": min(1.0, round(float(score[i]), 6)),
            "spans": [dict(zip(("label", "start", "end", "share"), x)) for x in sorted(spans.get(i, ()), key=lambda x: (x[1], x[0], x[2]))],
        })
    return out


def _stands(starts: np.ndarray, low: int, high: int) -> bool:
    at = np.searchsorted(starts, low)
    return at < len(starts) and starts[at] <= high


def scan(
    df: DataFrame, text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Templates = TEMPLATES
) -> DataFrame:
    """All rows and columns with ``n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    The base columns say how often the phrases stand in the text, where the first and last of these
    places start (words from 0; null without any) and their labels; ``labels`` has those and the
    labels of templates found. Labels are distinct, sorted and joined by commas. ``score`` is 1 with
    a phrase, else the largest share of a template's rare words that agree on a place. ``spans``
    lists the places with label, first word and end.

    A null text counts as empty: no words, empty labels, score 0. Words equally rare are taken in
    order, so ties have one outcome; repeated rows stay; columns named like the results are
    replaced; an empty table stays empty.
    """
    vocabulary = Vocabulary(phrases, templates)
    n, counts = document_frequencies(df.select(F.col(text).alias("text")), vocabulary)
    index = _Index(phrases, templates, vocabulary, n, counts)
    rows = packed(df, found=F.arrow_udf(_scan(index), _FOUND)(F.col(text)))
    names = [f.name for f in rows.schema["found"].dataType]
    return unpacked(rows, df, **{name: F.col("found").getField(name) for name in names})
