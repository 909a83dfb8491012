"""Words of a batch of texts as arrays: where they lie, which text they belong to, their 64-bit hashes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: ASCII characters that are neither letters nor digits: what lies between terms.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    raw: np.ndarray  # bytes of all texts
    first: np.ndarray  # first byte of each text, and the end
    text: np.ndarray  # text of each word
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray  # of the word with A-Z lower-cased


class WordHasher:
    """Words between bytes that are ``outside``; the tables of powers grow with the longest batch."""

    def __init__(self, outside: np.ndarray = _SPACE):
        self.outside = outside
        self.power = self.inverse = np.ones(0, np.uint64)

    def __call__(self, texts: pa.Array) -> Words:
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(ends[-1] - ends[0]) if len(texts) else 0
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if size else np.zeros(0, np.uint8)
        first = ends - ends[0] if len(texts) else np.zeros(1, np.int64)
        if size + 1 > len(self.power):
            self.power, self.inverse = _powers(_BASE, size + 1), _powers(_INVERSE, size + 1)
        inside = ~self.outside[raw]
        edge = np.zeros(size + 1, bool)  # a text starts here or the last one ends
        edge[first] = True
        before = np.concatenate([[False], inside[:-1]]) if size else inside
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if size else inside
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUES[_LOWER[raw]] * self.power[:size], out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * self.inverse[start])
        return Words(raw, first, np.searchsorted(first, start, "right") - 1, start, end, hashes)


def shingles(words: Words, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a text with fewer words gives the whole run."""
    count = np.bincount(words.text, minlength=n_texts)
    if len(words.text) >= size:
        ok = words.text[: len(words.text) - size + 1] == words.text[size - 1 :]
        total = np.zeros(len(ok), np.uint64)
        for k in range(size):
            total = mix(total + words.hash[k : k + len(ok)] + np.uint64(k + 1))
        text, value = words.text[: len(ok)][ok], total[ok]
    else:
        text, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    extra = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        here = count[short] > k
        extra[here] = mix(extra[here] + words.hash[first[short[here]] + k] + np.uint64(k + 1))
    extra = mix(extra + np.uint64(97) * count[short].astype(np.uint64))
    return np.concatenate([text, short]), np.concatenate([value, extra])
