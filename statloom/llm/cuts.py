"""Places where a text may be cut without changing its tokens, and batches balanced by bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of bytes: 1 ASCII letter, 2 ASCII white space, 3 part of a longer character, 0 the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[[*range(9, 14), *range(28, 33)]], _KIND[128:] = 1, 2, 3


def plain(texts: pa.Array) -> np.ndarray:
    """Whether each text may be cut before every space, full stop and comma without a closer look.

    That is so if no such character starts the text or follows white space, a full stop or comma
    follows only letters, and a longer character before one is an accented Latin letter.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return np.ones(len(texts), bool)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    at = np.flatnonzero((raw == 32) | (raw == 44) | (raw == 46))
    before, kind = raw[np.maximum(at - 1, 0)], _KIND[raw[np.maximum(at - 1, 0)]]
    latin = (kind == 3) & (raw[np.maximum(at - 2, 0)] == 0xC3) & (before != 0x97) & (before != 0xB7)
    odd = np.where(raw[at] == 32, (kind == 2) | (kind == 3) & ~latin, (kind != 1) & ~latin)
    odd |= np.isin(at, starts)
    odd_texts = np.searchsorted(starts, np.concatenate([at[odd], np.flatnonzero(raw == 0)]), "right") - 1
    out = np.ones(len(texts), bool)
    out[odd_texts] = False
    return out


def pieces(text: str, plain: bool = False) -> list[str]:
    """The text cut before every space that follows a non-space and every [.,] that follows a letter.

    The letter must still end in one when it is lower-cased, as some tokenizers do first.
    """
    if plain:
        return text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").split("\0")
    out = [""]
    for part in re.split(r"(?=[ .,])", text):
        last = out[-1][-1:]
        if part[:1] == " " and last and not last.isspace() or part[:1] in (".", ",") and last.lower()[-1:].isalpha():
            out.append(part)
        else:
            out[-1] += part
    return out


def runs(texts: pa.Array, batch_bytes: int) -> Iterator[pa.Array]:
    """Runs of texts of about ``batch_bytes`` each; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - sizes) // batch_bytes
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)
