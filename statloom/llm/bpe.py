"""BPE encoding and decoding of whole texts with a tokenizer file.

Texts up to ``leaf_chars`` are encoded where they lie. A longer one is halved until its parts
are that short, wherever the cuts fall; the leaves are encoded in parallel over the cluster and
put together again pair by pair. At each join a window around the cut is encoded anew and grows
until it agrees with the left part's tokens at its left edge and with the right part's at its
right edge, each edge being a place that no pre-token, special string or normalisation spans;
the tokens between the edges are the window's. Every join is therefore exact, and so is the whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.cuts import pieces, plain, runs
from statloom.llm.rows import giving_back, packed, unpacked

LEAF_CHARS = 32_768
FIRST_WINDOW = 64
#: Bytes of distinct words and their ids remembered in one task before the memory is emptied; it
#: changes no result. Each word takes some bytes beside its characters.
REMEMBERED, BESIDE = 48 << 20, 200
#: Rows that are decoded at a time.
ROWS_AT_ONCE = 500
ENCODED_AT_ONCE = 4096
BATCH_BYTES = 1 << 20
#: A space after a non-space, or a change between ASCII letters and digits.
_EDGE = re.compile(r"(?<=\S)(?= )|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


class Encoder:
    """Ids of whole texts; words that come again are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        split = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        # Where the pattern drops white space and ends at a letter's end, words are encoded one by one.
        self.by_word = any(x["behavior"] == "Removed" and x["invert"] for x in split) and not any(
            set(" .,") & set(t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]
        )
        self.known: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), ENCODED_AT_ONCE):
            for x in self.library.encode_batch_fast(texts[i : i + ENCODED_AT_ONCE], add_special_tokens=False):
                yield np.asarray(x.ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit numbers."""
        if not self.by_word:
            return list(self._ids(texts))
        words = [pieces(text, easy) for text, easy in zip(texts, plain(pa.array(texts, pa.string())).tolist())]
        distinct = set().union(*words)
        if self.held > REMEMBERED:
            self.forget()
        new = [x for x in distinct if x not in self.known]
        for word, ids in zip(new, self._ids(new)):
            self.known[word] = ids
            self.held += len(word) + len(ids) + BESIDE
        return [b"".join(map(self.known.__getitem__, x)) for x in words]

    def joined(self, left: tuple[str, bytes], right: tuple[str, bytes]) -> tuple[str, bytes]:
        """The tokens of two neighbouring parts as one."""
        (a, a_ids), (b, b_ids) = left, right
        size = FIRST_WINDOW
        while True:
            tail, head = a[-size:], b[:size]
            starts = [m.start() for m in _EDGE.finditer(tail)] if size < len(a) else [0]
            ends = [m.start() for m in _EDGE.finditer(head)] if size < len(b) else [len(b)]
            if starts and ends:
                old_left, window, old_right = self.encode([tail[starts[0] :], tail[starts[0] :] + head[: ends[-1]], head[: ends[-1]]])
                # Both sides hold exactly the tokens that the window replaces.
                if a_ids[len(a_ids) - len(old_left) :] == old_left and b_ids[: len(old_right)] == old_right:
                    return a + b, a_ids[: len(a_ids) - len(old_left)] + window + b_ids[len(old_right) :]
            if size >= len(a) and size >= len(b):
                return a + b, self.encode([a + b])[0]
            size *= 2

    def tree(self, parts: list[tuple[str, bytes]]) -> bytes:
        while len(parts) > 1:
            parts = [self.joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1]


def packed_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]) // 4
    values = pa.array(np.frombuffer(b"".join(ids), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _encoder(path: str):
    @giving_back
    def ids(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for array in arrays:
            # Run by run, so that neither side holds the ids of a whole batch.
            for run in runs(pc.fill_null(array, ""), BATCH_BYTES):
                yield packed_lists(encoder.encode(run.to_pylist()))

    return ids


def encoded(text: Column | str, path: str) -> Column:
    """``array<int>`` of the ids of a text, encoded in one piece; null is empty."""
    return F.arrow_udf(_encoder(path), "array<int>")(text)


def names_alone(library) -> list[str] | None:
    """The tokens' names where decoding joins them by spaces and needs no more than that."""
    if library.decoder is not None:
        return None
    return [library.id_to_token(i) for i in range(library.get_vocab_size(with_added_tokens=True))]


def decoded(ids: Column | str, path: str, skip_special_tokens: bool = False) -> Column:
    """The text of an array of ids as the library decodes it; null is empty, unknown ids are left out."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ids = F.col(ids) if isinstance(ids, str) else ids

    def texts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        for array in arrays:
            out = []
            for i in range(0, len(array), ROWS_AT_ONCE):
                rows = [x or [] for x in array.slice(i, ROWS_AT_ONCE).to_pylist()]
                out.append(pa.array(library.decode_batch(rows, skip_special_tokens=skip_special_tokens), pa.string()))
            yield pa.concat_arrays(out) if out else pa.array([], pa.string())

    return F.arrow_udf(texts, "string")(ids)


def _put_together(path: str):
    at_hand: list[Encoder] = []  # one for all texts of a task

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if not at_hand:
            at_hand.append(Encoder(path))
        pdf = pdf.sort_values("i")
        parts = [(text, np.asarray(ids, np.int32).tobytes()) for text, ids in zip(pdf["part"], pdf["ids"])]
        whole = np.frombuffer(at_hand[0].tree(parts), np.int32)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "ids": [whole]})

    return merge


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """All rows and columns with ``ids``: the ids of each whole text, without added special tokens.

    A null or empty text has no ids. Equal long texts are encoded once. A column named like the
    result is replaced; repeated rows stay; an empty table stays empty.
    """
    rows = packed(df, text=F.coalesce(F.col(text), F.lit("")))
    chars = F.length("text")
    short = rows.filter(chars <= leaf_chars).withColumn("ids", encoded("text", path))
    long = rows.filter(chars > leaf_chars).withColumn("key", F.sha2("text", 256))
    n = F.pow(F.lit(2), F.ceil(F.log2(chars / leaf_chars))).cast("long")
    start = lambda i: F.floor(i * chars / F.col("n")).cast("int")
    leaves = (
        long.select("key", "text", n.alias("n"))
        .select("key", "text", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
        .select("key", "i", F.substring("text", start(F.col("i")) + 1, start(F.col("i") + 1) - start(F.col("i"))).alias("part"))
        # Copies leave one leaf each; leaves of one text go to different tasks.
        .dropDuplicates(["key", "i"])
        .withColumn("ids", encoded("part", path))
    )
    whole = leaves.groupBy("key").applyInPandas(_put_together(path), "key string, ids array<int>")
    long = long.join(whole, "key").select(*short.columns)
    return unpacked(short.unionByName(long), df, **{ids: F.col("ids")})


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows and columns with the text that the library makes of ``ids``, special tokens kept."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    names = names_alone(Tokenizer.from_file(path))
    if names is None:
        return unpacked(packed(df, ids=F.col(ids)), df, **{text: decoded("ids", path)})
    # The names are the value of a subquery: as a literal, each description of the plan that the
    # driver keeps would spell them all out.
    table = df.sparkSession.createDataFrame(pa.table({"names": pa.array([names])}))
    rows = packed(df, ids=F.col(ids), names=table.scalar())
    found = F.transform("ids", lambda i: F.when(i >= 0, F.get("names", i)))
    return unpacked(rows, df, **{text: F.coalesce(F.array_join(found, " "), F.lit(""))})
