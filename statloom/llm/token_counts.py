"""Token counts of whole texts without keeping tokens.

An Arrow function takes texts in batches balanced by bytes, cuts them before spaces that follow
a non-space and before full stops and commas that follow a letter, encodes each distinct piece of
a batch once, and returns the sums of their lengths. No pre-token of the byte-level pattern spans
such a place (a word may take the one space before it, nothing takes a word and what follows its
last letter), nor does a special string, so the sum over the pieces is the count of the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.cuts import pieces, plain, runs

BATCH_BYTES = 4 << 20
#: Encodings that the library holds at a time.
ENCODED_AT_ONCE = 4096
#: Distinct pieces remembered in one task before the memory is emptied; it changes no result.
REMEMBERED = 1_000_000
def _lengths(path: str) -> tuple:
    """Two functions: counts of pieces as they are, and of pieces after a space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), None
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def lengths(texts: list[str]) -> list[int]:
        runs = (texts[i : i + ENCODED_AT_ONCE] for i in range(0, len(texts), ENCODED_AT_ONCE))
        return [len(x) for run in runs for x in library.encode_batch_fast(run, add_special_tokens=False)]

    return lengths, library


def _byte_level(library) -> bool:
    """Whether the tokenizer is of the kind whose texts may be cut before spaces."""
    import json

    spec = json.loads(library.to_str())
    pre = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not any(
        t["lstrip"] or t["rstrip"] or set(" .,") & set(t["content"]) for t in spec["added_tokens"]
    )


def _counter(path: str, batch_bytes: int):
    def count(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, library = _lengths(path)
        cut = library is not None and _byte_level(library)
        known: dict[str, int] = {}
        for array in arrays:
            out: list[int] = []
            for batch in runs(pc.fill_null(array, ""), batch_bytes):
                if not cut:
                    out.extend(encode(batch.to_pylist()))
                    continue
                split = [pieces(text, easy) for text, easy in zip(batch.to_pylist(), plain(batch).tolist())]
                distinct = set().union(*split)
                if len(known) + len(distinct) > REMEMBERED:
                    known = {}
                new = [x for x in distinct if x not in known]
                known.update(zip(new, encode(new)))
                out.extend(sum(map(known.__getitem__, x)) for x in split)
            yield pa.array(out, pa.int64())

    return count


def token_length(text: Column | str, path: str, batch_bytes: int = BATCH_BYTES) -> Column:
    """Number of tokens of a text (null: 0) under the tokenizer file at ``path``.

    ``.json`` files are read by the tokenizers library, ``.model`` files by sentencepiece. No
    begin, end or added special token is counted; special strings inside a text are handled as
    the library does by default. The path must be readable on every executor.
    """
    return F.arrow_udf(_counter(path, batch_bytes), "long")(text)


def count_tokens(
    df: DataFrame, path: str, text: str = "text", limit: int = 512, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """All rows and columns, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay. Columns of these names
    that the table already has are replaced; an empty table stays empty.
    """
    counted = df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    counted = counted.withColumn("n_tokens", token_length(F.col(text), path, batch_bytes))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
