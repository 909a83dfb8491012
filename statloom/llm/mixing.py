"""Documents sampled so that token weights meet target shares of source, language and topic.

Tokens are summed per cell of the three margins. Iterative proportional fitting scales the cells'
weights to each margin's targets in turn, never above what a cell holds; a document is kept with
the probability that its cell ends with, decided by a hash of its key, so that the kept tokens
meet the targets as far as the corpus allows. Only the table of cells is iterated on.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import batched

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.rows import packed, unpacked
from statloom.operators.stage import Stage

ROUNDS, ROUNDS_A_JOB = 18, 6
#: A table of cells up to this size is kept in one task, and broadcast; a larger one is shuffled.
SMALL_CELLS = 20_000
MARGINS = ("source", "lang", "topic")
# What tells the topics of the given documents.
TOPICS = {
    "licence": ("icense", "Copyright"),
    "contact": ("@", "+1 ("),
    "secret": ("token =", "password=", "AKIA"),
    "markup": (" | ", "###", "***", "!!"),
}
Targets = Mapping[str, float | Mapping[str, float]]


def topic_of(text: Column, topics: Mapping[str, tuple[str, ...]] = TOPICS) -> Column:
    """The topic with the most occurrences of its marks, the first of equals; ``prose`` without any."""
    chars = F.length(text)
    hits = {t: sum((chars - F.length(F.replace(text, F.lit(m)))) / len(m) for m in marks) for t, marks in topics.items()}
    most = F.greatest(*hits.values()) if len(hits) > 1 else next(iter(hits.values()))
    return F.when(most > 0, F.coalesce(*[F.when(h == most, F.lit(t)) for t, h in hits.items()])).otherwise("prose")


def words_of(text: Column) -> Column:
    """Runs of characters between spaces and line breaks: the weight of a document."""
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+")).cast("long")


def _shares(cells: DataFrame, margin: str, target: float | Mapping[str, float]) -> DataFrame:
    """``cells`` with the target share of each one's value of ``margin``."""
    held = F.sum("tokens").over(Window.partitionBy(margin)).cast("double")
    listed = F.col(margin).isin(list(target)) if isinstance(target, Mapping) else F.lit(True)
    if isinstance(target, Mapping):
        given = F.coalesce(*[F.when(F.col(margin) == v, F.lit(float(s))) for v, s in target.items()], F.lit(0.0))
    else:
        given = F.pow(held, F.lit(float(target)))
    # Each value counts once: its cells' parts of it sum to 1.
    cells = cells.withColumn("_given", given).withColumn("_once", F.when(held > 0, F.col("_given") * F.col("tokens") / held))
    total, inside, whole = cells.agg(F.sum("_once"), F.sum(F.when(listed, F.col("tokens"))), F.sum("tokens")).first()
    # Values left out keep their share of the corpus; those listed divide what is left.
    rest = (inside or 0) / whole if whole else 1.0
    share = F.when(listed, F.col("_given") / F.lit(total or 1.0) * F.lit(rest)).otherwise(held / F.lit(float(whole or 1)))
    return cells.withColumn(f"share_{margin}", share).drop("_given", "_once")


def raked(cells: DataFrame, targets: Targets, fraction: float, stage: Stage, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margins, ``tokens``) with ``probability``: the share of each cell to keep."""
    n, total = cells.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if n <= SMALL_CELLS:
        cells = cells.coalesce(1)
    for margin, target in targets.items():
        cells = _shares(cells, margin, target)
    budget = float(total) * fraction
    cells = cells.withColumn("w", F.col("tokens") * F.lit(float(fraction)))
    for job, turns in enumerate(batched(range(rounds), ROUNDS_A_JOB)):
        for _ in turns:
            for margin in targets:
                now = F.sum("w").over(Window.partitionBy(margin))
                scaled = F.when(now > 0, F.col("w") * F.col(f"share_{margin}") * F.lit(budget) / now).otherwise(0.0)
                cells = cells.withColumn("w", F.least(scaled, F.col("tokens").cast("double")))
        cells = stage.put(cells, f"raked-{job}")
        cells = cells.coalesce(1) if n <= SMALL_CELLS else cells
    share = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(float(fraction))
    return cells.select(*targets, F.round(share, 6).alias("probability"))


def described(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """``columns`` of a table with the ``topic`` and ``n_tokens`` of each text: what mixing needs of it."""
    words = F.coalesce(words_of(F.col(text)), F.lit(0)).cast("long")
    return df.select(*columns, topic_of(F.coalesce(F.col(text), F.lit(""))).alias("topic"), words.alias("n_tokens"))


def draw(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the key and the seed alone."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def with_probability(
    df: DataFrame, targets: Targets, fraction: float, key: str = "doc_id", text: str = "text",
    columns: Mapping[str, Column] | None = None, tokens: Column | None = None, seed: int = 0,
) -> DataFrame:
    """All rows and columns with ``topic``, ``n_tokens``, ``probability`` and ``kept``.

    ``targets`` gives each margin either shares by value or an exponent: the shares of the corpus
    to that power. Values left out, null included, keep their corpus share, and the given shares
    divide the rest; a value is excluded by a share of 0. ``fraction`` is the part of all tokens to
    keep. A margin is a column of the table or one of ``columns`` (default: ``topic`` from the
    text). Null margins are a value of their own, the empty one; null texts have no tokens and
    are kept with the cell's probability (``fraction`` in a cell without any). Rows of one key
    are kept or left together if their cells are one. Result columns replace existing ones.
    """
    stage = Stage(df.sparkSession, "mixing")
    columns = columns or {"topic": topic_of(F.coalesce(F.col(text), F.lit("")))}
    tokens = F.coalesce(words_of(F.col(text)) if tokens is None else tokens, F.lit(0)).cast("long")
    margin = {m: F.coalesce(columns.get(m, F.col(m) if m in df.columns else F.lit(None)).cast("string"), F.lit("")) for m in targets}
    cells = df.select(*[c.alias(m) for m, c in margin.items()], tokens.alias("tokens")).groupBy(*margin).agg(F.sum("tokens").alias("tokens"))
    cells = raked(stage.put(cells, "cells"), targets, fraction, stage)
    if cells.count() <= SMALL_CELLS:
        cells = F.broadcast(cells)
    rows = packed(df, key=F.col(key), n_tokens=tokens, **{f"m_{m}": c for m, c in margin.items()})
    rows = rows.join(cells.select(*[F.col(m).alias(f"m_{m}") for m in targets], "probability"), [f"m_{m}" for m in targets])
    made = {m: F.col(f"m_{m}") for m in columns if m in targets}
    kept = draw(F.col("key"), seed) < F.col("probability")
    return unpacked(rows, df, **made, n_tokens=F.col("n_tokens"), probability=F.col("probability"), kept=kept)


def mix_sql(targets: Targets, fraction: float, seed: int = 0, rounds: int = ROUNDS) -> str:
    """The same on ``documents`` in DuckDB SQL."""
    marks = {t: " + ".join(f"(length(tx) - length(replace(tx, '{m}', ''))) / {len(m)}::DOUBLE" for m in ms) for t, ms in TOPICS.items()}
    topics = ", ".join(f"{e} AS h_{t}" for t, e in marks.items())
    most = f"greatest({', '.join(f'h_{t}' for t in TOPICS)})"
    topic = "CASE WHEN m = 0 THEN 'prose' " + " ".join(f"WHEN h_{t} = m THEN '{t}'" for t in TOPICS) + " END"
    steps, last = [], "cells"
    for m, target in targets.items():
        if isinstance(target, Mapping):
            given = "CASE " + " ".join(f"WHEN {m} = '{v}' THEN {float(s)!r}::DOUBLE" for v, s in target.items()) + " ELSE 0 END"
            listed = f"{m} IN ({', '.join(repr(v) for v in target)})"
        else:
            given, listed = f"pow(held, {float(target)!r}::DOUBLE)", "true"
        steps += [f"held_{m} AS (SELECT *, (sum(tokens) OVER (PARTITION BY {m}))::DOUBLE AS held FROM {last})",
                  f"given_{m} AS (SELECT *, {given} AS given FROM held_{m})",
                  f"share_{m} AS (SELECT * EXCLUDE (held, given), CASE WHEN {listed} THEN given / (SELECT sum(given * tokens / held) FROM given_{m} WHERE held > 0) "
                  f"* (SELECT coalesce(sum(tokens) FILTER (WHERE {listed}), 0)::DOUBLE / sum(tokens) FROM given_{m}) ELSE held / (SELECT sum(tokens) FROM given_{m}) END AS share_{m} FROM given_{m})"]
        last = f"share_{m}"
    steps.append(f"w0 AS (SELECT *, tokens * {fraction!r}::DOUBLE AS w FROM {last})")
    last, i = "w0", 0
    for _ in range(rounds):
        for m in targets:
            i += 1
            steps.append(f"w{i} AS (SELECT * EXCLUDE (w), least(CASE WHEN now > 0 THEN w * share_{m} * budget / now ELSE 0 END, tokens::DOUBLE) AS w FROM "
                         f"(SELECT * EXCLUDE (now), now FROM (SELECT *, sum(w) OVER (PARTITION BY {m}) AS now FROM {last})), budget)".replace("SELECT * EXCLUDE (w), ", "SELECT * EXCLUDE (w, now, budget), "))
            last = f"w{i}"
    return f"""WITH texts AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS tx FROM documents),
marked AS (SELECT *, {topics} FROM texts),
rated AS (SELECT *, {most} AS m FROM marked),
docs AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(tx, '[^ \\t\\r\\n]+'))::BIGINT AS n_tokens FROM rated),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
budget AS (SELECT sum(tokens)::DOUBLE * {fraction!r}::DOUBLE AS budget FROM cells),
{", ".join(steps)},
p AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN w / tokens ELSE {fraction!r}::DOUBLE END, 6) AS probability FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, probability,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)!r} < probability AS kept
FROM docs JOIN p USING (source, lang, topic)"""
