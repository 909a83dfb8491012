"""URL verdicts by rules, and by a character language-model ratio where no rule fits.

Two Markov models of variable order are counted over the distinct URLs that the rules allow and
block: each order is smoothed towards the next lower one by the number of different characters
seen after its context, and contexts never seen are skipped. A URL's score is the difference of
its log-likelihoods, per character. URLs kept back from the counts place the threshold: the two
classes' mean scores and common variance give the probability of acceptance.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.rows import packed, unpacked
from statloom.operators.stage import Stage

ORDER = 4
ALPHABET = 256
#: One in so many distinct URLs is kept back for the threshold.
FOLDS = 5
#: A model table of this many bytes or less is broadcast; a larger one is shuffled.
BROADCAST_BYTES, GRAM_BYTES = 32 << 20, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column | str, path: Column | str, rules: Mapping[str, str]) -> Column:
    """The longest rule ``host/path`` that fits: the host or a subdomain, and the start of the path."""
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        here = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(F.when(here & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _grams(text: Column, order: int) -> Column:
    """Every character with the ``order`` ones before it, the end of the text included."""
    padded = F.concat(F.lit("\x02" * order), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def model(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, ratio)``: the log-probability of the last character in accepted less rejected texts.

    ``grams`` has every gram once with its counts ``yes`` and ``no``, zero for grams of texts
    that only need a score.
    """
    below = None
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        seen = grams.groupBy(tail.alias("g")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        context = F.substring("g", 1, k) if k else F.lit("")
        seen = seen.withColumn("context", context)
        total = seen.groupBy("context").agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("yes", "no")],
            *[F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}") for c in ("yes", "no")],
        )
        level = seen.join(total, "context")
        if below is None:
            lower = {c: F.lit(1.0 / ALPHABET) for c in ("yes", "no")}
        else:
            level = level.withColumn("short", F.substring("g", 2, k)).join(below, "short")
            lower = {c: F.col(f"p_{c}") for c in ("yes", "no")}
        new = {
            c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * lower[c]) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(lower[c])
            for c in ("yes", "no")
        }
        below = level.select(F.col("g").alias("short"), *[p.alias(f"p_{c}") for c, p in new.items()])
    return below.select(F.col("short").alias("gram"), (F.ln("p_yes") - F.ln("p_no")).alias("ratio"))


def judge(
    df: DataFrame, rules: Mapping[str, str], url: str = "url", order: int = ORDER, folds: int = FOLDS,
) -> DataFrame:
    """All rows and columns with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``; the models read the whole URL, scheme,
    query and fragment included (null as empty). A null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the models like any other. Equal URLs
    are counted once and judged alike; repeated rows stay. If the rules accept or reject nothing
    there is nothing to compare: the score is null and the verdict ``allow``. Columns of the
    result's names are replaced; an empty table stays empty.
    """
    stage = Stage(df.sparkSession, "url-lm")
    rows = packed(df, host=host_of(F.col(url)), path=path_of(F.col(url)), text=F.coalesce(F.col(url), F.lit("")))
    urls = rows.select("host", "path", "text").distinct().withColumn("rule", rule_of("host", "path", rules))
    allowed = [r for r, v in rules.items() if v == "allow"]
    urls = urls.select(
        "text", F.col("rule").isin(allowed).alias("yes"),
        (F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("long") % folds == 0).alias("kept_back"),
    )
    urls = stage.put(urls, "urls")
    told = F.col("yes").isNotNull() & ~F.col("kept_back")
    spread = urls.select("text", F.explode(_grams(F.col("text"), order)).alias("gram"), (told & F.col("yes")).alias("yes"), (told & ~F.col("yes")).alias("no"))
    counts = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("yes", "no")]
    grams = stage.put(spread.groupBy("gram").agg(*counts), "grams")
    size, n_yes, n_no = grams.agg(F.count(F.lit(1)), *counts).first()
    result = dict(host=F.col("host"), path=F.col("path"), rule=rule_of("host", "path", rules))
    by_rule = F.coalesce(*[F.when(result["rule"] == r, F.lit(v)) for r, v in rules.items()], F.lit(None)) if rules else F.lit(None)
    if not n_yes or not n_no:
        verdict = F.coalesce(by_rule, F.lit("allow"))
        return unpacked(rows, df, **result, score=F.lit(None).cast("double"), verdict=verdict)
    ratios = stage.put(model(grams, order), "ratios")
    if size * GRAM_BYTES <= BROADCAST_BYTES:
        ratios = F.broadcast(ratios)
    scores = spread.select("text", "gram").join(ratios, "gram").groupBy("text")
    scores = stage.put(scores.agg(F.round(F.avg("ratio"), 9).alias("score")), "scores")
    middle = calibrated(scores.join(urls.filter("kept_back and yes is not null"), "text"))
    verdict = F.coalesce(by_rule, F.when(F.col("score") >= middle, "allow").otherwise("block"))
    rows = rows.join(scores, "text")
    return unpacked(rows, df, **result, score=F.col("score"), verdict=verdict)


def calibrated(known: DataFrame) -> float:
    """The score at which acceptance and rejection are equally likely, classes weighing alike.

    With one common variance that is the middle of the two means; 0 where a class has no URL.
    """
    row = known.agg(F.avg(F.when(F.col("yes"), F.col("score"))), F.avg(F.when(~F.col("yes"), F.col("score")))).first()
    return 0.0 if row[0] is None or row[1] is None else round(math.fsum(row) / 2, 6)


def judge_sql(rules: Mapping[str, str], order: int = ORDER, folds: int = FOLDS) -> str:
    """The same verdicts on ``pages`` in DuckDB SQL."""
    def fits(r):
        name, slash, rest = r.partition("/")
        return f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN '{r}'"

    rule = "CASE " + " ".join(fits(r) for r in sorted(rules, key=lambda r: (-len(r), r))) + " END"
    allowed = ", ".join(f"'{r}'" for r, v in rules.items() if v == "allow")
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items())
    pad = " || ".join(["chr(2)"] * order)
    levels, lower = [], None
    for k in range(order + 1):
        levels.append(f"seen{k} AS (SELECT substr(gram, {order + 1 - k}, {k + 1}) AS g, sum(yes) AS yes, sum(no) AS no FROM grams GROUP BY 1)")
        levels.append(f"total{k} AS (SELECT substr(g, 1, {k}) AS context, sum(yes) AS n_yes, sum(no) AS n_no, sum((yes > 0)::INT) AS t_yes, sum((no > 0)::INT) AS t_no FROM seen{k} GROUP BY 1)")
        low = (lambda c: f"{1.0 / ALPHABET!r}::DOUBLE") if k == 0 else (lambda c: f"b.p_{c}")
        value = lambda c: f"CASE WHEN n_{c} > 0 THEN (s.{c} + t_{c} * {low(c)})::DOUBLE / (n_{c} + t_{c}) ELSE {low(c)} END AS p_{c}"  # noqa: E731, B023
        join = f" JOIN level{k - 1} b ON b.g = substr(s.g, 2, {k})" if k else ""
        levels.append(f"level{k} AS (SELECT s.g, {value('yes')}, {value('no')} FROM seen{k} s JOIN total{k} t ON t.context = substr(s.g, 1, {k}){join})")
    return f"""WITH parts AS (SELECT page_id, coalesce(url, '') AS text, coalesce(translate(regexp_extract(url, '{_PARTS}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule FROM parts),
urls AS (SELECT DISTINCT text, CASE WHEN rule IS NOT NULL THEN rule IN ({allowed}) END AS yes,
  ('0x' || substr(md5(text), 1, 4))::BIGINT % {folds} = 0 AS kept_back FROM ruled),
places AS (SELECT *, unnest(range(1, length(text) + 2)) AS place FROM urls),
spread AS (SELECT text, yes, kept_back, substr({pad} || text || chr(3), place, {order + 1}) AS gram FROM places),
grams AS (SELECT gram, sum((yes IS NOT NULL AND yes AND NOT kept_back)::INT) AS yes, sum((yes IS NOT NULL AND NOT yes AND NOT kept_back)::INT) AS no FROM spread GROUP BY 1),
{", ".join(levels)},
scores AS (SELECT text, round(avg(ln(p_yes) - ln(p_no)), 9) AS score FROM spread JOIN level{order} ON g = gram GROUP BY 1),
middle AS (SELECT round((avg(score) FILTER (WHERE yes) + avg(score) FILTER (WHERE NOT yes)) / 2, 6) AS m
  FROM scores JOIN urls USING (text) WHERE kept_back AND yes IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, CASE WHEN score >= coalesce(m, 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scores USING (text), middle"""
