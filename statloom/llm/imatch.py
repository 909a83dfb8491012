"""I-Match fingerprints over randomised lexicon subsets, in DataFrame expressions alone.

The lexicon holds the terms whose inverse document frequency lies in a band: neither those that
most documents have nor those of a handful. It is kept as a bitmap of fixed size over hashed
terms, whose document frequencies are counted over all documents, so that what every task
receives does not grow with the vocabulary; rare terms that share a bit only add to its count.

A document's distinct lexicon terms are sorted and hashed once per subset. At level L a subset
holds a random 1 / 2^L of the lexicon; a document uses the level at which a subset keeps about one
of its terms, and the next one, so that documents of any length have subsets that an edit misses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.rows import packed, unpacked
from statloom.operators.stage import Stage

#: Shares of documents between which a term belongs to the lexicon: idf from ln 5 to ln 2000.
MOST, LEAST = 1 / 5, 1 / 2000
SUBSETS = 32
BITS = 1 << 21
_PART = 32_768  # bits in one part of the bitmap: what bitmap_construct_agg returns
_NOT_A_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _NOT_A_TERM), lambda t: t != ""))


def _bit(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BITS))


def lexicon(df: DataFrame, text: str = "text", most: float = MOST, least: float = LEAST) -> DataFrame:
    """One row, ``parts``: the bitmap of terms in the band, counted over every document.

    A term of a single document is never in it, whatever the size of the table.
    """
    docs = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    bits = docs.select(F.explode(F.array_distinct(F.transform(terms(F.col("text")), _bit))).alias("bit"))
    counts = bits.groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = counts.filter((F.col("n") > 1) & (F.col("n") >= total * least) & (F.col("n") <= total * most))
    parts = kept.groupBy((F.col("bit") / _PART).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(_PART))).alias("bits")
    )
    found = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("m"))
    none = F.unhex(F.lit("00" * (_PART // 8)))
    return found.select(F.transform(F.sequence(F.lit(0), F.lit(BITS // _PART - 1)), lambda i: F.coalesce(F.element_at("m", i), none)).alias("parts"))


def _in_lexicon(bit: Column, parts: Column) -> Column:
    part = F.element_at(parts, (bit / _PART).cast("int") + 1)
    place = F.pmod(bit, F.lit(_PART)).cast("int")
    byte = F.conv(F.hex(F.substring(part, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)))) != 0


def with_fingerprint(df: DataFrame, text: str, parts: Column, name: str, seed: int = 0) -> DataFrame:
    """``df`` with the struct ``name``: the level, a hash per subset at it and at the next one, and the string.

    A text without lexicon terms is hashed by all its terms, at level -1. Empty subsets hash to ''.
    """
    salted = lambda t: F.xxhash64(F.lit(seed), t)
    df = df.withColumn("_terms", terms(F.col(text)))
    # Named first, as a subquery may not be written inside a lambda; the optimizer puts it there.
    names = df.columns
    kept = F.filter("_terms", lambda t: _in_lexicon(_bit(t), F.col("_lexicon")))
    df = df.withColumn("_lexicon", parts).select(*names, kept.alias("_kept"))
    n = F.size("_kept")
    level = F.when(n == 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(1.5)))).cast("int"))
    df = df.withColumn("_level", F.greatest(level, F.when(n == 0, F.lit(-1)).otherwise(F.lit(int(math.log2(SUBSETS))))))
    # Only terms of the first SUBSETS parts of the lexicon at this level matter.
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest("_level", F.lit(0)))
    cells = F.transform("_kept", lambda t: F.struct(F.pmod(salted(t), 2 * size).alias("cell"), t.alias("term")))
    df = df.withColumn("_size", size).withColumn("_cells", F.array_sort(F.filter(cells, lambda c: F.pmod(c["cell"], size) < SUBSETS)))

    def hashes(modulus: Column) -> Column:
        def one(k: Column) -> Column:
            own = F.filter("_cells", lambda c: F.pmod(c["cell"], modulus) == k)
            joined = F.array_join(F.array_sort(F.transform(own, lambda c: c["term"])), " ")
            return F.when(F.size(own) == 0, F.lit("")).otherwise(F.substring(F.lpad(F.lower(F.hex(F.xxhash64(joined))), 16, "0"), 1, 8))

        return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)

    plain = F.array(F.md5(F.array_join(F.array_sort("_terms"), " ")))
    df = df.withColumn("_low", F.when(F.col("_level") < 0, plain).otherwise(hashes(F.col("_size"))))
    df = df.withColumn("_high", F.when(F.col("_level") < 0, F.array().cast("array<string>")).otherwise(hashes(2 * F.col("_size"))))
    whole = F.concat_ws("|", F.col("_level").cast("string"), F.array_join("_low", ","), F.array_join("_high", ","))
    made = F.struct(F.col("_level").alias("level"), F.col("_low").alias("low"), F.col("_high").alias("high"), whole.alias("string"))
    return df.withColumn(name, made).drop("_terms", "_kept", "_level", "_size", "_cells", "_low", "_high")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes (0 to 1) among the subsets that are not empty in both.

    Fingerprints more than one level apart - one has at least twice the terms - are 0 alike, as
    are one with and one without lexicon terms; two without are alike if equal.
    """
    left = F.when(a["level"] < b["level"], a["high"]).otherwise(a["low"])
    right = F.when(b["level"] < a["level"], b["high"]).otherwise(b["low"])
    used = F.filter(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: (p["l"] != "") | (p["r"] != ""))
    share = F.size(F.filter(used, lambda p: p["l"] == p["r"])) / F.size(used)
    same = (a["string"] == b["string"]).cast("double")
    comparable = (a["level"] >= 0) & (b["level"] >= 0) & (F.abs(a["level"] - b["level"]) <= 1)
    return F.when(same == 1, 1.0).when(comparable & (F.size(used) > 0), share).otherwise(0.0)


def fingerprints(df: DataFrame, text: str = "text", seed: int = 0, most: float = MOST, least: float = LEAST) -> DataFrame:
    """All rows and columns with ``fingerprint``; equal texts have equal ones.

    A null text counts as empty. Repeated rows stay; a column of that name is replaced.
    """
    parts = lexicon(df, text, most, least).scalar()
    rows = packed(df, text=F.coalesce(F.col(text), F.lit("")))
    rows = with_fingerprint(rows, "text", parts, "made", seed)
    return unpacked(rows, df, fingerprint=F.col("made.string"))


def _rank(values: list[int], x: Column) -> Column:
    """How many of the sorted values lie below ``x``, looked up in two steps."""
    if not values:
        return F.lit(0)
    step = math.isqrt(len(values) - 1) + 1
    runs = [values[i : i + step] for i in range(0, len(values), step)]
    run = F.least(F.size(F.filter(F.lit([r[-1] for r in runs]), lambda v: v < x)), F.lit(len(runs) - 1))
    return run * step + F.size(F.filter(F.element_at(F.lit([r + [r[-1]] * (step - len(r)) for r in runs]), run + 1), lambda v: v < x))


def with_next(df: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with ``next_<value>`` from the row that follows in descending ``key`` (after the last: the first).

    Rows are dealt over ranges of the key, cut at quantiles; the first row of each range also
    visits the range before it. No task sees more than a range. Equal keys follow ``order``; a
    key that most rows share would fill one range, so it should be almost unique.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts))).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    tops = sorted(r[0] for r in df.select(_rank(bounds, F.col(key)).alias("_range"), key).groupBy("_range").agg(F.max(key).alias("top")).select("top").collect())
    if not tops:
        return df.withColumns({f"next_{v}": F.col(v) for v in values})
    own = F.least(_rank(tops, F.col(key)), F.lit(len(tops) - 1))
    visits = F.when(F.element_at(F.lit(tops), own + 1) == F.col(key), F.pmod(own + 1, F.lit(len(tops))))
    places = F.filter(F.array(F.struct(own.alias("range"), F.lit(0).alias("visit")), F.struct(visits.alias("range"), F.lit(1).alias("visit"))), lambda p: p["range"].isNotNull())
    dealt = df.withColumn("_place", F.explode(places)).withColumns({"_range": F.col("_place.range"), "_visit": F.col("_place.visit")})
    window = Window.partitionBy("_range").orderBy("_visit", F.col(key).desc(), *order)
    dealt = dealt.withColumn("_next", F.lead(F.struct(*values)).over(window)).filter("_visit = 0")
    return dealt.withColumns({f"next_{v}": F.col(f"_next.{v}") for v in values}).drop("_place", "_range", "_visit", "_next")


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """How fingerprints answer an edit: each text, the text with its last third replaced, the next text.

    The last floor(n_chars / 3) code points give way to the first as many (or all) of the next
    document in descending key; null keys come last. Returns ``key``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    stage = Stage(df.sparkSession, "imatch")
    parts = stage.put(lexicon(df, text), "lexicon").scalar()
    lowest = -(2**63)
    docs = df.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = with_fingerprint(docs, "text", parts, "made", seed)
    docs = with_next(docs, "k", [F.col("id").isNull(), F.col("text")], ["text", "made"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    docs = docs.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "made", "next_made")
    docs = with_fingerprint(docs, "edited", parts, "edited_made", seed)
    return docs.select(
        F.col("id").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.col("made.string").alias("fingerprint"), F.col("edited_made.string").alias("edited_fingerprint"),
        likeness(F.col("made"), F.col("edited_made")).alias("near_edited"),
        likeness(F.col("made"), F.col("next_made")).alias("near_next"),
    )
