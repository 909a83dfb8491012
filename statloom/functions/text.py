"""Column expressions that clean scraped text: spaces, ids, seasons, units, positions, drafts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Position names and their codes.
POSITION_CODES = {
    "point guard": "PG",
    "shooting guard": "SG",
    "small forward": "SF",
    "power forward": "PF",
    "center": "C",
    "guard": "G",
    "forward": "F",
}

# Unit conversions and the pseudo team of a combined season line.
CM_PER_FOOT = 30.48
CM_PER_INCH = 2.54
KG_PER_POUND = 0.45359237
TOTAL_TEAM_ID = "tot"

# Java's \s is ASCII only unless (?U) is set; the control separators are added by hand.
_SPACE = r"(?U)[\s\x1c-\x1f]"
#: The same characters one by one: trimming a set looks at the ends only, a pattern at every character.
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(c, F.lit(_SPACES))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First regex match, or NULL (Spark itself answers '' when nothing matches)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def to_int(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("int")


def to_number(c: Column) -> Column:
    # An empty cell is left out by itself: reading it as a number costs an exception.
    return F.nullif(strip(c.cast("string")), F.lit("")).try_cast("double")


def clean_text(c: Column) -> Column:
    """Collapse runs of white space, trim, and read an empty cell as NULL."""
    return F.nullif(F.trim(F.regexp_replace(c, rf"{_SPACE}+", " ")), F.lit(""))


def clean_id(c: Column) -> Column:
    return F.lower(strip(c.cast("string")))


def normalize_headers(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Lower-case and trim the column names, then apply a rename map."""
    return df.toDF(*[c.strip().lower() for c in df.columns]).withColumnsRenamed(renames or {})


def normalize_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Clean the named text columns, or every string column."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: clean_text(F.col(c).cast("string")) for c in columns})


def normalize_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean_id(F.col(c)) for c in columns})


def to_team_id(c: Column) -> Column:
    """Read a missing team, 'TOT' and '2TM', '3TM', … all as the combined line 'tot'."""
    # One expression, so that the id is cleaned once.
    return F.coalesce(F.regexp_replace(clean_id(c), r"^\d+tm$", TOTAL_TEAM_ID), F.lit(TOTAL_TEAM_ID))


def _repair_text(text: str, max_passes: int) -> str:
    def redecode(s: str) -> str | None:
        try:
            return s.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return None

    for _ in range(max_passes):
        # The string as it stands goes first: a no-break space may be half of a broken letter.
        better = redecode(text)
        if better is None and "\xa0" in text:
            better = redecode(text.replace("\xa0", " "))
        if better is None or better == text:
            break
        text = better
    return unicodedata.normalize("NFC", text)


def fix_mojibake(c: Column, max_passes: int = 3) -> Column:
    """Undo UTF-8 text that was read as Latin-1, and compose the result (NFC).

    Spark's strict codecs fail on bad bytes, so the repair is an Arrow UDF; pure ASCII
    text, which it cannot change, is sent as NULL and costs no transfer.
    """

    @F.pandas_udf("string")
    def repair(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: _repair_text(s, max_passes), na_action="ignore")

    suspect = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(repair(suspect), c)


def to_season_end_year(c: Column) -> Column:
    """'2024-25' becomes 2025; a plain year is kept."""
    text = strip(c.cast("string"))
    first = F.split(text, "-").getItem(0).try_cast("int")
    return F.when(text.rlike(r"^\d+(\.0*)?$"), text.try_cast("double").cast("int")).otherwise(first + 1)


def to_season_label(c: Column) -> Column:
    year = c.cast("int")
    return F.concat((year - 1).cast("string"), F.lit("-"), F.substring(year.cast("string"), -2, 2))


def height_to_cm(c: Column) -> Column:
    """Feet and inches ('6-5') in centimetres, one decimal."""
    parts = F.split(strip(c.cast("string")), "-")
    feet = F.try_element_at(parts, F.lit(1)).try_cast("double")
    inches = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.round(feet * CM_PER_FOOT + inches * CM_PER_INCH, 1)


def weight_to_kg(c: Column) -> Column:
    return F.round(to_number(c) * KG_PER_POUND, 1)


def split_positions(c: Column) -> Column:
    """The known positions a cell starts its tokens with, in order; anything else is dropped."""
    names = "|".join(sorted(POSITION_CODES, key=len, reverse=True))
    found = F.transform(
        F.split(c, "[,/]"), lambda t: F.regexp_extract(strip(t), rf"(?i)^({names})\b", 1)
    )
    return F.filter(found, lambda t: t != "")


def position_code(c: Column) -> Column:
    """Short code of a position name; unknown names give NULL."""
    pairs = [F.lit(x) for name, code in POSITION_CODES.items() for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(c)))


def parse_shooting_hand(c: Column) -> Column:
    right, left = c.rlike(r"(?i)\bright\b"), c.rlike(r"(?i)\bleft\b")
    return F.when(right & left, "both").when(right, "right").when(left, "left")


def clean_college(c: Column) -> Column:
    text = clean_text(F.replace(c, F.lit(","), F.lit(" ")))
    return F.when(~text.isin("Colleges", "College"), text)


def month_number(c: Column) -> Column:
    """English month name to 1..12."""
    date = F.try_to_date(F.concat(F.lit("1 "), F.initcap(strip(c)), F.lit(" 2000")), "d MMMM yyyy")
    return F.month(date)


def assemble_date(year: Column, month: Column, day: Column) -> Column:
    """A date from its three parts; NULL when one is missing or the day does not exist."""
    whole = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(whole, F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d"))


def parse_long_date(c: Column) -> Column:
    """'October 28, 2003' as a date."""
    return F.try_to_date(strip(c), "MMMM d, yyyy")


def draft_year(c: Column) -> Column:
    return extract(c, r"(\d{4})").try_cast("int")


def draft_round(c: Column) -> Column:
    return extract(c, r"(\d+)(?:st|nd|rd|th)\s+round").try_cast("int")


def draft_pick(c: Column, which: int) -> Column:
    """Pick number inside the brackets: 1 = within the round, 2 = overall."""
    return extract(c, r"\((\d+)[^0-9]+(\d+)", which).try_cast("int")


def dash_to_number(c: Column) -> Column:
    """Numbers where a lone dash means 'not applicable'."""
    return F.nullif(strip(c.cast("string")), F.lit("-")).try_cast("double")


def coerce_numbers(df: DataFrame, columns: list[str], dtype: str = "int") -> DataFrame:
    cast = to_int if dtype == "int" else to_number
    return df.withColumns({c: cast(F.col(c)) for c in columns})


def trailing_note(c: Column) -> Column:
    """Text of a bracket that ends the cell."""
    return F.when(c.rlike(r"\([^)]*\)\s*$"), F.regexp_extract(c, r"\(([^)]*)\)\s*$", 1))


def without_trailing_note(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))


def part(c: Column, sep: str, index: int) -> Column:
    """The index-th (1-based) piece of a separated cell, trimmed; NULL if there is none."""
    return strip(F.try_element_at(F.split(c, sep), F.lit(index)))


def last_token_upper(c: Column) -> Column:
    return F.upper(F.try_element_at(F.split(strip(c), rf"{_SPACE}+"), F.lit(-1)))


def sentinel_to_int(c: Column, sentinel: str = "R", value: int = 0) -> Column:
    text = strip(c.cast("string"))
    return F.when(text == sentinel, F.lit(value)).otherwise(text.try_cast("int"))


def rank_number(c: Column) -> Column:
    """'10T' gives 10."""
    return extract(F.upper(c.cast("string")), r"(\d+)(T?)").try_cast("int")


def rank_is_tied(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.upper(c.cast("string")), r"(\d+)(T?)", 2) == "T", F.lit(False))
