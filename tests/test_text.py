"""Literal cases of the cleaning expressions."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.functions import text as X


def apply(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


CASES = {
    "clean_text": (X.clean_text, ["  a\n b  ", "   ", "a  b", "\x1ca\x1fb", None], ["a b", None, "a b", "a b", None]),
    "clean_id": (X.clean_id, [" OKC\t", None], ["okc", None]),
    "team_id": (X.to_team_id, [None, "TOT", "2TM", "OKC ", "tmx"], ["tot", "tot", "tot", "okc", "tmx"]),
    "mojibake": (
        X.fix_mojibake,
        ["Nikola JokiÄ\u0087", "Dario Šarić", "Dario Å ariÄ\u0087", "JosÃ©  (TW)", "plain", "été", None],
        ["Nikola Jokić", "Dario Šarić", "Dario Šarić", "José  (TW)", "plain", "été", None],
    ),
    "season_end": (X.to_season_end_year, ["2024-25", "1999-00", "2025", "2025.0", "x"], [2025, 2000, 2025, 2025, None]),
    "height": (X.height_to_cm, ["6-5", "abc", "7-0", "6"], [195.6, None, 213.4, None]),
    "weight": (X.weight_to_kg, ["180", "x"], [81.6, None]),
    "positions": (
        X.split_positions,
        ["Small Forward, Power Forward, , Shooting Guard", "Guard/Forward", "Point Guard, 6-3, uniform, <script>", "guards"],
        [["Small Forward", "Power Forward", "Shooting Guard"], ["Guard", "Forward"], ["Point Guard"], []],
    ),
    "position_code": (X.position_code, ["Small Forward", " center ", "Wing", None], ["SF", "C", None, None]),
    "hand": (X.parse_shooting_hand, ["\n  Shoots:\n  \nRight Left", "Left", "x", "bright"], ["both", "left", None, None]),
    "college": (X.clean_college, ["Arizona,State", "Colleges", " ", "Duke"], ["Arizona State", None, None, "Duke"]),
    "month": (X.month_number, ["march", "December ", "Smarch"], [3, 12, None]),
    "long_date": (X.parse_long_date, ["October 28, 2003", "soon"], [datetime.date(2003, 10, 28), None]),
    "draft_year": (X.draft_year, ["2009 NBA Draft", "undrafted"], [2009, None]),
    "draft_round": (X.draft_round, [" 1st round (3rd pick 3rd overall)", "none"], [1, None]),
    "overall": (lambda c: X.draft_pick(c, 2), ["2nd round (5th pick, 35th overall)"], [35]),
    "dash": (X.dash_to_number, [" - ", "4.5", "x"], [None, 4.5, None]),
    "note": (X.trailing_note, ["Ulrich Chomche  (TW)", "Plain"], ["TW", None]),
    "no_note": (X.without_trailing_note, ["Ulrich Chomche  (TW)", "Plain "], ["Ulrich Chomche", "Plain"]),
    "second": (lambda c: X.part(c, "-", 2), ["F-C", "F"], ["C", None]),
    "country": (X.last_token_upper, ["us US", "fr"], ["US", "FR"]),
    "rookie": (X.sentinel_to_int, ["R", "4", "x"], [0, 4, None]),
    "rank": (X.rank_number, ["10T", "3", None], [10, 3, None]),
    "tie": (X.rank_is_tied, ["10T", "3", None], [True, False, False]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    fn, values, expected = CASES[name]
    assert apply(spark, fn, values) == expected


def test_twice_mangled_and_idempotent(spark):
    once = "Nikola Jokić"
    twice = once.encode().decode("latin-1").encode().decode("latin-1")
    assert apply(spark, X.fix_mojibake, [twice, once]) == [once, once]


def test_season_label_round_trip(spark):
    labels = apply(spark, X.to_season_label, [2025, 2000, 1947], "int")
    assert labels == ["2024-25", "1999-00", "1946-47"]
    assert apply(spark, X.to_season_end_year, labels) == [2025, 2000, 1947]


def test_assembled_date_needs_all_parts(spark):
    df = spark.createDataFrame([(1990, 2, 28), (1990, 2, 30), (1990, None, 1)], "y int, m int, d int")
    got = [r[0] for r in df.select(X.assemble_date(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [datetime.date(1990, 2, 28), None, None]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_cleaning_twice_changes_nothing(spark, values):
    values = [v.replace("\ud800", "").encode("utf-8", "ignore").decode() for v in values]
    for fn in (X.clean_text, X.clean_id, X.fix_mojibake):
        once = apply(spark, fn, values)
        if fn is X.fix_mojibake:
            # Three passes may stop before a text mangled four times is clean.
            continue
        assert apply(spark, fn, once) == once


def test_strip_and_team_ids_like_their_patterns(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"{chr(c)} {chr(c)}x{chr(c)}y{chr(c)}") for c in codes], "c int, t string")
    pattern = F.regexp_replace("t", r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")
    assert df.filter(X.strip(F.col("t")) != pattern).count() == 0
    teams = spark.createDataFrame([(" TOT",), ("12tm ",), (None,), ("tm",), ("2TMs",), ("",), ("Aaa",)], "t string")
    assert [r[0] for r in teams.select(X.to_team_id(F.col("t"))).collect()] == ["tot", "tot", "tot", "tm", "2tms", "", "aaa"]
    plan = teams.select(X.to_team_id(F.col("t")).alias("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
