"""Rows, quality checks, builders, marts, files and pages on hand-written fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators import quality as D
from statloom.operators import ranks
from statloom.operators import rows as R
from statloom.plans import builders as B
from statloom.plans import marts as M
from statloom.plans import schemas
from statloom.sources import files
from statloom.sources import pages as H


def strings(spark, names, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


# ---------------------------------------------------------------- rows


def test_stints(spark):
    rows = [(2024, "p", "tot", 0), (2024, "p", "a", 1), (2024, "p", "b", 2), (2024, "q", "c", 3), (2023, "p", "b", 4)]
    df = spark.createDataFrame(rows, "season int, player string, team string, _src_row long")
    out = R.add_stint_columns(df, "season", "player", "team").orderBy("_src_row").collect()
    assert [r["stint"] for r in out] == [0, 1, 2, 1, 1]
    assert [r["is_primary"] for r in out] == [True, False, False, True, True]


def test_tied_stints_are_distinct(spark):
    rows = [(1, "p", "a", 5), (1, "p", "b", 5), (1, "p", "c", 6), (1, "p", "b", 5)]
    df = spark.createDataFrame(rows, "season int, player string, team string, _src_row long")
    out = R.add_stint_columns(df, "season", "player", "team").collect()
    assert sorted(r["stint"] for r in out) == [1, 2, 3, 4] and sum(r["is_primary"] for r in out) == 1
    assert [r["stint"] for r in out if r["team"] == "c"] == [4]


def test_stints_of_one_huge_key(spark):
    df = spark.range(30_000).select(F.lit(1).alias("s"), F.lit("p").alias("p"), F.lit("t").alias("t"), F.col("id").alias("_src_row"))
    usual = spark.createDataFrame([(1, "q", "tot", 5), (1, "q", "t", 6), (None, "q", "t", 7)], "s int, p string, t string, _src_row long")
    out = R.add_stint_columns(df.unionByName(usual), "s", "p", "t").cache()
    huge = out.filter("p = 'p'")
    assert huge.count() == 30_000 and huge.filter(F.col("stint") != F.col("_src_row") + 1).count() == 0
    assert huge.filter("is_primary").count() == 1
    rest = out.filter("p = 'q'").orderBy("_src_row").collect()
    assert [(r["stint"], r["is_primary"]) for r in rest] == [(0, True), (1, False), (1, True)]


def test_stints_of_busy_keys_by_buckets(spark, monkeypatch):
    df = spark.range(600).select(
        (F.col("id") % 2).cast("int").alias("s"), F.when(F.col("id") < 500, "p").otherwise(F.concat(F.lit("q"), F.col("id") % 7)).alias("p"),
        F.when(F.col("id") % 90 == 1, "tot").otherwise("t").alias("t"), (F.col("id") * 7919 % 601).alias("_src_row"),
    )
    values = lambda: sorted(map(tuple, R.add_stint_columns(df, "s", "p", "t").collect()))
    want = values()
    monkeypatch.setattr(ranks, "BUSY_ROWS", 40)
    assert ranks.split_busy(df, ["s", "p"])[1].select("p").distinct().count() == 1
    assert values() == want


def test_stint_tables_move_rows_once_and_join_nothing(spark):
    box = [("2024", "1", " P1", "30", "2TM", "G"), ("2024", "2", "P1", "30", "AAA", "G")]
    raw = strings(spark, ["Year", "Rank", "Player_Id", "Age", "Team", "Position", *sorted({*B.C.PLAYER_SEASON_STATS[8:]})], [r + ("1",) * len({*B.C.PLAYER_SEASON_STATS[8:]}) for r in box])
    out = B.player_season_stats(raw)
    assert [(r["stint"], r["team_id"], r["is_primary"], r["points"]) for r in out.collect()] == [(0, "tot", True, 1), (1, "aaa", False, 1)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1


def test_advanced_stats_read_blank_cells_and_join_nothing(spark):
    names = ["Season", "Player_Id", "Team", *[m.title() for m in B.C.ADVANCED_METRICS]]
    raw = strings(spark, names, [("2023-24", p, t, *[x] * len(B.C.ADVANCED_METRICS)) for p, t, x in (("P1", "AAA", " "), ("P1", "BBB", "x"), ("P2", "3TM", " 1.5"), (" ", None, "2"))])
    out = B.player_advanced_stats(raw)
    assert [(r["season"], r["player_id"], r["stint"], r["is_primary"], r["win_shares"]) for r in out.collect()] == [
        (2024, "p1", 1, True, None), (2024, "p1", 2, False, None), (2024, "p2", 0, True, 1.5)]
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()


def test_dimension_and_audit(spark):
    detail = spark.createDataFrame([("a", "Alpha")], "id string, name string")
    used = spark.createDataFrame([("b",), (None,), ("a",)], "id string")
    out = {r["id"]: (r["name"], r["has"]) for r in R.complete_dimension(detail, "id", used, "has", ["tot"]).collect()}
    assert out == {"a": ("Alpha", True), "b": (None, False), "tot": (None, False)}
    row = R.audit("t", used, used.dropna(), "why").first()
    assert (row["rows_in"], row["rows_out"], row["rows_dropped"], row["rows_added"]) == (3, 2, 1, 0)


def test_keep_first_with_missing_values(spark):
    df = spark.createDataFrame([("k", 2, None), ("k", 1, "x"), ("k", 3, "y"), (None, 9, "z")], "k string, o int, v string")
    got = {r["k"]: (r["o"], r["v"]) for r in R.keep_first(df, ["k"], ["o"]).collect()}
    assert got == {"k": (1, "x"), None: (9, "z")}


# ---------------------------------------------------------------- quality


def test_checks_pass_on_unknown(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (-1, None)], "n int, c string")
    got = {r["rule"]: r["n_violations"] for r in D.check_rules(df, {"positive": "n > 0"}, ["c"], {"c": 0}).collect()}
    assert got == {"positive": 1, "c not null": 1, "length(c) <= 0": 2}


def test_grain_and_orphans(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, None)], "k string, n int")
    row = D.key_check(df, ["k", "n"]).first()
    assert (row["n_duplicates"], row["n_null_keys"]) == (1, 2)
    with pytest.raises(ValueError):
        D.assert_grain(df, ["k", "n"], "t")
    parent = spark.createDataFrame([("a",)], "k string")
    assert D.orphan_count(df, ["k"], parent, ["k"]).first()["n_orphans"] == 1


def test_verdict(spark):
    ok = spark.createDataFrame([(0,)], "n long")
    assert D.verdict({"a": ok, "b": ok}).first()["verdict"] == "PASS"
    assert D.verdict({"a": ok, "b": spark.createDataFrame([(2,)], "n long")}).first()["verdict"] == "FAIL"


# ---------------------------------------------------------------- builders and marts


def raw_tables(spark):
    box = ["Year", "Rank", "Player_Id", "Age", "Team", "Position", "Games", "Games Started", "Minutes Played", "FG", "FGA", "FG%", "3P", "3PA", "3p%",
           "2P", "2PA", "2P%", "eFG%", "FT", "FTA", "FT%", "ORB", "DRB", "TRB", "AST", "STL", "BLK", "TOV", "PF", "PTS", "Trp_Dbl"]

    def line(season, rank, player, team, games, points):
        fixed = ["10", "5", "10", ".500", "1", "2", ".500", "4", "8", ".500", ".550", "3", "4", ".750", "1", "2", "3", "4", "1", "1", "2", "2"]
        return (season, rank, player, "25", team, "G", games, "1", *fixed, points, "0")

    stats = [line("2023-24", "1", " P1 ", "2TM", "60", "900"), line("2023-24", "1", "p1", "AAA", "20", "300"), line("2023-24", "1", "p1", "BBB", "40", "600"),
             line("2023-24", "2", "p2", "AAA", "41", "410"), line("2023-24", None, " ", "", "", ""), line("2024-25", "1", "p2", "BBB", "70", "800")]
    adv_cols = ["Season", "Rank", "Player_id", "Age", "Team", "Position", *[c.title() for c in B.C.ADVANCED_METRICS]]
    adv = [(s[0], s[1], s[2], "25", s[4], "G", *["1.5"] * 20) for s in stats]
    totals_cols = ["Rk", "Season", "TeamName", "TeamId", "G", "MP", "FG", "FGA", "FG%", "3P", "3PA", "3P%", "2P", "2PA", "2P%", "FT", "FTA", "FT%",
                   "ORB", "DRB", "TRB", "AST", "STL", "BLK", "TOV", "PF", "PTS"]

    def total(season, name, ident, games):
        return ("1", season, name, ident, games, "100", "40", "90", ".444", "10", "30", ".333", "30", "60", ".5", "20", "25", ".8", "10", "30", "40", "25", "7", "5", "14", "20", "110")

    totals = [total("2023-24", "Alphas", "AAA", "82"), total("2023-24", "Betas", "BBB", "80"), total("2024-25", "Betas", "BBB", "82"), total("2024-25", "Alphas", "AAA", "0"),
              tuple([None, "2024-25", None, " ", *[None] * 23])]
    rosters = [("Alphas", "2023-24", "P Two\xa0\xa0(TW)", "p2", "AAA", "F-C", "6-5", "220", "October 28, 2000", "us US", "R", ""),
               ("Betas", "2023-24", "P One", "p1", "BBB", "G", "6-0", "180", "May 1, 1999", "fr FR", "3", "Duke"),
               ("Oldies", "1949-50", "Nikola JokiÄ\x87", "p9", "OLD", "C", "7-0", "", "", "rs RS", "1", ""),
               ("Alphas", "2023-24", None, " ", "AAA", None, None, None, None, None, None, None)]
    bios = [("p1", "P One", "Point Guard, , Small Forward", "\n Shoots:\n Right Left", "6-0", "180", "1", "May", "1999", "Arizona,State", "2019 NBA Draft", "Betas",
             " 1st round (3rd pick 33rd overall)", None, "October 28, 2019"),
            ("P2", "P Two", "Forward/Guard", "Left", "x", "220", "30", "February", "2000", "Colleges", None, None, None, "2", None)]
    career = [("p1", "P One", "5", "300", "12.5", "4", "3", "45.1", "-", "80.2", "52.0", "18.1", "20.5"), ("p1", "again", "9", *["1"] * 10)]
    seasons = [("2023-24", "nba", "Betas", "P One", "x", "JosÃ©", "x", "x", "x"), ("1949-50", "baa", "Oldies", "x", "x", "x", "x", "x", "x")]
    winners = [("2023-24", "NBA", "p1", "25", "BBB", "60", *["1.0"] * 11)]
    ballot = [("2024", "1T", "p1", "25", "TOT", "10", "500", "1000", "0.5", "60", *["1"] * 11), ("2024", "1T", "p2", "25", None, "10", "500", "1000", "0.5", "60", *["1"] * 11)]
    return {
        "player_stats": R.with_source_row(strings(spark, box, stats).coalesce(1)),
        "advanced_stats": R.with_source_row(strings(spark, adv_cols, adv).coalesce(1)),
        "team_season_totals": strings(spark, totals_cols, totals),
        "team_season_rosters": strings(spark, ["TeamName", "Season", "PlayerName", "Player_id", "Team_id", "Pos", "Ht", "Wt", "Birth Date", "Birth", "Exp", "College"], rosters),
        "player_bios": strings(spark, ["player_id", "player_name", "Position", "Shoots", "Height", "Weight", "Birthday", "Birthmonth", "Birthyear", "College", "Draft", "Draft Team",
                                       "Draf Pick", "Experience", "NBA Debut"], bios),
        "player_career_stats": R.with_source_row(strings(spark, ["player_id", "player_name", "Experience", *[c.title().replace("3Pt", "3pt") for c in B.C.CAREER]], career).coalesce(1)),
        "season_summaries": strings(spark, ["Season Year", "League", "Champion Name", "MVP", "Rookie of the Year", "Most Points", "Most Rebounds", "Most Assists", "Most Winshares"], seasons),
        "mvp_winners": strings(spark, ["Season", "League", "Player_id", "Age", "Team_id", "Game", *[k.title().replace("3-Point", "3-Point") for k in list(B.C.MVP_WINNERS)[6:]]], winners),
        "mvp_candidates": strings(spark, ["Year", "Rank", "Player_Id", "Age", "Team", "First_Place_Vote", "Pts Won", "pts Max", "Share", "Games", "MP", "PTS", "TRB", "AST", "STL", "BLK",
                                          "FG%", "3P%", "FT%", "WS", "WS/48"], ballot),
    }


@pytest.fixture(scope="module")
def cleaned(spark):
    return {k: v.cache() for k, v in B.build_all(raw_tables(spark)).items()}


def test_cleaned_tables(cleaned):
    box = cleaned["player_season_stats"].collect()
    assert [(r["season"], r["player_id"], r["stint"], r["team_id"], r["is_primary"]) for r in box] == [
        (2024, "p1", 0, "tot", True), (2024, "p1", 1, "aaa", False), (2024, "p1", 2, "bbb", False), (2024, "p2", 1, "aaa", True), (2025, "p2", 1, "bbb", True)]
    assert box[0].asDict().keys() == dict.fromkeys(B.C.PLAYER_SEASON_STATS).keys()
    teams = {r["team_id"]: r for r in cleaned["teams"].collect()}
    assert set(teams) == {"aaa", "bbb", "old", "tot"}
    assert teams["old"]["team_name"] == "Oldies" and not teams["old"]["has_detail"] and teams["tot"]["is_aggregate"]
    assert [r["season"] for r in cleaned["seasons"].collect()] == [1950, 2024, 2025]
    awards = {r["season"]: r for r in cleaned["season_awards"].collect()}
    assert awards[2024]["champion_team_id"] == "bbb" and awards[2024]["most_points"] == "José" and awards[1950]["league"] == "BAA"
    roster = {r["player_id"]: r for r in cleaned["rosters"].collect()}
    assert roster["p2"]["player_name"] == "P Two" and roster["p2"]["roster_note"] == "TW"
    assert (roster["p2"]["position_primary"], roster["p2"]["position_secondary"], roster["p2"]["experience_seasons"]) == ("F", "C", 0)
    assert roster["p2"]["birth_date"] == datetime.date(2000, 10, 28) and roster["p9"]["player_name"] == "Nikola Jokić"
    ballot = cleaned["mvp_candidates"].collect()
    assert [(r["season"], r["rank"], r["tie"], r["team_id"]) for r in ballot] == [(2024, 1, True, "tot"), (2024, 1, True, None)]


def test_players(cleaned):
    players = {r["player_id"]: r for r in cleaned["players"].collect()}
    assert set(players) == {"p1", "p2", "p9"}
    p1, p2, p9 = players["p1"], players["p2"], players["p9"]
    assert p1["shoots"] == "both" and p1["college"] == "Arizona State" and p1["birth_date"] == datetime.date(1999, 5, 1)
    assert (p1["draft_year"], p1["draft_round"], p1["draft_round_pick"], p1["draft_overall_pick"]) == (2019, 1, 3, 33)
    assert p1["experience_seasons"] == 5 and p1["career_games"] == 300 and p1["career_three_point_pct"] is None
    assert p2["height_cm"] is None and p2["birth_date"] is None and p2["experience_seasons"] == 2 and p2["primary_position"] == "F"
    assert not p9["has_bio"] and p9["player_name"] == "Nikola Jokić"
    slots = [(r["player_id"], r["slot"], r["position_code"]) for r in cleaned["player_positions"].collect()]
    assert slots == [("p1", 1, "PG"), ("p1", 2, "SF"), ("p2", 1, "F"), ("p2", 2, "G")]


def test_cleaned_tables_keep_their_rules(cleaned):
    report = D.foreign_key_report(cleaned, [k for k in schemas.FOREIGN_KEYS if k[0] in cleaned and k[2] in cleaned])
    bad = {r["constraint"]: r["n_orphans"] for r in report.collect() if r["n_orphans"]}
    assert bad == {}
    for name, keys in schemas.PRIMARY_KEYS.items():
        assert tuple(D.key_check(cleaned[name], keys).first())[1:] == (0, 0), name
    for name in ("player_season_stats", "player_positions", "seasons", "mvp_candidates"):
        rules = D.check_rules(cleaned[name], schemas.CHECKS[name], schemas.NOT_NULL[name], schemas.WIDTHS[name])
        assert rules.agg(F.sum("n_violations")).first()[0] == 0, name
    # 9 + 12 simple references and one composite, 22 checks as in the declared schema.
    assert len(schemas.FOREIGN_KEYS) == 21
    assert sum(map(len, schemas.CHECKS.values())) == 22


def test_marts(cleaned):
    marts = M.build_marts(cleaned)
    rows = {(r["season"], r["player_id"]): r for r in marts["player_season"].collect()}
    assert set(rows) == {(2024, "p1"), (2024, "p2"), (2025, "p2")}
    p1 = rows[(2024, "p1")]
    assert p1["is_multi_team_season"] and p1["games_basis"] == "league_schedule" and p1["team_games"] == 82
    assert p1["availability"] == 0.7317 and p1["points_per_game"] == 15.0 and p1["is_mvp_winner"] and p1["is_mvp_candidate"]
    assert p1["is_on_champion_team"] is False and rows[(2025, "p2")]["is_on_champion_team"] is None
    assert p1["experience_seasons"] == 5 - 1 - 1 and rows[(2024, "p2")]["team_games"] == 82
    teams = {(r["season"], r["team_id"]): r for r in marts["team_season"].collect()}
    t = teams[(2024, "aaa")]
    assert t["estimated_possessions"] == 105.0 and t["possessions_per_game"] == 1.3 and t["offensive_rating"] == 104.76
    assert t["effective_fg_pct"] == 50.0 and t["offensive_rebound_pct"] == 20.0 and t["assisted_fg_pct"] == 62.5
    assert teams[(2025, "aaa")]["points_per_game"] is None and teams[(2025, "aaa")]["has_been_played"] is False


# ---------------------------------------------------------------- files


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "q"', 1.0), (1, "x,y", None)], "k int, t string, d double")
    files.write_table(df, str(tmp_path / "t.csv"), ["k"], "csv")
    back = files.read_source(spark, str(tmp_path), "t", source_row=True)
    assert [f.dataType.simpleString() for f in back.schema][:3] == ["string"] * 3
    assert [r["t"] for r in back.orderBy(R.SOURCE_ROW).collect()] == ["x,y", 'a "q"']
    with pytest.raises(FileNotFoundError):
        files.read_source(spark, str(tmp_path), "nothing")
    schema = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("k", T.IntegerType()), T.StructField("t", T.StringType())])
    loaded = files.load_declared(spark, str(tmp_path / "t.csv"), schema)
    assert loaded.columns == ["d", "k", "t"] and loaded.agg(F.sum("k")).first()[0] == 3
    whole = files.restore_integers(spark.createDataFrame([(1.0, 1.5, None), (2.0, 2.0, None)], "a double, b double, c double"))
    assert [f.dataType.simpleString() for f in whole.schema] == ["bigint", "double", "double"]


def test_bad_value_fails_the_load(spark, tmp_path):
    spark.createDataFrame([("x",)], "k string").write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(Exception):
        files.load_declared(spark, str(tmp_path / "bad"), T.StructType([T.StructField("k", T.IntegerType())])).collect()


def test_rebuild_is_all_or_nothing(spark, tmp_path):
    base = {"b": spark.createDataFrame([(1,)], "x int")}
    target = str(tmp_path / "layer")
    built = files.rebuild(spark, target, [("one", lambda t: t["b"]), ("two", lambda t: t["one"].selectExpr("x + 1 as x"))], base)
    assert built["two"].first()[0] == 2
    with pytest.raises(Exception):
        files.rebuild(spark, target, [("one", lambda t: t["b"].selectExpr("x + 9 as x")), ("two", lambda t: t["gone"])], base)
    assert spark.read.parquet(f"{target}/one").first()[0] == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["layer"]
    with pytest.raises(ValueError, match="protected"):
        files.rebuild(spark, target, [], base, protected=[target])
    with pytest.raises(ValueError, match="empty"):
        files.rebuild(spark, target, [], {"b": base["b"].limit(0)})


# ---------------------------------------------------------------- pages


def one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_page_expressions(spark):
    assert one(spark, H.href_id, ["/players/c/carlsbr01.html", "/x/y.html?q=1"]) == ["carlsbr01", "y"]
    assert one(spark, lambda c: H.href_id(c, -2), ["/teams/OKC/2025.html"]) == ["OKC"]
    assert one(spark, H.to_snake_case, ["Draft Position:", " NBA Debut: "]) == ["draft_position", "nba_debut"]
    assert one(spark, H.try_int, ["1,234", "12%", "7"]) == [1234, None, 7]
    got = one(spark, H.seasons_summary, ["80; 1946-47 to 2025-26", "1949-50 to 2025-26", "none"])
    assert [(r["count"], r["range"]) for r in got] == [(80, "1946-47 to 2025-26"), (None, "1949-50 to 2025-26"), (None, None)]
    assert one(spark, H.parent_path, ["https://h.org/teams/OKC/2025.html"]) == ["https://h.org/teams/OKC"]
    base = F.lit("https://h.org/a/b.html?x=1#t")
    links = ["/c", "d.html", "//o.org/e", "http://f.g/", "?y=2"]
    assert one(spark, lambda c: H.absolute_url(base, c), links) == ["https://h.org/c", "https://h.org/a/d.html", "https://o.org/e", "http://f.g/", "https://h.org/a/b.html?y=2"]
    status = F.lit(403)
    assert one(spark, lambda c: H.is_challenge(c, status), ["<p>Just a moment...</p>", "fine"]) == [True, False]


def test_broken_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", "<table id=t><tr><td data-stat=a>1<td data-stat=b><a href=/x>2</a>*"), (3, "u", "<p>no")], "page_id long, url string, html string")
    rows = H.stat_table_rows(pages, "t").collect()
    assert len(rows) == 1 and rows[0]["page_id"] == 2
    assert H.bio_fields(pages).count() == 0 and H.career_line(pages).count() == 0
    assert H.meta_box(pages).filter(F.size("fields") > 0).count() == 0


def test_links_once_per_page(spark):
    html = '<a href="/a">One</a><a class="x" href="/b"><b>Two</b></a><a href="/a">Again</a><a href="/c">Skip</a>'
    pages = spark.createDataFrame([(1, "http://h.org/p", html)], "page_id long, url string, html string")
    got = [(r["link"], r["text"]) for r in H.page_links(pages, "^/", skip_text=["Skip"]).orderBy("pos").collect()]
    assert got == [("http://h.org/a", "One"), ("http://h.org/b", "Two")]


def test_links_in_every_quote_form(spark):
    html = "<a href='/a'>One</a><a data-href=\"/no\" HREF = \"/b\">Two</a><a class=x href=/c>Three</a>"
    pages = spark.createDataFrame([(1, "http://h.org/p", html)], "page_id long, url string, html string")
    got = [(r["link"], r["text"]) for r in H.page_links(pages).orderBy("pos").collect()]
    assert got == [("http://h.org/a", "One"), ("http://h.org/b", "Two"), ("http://h.org/c", "Three")]


def test_merged_links_keep_the_first_place_by_number(spark):
    schema = "page_id long, pos int, link string, text string"
    first = spark.createDataFrame([(1, 10, "u", "tenth"), (1, 9, "u", "ninth"), (10, 0, "v", "later"), (9, 5, "v", "sooner")], schema)
    second = spark.createDataFrame([(1, 0, "u", "other list"), (1, 0, "w", "own")], schema)
    got = {r["link"]: (r["text"], r["source"]) for r in H.merge_links([first, second]).collect()}
    assert got == {"u": ("ninth", 0), "v": ("sooner", 0), "w": ("own", 1)}


def test_quoted_line_breaks_and_failing_loads(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('id,note\n1,"a\nb"\n2,c\n')
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "notes.csv")).collect())) == [("1", "a\nb"), ("2", "c")]
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("note", T.StringType())])
    tables, report = files.load_all(spark, str(tmp_path), {"notes": schema}, ["notes"])
    assert [tuple(r) for r in report.collect()] == [("notes", 2, "loaded")] and tables["notes"].count() == 2
    (tmp_path / "notes.csv").write_text("id,note\n1,a\nxx,b\n")
    with pytest.raises(Exception, match="MALFORMED|xx|FAILFAST|Malformed"):
        files.load_all(spark, str(tmp_path), {"notes": schema}, ["notes"])


def test_a_rebuild_replaces_the_old_layer_whole(spark, tmp_path):
    target = f"{tmp_path}/layer"
    base = {"n": spark.range(3)}
    files.rebuild(spark, target, [("old", lambda t: t["n"])], base)
    files.rebuild(spark, target, [("new", lambda t: t["n"].filter("id > 0"))], base)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["layer"]
    assert [p.name for p in (tmp_path / "layer").iterdir() if p.is_dir()] == ["new"]
    with pytest.raises(ValueError):
        files.rebuild(spark, target, [("bad", lambda t: (_ for _ in ()).throw(ValueError("no")))], base)
    assert spark.read.parquet(f"{target}/new").count() == 2


def test_catalog_listings(spark):
    spark.range(2).createOrReplaceTempView("listed_orders")
    assert ("listed_orders", "TEMPORARY") in [tuple(r) for r in files.list_tables(spark).collect()]
    got = D.expected_tables(spark, ["orders", "customer"], ["customer", "refunds"])
    assert sorted(map(tuple, got.collect())) == [("orders", "unexpected"), ("refunds", "missing")]


def test_sources_merge_column_by_column(spark):
    """The first source with a value wins per column; conflicts and sources are counted; blank keys are left out."""
    a = spark.createDataFrame([("p", None, 5), ("q", "Q", None), ("q", "A", None), (None, "no", 1)], "id string, name string, n int")
    b = spark.createDataFrame([("p", "P", 6), ("r", "R", 7)], "id string, name string, n int")
    c = spark.createDataFrame([("p", 1.5), ("q", None)], "id string, x double")
    got = {r["id"]: tuple(r)[1:] for r in R.merge_sources([a, b, c], ["id"]).collect()}
    # Two rows of one key in a source differ from each other as well.
    assert got == {"p": ("P", 5, 1.5, 3, 1), "q": ("A", None, None, 2, 1), "r": ("R", 7, None, 1, 0)}
    assert R.merge_sources([a.limit(0), b.limit(0)], ["id"]).columns == ["id", "name", "n", "n_sources", "n_conflicts"]
    assert R.merge_sources([a.limit(0)], ["id"]).count() == 0


def test_pages_become_objects_a_few_at_a_time(spark, monkeypatch):
    """Results do not depend on where an Arrow batch is cut, and no part holds more pages than asked for."""
    from statloom.sources import pages as P

    monkeypatch.setattr(P, "PAGES_AT_A_TIME", 3)
    html = "<table id='t'><tr><td data-stat='a'>{0}</td><td data-stat='b'></td></tr></table>"
    df = spark.createDataFrame([(i, html.format(i)) for i in range(10)] + [(10, None), (11, "")], "page_id long, html string").coalesce(1)
    rows = {(r.page_id, r.row_no): dict(r.cells) for r in P.stat_table_rows(df, "t").collect()}
    assert rows == {(i, 0): {"a": str(i), "b": None} for i in range(10)}
    scanned = P.scan_pages(df, ["t"]).collect()
    assert len(scanned) == 12 and all(r.bio is None and dict(r.career) == {} for r in scanned)
