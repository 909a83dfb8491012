"""Queries for row-level cleaning and the table builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import longs, query, rounded, table
from statloom.operators import rows as R
from statloom.plans import builders as B


def _blanked(spark, sf):
    """Line items whose key is blank on some rows, like a table with summary lines."""
    flag = F.col("l_returnflag")
    key = F.when((flag == "R") & (F.col("l_quantity") > 40), F.lit(" ")).when(F.col("l_discount") == 0, None).otherwise(F.col("l_orderkey").cast("string"))
    return table(spark, sf, "lineitem").withColumn("player_id", key)


_BLANK = "((l_returnflag = 'R' AND l_quantity > 40) OR l_discount = 0)"


@query("r01_drop_league_average", f"SELECT count(*) FILTER (WHERE {_BLANK}) AS n_dropped, count(*) FILTER (WHERE NOT {_BLANK}) AS n_kept FROM lineitem")
def r01(spark, sf):
    kept, dropped = R.drop_league_average_rows(_blanked(spark, sf), "player_id")
    return dropped.withColumn("n_kept", kept.agg(F.count(F.lit(1))).scalar())


@query("r02_drop_separators", f"SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE NOT {_BLANK}")
def r02(spark, sf):
    return R.drop_blank_key(_blanked(spark, sf), "player_id").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


_STINT_SQL = """WITH src AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_linenumber = 7 THEN 'tot' ELSE cast(l_suppkey AS varchar) END AS team_id,
    l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, team_id = 'tot' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
    bool_or(team_id = 'tot') OVER (PARTITION BY l_orderkey, l_returnflag) AS has FROM src)
    SELECT l_orderkey, l_returnflag, l_partkey, l_suppkey, l_extendedprice, CASE WHEN team_id = 'tot' THEN 0 ELSE rn END AS stint,
    team_id = 'tot' OR (NOT has AND rn = 1) AS is_primary FROM n"""


@query("r03_stints", _STINT_SQL)
def r03(spark, sf):
    team = F.when(F.col("l_linenumber") == 7, "tot").otherwise(F.col("l_suppkey").cast("string"))
    df = table(spark, sf, "lineitem").withColumn("team_id", team)
    out = R.add_stint_columns(df, "l_orderkey", "l_returnflag", "team_id", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return longs(out.select("l_orderkey", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice", "stint", "is_primary"))


@query(
    "r04_collect_keys",
    """SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation) WHERE k IS NOT NULL""",
)
def r04(spark, sf):
    parts = [table(spark, sf, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return R.collect_keys([*parts, table(spark, sf, "region")], "k")


@query(
    "r05_complete_dimension",
    """SELECT k AS custkey, c_name, c_name IS NOT NULL AS has_detail FROM (SELECT c_custkey AS k FROM customer
    UNION SELECT CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END FROM orders UNION SELECT -1) LEFT JOIN customer ON k = c_custkey""",
)
def r05(spark, sf):
    detail = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    # Orders still in part point at keys that no customer has.
    key = F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    used = table(spark, sf, "orders").select(key.alias("custkey"))
    return R.complete_dimension(detail, "custkey", used, "has_detail", ["-1"])


@query(
    "r06_latest_value",
    "SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS last_priority FROM orders GROUP BY o_custkey",
)
def r06(spark, sf):
    return R.latest_value(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderpriority", "last_priority")


@query(
    "r07_name_fallback",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_name END, p) AS name FROM customer
    LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def r07(spark, sf):
    named = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"))
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    first = R.first_value(orders, "c_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority", "name")
    return R.fill_from_lookup(named, first, "c_custkey", "name")


@query("r08_distinct_lookup", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def r08(spark, sf):
    return R.distinct_lookup(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"], ["l_suppkey"])


@query(
    "r09_two_key_lookup",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE q.doc_id IS NULL) AS n_unresolved FROM documents d
    LEFT JOIN labels q ON d.doc_id = q.doc_id AND (d.n_chars > 500) = (q.quality = 1)""",
)
def r09(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 500).alias("long"))
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("long"), F.lit(1).alias("found"))
    return R.unresolved_count(R.lookup_join(docs, labels, ["doc_id", "long"]), "found")


_CELL = "CASE p_type WHEN 'ECONOMY' THEN 'Small Forward, Power Forward, , Shooting Guard' WHEN 'PROMO' THEN 'Guard/Forward' ELSE p_name END"


def _cells(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_CELL).alias("cell"))


@query(
    "r10_explode_positions",
    """SELECT p_partkey, cast(unnest(CASE p_type WHEN 'ECONOMY' THEN [1, 2, 3] ELSE [1, 2] END) AS bigint) AS slot,
    unnest(CASE p_type WHEN 'ECONOMY' THEN ['Small Forward', 'Power Forward', 'Shooting Guard'] ELSE ['Guard', 'Forward'] END) AS position,
    unnest(CASE p_type WHEN 'ECONOMY' THEN ['SF', 'PF', 'SG'] ELSE ['G', 'F'] END) AS position_code
    FROM part WHERE p_type IN ('ECONOMY', 'PROMO')""",
)
def r10(spark, sf):
    return longs(R.explode_positions(_cells(spark, sf), "p_partkey", "cell"))


@query(
    "r11_first_child",
    "SELECT p_partkey, p_name, CASE p_type WHEN 'ECONOMY' THEN 'SF' WHEN 'PROMO' THEN 'G' END AS primary_position FROM part",
)
def r11(spark, sf):
    children = R.explode_positions(_cells(spark, sf), "p_partkey", "cell")
    first = R.first_child(children, "p_partkey", "position_code", "primary_position")
    return table(spark, sf, "part").select("p_partkey", "p_name").join(first, "p_partkey", "left")


@query(
    "r12_keep_first",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""",
)
def r12(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return R.keep_first(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_linenumber")


@query("r13_project_sorted", "SELECT s_nationkey, s_suppkey, s_name FROM supplier ORDER BY s_nationkey, s_suppkey")
def r13(spark, sf):
    return R.project_sorted(table(spark, sf, "supplier"), ["s_nationkey", "s_suppkey", "s_name"], ["s_nationkey", "s_suppkey"])


@query(
    "r14_audit",
    f"""SELECT 'lineitem' AS "table", count(*) AS rows_in, count(*) FILTER (WHERE NOT {_BLANK}) AS rows_out,
    count(*) FILTER (WHERE {_BLANK}) AS rows_dropped, 0::bigint AS rows_added, 'blank keys' AS reason FROM lineitem""",
)
def r14(spark, sf):
    before = _blanked(spark, sf)
    return R.audit("lineitem", before, R.drop_blank_key(before, "player_id"), "blank keys")


# The raw tables of the builders, made of the given ones: orders are ballots, customers players, suppliers clubs.


def _raw_box(spark, sf):
    c = F.col
    team = F.when(c("l_linenumber") == 7, "2TM").otherwise(F.concat(F.lit(" T"), c("l_suppkey").cast("string")))
    q, n = c("l_quantity").cast("int"), c("l_linenumber")
    cells = {
        "Year": F.year("l_shipdate"), "Rank": n, "Player_Id": F.concat(F.lit(" P"), c("l_orderkey").cast("string")), "Age": 20 + n, "Team": team,
        "Position": c("l_returnflag"), "Games": q, "Games Started": q - n, "Minutes Played": q * 30, "FG": q * 3, "FGA": q * 6, "FG%": F.lit("0.5"),
        "3P": n, "3PA": n * 2, "3p%": F.lit("0.5"), "2P": q, "2PA": q * 2, "2P%": F.lit(""), "eFG%": F.lit("0.55"), "FT": n, "FTA": n, "FT%": F.lit("1.0"),
        "ORB": n, "DRB": n, "TRB": n * 2, "AST": q, "STL": n, "BLK": n, "TOV": n, "PF": n, "PTS": F.floor(c("l_extendedprice")), "Trp_Dbl": F.lit("x"),
    }
    df = table(spark, sf, "lineitem").select(
        *[v.cast("string").alias(k) for k, v in cells.items()],
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias(R.SOURCE_ROW),
    )
    footer = df.groupBy("Year").agg(F.max("PTS").alias("PTS")).withColumn("Player_Id", F.lit("  "))
    return df.unionByName(footer, allowMissingColumns=True)


@query(
    "r15_player_season_stats",
    """WITH s AS (SELECT cast(year(l_shipdate) AS integer) AS season, 'p' || l_orderkey AS player_id,
    CASE WHEN l_linenumber = 7 THEN 'tot' ELSE 't' || l_suppkey END AS team_id, * FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY season, player_id, team_id = 'tot' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
    bool_or(team_id = 'tot') OVER (PARTITION BY season, player_id) AS has FROM s)
    SELECT season, player_id, team_id, CASE WHEN team_id = 'tot' THEN 0 ELSE rn END AS stint, team_id = 'tot' OR (NOT has AND rn = 1) AS is_primary,
    cast(l_linenumber AS bigint) AS rank, l_returnflag AS position, cast(l_quantity AS bigint) AS games_played, cast(l_quantity * 6 AS bigint) AS field_goals_attempted,
    CAST(NULL AS double) AS two_point_pct, cast(floor(l_extendedprice) AS bigint) AS points, CAST(NULL AS bigint) AS triple_doubles FROM n""",
)
def r15(spark, sf):
    out = B.player_season_stats(_raw_box(spark, sf)).select(
        "season", "player_id", "team_id", "stint", "is_primary", "rank", "position", "games_played", "field_goals_attempted", "two_point_pct", "points", "triple_doubles"
    )
    return longs(out).withColumn("season", F.col("season").cast("int"))


@query(
    "r15_mvp_candidates",
    """SELECT cast(year(o_orderdate) AS integer) AS season, 'c' || o_custkey AS player_id, cast(o_custkey % 12 AS bigint) AS rank, o_orderstatus = 'P' AS tie,
    cast(NULL AS varchar) AS team_id, cast(floor(o_totalprice) AS bigint) AS points_won, round(o_totalprice / 600000, 3) AS share FROM orders""",
)
def r15_candidates(spark, sf):
    c = F.col
    year = F.year("o_orderdate")
    label = F.concat((year - 1).cast("string"), F.lit("-"), F.substring(year.cast("string"), -2, 2))
    one = F.lit("1")
    cells = {
        "Year": label, "Rank": F.concat((c("o_custkey") % 12).cast("string"), F.when(c("o_orderstatus") == "P", "T").otherwise("")),
        "Player_Id": F.concat(F.lit("C"), c("o_custkey").cast("string")), "Age": F.lit("30"), "Team": F.lit(" "), "First_Place_Vote": one,
        "Pts Won": F.floor("o_totalprice").cast("string"), "pts Max": F.lit("600000"), "Share": F.round(c("o_totalprice") / 600000, 3).cast("string"),
        "Games": one, "MP": one, "PTS": one, "TRB": one, "AST": one, "STL": one, "BLK": one, "FG%": one, "3P%": one, "FT%": one, "WS": one, "WS/48": one,
    }
    raw = table(spark, sf, "orders").select(*[v.alias(k) for k, v in cells.items()])
    out = B.mvp_candidates(raw).select("season", "player_id", "rank", "tie", "team_id", "points_won", "share")
    return rounded(longs(out)).withColumn("season", F.col("season").cast("int"))


@query(
    "r15_rosters",
    """SELECT cast(year(o_orderdate) AS integer) AS season, 't' || (o_custkey % 30) AS team_id, 'p' || o_orderkey AS player_id, c_name AS player_name,
    CASE WHEN o_orderstatus = 'F' THEN 'TW' END AS roster_note, left(o_orderpriority, 1) AS position_primary,
    upper(c_mktsegment) AS birth_country, cast(o_orderdate AS date) AS birth_date,
    CASE WHEN o_orderstatus = 'O' THEN 0 ELSE cast(o_custkey % 20 AS bigint) END AS experience_seasons, round(((60 + o_custkey % 20) * 2.54)::double, 1) AS height_cm
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def r15_rosters(spark, sf):
    c = F.col
    year = F.year("o_orderdate")
    inches = c("o_custkey") % 20 + 60
    note = F.when(c("o_orderstatus") == "F", "  (TW)").otherwise("")
    cells = {
        "TeamName": F.concat(F.lit("Team "), (c("o_custkey") % 30).cast("string")), "Season": F.concat((year - 1).cast("string"), F.lit("-"), F.substring(year.cast("string"), -2, 2)),
        "PlayerName": F.concat("c_name", note), "Player_id": F.concat(F.lit("P"), c("o_orderkey").cast("string")), "Team_id": F.concat(F.lit("T"), (c("o_custkey") % 30).cast("string")),
        "Pos": c("o_orderpriority"), "Ht": F.concat(F.floor(inches / 12).cast("string"), F.lit("-"), (inches % 12).cast("string")), "Wt": F.lit("200"),
        "Birth Date": F.date_format("o_orderdate", "MMMM d, yyyy"), "Birth": F.concat(F.lower("c_mktsegment"), F.lit(" "), F.lower("c_mktsegment")),
        "Exp": F.when(c("o_orderstatus") == "O", "R").otherwise((c("o_custkey") % 20).cast("string")), "College": F.lit(""),
    }
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey"))
    raw = joined.select(*[v.alias(k) for k, v in cells.items()])
    footer = raw.groupBy("TeamName", "Season", "Team_id").agg(F.lit(" ").alias("Player_id"))
    out = B.rosters(raw.unionByName(footer, allowMissingColumns=True)).select(
        "season", "team_id", "player_id", "player_name", "roster_note", "position_primary", "birth_country", "birth_date", "experience_seasons", "height_cm"
    )
    return rounded(out.withColumn("experience_seasons", c("experience_seasons").cast("long")))


@query(
    "r15_teams_and_seasons",
    """SELECT 't' || s AS team_id, CASE WHEN d THEN 'Team ' || s END AS team_name, false AS is_aggregate, d AS has_detail
    FROM (SELECT s, bool_or(d) AS d FROM (SELECT o_custkey % 30 AS s, true AS d FROM orders UNION ALL SELECT o_custkey % 35, false FROM orders) GROUP BY s) UNION ALL SELECT 'tot', 'Multiple Teams (season total)', true, false""",
)
def r15_teams(spark, sf):
    c = F.col
    orders = table(spark, sf, "orders").withColumn("club", c("o_custkey") % 30)
    totals = orders.groupBy(F.year("o_orderdate").alias("Season"), "club").agg(F.count(F.lit(1)).alias("G"))
    counts = [n for n in B.C.TEAM_TOTALS if n not in ("season", "teamname", "teamid", "g")]
    raw = totals.select(
        c("Season").cast("string").alias("Season"), F.concat(F.lit("Team "), c("club").cast("string")).alias("TeamName"),
        F.concat(F.lit(" T"), c("club").cast("string")).alias("TeamId"), c("G").cast("string").alias("G"), *[F.lit("1").alias(n) for n in counts],
    )
    used = orders.select(F.concat(F.lit("T"), (c("o_custkey") % 35).cast("string")).alias("team_id"))
    return B.teams(raw, used)


def _raw_bios(spark, sf):
    """Bio pages of four customers in five."""
    c, k = F.col, F.col("c_custkey")
    text = lambda x: x.cast("string")
    cells = {
        "Player_id": F.concat(F.lit(" C"), text(k)), "player_name": c("c_name"),
        "Position": F.when(k % 3 == 0, "Point Guard").when(k % 3 == 1, "Center, Power Forward"), "Shoots": F.when(k % 2 == 0, "Shoots: Right").otherwise("Left"),
        "Height": F.concat(F.lit("6-"), text(k % 12)), "Weight": text(180 + k % 50), "College": F.when(k % 4 == 0, "Colleges").otherwise(c("c_mktsegment")),
        "Experience": F.when(k % 3 != 0, text(k % 20)), "NBA Debut": F.when(k % 2 == 0, "October 28, 2003").otherwise("soon"),
        "Birthyear": text(1950 + k % 50), "Birthmonth": F.lit("March"), "Birthday": F.when(k % 6 == 0, "40").otherwise("4"),
        "Draft": F.concat(text(1970 + k % 50), F.lit(" NBA Draft")), "Draft Team": F.concat(F.lit("Team "), text(k % 30)),
        "Draf Pick": F.concat(F.lit("2nd round ("), text(k % 30), F.lit("th pick, "), text(k % 30 + 30), F.lit("th overall)")),
    }
    return table(spark, sf, "customer").filter(k % 5 != 0).select(*[v.alias(n) for n, v in cells.items()])


def _raw_career(spark, sf):
    """Career pages of two customers in three, some of them twice."""
    k = F.col("c_custkey")
    cells = {"Player_id": F.concat(F.lit("C"), k.cast("string")), "Experience": (k % 20 + k % 2).cast("string"), **{n.title(): F.lit("-") for n in B.C.CAREER}}
    cells |= {"Career Games": (k % 900).cast("string"), "Career Points": F.when(k % 7 == 0, "-").otherwise("12.5")}
    rows = table(spark, sf, "customer").filter(k % 3 != 1).select(*[v.alias(n) for n, v in cells.items()], F.struct(k, F.lit(0)).alias(R.SOURCE_ROW))
    again = rows.filter(F.col(f"{R.SOURCE_ROW}.c_custkey") % 8 == 0).withColumns({"Career Games": F.lit("-1"), R.SOURCE_ROW: F.struct(F.col(f"{R.SOURCE_ROW}.c_custkey").alias("c_custkey"), F.lit(1))})
    return rows.unionByName(again)


def _player_names(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(F.year("o_orderdate").alias("season"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("player_id"), F.concat(F.lit("Order "), F.col("o_custkey").cast("string")).alias("player_name"))


@query(
    "r15_players",
    """WITH b AS (SELECT c_custkey AS k, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders), u AS (SELECT k FROM b UNION SELECT k FROM o)
    SELECT 'c' || u.k AS player_id, coalesce(c_name, 'Order ' || o.k) AS player_name, b.k IS NOT NULL AS has_bio, CASE b.k % 3 WHEN 0 THEN 'PG' WHEN 1 THEN 'C' END AS primary_position,
    CASE b.k % 2 WHEN 0 THEN 'right' WHEN 1 THEN 'left' END AS shoots, round(6 * 30.48 + b.k % 12 * 2.54, 1)::double AS height_cm, round((180 + b.k % 50) * 0.45359237, 1)::double AS weight_kg,
    CASE WHEN b.k % 4 <> 0 THEN c_mktsegment END AS college, (CASE WHEN b.k % 3 <> 0 THEN b.k % 20 ELSE b.k % 20 + b.k % 2 END)::bigint AS experience_seasons,
    CASE WHEN b.k % 2 = 0 THEN 2003 END AS nba_debut_year, CASE WHEN b.k % 6 <> 0 THEN make_date(1950 + b.k % 50, 3, 4) END AS birth_date, (1970 + b.k % 50)::int AS draft_year,
    CASE WHEN b.k IS NOT NULL THEN 2 END AS draft_round, (b.k % 30 + 30)::int AS draft_overall_pick, CASE WHEN b.k % 3 <> 1 THEN (b.k % 900)::double END AS career_games,
    CASE WHEN b.k % 3 <> 1 AND b.k % 7 <> 0 THEN 12.5::double END AS career_points FROM u LEFT JOIN b ON b.k = u.k LEFT JOIN o ON o.k = u.k""",
)
def r15_players(spark, sf):
    names = _player_names(spark, sf)
    out = B.players(_raw_bios(spark, sf), _raw_career(spark, sf), names.select("player_id"), names).select(
        "player_id", "player_name", "has_bio", "primary_position", "shoots", "height_cm", "weight_kg", "college", F.col("experience_seasons").cast("long").alias("experience_seasons"),
        "nba_debut_year", "birth_date", "draft_year", "draft_round", "draft_overall_pick", "career_games", "career_points",
    )
    return out


@query(
    "r15_player_conflicts",
    """WITH c AS (SELECT c_custkey AS k, c_name, c_custkey % 5 <> 0 AS bio, c_custkey % 3 <> 1 AS career, o.k IS NOT NULL AS named FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey),
    v AS (SELECT *, CASE WHEN bio AND k % 3 <> 0 THEN k % 20 END AS x, CASE WHEN career THEN k % 20 + k % 2 END AS y, CASE WHEN bio THEN c_name END AS a, CASE WHEN named THEN 'Order ' || k END AS b FROM c)
    SELECT 'c' || k AS player_id, coalesce(a, b) AS player_name, coalesce(x, y)::bigint AS experience_seasons, (bio::int + career::int + named::int)::bigint AS n_sources,
    (coalesce(a <> b, false)::int + coalesce(x <> y, false)::int)::bigint AS n_conflicts FROM v WHERE bio OR career OR named""",
)
def r15_player_conflicts(spark, sf):
    out = B.player_conflicts(_raw_bios(spark, sf), _raw_career(spark, sf), _player_names(spark, sf))
    return longs(out)


@query(
    "r15_mvp_winners",
    """SELECT year(o_orderdate)::int AS season, 'NBA' AS league, 'c' || o_custkey AS player_id, CASE WHEN o_orderstatus <> 'P' THEN 't' || o_custkey % 12 END AS team_id, (19 + o_custkey % 20)::bigint AS age,
    CASE WHEN o_orderstatus = 'F' THEN 82 END::bigint AS games, round(o_totalprice / 1000, 2) AS win_shares FROM orders""",
)
def r15_winners(spark, sf):
    c, year = F.col, F.year("o_orderdate")
    one = F.lit("1")
    cells = {
        "Season": F.concat((year - 1).cast("string"), F.lit("-"), F.substring(year.cast("string"), -2, 2)), "League": F.lit(" nba"), "Player_id": F.concat(F.lit("C"), c("o_custkey").cast("string")),
        "Age": (19 + c("o_custkey") % 20).cast("string"), "Team_id": F.when(c("o_orderstatus") != "P", F.concat(F.lit("T"), (c("o_custkey") % 12).cast("string"))).otherwise(" "),
        "Game": F.when(c("o_orderstatus") == "F", "82").otherwise("none"), "Win Shares": F.round(c("o_totalprice") / 1000, 2).cast("string"),
    }
    rest = [n for n in B.C.MVP_WINNERS if n not in {k.lower() for k in cells}]
    raw = table(spark, sf, "orders").select(*[v.alias(n) for n, v in cells.items()], *[one.alias(n) for n in rest])
    out = B.mvp_winners(raw).select("season", "league", "player_id", "team_id", "age", "games", "win_shares")
    return rounded(longs(out), 2).withColumn("season", c("season").cast("int"))


def _award_rows(spark, sf):
    """A summary per order year: the champion of even ones is a club of that year, of odd ones nobody known."""
    c = F.col
    years = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.max("o_custkey").alias("k"))
    cells = {
        "Season Year": F.concat((c("y") - 1).cast("string"), F.lit("-"), F.substring(c("y").cast("string"), -2, 2)), "League": F.lit("nba "),
        "Champion Name": F.when(c("y") % 2 == 0, F.concat(F.lit("Team "), (c("k") % 30).cast("string"))).otherwise("Nobody"), "MVP": F.lit("x"),
        "Rookie of the Year": F.lit("Jos\u00c3\u00a9"), "Most Points": F.concat(F.lit("P"), c("k").cast("string")), "Most Rebounds": F.lit(""), "Most Assists": F.lit("a"), "Most Winshares": F.lit("b"),
    }
    lookup = table(spark, sf, "orders").select(F.year("o_orderdate").alias("season"), (c("o_custkey") % 30).alias("t")).distinct()
    lookup = lookup.select("season", F.concat(F.lit(" T"), c("t").cast("string")).alias("team_id"), F.concat(F.lit("Team "), c("t").cast("string")).alias("team_name"))
    return B.season_awards(years.select(*[v.alias(n) for n, v in cells.items()]), lookup)


@query(
    "r15_season_awards",
    """SELECT y::int AS season, 'NBA' AS league, CASE WHEN y % 2 = 0 THEN 't' || k % 30 END AS champion_team_id, 'José' AS rookie_of_the_year, 'P' || k AS most_points, CAST(NULL AS varchar) AS most_rebounds, 'a' AS most_assists, 'b' AS most_winshares
    FROM (SELECT year(o_orderdate) AS y, max(o_custkey) AS k FROM orders GROUP BY 1)""",
)
def r15_awards(spark, sf):
    return _award_rows(spark, sf).withColumn("season", F.col("season").cast("int"))


@query(
    "r15_seasons",
    """WITH a AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), u AS (SELECT y FROM a UNION SELECT year(l_shipdate) FROM lineitem)
    SELECT u.y::bigint AS season, (u.y - 1) || '-' || right(u.y::varchar, 2) AS season_label, (u.y - 1)::bigint AS start_year, a.y IS NOT NULL AS has_awards FROM u LEFT JOIN a ON a.y = u.y""",
)
def r15_seasons(spark, sf):
    used = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("season"))
    return longs(B.seasons(_award_rows(spark, sf), used))


@query(
    "r15_player_advanced_stats",
    """WITH s AS (SELECT year(l_shipdate)::int AS season, 'p' || l_orderkey AS player_id, CASE WHEN l_linenumber = 7 THEN 'tot' ELSE 't' || l_suppkey END AS team_id, * FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY season, player_id, team_id = 'tot' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, bool_or(team_id = 'tot') OVER (PARTITION BY season, player_id) AS has FROM s)
    SELECT season, player_id, CASE WHEN team_id = 'tot' THEN 0 ELSE rn END AS stint, team_id = 'tot' OR (NOT has AND rn = 1) AS is_primary, team_id, l_tax AS usage_percentage, CAST(NULL AS double) AS win_shares,
    l_discount AS box_plus_minus FROM n""",
)
def r15_advanced(spark, sf):
    c = F.col
    team = F.when(c("l_linenumber") == 7, "3TM").otherwise(F.concat(F.lit("T"), c("l_suppkey").cast("string")))
    value = {"usage_percentage": c("l_tax").cast("string"), "win_shares": F.lit(" "), "box_plus_minus": c("l_discount").cast("string")}
    cells = {"Season": F.year("l_shipdate").cast("string"), "Player_Id": F.concat(F.lit(" P"), c("l_orderkey").cast("string")), "Team": team}
    cells |= {m.title(): value.get(m, F.lit("1")) for m in B.C.ADVANCED_METRICS}
    raw = table(spark, sf, "lineitem").select(*[v.alias(n) for n, v in cells.items()], F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias(R.SOURCE_ROW))
    averages = raw.groupBy("Season").agg(F.lit(" ").alias("Player_Id"))
    out = B.player_advanced_stats(raw.unionByName(averages, allowMissingColumns=True)).select("season", "player_id", "stint", "is_primary", "team_id", "usage_percentage", "win_shares", "box_plus_minus")
    return longs(out).withColumn("season", c("season").cast("int"))
