"""Queries for the dimension views and marts (M1-M17) over the order star.

Orders stand in for the league tables: a year is a season, a customer a player, a supplier a
club, a line item a box-score line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.catalog.registry import query, rounded, table
from statloom.functions.numeric import safe_ratio
from statloom.operators.ranks import settle
from statloom.operators.rows import collect_keys
from statloom.plans import columns as C
from statloom.plans import marts as M


# The half-up nudge of safe_ratio.
N = "1.000000000001"


@query(
    "flagship_customer_ranking",
    f"""WITH spend AS (SELECT o_custkey, o_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS qty
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    per AS (SELECT o_custkey, count(*) AS n_orders, sum(revenue) AS revenue, sum(qty) AS qty FROM spend GROUP BY 1),
    busiest AS (SELECT c_nationkey, max(n) AS nation_max_orders FROM (SELECT c_nationkey, c_custkey, count(*) AS n
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1)
    SELECT row_number() OVER (ORDER BY n_orders DESC, revenue DESC, c_custkey) AS place, c_custkey, c_name, n_orders, round(revenue, 4) AS revenue,
    round(revenue / nullif(qty, 0) * {N}, 2) AS revenue_per_unit, round(n_orders::double / nullif(nation_max_orders, 0) * {N}, 4) AS activity
    FROM customer JOIN per ON o_custkey = c_custkey LEFT JOIN busiest USING (c_nationkey) ORDER BY place LIMIT 100""",
)
def flagship(spark, sf):
    orders, lines, customer = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    # Line items are summed per order before they meet the orders, and per customer after.
    per_order = lines.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.sum("l_quantity").alias("qty")
    )
    per = (
        orders.join(per_order, orders.o_orderkey == per_order.l_orderkey)
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("revenue").alias("revenue"), F.sum("qty").alias("qty"))
    )
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    busiest = (
        customer.join(counts, customer.c_custkey == counts.o_custkey)
        .groupBy("c_nationkey")
        .agg(F.max("n").alias("nation_max_orders"))
    )
    df = customer.join(per, customer.c_custkey == per.o_custkey).join(busiest, "c_nationkey", "left")
    order = [F.col("n_orders").desc(), F.col("revenue").desc(), F.col("c_custkey").asc()]
    top = df.orderBy(*order).limit(100)
    return top.select(
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long").alias("place"),
        "c_custkey", "c_name", "n_orders", F.round("revenue", 4).alias("revenue"),
        safe_ratio(F.col("revenue"), F.col("qty"), 2).alias("revenue_per_unit"),
        safe_ratio(F.col("n_orders"), F.col("nation_max_orders"), 4).alias("activity"),
    )


def cleaned(spark, sf) -> dict[str, DataFrame]:
    """The eleven cleaned tables, shaped from the order star."""
    c = F.col
    customer, orders, lines, supplier = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "supplier"))
    bio = c("c_acctbal") >= 0
    years = F.year("o_orderdate")
    described = [x for x in C.PLAYER_COLUMNS if x not in ("player_id", "player_name", "has_bio")]
    known = {
        "primary_position": F.when(bio, F.expr("left(c_mktsegment, 2)")), "height_cm": F.when(bio, 180.0 + c("c_nationkey")),
        "weight_kg": F.when(bio, 80.0 + c("c_custkey") % 30), "experience_seasons": F.when(bio, (c("c_custkey") % 20).cast("int")),
        "career_games": F.when(bio, (c("c_custkey") % 900).cast("int")), "career_points": F.when(bio, F.round(c("c_acctbal") / 100, 1)),
    }
    players = customer.select(
        c("c_custkey").alias("player_id"), c("c_name").alias("player_name"), bio.alias("has_bio"),
        *[known.get(x, F.lit(None).cast("string")).alias(x) for x in described],
    )
    club = supplier.select(c("s_suppkey").alias("team_id"), c("s_name").alias("team_name"), F.lit(False).alias("is_aggregate"), F.lit(True).alias("has_detail"))
    combined = spark.createDataFrame([(-1, "All clubs", True, False)], "team_id long, team_name string, is_aggregate boolean, has_detail boolean")
    line = lines.join(orders, c("l_orderkey") == c("o_orderkey")).withColumn("season", years)
    count = [x for x in C.PLAYER_SEASON_STATS[8:] if x not in C.PERCENTAGES]
    # One combined row per player-season, one row per club of a player-season.
    value = {
        "games_played": F.count(F.lit(1)), "games_started": F.count_if(c("l_linenumber") == 1), "minutes_played": F.sum("l_quantity").cast("long"),
        "points": F.sum(F.floor("l_extendedprice")), "total_rebounds": F.sum("l_linenumber"), "assists": F.sum(F.floor("l_quantity")),
        "turnovers": F.count_if(c("l_returnflag") == "R"),
    }
    team_counts = [x for x in C.TEAM_SEASON_STATS[3:] if x not in C.PERCENTAGES]
    team_value = {
        "games": F.count_if(c("l_returnflag") != "N"), "minutes_played": F.sum("l_quantity").cast("long"), "points": F.sum(F.floor("l_extendedprice")),
        "field_goals_made": F.sum(F.floor("l_quantity")), "field_goals_attempted": F.sum(F.floor("l_quantity") * 2 + c("l_linenumber")),
        "three_pointers_made": F.sum("l_linenumber"), "three_pointers_attempted": F.sum(c("l_linenumber") * 2), "free_throws_attempted": F.sum(c("l_linenumber") * 3),
        "offensive_rebounds": F.count_if(c("l_returnflag") == "A"), "total_rebounds": F.count(F.lit(1)), "assists": F.sum("l_linenumber"),
        "turnovers": F.count_if(c("l_returnflag") == "R"),
    }
    rates = [x for x in C.PERCENTAGES if x in C.TEAM_SEASON_STATS]
    # One join and one aggregation for players, players at a club, and clubs, read from then on.
    keys = ["season", "player_id", "team_id"]
    line = line.withColumns({"player_id": c("o_custkey"), "team_id": c("l_suppkey")})
    sums = [v.cast("long").alias(f"b_{x}") for x, v in value.items()] + [v.cast("long").alias(f"t_{x}") for x, v in team_value.items()]
    grouped = line.groupingSets([keys, keys[:2], [keys[0], keys[2]]], *keys).agg(*sums, F.avg("l_discount").alias("rate"), F.grouping_id().alias("level"))
    grouped = settle(grouped)
    zero = F.lit(0).cast("long")
    lines = [(c(f"b_{x}") if x in value else zero).alias(x) for x in count] + [c("rate").alias(x) for x in C.PERCENTAGES]
    combined_line = c("level") == 1
    both = grouped.filter("level < 2").select(
        "season", "player_id", F.when(combined_line, -1).otherwise(c("team_id")).cast("long").alias("team_id"), *lines,
        F.when(combined_line, 0).otherwise(1).alias("stint"), combined_line.alias("is_primary"),
    )
    box = both.withColumns({"rank": F.lit(1), "age": (c("player_id") % 20 + 19).cast("int"), "position": F.lit("G")})
    box = box.withColumn("stint", F.when(c("stint") == 0, 0).otherwise(c("team_id") + 1))
    adv = box.select("season", "player_id", "stint", "is_primary", "team_id", *[(c("points") / c("games_played")).alias(m) for m in C.ADVANCED_METRICS])
    totals = grouped.filter("level = 2").select(
        "season", "team_id", F.lit(1).alias("rank"), *[(c(f"t_{x}") if x in team_value else zero).alias(x) for x in team_counts], *[c("rate").alias(x) for x in rates]
    )
    # The champion of an even season is its best seller; odd seasons have none, like years without an award.
    best = totals.groupBy("season").agg(F.max_by("team_id", F.struct("points", "team_id")).alias("champion_team_id"))
    awards = best.select("season", F.when(c("season") % 2 == 0, "NBA").otherwise("BAA").alias("league"), "champion_team_id")
    spend = orders.groupBy(years.alias("season"), c("o_custkey").alias("player_id")).agg(F.sum("o_totalprice").alias("s"))
    winners = spend.groupBy("season").agg(F.max_by("player_id", F.struct("s", "player_id")).alias("player_id")).withColumn("league", F.lit("NBA"))
    ballot = orders.filter("o_orderpriority = '1-URGENT'").groupBy(years.alias("season"), c("o_custkey").alias("player_id")).agg(
        F.count(F.lit(1)).alias("rank"), F.round(F.max("o_totalprice") / 600000, 3).alias("share")
    )
    seasons = collect_keys([totals, box], "season")
    label = F.concat((c("season") - 1).cast("string"), F.lit("-"), F.substring(c("season").cast("string"), -2, 2))
    seasons = seasons.select("season", label.alias("season_label"), (c("season") - 1).alias("start_year"))
    return {
        "players": players, "teams": club.unionByName(combined), "seasons": seasons, "season_awards": awards, "mvp_winners": winners,
        "mvp_candidates": ballot, "player_season_stats": box, "player_advanced_stats": adv, "team_season_stats": totals,
    }


# The same shapes in SQL.
_LINE = "line AS (SELECT *, cast(year(o_orderdate) AS integer) AS season FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_TOTALS = """totals AS (SELECT season, l_suppkey AS team_id, count(*) FILTER (WHERE l_returnflag <> 'N') AS games, sum(floor(l_extendedprice)) AS points,
    sum(floor(l_quantity)) AS fgm, sum(floor(l_quantity) * 2 + l_linenumber) AS fga, sum(l_linenumber) AS tpm, sum(l_linenumber * 2) AS tpa,
    sum(l_linenumber * 3) AS fta, count(*) FILTER (WHERE l_returnflag = 'A') AS orb, count(*) AS trb, sum(l_linenumber) AS ast,
    count(*) FILTER (WHERE l_returnflag = 'R') AS tov FROM line GROUP BY 1, 2)"""
_AWARDS = """best AS (SELECT season, arg_max(team_id, (points, team_id)) AS champion_team_id FROM totals GROUP BY 1),
    champ AS (SELECT * FROM best WHERE season % 2 = 0)"""
_MVP = """spend AS (SELECT cast(year(o_orderdate) AS integer) AS season, o_custkey AS player_id, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2),
    mvp AS (SELECT season, arg_max(player_id, (s, player_id)) AS player_id FROM spend GROUP BY 1)"""
_SCHEDULE = "sched AS (SELECT season, max(games) AS scheduled_games FROM totals WHERE games > 0 GROUP BY 1)"
_LABEL = "(season - 1) || '-' || right(cast(season AS varchar), 2)"


@query(
    "m01_dim_player",
    f"""SELECT c_custkey AS player_id, c_name AS player_name, c_acctbal >= 0 AS has_bio,
    CASE WHEN c_acctbal >= 0 THEN round((180.0 + c_nationkey)::double / (80.0 + c_custkey % 30) * {N}, 4) END AS height_to_weight,
    CASE WHEN c_acctbal >= 0 THEN cast(c_custkey % 20 AS integer) END AS career_experience_seasons,
    CASE WHEN c_acctbal >= 0 THEN round(c_acctbal / 100, 1) END AS career_points_per_game FROM customer""",
)
def m01(spark, sf):
    out = M.dim_player(cleaned(spark, sf)["players"])
    return rounded(out.select("player_id", "player_name", "has_bio", "height_to_weight", "career_experience_seasons", "career_points_per_game"))


@query(
    "m02_dim_team",
    """SELECT s_suppkey AS team_id, s_name AS team_name, false AS is_aggregate, true AS has_detail FROM supplier
    UNION ALL SELECT -1, 'All clubs', true, false""",
)
def m02(spark, sf):
    return M.dim_team(cleaned(spark, sf)["teams"])


@query(
    "m03_dim_season",
    f"""WITH {_LINE}, {_TOTALS}, {_AWARDS}, {_MVP}, {_SCHEDULE}
    SELECT t.season, {_LABEL.replace('season', 't.season')} AS season_label, t.season - 1 AS start_year, champion_team_id, s_name AS champion_team_name,
    mvp.player_id AS mvp_player_id, c_name AS mvp_player_name, scheduled_games, scheduled_games IS NOT NULL AS has_been_played
    FROM (SELECT DISTINCT season FROM totals) t LEFT JOIN champ ON champ.season = t.season LEFT JOIN mvp ON mvp.season = t.season
    LEFT JOIN supplier ON s_suppkey = champion_team_id LEFT JOIN customer ON c_custkey = mvp.player_id LEFT JOIN sched ON sched.season = t.season""",
)
def m03(spark, sf):
    t = cleaned(spark, sf)
    return M.dim_season(t["seasons"], t["season_awards"], t["teams"], t["mvp_winners"], t["players"], t["team_season_stats"])


@query(
    "m04_scalar_broadcast",
    "SELECT o_orderkey, (SELECT max(year(o_orderdate)) FROM orders) - year(o_orderdate) AS seasons_ago FROM orders",
)
def m04(spark, sf):
    orders = table(spark, sf, "orders")
    latest = orders.agg(F.max(F.year("o_orderdate"))).scalar()
    return orders.select("o_orderkey", (latest - F.year("o_orderdate")).cast("long").alias("seasons_ago"))


@query(
    "m05_composite_join",
    """SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.q, b.d FROM
    (SELECT l_orderkey, l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3) a JOIN
    (SELECT l_orderkey, l_partkey, l_suppkey, max(l_discount) AS d FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3) b
    USING (l_orderkey, l_partkey, l_suppkey)""",
)
def m05(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = table(spark, sf, "lineitem")
    box = lines.groupBy(*keys).agg(F.sum("l_quantity").alias("q"))
    advanced = lines.filter("l_returnflag <> 'N'").groupBy(*keys).agg(F.max("l_discount").alias("d"))
    return rounded(box.join(advanced, keys))


@query(
    "m06_dimension_joins",
    """SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def m06(spark, sf):
    orders, customer, nation, region = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    # Summed per customer first: the dimensions then join one row per customer, not per order.
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    df = per.join(customer, per.o_custkey == customer.c_custkey)
    df = df.join(nation, df.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return df.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))


@query(
    "m07_optional_join",
    """SELECT c_custkey, max(o_totalprice) AS best_urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""",
)
def m07(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best_urgent"))
    customer = table(spark, sf, "customer")
    return rounded(customer.join(urgent, customer.c_custkey == urgent.o_custkey, "left").select("c_custkey", "best_urgent"))


@query("m08_base_filter", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_linestatus = 'F'")
def m08(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("is_primary", F.col("l_linestatus") == "F")
    return df.filter("is_primary").select("l_orderkey", "l_partkey", "l_extendedprice")


@query(
    "m09_null_aware_flags",
    """SELECT d.doc_id, (quality = 1) AS is_good, (quality IS NOT NULL) AS is_labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def m09(spark, sf):
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return df.select("doc_id", (F.col("quality") == 1).alias("is_good"), F.col("quality").isNotNull().alias("is_labelled"))


@query(
    "m10_denominator_choice",
    """SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN 82 ELSE nullif(l_linenumber - 1, 0) END::bigint AS team_games,
    CASE WHEN l_returnflag = 'N' THEN 'league_schedule' ELSE 'own_team' END AS games_basis FROM lineitem""",
)
def m10(spark, sf):
    games, basis = M.denominator(F.col("l_returnflag") == "N", F.lit(82), F.col("l_linenumber") - 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", games.cast("long").alias("team_games"), basis.alias("games_basis"))


@query(
    "m11_safe_ratio",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, round(l_extendedprice / nullif(l_quantity, 0) * {N}, 2) AS unit_price,
    round(l_tax / nullif(l_discount, 0) * {N}, 4) AS tax_per_discount FROM lineitem""",
)
def m11(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", safe_ratio(c("l_extendedprice"), c("l_quantity"), 2).alias("unit_price"),
        safe_ratio(c("l_tax"), c("l_discount"), 4).alias("tax_per_discount"),
    )


@query(
    "m12_experience_rollback",
    """SELECT o_orderkey, o_custkey % 20 - ((SELECT max(year(o_orderdate)) FROM orders) - year(o_orderdate)) - 1 AS experience FROM orders""",
)
def m12(spark, sf):
    orders = table(spark, sf, "orders")
    latest = orders.agg(F.max(F.year("o_orderdate"))).scalar()
    out = M.rolled_back_experience(F.col("o_custkey") % 20, latest, F.year("o_orderdate"))
    return orders.select("o_orderkey", out.alias("experience"))


_RATES = f"""WITH {_LINE}, {_TOTALS}, p AS (SELECT *, fga - orb + tov + 0.44::double * fta AS poss FROM totals)"""


def _rates(spark, sf):
    return M.team_rates(cleaned(spark, sf)["team_season_stats"])


@query(
    "m13_possessions",
    f"""{_RATES} SELECT season, team_id, round(poss, 1) AS estimated_possessions, round(poss / nullif(games, 0) * {N}, 1) AS possessions_per_game,
    round(points / nullif(poss, 0) * 100 * {N}, 2) AS offensive_rating FROM p""",
)
def m13(spark, sf):
    return _rates(spark, sf).select("season", "team_id", "estimated_possessions", "possessions_per_game", "offensive_rating")


@query(
    "m14_four_factors",
    f"""{_RATES} SELECT season, team_id, round((fgm + 0.5 * tpm)::double / nullif(fga, 0) * 100 * {N}, 2) AS effective_fg_pct,
    round(tov / nullif(poss, 0) * 100 * {N}, 2) AS turnover_pct, round(orb::double / nullif(fga - fgm, 0) * 100 * {N}, 2) AS offensive_rebound_pct,
    round(fta::double / nullif(fga, 0) * 100 * {N}, 2) AS free_throw_rate FROM p""",
)
def m14(spark, sf):
    return _rates(spark, sf).select("season", "team_id", "effective_fg_pct", "turnover_pct", "offensive_rebound_pct", "free_throw_rate")


@query(
    "m15_shot_profile",
    f"""{_RATES} SELECT season, team_id, round(tpa::double / nullif(fga, 0) * 100 * {N}, 2) AS three_point_attempt_rate,
    round(ast::double / nullif(fgm, 0) * 100 * {N}, 2) AS assisted_fg_pct FROM p""",
)
def m15(spark, sf):
    return _rates(spark, sf).select("season", "team_id", "three_point_attempt_rate", "assisted_fg_pct")


@query(
    "m16_player_season",
    f"""WITH {_LINE}, {_TOTALS}, {_AWARDS}, {_MVP}, {_SCHEDULE},
    box AS (SELECT season, o_custkey AS player_id, count(*) AS games_played, sum(floor(l_extendedprice)) AS points, sum(l_linenumber) AS trb FROM line GROUP BY 1, 2),
    ballot AS (SELECT cast(year(o_orderdate) AS integer) AS season, o_custkey AS player_id, count(*) AS rank, round(max(o_totalprice) / 600000, 3) AS share
    FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
    SELECT b.season, b.player_id, c_name AS player_name, 'All clubs' AS team_name, true AS is_multi_team_season,
    (-1 = champion_team_id) AS is_on_champion_team, l.player_id IS NOT NULL AS is_mvp_candidate, l.rank AS mvp_rank, l.share AS mvp_vote_share,
    mvp.player_id IS NOT NULL AS is_mvp_winner, games_played, scheduled_games AS team_games, 'league_schedule' AS games_basis,
    round(games_played::double / scheduled_games * {N}, 4) AS availability, round(points / games_played * {N}, 2) AS points_per_game,
    round(trb::double / games_played * {N}, 2) AS rebounds_per_game, round(points / games_played, 6) AS win_shares,
    CASE WHEN c_acctbal >= 0 THEN c_custkey % 20 - ((SELECT max(season) FROM box) - b.season) - 1 END AS experience_seasons
    FROM box b JOIN customer ON c_custkey = b.player_id LEFT JOIN champ ON champ.season = b.season LEFT JOIN sched ON sched.season = b.season
    LEFT JOIN ballot l ON l.season = b.season AND l.player_id = b.player_id LEFT JOIN mvp ON mvp.season = b.season AND mvp.player_id = b.player_id""",
)
def m16(spark, sf):
    t = cleaned(spark, sf)
    season = M.dim_season(t["seasons"], t["season_awards"], t["teams"], t["mvp_winners"], t["players"], t["team_season_stats"])
    out = M.player_season(
        t["player_season_stats"], t["player_advanced_stats"], M.dim_player(t["players"]), M.dim_team(t["teams"]), season,
        t["team_season_stats"], t["mvp_candidates"], t["mvp_winners"],
    )
    return rounded(
        out.select(
            "season", "player_id", "player_name", "team_name", "is_multi_team_season", "is_on_champion_team", "is_mvp_candidate", "mvp_rank",
            "mvp_vote_share", "is_mvp_winner", "games_played", "team_games", "games_basis", "availability", "points_per_game",
            "rebounds_per_game", "win_shares", F.col("experience_seasons").cast("long").alias("experience_seasons"),
        )
    )


@query(
    "m17_team_season",
    f"""WITH {_LINE}, {_TOTALS}, {_AWARDS}, p AS (SELECT *, fga - orb + tov + 0.44::double * fta AS poss FROM totals)
    SELECT p.season, {_LABEL.replace('season', 'p.season')} AS season_label, p.team_id, s_name AS team_name, (p.team_id = champion_team_id) AS is_champion,
    games > 0 AS has_been_played, games, round(p.points / nullif(games, 0) * {N}, 1) AS points_per_game, round(p.points / nullif(poss, 0) * 100 * {N}, 2) AS offensive_rating
    FROM p JOIN supplier ON s_suppkey = p.team_id LEFT JOIN champ ON champ.season = p.season""",
)
def m17(spark, sf):
    t = cleaned(spark, sf)
    season = M.dim_season(t["seasons"], t["season_awards"], t["teams"], t["mvp_winners"], t["players"], t["team_season_stats"])
    out = M.team_season(t["team_season_stats"], M.dim_team(t["teams"]), season)
    return out.select("season", "season_label", "team_id", "team_name", "is_champion", "has_been_played", "games", "points_per_game", "offensive_rating")
