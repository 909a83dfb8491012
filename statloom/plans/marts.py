"""Dimension views and the two wide marts, from the cleaned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.numeric import safe_ratio
from statloom.operators.quality import assert_grain

# Fixed value: share of free throws that end a possession.
FREE_THROW_WEIGHT = 0.44


def dim_player(players: DataFrame) -> DataFrame:
    return players.select(
        "player_id", "player_name", "has_bio", "primary_position", "shoots", "height_cm", "weight_kg",
        safe_ratio(F.col("height_cm"), F.col("weight_kg"), 4).alias("height_to_weight"),
        "birth_date", "birth_year", "college", F.col("experience_seasons").alias("career_experience_seasons"),
        "nba_debut_year", "draft_year", "draft_round", "draft_overall_pick", "draft_team_name", "career_games",
        F.col("career_points").alias("career_points_per_game"), "career_per", "career_win_shares",
    )


def dim_team(teams: DataFrame) -> DataFrame:
    return teams.select("team_id", "team_name", "is_aggregate", "has_detail")


def scheduled_games(team_season_stats: DataFrame) -> DataFrame:
    """Longest schedule of a season; seasons nobody has played yet have no row."""
    return team_season_stats.filter("games > 0").groupBy("season").agg(F.max("games").alias("scheduled_games"))


def dim_season(
    seasons: DataFrame, awards: DataFrame, teams: DataFrame, winners: DataFrame, players: DataFrame, team_season_stats: DataFrame
) -> DataFrame:
    champion = awards.filter("league = 'NBA'").select("season", "champion_team_id")
    mvp = winners.filter("league = 'NBA'").select("season", F.col("player_id").alias("mvp_player_id"))
    club = teams.select(F.col("team_id").alias("champion_team_id"), F.col("team_name").alias("champion_team_name"))
    name = players.select(F.col("player_id").alias("mvp_player_id"), F.col("player_name").alias("mvp_player_name"))
    out = seasons.join(champion, "season", "left").join(mvp, "season", "left")
    out = out.join(club, "champion_team_id", "left").join(name, "mvp_player_id", "left")
    out = out.join(scheduled_games(team_season_stats), "season", "left")
    return out.select(
        "season", "season_label", "start_year", "champion_team_id", "champion_team_name", "mvp_player_id",
        "mvp_player_name", "scheduled_games", F.col("scheduled_games").isNotNull().alias("has_been_played"),
    )


def denominator(is_aggregate: Column, schedule: Column, own: Column) -> tuple[Column, Column]:
    """Games a player could have played, and which of the two readings that is."""
    games = F.when(is_aggregate, schedule).otherwise(F.nullif(own, F.lit(0)))
    basis = F.when(is_aggregate, "league_schedule").otherwise("own_team")
    return games, basis


def rolled_back_experience(career: Column, latest: Column, season: Column) -> Column:
    """Seasons of experience before this one, from the figure as of the latest season."""
    return career - (latest - season) - 1


def possessions(attempts: Column, offensive: Column, turnovers: Column, free_throws: Column) -> Column:
    return attempts - offensive + turnovers + FREE_THROW_WEIGHT * free_throws


def player_season(
    box: DataFrame, advanced: DataFrame, dim_players: DataFrame, dim_teams: DataFrame, dim_seasons: DataFrame,
    team_season_stats: DataFrame, candidates: DataFrame, winners: DataFrame,
) -> DataFrame:
    """One row per player-season: box score, advanced metrics, honours, bio and availability."""
    latest = box.agg(F.max("season")).scalar()
    metrics = [c for c in advanced.columns if c not in ("season", "player_id", "stint", "is_primary", "team_id")]
    ballot = candidates.select("season", "player_id", F.lit(True).alias("_c"), F.col("rank").alias("mvp_rank"), F.col("share").alias("mvp_vote_share"))
    won = winners.filter("league = 'NBA'").select("season", "player_id", F.lit(True).alias("_w"))
    schedule = team_season_stats.select("season", "team_id", F.col("games").alias("_own_games"))
    # The fact side is filtered to its primary rows first; everything joined on is a dimension
    # or a season-grain table, whose size Spark knows and broadcasts or shuffles accordingly.
    df = box.filter("is_primary").withColumn("_latest", latest)
    df = df.join(advanced.select("season", "player_id", "stint", *metrics), ["season", "player_id", "stint"])
    df = df.join(dim_players, "player_id").join(dim_teams, "team_id").join(dim_seasons, "season")
    df = df.join(schedule, ["season", "team_id"], "left").join(ballot, ["season", "player_id"], "left").join(won, ["season", "player_id"], "left")
    team_games, basis = denominator(F.col("is_aggregate"), F.col("scheduled_games"), F.col("_own_games"))
    games = F.col("games_played")

    def per_game(c: str) -> Column:
        return safe_ratio(F.col(c), games, 2)

    return df.select(
        "season", "season_label", "player_id", "player_name", "team_id", "team_name",
        F.col("is_aggregate").alias("is_multi_team_season"),
        # NULL, not false, in a season without an NBA champion.
        (F.col("team_id") == F.col("champion_team_id")).alias("is_on_champion_team"),
        "age", "position", "primary_position", F.col("rank").alias("points_rank"),
        F.col("_c").isNotNull().alias("is_mvp_candidate"), "mvp_rank", "mvp_vote_share",
        F.col("_w").isNotNull().alias("is_mvp_winner"),
        "games_played", "games_started", "minutes_played", team_games.alias("team_games"), basis.alias("games_basis"),
        safe_ratio(games, team_games, 4).alias("availability"),
        "points", "total_rebounds", "assists", "steals", "blocks", "turnovers", "triple_doubles",
        per_game("points").alias("points_per_game"), per_game("total_rebounds").alias("rebounds_per_game"),
        per_game("assists").alias("assists_per_game"), per_game("minutes_played").alias("minutes_per_game"),
        "field_goal_pct", "three_point_pct", "free_throw_pct", "effective_fg_pct",
        "player_efficiency_rate", "true_shooting_percentage", "usage_percentage", "total_rebound_percentage",
        "assist_percentage", "steal_percentage", "block_percentage", "turnover_percentage", "win_shares",
        "win_shares_per_48_minutes", "offensive_box_plus_minus", "defensive_box_plus_minus", "box_plus_minus",
        "value_over_replacement_player", "has_bio", "height_cm", "weight_kg", "height_to_weight", "college",
        "draft_year", "draft_round", "draft_overall_pick", "career_experience_seasons",
        rolled_back_experience(F.col("career_experience_seasons"), F.col("_latest"), F.col("season")).alias("experience_seasons"),
    )


def team_rates(df: DataFrame) -> DataFrame:
    """Add per-game rates, possessions, the four factors and the shot profile to team totals."""
    c = F.col
    poss = possessions(c("field_goals_attempted"), c("offensive_rebounds"), c("turnovers"), c("free_throws_attempted"))
    shots = c("field_goals_attempted")

    def percent(num: Column, den: Column) -> Column:
        return safe_ratio(num, den, 2, 100)

    return df.withColumns(
        {
            "points_per_game": safe_ratio(c("points"), c("games"), 1),
            "rebounds_per_game": safe_ratio(c("total_rebounds"), c("games"), 1),
            "assists_per_game": safe_ratio(c("assists"), c("games"), 1),
            "turnovers_per_game": safe_ratio(c("turnovers"), c("games"), 1),
            "estimated_possessions": F.round(poss, 1),
            "possessions_per_game": safe_ratio(poss, c("games"), 1),
            "offensive_rating": percent(c("points"), poss),
            "effective_fg_pct": percent(c("field_goals_made") + 0.5 * c("three_pointers_made"), shots),
            "turnover_pct": percent(c("turnovers"), poss),
            "offensive_rebound_pct": percent(c("offensive_rebounds"), shots - c("field_goals_made")),
            "free_throw_rate": percent(c("free_throws_attempted"), shots),
            "three_point_attempt_rate": percent(c("three_pointers_attempted"), shots),
            "assisted_fg_pct": percent(c("assists"), c("field_goals_made")),
        }
    )


def team_season(team_season_stats: DataFrame, dim_teams: DataFrame, dim_seasons: DataFrame) -> DataFrame:
    """One row per club-season; the inner join on the dimension drops what is no club."""
    df = team_season_stats.join(dim_teams.select("team_id", "team_name"), "team_id")
    df = df.join(dim_seasons.select("season", "season_label", "champion_team_id"), "season")
    out = team_rates(df).withColumns(
        {"is_champion": F.col("team_id") == F.col("champion_team_id"), "has_been_played": F.col("games") > 0}
    )
    front = ["season", "season_label", "team_id", "team_name", "is_champion", "rank", "has_been_played"]
    rest = [c for c in out.columns if c not in (*front, "champion_team_id")]
    return out.select(*front, *rest).withColumnRenamed("rank", "points_rank")


def build_marts(t: dict[str, DataFrame], check: bool = True) -> dict[str, DataFrame]:
    """The analyst-ready layer; with ``check`` a broken grain fails the build."""
    out = {"dim_player": dim_player(t["players"]), "dim_team": dim_team(t["teams"])}
    out["dim_season"] = dim_season(
        t["seasons"], t["season_awards"], t["teams"], t["mvp_winners"], t["players"], t["team_season_stats"]
    )
    out["player_season"] = player_season(
        t["player_season_stats"], t["player_advanced_stats"], out["dim_player"], out["dim_team"], out["dim_season"],
        t["team_season_stats"], t["mvp_candidates"], t["mvp_winners"],
    )
    out["team_season"] = team_season(t["team_season_stats"], out["dim_team"], out["dim_season"])
    if check:
        assert_grain(out["player_season"], ["season", "player_id"], "player_season")
        assert_grain(out["team_season"], ["season", "team_id"], "team_season")
    return out
