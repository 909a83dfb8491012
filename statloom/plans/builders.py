"""Raw tables to cleaned tables: DataFrame chains over the cleaning expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import text as X
from statloom.operators import rows as R
from statloom.plans import columns as C

TOTAL_TEAM_NAME = "Multiple Teams (season total)"


def _prepared(raw: DataFrame, renames: dict[str, str], season: str = "season") -> DataFrame:
    df = X.normalize_headers(raw, renames)
    return df.withColumn(season, X.to_season_end_year(F.col(season)))


def _with_stints(raw: DataFrame, renames: dict[str, str], extra_text: list[str], numbers: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Common part of the per-season player tables: ids, folded team codes, numbers, stints.

    Cells are read before the rows are numbered: what follows the exchange may run twice, as a sort
    looks at its input first. Ties are told apart by the cells as they came.
    """
    if R.SOURCE_ROW not in raw.columns:
        raw = R.with_source_row(raw)
    df = _prepared(raw.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])), renames)
    df, dropped = R.drop_league_average_rows(df, "player_id")
    df = X.normalize_text(df, ["player_id", "team_id", *extra_text])
    df = df.withColumns({"player_id": X.clean_id(F.col("player_id")), "team_id": X.to_team_id(F.col("team_id"))})
    for dtype in dict.fromkeys(numbers.values()):
        df = X.coerce_numbers(df, [c for c, kind in numbers.items() if kind == dtype], dtype)
    return R.add_stint_columns(df, "season", "player_id", "team_id", tie="_tie").drop("_tie"), dropped


def player_season_stats(raw: DataFrame) -> DataFrame:
    counts = [c for c in C.PLAYER_SEASON_STATS[5:] if c not in (*C.PERCENTAGES, "position")]
    numbers = dict.fromkeys(counts, "int") | dict.fromkeys(C.PERCENTAGES, "double")
    df, _ = _with_stints(raw, C.PLAYER_STATS, ["position"], numbers)
    return R.project_sorted(df, C.PLAYER_SEASON_STATS, ["season", "rank", "player_id", "stint"])


def player_advanced_stats(raw: DataFrame) -> DataFrame:
    df, _ = _with_stints(raw, {"team": "team_id"}, [], dict.fromkeys(C.ADVANCED_METRICS, "double"))
    columns = ["season", "player_id", "stint", "is_primary", "team_id", *C.ADVANCED_METRICS]
    return R.project_sorted(df, columns, ["season", "player_id", "stint"])


def _roster_rows(raw: DataFrame) -> DataFrame:
    df = X.normalize_text(X.normalize_headers(raw, C.ROSTERS))
    return df.withColumns({"season": X.to_season_end_year(F.col("season")), "team_id": X.clean_id(F.col("team_id"))})


def team_name_lookup(raw_rosters: DataFrame) -> DataFrame:
    """Distinct (season, team_id, team_name) of the roster pages."""
    columns = ["season", "team_id", "team_name"]
    return R.distinct_lookup(_roster_rows(raw_rosters), columns, ["team_id", "team_name"])


def rosters(raw: DataFrame) -> DataFrame:
    df = _roster_rows(raw).filter(F.col("player_id").isNotNull())
    name = X.fix_mojibake(F.col("player_name"))
    df = df.withColumns({"player_id": X.clean_id(F.col("player_id")), "player_name": name})
    position = F.col("position")
    df = df.withColumns(
        {
            "roster_note": X.trailing_note(F.col("player_name")),
            "position_primary": X.part(position, "-", 1),
            "position_secondary": X.part(position, "-", 2),
            "height_cm": X.height_to_cm(F.col("height")),
            "weight_kg": X.weight_to_kg(F.col("weight")),
            "birth_date": X.parse_long_date(F.col("birth_date")),
            "birth_country": X.last_token_upper(F.col("birth_country")),
            "experience_seasons": X.sentinel_to_int(F.col("experience_seasons")),
        }
    )
    df = df.withColumn("player_name", X.without_trailing_note(F.col("player_name")))
    return R.project_sorted(df, C.ROSTER_COLUMNS, ["season", "team_id", "player_id"])


def mvp_winners(raw: DataFrame) -> DataFrame:
    df = X.normalize_text(X.normalize_headers(raw, C.MVP_WINNERS))
    df = df.withColumns({"season": X.to_season_end_year(F.col("season")), "league": F.upper("league")})
    df = X.normalize_ids(df, ["player_id", "team_id"])
    df = X.coerce_numbers(X.coerce_numbers(df, ["age", "games"]), C.MVP_WINNER_COLUMNS[6:], "double")
    return R.project_sorted(df, C.MVP_WINNER_COLUMNS, ["season"])


def mvp_candidates(raw: DataFrame) -> DataFrame:
    df = X.normalize_text(X.normalize_headers(raw, C.MVP_CANDIDATES))
    cell = F.col("rank")
    df = df.withColumns({"tie": X.rank_is_tied(cell), "rank": X.rank_number(cell)})
    df = X.normalize_ids(df.withColumn("season", X.to_season_end_year(F.col("season"))), ["player_id", "team_id"])
    df = X.coerce_numbers(df, ["age", "first_place_votes", "points_won", "points_max", "games"])
    df = X.coerce_numbers(df, ["share", *C.MVP_CANDIDATE_COLUMNS[11:]], "double")
    return R.project_sorted(df, C.MVP_CANDIDATE_COLUMNS, ["season", "rank", "player_id"])


def _team_totals(raw: DataFrame) -> DataFrame:
    df = X.normalize_text(X.normalize_headers(raw, C.TEAM_TOTALS))
    df = df.filter(F.col("team_id").isNotNull())
    df = df.withColumns({"season": X.to_season_end_year(F.col("season")), "team_id": X.clean_id(F.col("team_id"))})
    counts = [c for c in C.TEAM_SEASON_STATS[2:] if c not in C.PERCENTAGES]
    rates = [c for c in C.TEAM_SEASON_STATS if c in C.PERCENTAGES]
    return X.coerce_numbers(X.coerce_numbers(df, counts), rates, "double")


def team_season_stats(raw: DataFrame) -> DataFrame:
    return R.project_sorted(_team_totals(raw), C.TEAM_SEASON_STATS, ["season", "team_id"])


def teams(raw: DataFrame, referenced: DataFrame | None = None, roster_names: DataFrame | None = None) -> DataFrame:
    """Every team code used anywhere, named by the totals table first and the rosters second."""
    totals = _team_totals(raw)
    detail = totals.select("team_id").distinct().join(R.latest_value(totals, "team_id", "season", "team_name"), "team_id", "left")
    used = detail.select("team_id")
    if roster_names is not None:
        used = used.unionByName(roster_names.filter("team_name is not null").select("team_id"))
    if referenced is not None:
        used = used.unionByName(referenced.select(X.clean_id(F.col("team_id")).alias("team_id")).filter("team_id <> ''"))
    out = R.complete_dimension(detail, "team_id", used, "has_detail", [X.TOTAL_TEAM_ID])
    if roster_names is not None:
        out = R.fill_from_lookup(out, R.latest_value(roster_names, "team_id", "season", "team_name"), "team_id", "team_name")
    combined = F.col("team_id") == X.TOTAL_TEAM_ID
    out = out.withColumns(
        {"team_name": F.when(combined, TOTAL_TEAM_NAME).otherwise(F.col("team_name")), "is_aggregate": combined}
    )
    return R.project_sorted(out, ["team_id", "team_name", "is_aggregate", "has_detail"], ["team_id"])


def season_awards(raw: DataFrame, champion_lookup: DataFrame) -> DataFrame:
    """Awards with the champion's name resolved to a team by season and name."""
    df = X.normalize_text(X.normalize_headers(raw, C.SEASON_SUMMARIES))
    names = ["champion_name", *C.SEASON_AWARDS[3:]]
    df = df.withColumns({c: X.fix_mojibake(F.col(c)) for c in names})
    df = df.withColumns({"season": X.to_season_end_year(F.col("season")), "league": F.upper("league")})
    lookup = champion_lookup.select(
        "season", F.col("team_name").alias("champion_name"), F.col("team_id").alias("champion_team_id")
    )
    df = X.normalize_ids(R.lookup_join(df, lookup, ["season", "champion_name"]), ["champion_team_id"])
    return R.project_sorted(df, C.SEASON_AWARDS, ["season", "league"])


def seasons(awards: DataFrame, referenced: DataFrame | None = None) -> DataFrame:
    detail = awards.select("season").dropna().distinct()
    used = referenced.select(F.col("season").cast("int").alias("season")) if referenced is not None else detail
    out = R.complete_dimension(detail, "season", used, "has_awards")
    out = out.withColumns({"season_label": X.to_season_label(F.col("season")), "start_year": F.col("season") - 1})
    return R.project_sorted(out, ["season", "season_label", "start_year", "has_awards"], ["season"])


def _bio_rows(raw_bios: DataFrame) -> DataFrame:
    df = X.normalize_headers(raw_bios)
    # The shooting hand is read from the cell as scraped.
    df = df.withColumn("shoots", X.parse_shooting_hand(F.col("shoots")))
    df = X.normalize_text(df, [c for c in df.columns if c not in ("shoots", R.SOURCE_ROW)])
    return df.withColumns({"player_id": X.clean_id(F.col("player_id")), "player_name": X.fix_mojibake(F.col("player_name"))})


def player_positions(raw_bios: DataFrame) -> DataFrame:
    return R.explode_positions(_bio_rows(raw_bios), "player_id", "position").orderBy("player_id", "slot")


def career_stats(raw: DataFrame) -> DataFrame:
    if R.SOURCE_ROW not in raw.columns:
        raw = R.with_source_row(raw)
    df = X.normalize_headers(raw, C.CAREER)
    df = df.withColumn("player_id", X.clean_id(F.col("player_id")))
    df = df.withColumns({c: X.dash_to_number(F.col(c)) for c in C.CAREER.values()})
    df = df.withColumn("career_experience_seasons", X.to_int(F.col("experience")))
    keep = ["player_id", *C.CAREER.values(), "career_experience_seasons"]
    return R.keep_first(df.select(*keep, R.SOURCE_ROW), ["player_id"], [R.SOURCE_ROW]).select(*keep)


def players(
    raw_bios: DataFrame, raw_career: DataFrame, referenced: DataFrame | None = None, names: DataFrame | None = None
) -> DataFrame:
    """One row per player described or referenced anywhere."""
    bios = _bio_rows(raw_bios)
    primary = R.first_child(R.explode_positions(bios, "player_id", "position"), "player_id", "position_code", "primary_position")
    year, day = X.to_int(F.col("birthyear")), X.to_int(F.col("birthday"))
    debut = X.parse_long_date(F.col("nba debut"))
    pick = F.col("draf pick")
    frame = bios.select(
        "player_id",
        "player_name",
        "shoots",
        X.height_to_cm(F.col("height")).alias("height_cm"),
        X.weight_to_kg(F.col("weight")).alias("weight_kg"),
        X.clean_college(F.col("college")).alias("college"),
        X.to_int(F.col("experience")).alias("experience_seasons"),
        debut.alias("nba_debut_date"),
        F.year(debut).alias("nba_debut_year"),
        year.alias("birth_year"),
        X.month_number(F.col("birthmonth")).alias("birth_month"),
        day.alias("birth_day"),
        X.assemble_date(year, X.month_number(F.col("birthmonth")), day).alias("birth_date"),
        X.draft_year(F.col("draft")).alias("draft_year"),
        F.col("draft team").alias("draft_team_name"),
        X.draft_round(pick).alias("draft_round"),
        X.draft_pick(pick, 1).alias("draft_round_pick"),
        X.draft_pick(pick, 2).alias("draft_overall_pick"),
    )
    frame = frame.join(primary, "player_id", "left").join(career_stats(raw_career), "player_id", "left")
    frame = frame.withColumn("experience_seasons", F.coalesce("experience_seasons", "career_experience_seasons"))
    frame = frame.drop("career_experience_seasons")
    used = frame.select("player_id")
    if referenced is not None:
        used = R.referenced_ids([referenced], "player_id")
    out = R.complete_dimension(frame, "player_id", used, "has_bio")
    if names is not None:
        order = [c for c in ("season", R.SOURCE_ROW) if c in names.columns]
        first = R.first_value(names, "player_id", order, "player_name")
        out = R.fill_from_lookup(out, first, "player_id", "player_name")
    return R.project_sorted(out, C.PLAYER_COLUMNS, ["player_id"])


def player_conflicts(raw_bios: DataFrame, raw_career: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(player_id, player_name, experience_seasons, n_sources, n_conflicts): where the sources of a player disagree.

    The bio page comes before the career page, and both before the rosters.
    """
    bios = _bio_rows(raw_bios).select("player_id", "player_name", X.to_int(F.col("experience")).alias("experience_seasons"))
    career = career_stats(raw_career).select("player_id", F.col("career_experience_seasons").alias("experience_seasons"))
    sources = [bios, career]
    if names is not None:
        order = [c for c in ("season", R.SOURCE_ROW) if c in names.columns]
        sources.append(R.first_value(names, "player_id", order, "player_name"))
    return R.merge_sources(sources, ["player_id"])


def build_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All eleven cleaned tables; facts first, the dimensions from the keys the facts use."""
    out = {
        "player_season_stats": player_season_stats(raw["player_stats"]),
        "player_advanced_stats": player_advanced_stats(raw["advanced_stats"]),
        "rosters": rosters(raw["team_season_rosters"]),
        "mvp_winners": mvp_winners(raw["mvp_winners"]),
        "mvp_candidates": mvp_candidates(raw["mvp_candidates"]),
        "team_season_stats": team_season_stats(raw["team_season_totals"]),
    }
    lookup = team_name_lookup(raw["team_season_rosters"])
    out["season_awards"] = season_awards(raw["season_summaries"], lookup)
    facts = list(out.values())
    team_facts = facts + [out["season_awards"].select(F.col("champion_team_id").alias("team_id"))]
    out["teams"] = teams(raw["team_season_totals"], R.collect_keys(team_facts, "team_id"), lookup)
    out["seasons"] = seasons(out["season_awards"], R.collect_keys(facts, "season"))
    out["players"] = players(
        raw["player_bios"], raw["player_career_stats"], R.collect_keys(facts, "player_id"),
        out["rosters"].select("season", "player_id", "player_name"),
    )
    out["player_positions"] = player_positions(raw["player_bios"])
    return out
