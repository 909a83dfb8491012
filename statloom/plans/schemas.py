"""Declared schemas and the rules of the star: keys, references, vocabularies, checks."""

from __future__ import annotations

from pyspark.sql import types as T

from statloom.functions.text import POSITION_CODES
from statloom.plans import columns as C


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "decimal(5,1)": T.DecimalType(5, 1), "decimal(5,3)": T.DecimalType(5, 3),
}


def ddl(text: str) -> T.StructType:
    """Schema from 'name type, name type' (StructType.fromDDL would need a running session)."""
    pairs = [part.split(" ") for part in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def _columns(names: list[str], kind: str) -> str:
    return ", ".join(f"{n} {kind}" for n in names)


_COUNTS = [c for c in C.PLAYER_SEASON_STATS[8:] if c not in C.PERCENTAGES]
_TEAM_COUNTS = [c for c in C.TEAM_SEASON_STATS[3:] if c not in C.PERCENTAGES]
_FRACTIONS = ["true_shooting_percentage", "three_point_attempt_rate", "free_throw_attempt_rate", "win_shares_per_48_minutes"]


def _mixed(names: list[str], fractions: list[str], other: str = "decimal(5,1)") -> str:
    return ", ".join(f"{n} {'decimal(5,3)' if n in fractions else other}" for n in names)


SCHEMAS: dict[str, T.StructType] = {
    "teams": ddl("team_id string, team_name string, is_aggregate boolean, has_detail boolean"),
    "players": ddl(
        "player_id string, player_name string, has_bio boolean, primary_position string, shoots string, "
        "height_cm decimal(5,1), weight_kg decimal(5,1), birth_year int, birth_month int, birth_day int, "
        "birth_date date, college string, experience_seasons int, nba_debut_date date, nba_debut_year int, "
        "draft_year int, draft_team_name string, draft_round int, draft_round_pick int, draft_overall_pick int, "
        "career_games int, " + _columns(list(C.CAREER.values())[1:], "decimal(5,1)")
    ),
    "seasons": ddl("season int, season_label string, start_year int, has_awards boolean"),
    "player_positions": ddl("player_id string, slot int, position string, position_code string"),
    "season_awards": ddl("season int, league string, " + _columns(C.SEASON_AWARDS[2:], "string")),
    "rosters": ddl(
        "season int, team_id string, player_id string, player_name string, roster_note string, position string, "
        "position_primary string, position_secondary string, height_cm decimal(5,1), weight_kg decimal(5,1), "
        "birth_date date, birth_country string, experience_seasons int, college string"
    ),
    "player_season_stats": ddl(
        "season int, player_id string, stint int, is_primary boolean, team_id string, rank int, age int, "
        "position string, " + _mixed(C.PLAYER_SEASON_STATS[8:], C.PERCENTAGES, "int")
    ),
    "player_advanced_stats": ddl(
        "season int, player_id string, stint int, is_primary boolean, team_id string, "
        + _mixed(C.ADVANCED_METRICS, _FRACTIONS)
    ),
    "team_season_stats": ddl(
        "season int, team_id string, rank int, " + _mixed(C.TEAM_SEASON_STATS[3:], C.PERCENTAGES, "int")
    ),
    "mvp_winners": ddl(
        "season int, league string, player_id string, team_id string, age int, games int, "
        + _mixed(C.MVP_WINNER_COLUMNS[6:], ["field_goal_pct", "three_point_pct", "free_throw_pct", "win_shares_per_48"])
    ),
    "mvp_candidates": ddl(
        "season int, player_id string, rank int, tie boolean, age int, team_id string, first_place_votes int, "
        "points_won int, points_max int, share decimal(5,3), games int, "
        + _mixed(C.MVP_CANDIDATE_COLUMNS[11:], ["fg_pct", "three_pct", "ft_pct", "ws_per_48"])
    ),
}

# Parents before children.
LOAD_ORDER = [
    "teams", "players", "seasons", "player_positions", "season_awards", "rosters", "player_season_stats",
    "player_advanced_stats", "team_season_stats", "mvp_winners", "mvp_candidates",
]

PRIMARY_KEYS = {
    "teams": ["team_id"],
    "players": ["player_id"],
    "seasons": ["season"],
    "player_positions": ["player_id", "slot"],
    "season_awards": ["season", "league"],
    "rosters": ["season", "team_id", "player_id"],
    "player_season_stats": ["season", "player_id", "stint"],
    "player_advanced_stats": ["season", "player_id", "stint"],
    "team_season_stats": ["season", "team_id"],
    "mvp_winners": ["season", "league"],
    "mvp_candidates": ["season", "player_id"],
}

_PARENTS = {"player_id": "players", "team_id": "teams", "season": "seasons"}
_CHILDREN = {
    "player_positions": ["player_id"],
    "player_season_stats": ["player_id", "team_id", "season"],
    "player_advanced_stats": ["player_id", "team_id", "season"],
    "rosters": ["player_id", "team_id", "season"],
    "mvp_winners": ["player_id", "team_id", "season"],
    "mvp_candidates": ["player_id", "team_id", "season"],
    "team_season_stats": ["team_id", "season"],
    "season_awards": ["season"],
}
FOREIGN_KEYS = [(child, [c], _PARENTS[c], [c]) for child, cols in _CHILDREN.items() for c in cols]
FOREIGN_KEYS.append(("season_awards", ["champion_team_id"], "teams", ["team_id"]))
FOREIGN_KEYS.append(
    ("player_advanced_stats", ["season", "player_id", "stint"], "player_season_stats", ["season", "player_id", "stint"])
)

# Vocabularies and the smallest healthy table sizes.
_CODES = list(POSITION_CODES.values())
_LEAGUES = ["NBA", "ABA", "BAA"]
DOMAINS = {
    "players": {"primary_position": _CODES, "shoots": ["right", "left", "both"]},
    "player_positions": {"position_code": _CODES},
    "player_season_stats": {"position": _CODES},
    "rosters": {"position_primary": _CODES, "position_secondary": _CODES},
    "season_awards": {"league": _LEAGUES},
    "mvp_winners": {"league": _LEAGUES},
}
ROW_FLOORS = {
    "mvp_candidates": 72, "mvp_winners": 59, "player_advanced_stats": 4271, "player_positions": 1396,
    "player_season_stats": 4271, "players": 1690, "rosters": 1592, "season_awards": 74, "seasons": 68,
    "team_season_stats": 1439, "teams": 63,
}

_IN_CODES = "in ('PG', 'SG', 'SF', 'PF', 'C', 'G', 'F')"
_IN_LEAGUES = "in ('NBA', 'ABA', 'BAA')"
_SHARES = [
    "offensive_rebound_percentage", "defensive_rebound_percentage", "total_rebound_percentage", "assist_percentage",
    "steal_percentage", "block_percentage", "usage_percentage", "turnover_percentage",
]
# A check is broken only where it is false; NULL passes.
CHECKS = {
    "players": {
        "primary_position": f"primary_position {_IN_CODES}",
        "shoots": "shoots in ('right', 'left', 'both')",
        "bio_flag": "has_bio or coalesce(primary_position, cast(height_cm as string), cast(weight_kg as string), "
        "cast(birth_date as string), cast(nba_debut_date as string), cast(draft_year as string)) is null",
    },
    "seasons": {"ending_year": "season = start_year + 1", "range": "season between 1947 and 2100"},
    "player_positions": {"slot": "slot >= 1", "code": f"position_code {_IN_CODES}"},
    "season_awards": {"league": f"league {_IN_LEAGUES}"},
    "rosters": {"experience": "experience_seasons >= 0", "height": "height_cm > 0"},
    "player_season_stats": {
        "tot_stint": "(stint = 0) = (team_id = 'tot')",
        "games": "games_played >= 1 and games_started between 0 and games_played and minutes_played >= 0",
        "shooting": "field_goals_made <= field_goals_attempted and three_pointers_made <= three_pointers_attempted "
        "and two_pointers_made <= two_pointers_attempted and free_throws_made <= free_throws_attempted",
    },
    "player_advanced_stats": {
        "tot_stint": "(stint = 0) = (team_id = 'tot')",
        "percentages": " and ".join(f"{c} between 0 and 100" for c in _SHARES),
    },
    "team_season_stats": {
        "rank": "rank >= 1",
        "games": "games >= 0",
        "shooting": "field_goals_made <= field_goals_attempted and free_throws_made <= free_throws_attempted",
    },
    "mvp_winners": {"league": f"league {_IN_LEAGUES}", "games": "games >= 0 and age >= 0"},
    "mvp_candidates": {
        "rank": "rank >= 1",
        "votes": "first_place_votes >= 0 and points_won between 0 and points_max and share between 0 and 1",
    },
}

_BOX = [c for c in C.PLAYER_SEASON_STATS if c not in C.PERCENTAGES]
NOT_NULL = {
    "teams": ["team_id", "team_name", "is_aggregate", "has_detail"],
    "players": ["player_id", "has_bio"],
    "seasons": ["season", "season_label", "start_year", "has_awards"],
    "player_positions": ["player_id", "slot", "position", "position_code"],
    "season_awards": ["season", "league", "champion_team_id"],
    "rosters": ["season", "team_id", "player_id", "player_name", "position", "position_primary", "height_cm",
                "birth_country", "experience_seasons"],
    "player_season_stats": _BOX,
    "player_advanced_stats": ["season", "player_id", "stint", "is_primary", "team_id"]
    + [c for c in C.ADVANCED_METRICS if c not in (*_FRACTIONS[:3], "turnover_percentage")],
    "team_season_stats": ["season", "team_id", "rank"],
    "mvp_winners": [c for c in C.MVP_WINNER_COLUMNS if c not in ("steals_per_game", "blocks_per_game", "three_point_pct")],
    "mvp_candidates": [c for c in C.MVP_CANDIDATE_COLUMNS if c not in ("team_id", "three_pct")],
}
WIDTHS = {
    "teams": {"team_id": 4},
    "players": {"player_id": 12, "primary_position": 2, "shoots": 8},
    "seasons": {"season_label": 8},
    "player_positions": {"player_id": 12, "position": 16, "position_code": 2},
    "season_awards": {"league": 4, "champion_team_id": 4},
    "rosters": {"team_id": 4, "player_id": 12, "roster_note": 8, "position": 4, "position_primary": 2,
                "position_secondary": 2, "birth_country": 2},
    "player_season_stats": {"player_id": 12, "team_id": 4, "position": 2},
    "player_advanced_stats": {"player_id": 12, "team_id": 4},
    "team_season_stats": {"team_id": 4},
    "mvp_winners": {"league": 4, "player_id": 12, "team_id": 4},
    "mvp_candidates": {"player_id": 12, "team_id": 4},
}
