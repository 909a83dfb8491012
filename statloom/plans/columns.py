"""Column names of the raw tables, the cleaned tables and the page cells.

They have to match the data being read and the tables being produced, so they are listed
as they are.
"""

from __future__ import annotations

from typing import NamedTuple

# Raw header (lower case) -> cleaned column.
PLAYER_STATS = {
    "year": "season", "rank": "rank", "player_id": "player_id", "age": "age", "team": "team_id",
    "position": "position", "games": "games_played", "games started": "games_started",
    "minutes played": "minutes_played", "fg": "field_goals_made", "fga": "field_goals_attempted",
    "fg%": "field_goal_pct", "3p": "three_pointers_made", "3pa": "three_pointers_attempted",
    "3p%": "three_point_pct", "2p": "two_pointers_made", "2pa": "two_pointers_attempted",
    "2p%": "two_point_pct", "efg%": "effective_fg_pct", "ft": "free_throws_made",
    "fta": "free_throws_attempted", "ft%": "free_throw_pct", "orb": "offensive_rebounds",
    "drb": "defensive_rebounds", "trb": "total_rebounds", "ast": "assists", "stl": "steals",
    "blk": "blocks", "tov": "turnovers", "pf": "personal_fouls", "pts": "points",
    "trp_dbl": "triple_doubles",
}
PLAYER_SEASON_STATS = [
    "season", "player_id", "stint", "is_primary", "team_id", "rank", "age", "position",
    "games_played", "games_started", "minutes_played", "field_goals_made",
    "field_goals_attempted", "field_goal_pct", "three_pointers_made",
    "three_pointers_attempted", "three_point_pct", "two_pointers_made",
    "two_pointers_attempted", "two_point_pct", "effective_fg_pct", "free_throws_made",
    "free_throws_attempted", "free_throw_pct", "offensive_rebounds", "defensive_rebounds",
    "total_rebounds", "assists", "steals", "blocks", "turnovers", "personal_fouls", "points",
    "triple_doubles",
]
PERCENTAGES = [
    "field_goal_pct", "three_point_pct", "two_point_pct", "effective_fg_pct", "free_throw_pct",
]
ADVANCED_METRICS = [
    "player_efficiency_rate", "true_shooting_percentage", "three_point_attempt_rate",
    "free_throw_attempt_rate", "offensive_rebound_percentage", "defensive_rebound_percentage",
    "total_rebound_percentage", "assist_percentage", "steal_percentage", "block_percentage",
    "turnover_percentage", "usage_percentage", "offensive_win_shares", "defensive_win_shares",
    "win_shares", "win_shares_per_48_minutes", "offensive_box_plus_minus",
    "defensive_box_plus_minus", "box_plus_minus", "value_over_replacement_player",
]
ROSTERS = {
    "teamname": "team_name", "season": "season", "playername": "player_name",
    "player_id": "player_id", "team_id": "team_id", "pos": "position", "ht": "height",
    "wt": "weight", "birth date": "birth_date", "birth": "birth_country",
    "exp": "experience_seasons", "college": "college",
}
ROSTER_COLUMNS = [
    "season", "team_id", "player_id", "player_name", "roster_note", "position",
    "position_primary", "position_secondary", "height_cm", "weight_kg", "birth_date",
    "birth_country", "experience_seasons", "college",
]
MVP_WINNERS = {
    "season": "season", "league": "league", "player_id": "player_id", "age": "age",
    "team_id": "team_id", "game": "games", "minutes played per game": "minutes_per_game",
    "points per game": "points_per_game", "total rebounds per game": "rebounds_per_game",
    "assists per game": "assists_per_game", "steals per game": "steals_per_game",
    "blocks per game": "blocks_per_game", "field goal percentage": "field_goal_pct",
    "3-point field goal percentage": "three_point_pct", "free throw percentage": "free_throw_pct",
    "win shares": "win_shares", "win shares per 48 minutes": "win_shares_per_48",
}
MVP_WINNER_COLUMNS = [
    "season", "league", "player_id", "team_id", "age", "games", "minutes_per_game",
    "points_per_game", "rebounds_per_game", "assists_per_game", "steals_per_game",
    "blocks_per_game", "field_goal_pct", "three_point_pct", "free_throw_pct", "win_shares",
    "win_shares_per_48",
]
MVP_CANDIDATES = {
    "year": "season", "player_id": "player_id", "first_place_vote": "first_place_votes",
    "pts won": "points_won", "pts max": "points_max", "fg%": "fg_pct", "3p%": "three_pct",
    "ft%": "ft_pct", "ws/48": "ws_per_48", "team": "team_id",
}
MVP_CANDIDATE_COLUMNS = [
    "season", "player_id", "rank", "tie", "age", "team_id", "first_place_votes", "points_won",
    "points_max", "share", "games", "mp", "pts", "trb", "ast", "stl", "blk", "fg_pct",
    "three_pct", "ft_pct", "ws", "ws_per_48",
]
TEAM_TOTALS = {
    "rk": "rank", "season": "season", "teamname": "team_name", "teamid": "team_id", "g": "games",
    "mp": "minutes_played", "fg": "field_goals_made", "fga": "field_goals_attempted",
    "fg%": "field_goal_pct", "3p": "three_pointers_made", "3pa": "three_pointers_attempted",
    "3p%": "three_point_pct", "2p": "two_pointers_made", "2pa": "two_pointers_attempted",
    "2p%": "two_point_pct", "ft": "free_throws_made", "fta": "free_throws_attempted",
    "ft%": "free_throw_pct", "orb": "offensive_rebounds", "drb": "defensive_rebounds",
    "trb": "total_rebounds", "ast": "assists", "stl": "steals", "blk": "blocks",
    "tov": "turnovers", "pf": "personal_fouls", "pts": "points",
}
TEAM_SEASON_STATS = [
    "season", "team_id", "rank", "games", "minutes_played", "field_goals_made",
    "field_goals_attempted", "field_goal_pct", "three_pointers_made",
    "three_pointers_attempted", "three_point_pct", "two_pointers_made",
    "two_pointers_attempted", "two_point_pct", "free_throws_made", "free_throws_attempted",
    "free_throw_pct", "offensive_rebounds", "defensive_rebounds", "total_rebounds", "assists",
    "steals", "blocks", "turnovers", "personal_fouls", "points",
]
SEASON_SUMMARIES = {
    "season year": "season", "league": "league", "champion name": "champion_name", "mvp": "mvp",
    "rookie of the year": "rookie_of_the_year", "most points": "most_points",
    "most rebounds": "most_rebounds", "most assists": "most_assists",
    "most winshares": "most_winshares",
}
SEASON_AWARDS = [
    "season", "league", "champion_team_id", "rookie_of_the_year", "most_points",
    "most_rebounds", "most_assists", "most_winshares",
]
CAREER = {
    "career games": "career_games", "career points": "career_points",
    "career total rebound percentage": "career_total_rebound_pct",
    "career assists percentage": "career_assists_pct",
    "career field goal percentage": "career_field_goal_pct",
    "career 3pt field goal percentage": "career_three_point_pct",
    "career free throw percentage": "career_free_throw_pct",
    "career effective field goal percentage": "career_effective_fg_pct",
    "career player efficiency rating": "career_per", "career win shares": "career_win_shares",
}
PLAYER_COLUMNS = [
    "player_id", "player_name", "has_bio", "primary_position", "shoots", "height_cm",
    "weight_kg", "birth_year", "birth_month", "birth_day", "birth_date", "college",
    "experience_seasons", "nba_debut_date", "nba_debut_year", "draft_year", "draft_team_name",
    "draft_round", "draft_round_pick", "draft_overall_pick", *CAREER.values(),
]

# Page cell (data-stat name) -> raw column, one mapping per page type.
PAGE_PLAYER_STATS = {
    "ranker": "Rank", "age": "Age", "team_name_abbr": "Team", "pos": "Position",
    "games": "Games", "games_started": "Games Started", "mp": "Minutes Played", "fg": "FG",
    "fga": "FGA", "fg_pct": "FG%", "fg3": "3P", "fg3a": "3PA", "fg3_pct": "3p%", "fg2": "2P",
    "fg2a": "2PA", "fg2_pct": "2P%", "efg_pct": "eFG%", "ft": "FT", "fta": "FTA",
    "ft_pct": "FT%", "orb": "ORB", "drb": "DRB", "trb": "TRB", "ast": "AST", "stl": "STL",
    "blk": "BLK", "tov": "TOV", "pf": "PF", "pts": "PTS", "tpl_dbl": "Trp_Dbl",
}
PAGE_ADVANCED = {
    "ranker": "Rank", "age": "Age", "team_name_abbr": "Team", "pos": "Position",
    "games": "Games", "games_started": "Games_started", "mp": "Minute_Played",
    "per": "Player_Efficiency_Rate", "ts_pct": "True_Shooting_Percentage",
    "fg3a_per_fga_pct": "Three_Point_Attempt_Rate",
    "fta_per_fga_pct": "Free_Throw_Attempt_Rate", "orb_pct": "Offensive_Rebound_Percentage",
    "drb_pct": "Defensive_Rebound_Percentage", "trb_pct": "Total_Rebound_Percentage",
    "ast_pct": "Assist_Percentage", "stl_pct": "Steal_Percentage", "blk_pct": "Block_Percentage",
    "tov_pct": "Turnover_Percentage", "usg_pct": "Usage_Percentage",
    "ows": "Offensive_Win_Shares", "dws": "Defensive_Win_Shares", "ws": "Win_Shares",
    "ws_per_48": "Win_Shares_Per_48_Minutes", "obpm": "Offensive_Box_Plus_Minus",
    "dbpm": "Defensive_Box_Plus_Minus", "bpm": "Box_Plus_Minus",
    "vorp": "Value_over_Replacement_Player",
}
PAGE_MVP_CANDIDATES = {
    "rank": "Rank", "age": "Age", "team_id": "Team", "votes_first": "First_Place_Vote",
    "points_won": "Pts Won", "points_max": "pts Max", "award_share": "Share", "g": "Games",
    "mp_per_g": "MP", "pts_per_g": "PTS", "trb_per_g": "TRB", "ast_per_g": "AST",
    "stl_per_g": "STL", "blk_per_g": "BLK", "fg_pct": "FG%", "fg3_pct": "3P%", "ft_pct": "FT%",
    "ws": "WS", "ws_per_48": "WS/48",
}
PAGE_MVP_WINNERS = {
    "season": "Season", "lg_id": "League", "age": "Age", "team_id": "Team_id", "g": "Game",
    "mp_per_g": "Minutes Played Per Game", "pts_per_g": "Points Per Game",
    "trb_per_g": "Total Rebounds Per Game", "ast_per_g": "Assists Per Game",
    "stl_per_g": "Steals Per Game", "blk_per_g": "Blocks Per Game",
    "fg_pct": "Field Goal Percentage", "fg3_pct": "3-Point Field Goal Percentage",
    "ft_pct": "Free Throw Percentage", "ws": "Win Shares",
    "ws_per_48": "Win Shares Per 48 Minutes",
}
PAGE_SEASONS = {
    "season": "Season Year", "lg_id": "League", "champion": "Champion Name", "mvp": "MVP",
    "roy": "Rookie of the Year", "pts_leader_name": "Most Points",
    "trb_leader_name": "Most Rebounds", "ast_leader_name": "Most Assists",
    "ws_leader_name": "Most Winshares",
}
PAGE_ROSTER = {
    "player": "PlayerName", "pos": "Pos", "height": "Ht", "weight": "Wt",
    "birth_date": "Birth Date", "flag": "Birth", "years_experience": "Exp",
    "college": "College",
}
PAGE_TEAM_TOTALS = {
    "ranker": "Rk", "team": "TeamName", "g": "G", "mp": "MP", "fg": "FG", "fga": "FGA",
    "fg_pct": "FG%", "fg3": "3P", "fg3a": "3PA", "fg3_pct": "3P%", "fg2": "2P", "fg2a": "2PA",
    "fg2_pct": "2P%", "ft": "FT", "fta": "FTA", "ft_pct": "FT%", "orb": "ORB", "drb": "DRB",
    "trb": "TRB", "ast": "AST", "stl": "STL", "blk": "BLK", "tov": "TOV", "pf": "PF",
    "pts": "PTS",
}
PAGE_CAREER = {
    "G": "Career Games", "PTS": "Career Points", "TRB": "Career Total Rebound Percentage",
    "AST": "Career Assists Percentage", "FG%": "Career Field Goal Percentage",
    "FG3%": "Career 3pt Field Goal Percentage", "FT%": "Career Free Throw Percentage",
    "eFG%": "Career Effective Field Goal Percentage", "PER": "Career Player Efficiency Rating",
    "WS": "Career Win Shares",
}


class PageType(NamedTuple):
    """What a type of page holds: a table by id, or a box of labels under a heading."""

    table: str | None
    columns: dict[str, str]
    ids: dict[str, tuple[str, int]] = {}  # column: (cell whose address has the id, path part from the end)
    needs: str | None = None  # rows without this column are left out
    headings: tuple[str, ...] = ()


# The tables' ids on their pages.
PAGE_TYPES = {
    "player_stats": PageType("totals_stats", PAGE_PLAYER_STATS, {"Player_Id": ("name_display", -1)}),
    "advanced_stats": PageType("advanced", PAGE_ADVANCED, {"Player_id": ("name_display", -1)}),
    "mvp_candidates": PageType("mvp", PAGE_MVP_CANDIDATES, {"Player_Id": ("player", -1)}),
    "mvp_winners": PageType("mvp_NBA", PAGE_MVP_WINNERS, {"Player_id": ("player", -1)}),
    "season_summaries": PageType("stats", PAGE_SEASONS, needs="Champion Name"),
    "team_season_rosters": PageType("roster", PAGE_ROSTER, {"Player_id": ("player", -1)}),
    "team_season_totals": PageType("totals-team", PAGE_TEAM_TOTALS, {"TeamId": ("team", -2)}),
    "team_seasons": PageType(None, {}, headings=("season", "team_full_name")),
    "teams": PageType(None, {"seasons": "seasons"}, headings=("team_full_name",)),
}
CHALLENGE_MARKERS = [
    "Just a moment", "challenge-platform", "Enable JavaScript and cookies to continue",
]
