"""Declared schemas of the tables that the operators read."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(), "array<double>": T.ArrayType(T.DoubleType()),
}


def table_schema(spec: str) -> T.StructType:
    """Columns as "name type", joined by commas; needs no session."""
    pairs = [field.strip().rsplit(" ", 1) for field in spec.split(",")]
    return T.StructType([T.StructField(name.strip("`"), _KINDS[kind]) for name, kind in pairs])


ROSTER = table_schema("row int, game_id bigint, team_id bigint, player_id bigint, player_name string, is_starter boolean, minutes_played int, jersey_number int, starting_position string")
MATCH = table_schema(
    "match_id bigint, match_date date, kick_off string, competition string, season string, home_team string, away_team string, home_score int, away_score int, "
    "match_status string, match_status_360 string, last_updated timestamp_ntz, last_updated_360 timestamp_ntz, match_week int, competition_stage string, stadium string, "
    "referee string, home_managers string, away_managers string, data_version string, shot_fidelity_version int, xy_fidelity_version int"
)
COMPETITION = table_schema(
    "competition_id bigint, season_id bigint, country_name string, competition_name string, competition_gender string, competition_youth boolean, competition_international boolean, "
    "season_name string, match_updated timestamp_ntz, match_updated_360 timestamp_ntz, match_available_360 timestamp_ntz, match_available timestamp_ntz"
)
TEAM_GAME_STAT = table_schema(
    "league string, season string, team string, game string, date date, time string, round string, day string, venue string, result string, GF int, GA int, opponent string, "
    "xG double, xGA double, Poss int, Attendance int, Captain string, Formation string, `Opp Formation` string, Referee string, match_report string, Notes string"
)
MATCH_EVENT = table_schema(
    "game_id bigint, team string, player string, player_id bigint, minute int, second int, type string, outcome_type string, x double, y double, end_x double, end_y double, "
    "is_shot boolean, is_goal boolean, blocked_x double, blocked_y double, goal_mouth_y double, goal_mouth_z double"
)
SCHEDULE = table_schema("game_id bigint, home_team string, away_team string")
WIDE_EVENT = table_schema(
    "seq bigint, period int, minute int, timestamp string, team string, player string, type string, location array<double>, pass_recipient string, shot_outcome string, shot_statsbomb_xg double"
)
PARSED_EVENT = table_schema(
    "seq bigint, id string, team_name string, type_name string, tactics_id string, tactics_formation string, player_id bigint, pass_recipient_id bigint, "
    "substitution_replacement_id bigint, substitution_replacement_name string, x double, y double"
)
PLAYER_SEASON_STAT = table_schema("league string, season string, team string, player string, nation string, pos string, age string, born int, `90s` double")
LINEUP = table_schema("id string, player_id bigint, position_id int")
TEAM_MATCH_STAT = table_schema(
    "league string, season string, game string, team string, `Ball possession` double, `Accurate passes` double, `Accurate passes (%)` double, `Total shots` double, `Shots on target` double, "
    "`Expected goals (xG)` double, `Big chances` double, `Big chances missed` double, Corners double, `Fouls committed` double"
)
