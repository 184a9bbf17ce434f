"""Declared schemas of the tables the plans read and write."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def schema(fields: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no running session."""
    pairs = (f.split() for f in fields.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# fixed values: the 35 columns of the action-tree play-by-play table
ACTIONS = schema(
    "quarter int, parameters_team int, parameters_player int, parameters_type string, "
    "parameters_quarter int, parameters_player_in int, parameters_player_out int, "
    "parameters_current_quarter int, parameters_current_quarter_time string, "
    "parameters_coord_x int, parameters_coord_y int, parameters_points int, "
    "parameters_fast_break boolean, parameters_second_chance_points boolean, "
    "parameters_points_from_turnover boolean, parameters_made string, parameters_kind string, "
    "parameters_fouled_on int, parameters_free_throws int, parameters_free_throws_awarded int, "
    "parameters_free_throw_number int, id bigint, parent_action_id bigint, user_time timestamp, "
    "quarter_time string, type string, player_id int, team_id int, score string, "
    "total_player_points int, game_id int, end_quarter_seconds_remaining int, "
    "end_game_seconds_remaining int, parameters_is_coach_foul boolean, "
    "parameters_is_bench_foul boolean"
)
RAW_PBP = schema(
    "game_id string, seq bigint, time string, visit_team string, change_visit string, "
    "score string, change_home string, home_team string"
)
GAMES = schema(
    "game_id string, visitor_team_name string, home_team_name string, visitor_pts int, home_pts int"
)
ROSTERS = schema(
    "player_id int, game_id int, team_id int, first_name string, last_name string, team_name string"
)
LINEUPS = schema(
    "id bigint, game_id int, player_id int, team_id int, quarter int, quarter_time string, "
    "end_game_seconds_remaining int, end_quarter_seconds_remaining int, is_on_verdict boolean, "
    "lineup_id string, n_on bigint, lineup_hash string"
)
STINTS = schema(
    "team_id int, game_id int, final_start_seg int, final_end_seg int, segment_id int, "
    "lineup_hash_offense string, lineup_hash_defense string, team_id_defense int, q_bucket int, "
    "final_start_id bigint, final_end_id bigint"
)
RATINGS = schema("TEAM string, OffRtg double")
