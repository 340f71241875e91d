"""Declared schemas of the inputs and of a published snapshot."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}


def _struct(columns: str) -> T.StructType:
    """Schema of ``name TYPE`` pairs; unlike a DDL text it can be built before there is a session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[type_name]) for name, type_name in pairs])


ENTITY = _struct(
    """
    id BIGINT, code BIGINT, first_name STRING, second_name STRING, web_name STRING,
    team BIGINT, element_type BIGINT, minutes BIGINT, goals_scored BIGINT, assists BIGINT, bonus BIGINT, starts BIGINT,
    yellow_cards BIGINT, red_cards BIGINT, clean_sheets BIGINT, total_points BIGINT, influence_rank BIGINT,
    threat_rank BIGINT, now_cost BIGINT, form STRING, points_per_game STRING, influence STRING, creativity STRING,
    threat STRING, ict_index STRING, expected_goals STRING, expected_assists STRING, expected_goal_involvements STRING,
    selected_by_percent STRING, transfers_in_event BIGINT, transfers_out_event BIGINT, saves_per_90 DOUBLE,
    clean_sheets_per_90 DOUBLE, goals_conceded_per_90 DOUBLE, chance_of_playing_next_round DOUBLE,
    chance_of_playing_this_round DOUBLE
    """
)
TEAM = _struct("id BIGINT, name STRING, strength BIGINT")
PERIOD = _struct("id BIGINT, name STRING, is_current BOOLEAN, is_next BOOLEAN, finished BOOLEAN")
FIXTURE = _struct("id BIGINT, event BIGINT, team_h BIGINT, team_a BIGINT, finished BOOLEAN")

ENVELOPE = T.StructType(
    [
        T.StructField("elements", T.ArrayType(ENTITY)),
        T.StructField("teams", T.ArrayType(TEAM)),
        T.StructField("events", T.ArrayType(PERIOD)),
    ]
)

PREDICTIONS = _struct(
    """
    name STRING, team STRING, position STRING, next_opponent STRING, fixture STRING, predicted_points DOUBLE,
    now_cost DOUBLE, points_per_game DOUBLE, form DOUBLE, expected_goals DOUBLE, minutes BIGINT, assists BIGINT,
    goals_scored BIGINT, yellow_cards BIGINT, red_cards BIGINT, saves_per_90 DOUBLE, total_points BIGINT,
    clean_sheets BIGINT, opponent_difficulty BIGINT, is_home BOOLEAN, chance_of_playing_this_round DOUBLE,
    player_code BIGINT, web_name STRING, display_name STRING, image_url_primary STRING, image_url_secondary STRING,
    image_url_tertiary STRING
    """
)

#: What an export may hold: the snapshot and, after it, the key that makes its order total.
EXPORTED = T.StructType([*PREDICTIONS.fields, T.StructField("id", T.LongType())])

RESPONSE = T.StructType(
    [
        T.StructField("gameweek", T.IntegerType()),
        T.StructField("csv_file", T.StringType()),
        T.StructField("total_players", T.LongType()),
        T.StructField("filtered_players", T.LongType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("players", T.ArrayType(PREDICTIONS)),
    ]
)
