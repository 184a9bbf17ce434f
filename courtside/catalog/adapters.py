"""The driver's tables read as event logs, rosters, games and shots.

Each adapter has a Spark form and an oracle CTE of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import bucket_of, ordered_pass, running
from .registry import cte

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the integer in ``props`` and the second of the day."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        "int(regexp_extract(props, '([0-9]+)', 1)) AS k",
        "hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sod",
        "datediff(ts, DATE'2023-12-31') AS game_id",
    )


cte("ev", """
SELECT event_id, ts, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS sod,
  CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS INTEGER) AS game_id
FROM events""")


# event types that are substitutions, so that the filter reaches the scan
SUB_EVENTS = ("signup", "error")

ACTION_TYPE = """CASE WHEN event_type = 'purchase' THEN 'shot'
  WHEN event_type = 'view' THEN if(k >= 95, 'foul', 'rebound')
  WHEN event_type IN ('signup', 'error') THEN 'substitution'
  WHEN k < 50 THEN 'shot' WHEN k < 70 THEN 'freeThrow' WHEN k < 85 THEN 'turnover'
  WHEN k < 98 THEN 'block' ELSE 'quarter' END"""
ACTION_COLUMNS = (
    "game_id",
    "event_id AS id",
    "if(event_id % 4 = 0, 0, event_id - event_id % 4) AS parent_action_id",
    "ts AS user_time",
    "int(sod div 21600 + 1) AS quarter",
    "concat(_left div 60, ':', lpad(_left % 60, 2, '0')) AS quarter_time",
    "_left AS end_quarter_seconds_remaining",
    "86400 - sod AS end_game_seconds_remaining",
    "type",
    "if(type <> 'quarter', int(user_id % 2 + 1), 0) AS team_id",
    "if(type <> 'quarter', int(user_id % 20), NULL) AS player_id",
    """CASE type WHEN 'foul' THEN 'technical' WHEN 'quarter' THEN 'end-of-quarter'
      WHEN 'rebound' THEN if(k % 4 = 0, 'offensive', 'defensive')
      WHEN 'shot' THEN if(k % 5 = 0, '3-pt', '2-pt') END AS parameters_type""",
    """CASE type WHEN 'shot' THEN CASE WHEN k % 2 = 0 THEN 'made' WHEN k % 10 = 9 THEN 'blocked' ELSE 'missed' END
      WHEN 'freeThrow' THEN if(k % 3 <> 0, 'made', 'missed') END AS parameters_made""",
    "if(type = 'shot', if(k % 5 = 0, 3, 2), NULL) AS parameters_points",
    "if(type = 'freeThrow', k % 2 + 1, NULL) AS parameters_free_throw_number",
    "if(type = 'freeThrow', 2, NULL) AS parameters_free_throws_awarded",
    "if(event_type = 'signup', int(user_id % 20), NULL) AS parameters_player_in",
    "if(event_type = 'error', int(user_id % 20), NULL) AS parameters_player_out",
)


def actions(
    spark: SparkSession, sf_dir: str, source: bool = False, only: tuple[str, ...] = ()
) -> DataFrame:
    """Action-tree play-by-play: one game per day, four quarters of six hours.

    ``source`` keeps the columns of the event a row was made from; ``only``
    reads just the events of some types.
    """
    rows = events(spark, sf_dir)
    if only:
        rows = rows.where(F.col("event_type").isin(*only))
    typed = rows.selectExpr("*", f"{ACTION_TYPE} AS type", "21600 - sod % 21600 AS _left")
    return typed.selectExpr(
        *ACTION_COLUMNS, *(["event_id", "user_id", "k", "sod"] if source else [])
    )


cte("typed", """
SELECT *, CASE WHEN event_type = 'purchase' THEN 'shot'
  WHEN event_type = 'view' AND k >= 95 THEN 'foul' WHEN event_type = 'view' THEN 'rebound'
  WHEN event_type IN ('signup', 'error') THEN 'substitution'
  WHEN k < 50 THEN 'shot' WHEN k < 70 THEN 'freeThrow' WHEN k < 85 THEN 'turnover'
  WHEN k < 98 THEN 'block' ELSE 'quarter' END AS type
FROM {ev}""")
cte("actions", """
SELECT game_id, event_id AS id,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id - event_id % 4 END AS parent_action_id,
  ts AS user_time, CAST(sod // 21600 + 1 AS INTEGER) AS quarter,
  CAST((21600 - sod % 21600) // 60 AS VARCHAR) || ':'
    || lpad(CAST((21600 - sod % 21600) % 60 AS VARCHAR), 2, '0') AS quarter_time,
  21600 - sod % 21600 AS end_quarter_seconds_remaining,
  86400 - sod AS end_game_seconds_remaining, type,
  CAST(CASE WHEN type <> 'quarter' THEN user_id % 2 + 1 ELSE 0 END AS INTEGER) AS team_id,
  CAST(CASE WHEN type <> 'quarter' THEN user_id % 20 END AS INTEGER) AS player_id,
  CASE WHEN type = 'foul' THEN 'technical' WHEN type = 'rebound' AND k % 4 = 0 THEN 'offensive'
    WHEN type = 'rebound' THEN 'defensive' WHEN type = 'quarter' THEN 'end-of-quarter'
    WHEN type = 'shot' AND k % 5 = 0 THEN '3-pt' WHEN type = 'shot' THEN '2-pt' END AS parameters_type,
  CASE WHEN type = 'shot' AND k % 2 = 0 THEN 'made' WHEN type = 'shot' AND k % 10 = 9 THEN 'blocked'
    WHEN type = 'shot' THEN 'missed' WHEN type = 'freeThrow' AND k % 3 <> 0 THEN 'made'
    WHEN type = 'freeThrow' THEN 'missed' END AS parameters_made,
  CASE WHEN type = 'shot' AND k % 5 = 0 THEN 3 WHEN type = 'shot' THEN 2 END AS parameters_points,
  CASE WHEN type = 'freeThrow' THEN k % 2 + 1 END AS parameters_free_throw_number,
  CASE WHEN type = 'freeThrow' THEN 2 END AS parameters_free_throws_awarded,
  CAST(CASE WHEN event_type = 'signup' THEN user_id % 20 END AS INTEGER) AS parameters_player_in,
  CAST(CASE WHEN event_type = 'error' THEN user_id % 20 END AS INTEGER) AS parameters_player_out
FROM {typed}""")


def rosters(acts: DataFrame) -> DataFrame:
    """(player, game, team) with names; distinct by partial aggregation."""
    return (
        acts.where(F.col("team_id") != 0)
        .select("player_id", "game_id", "team_id")
        .distinct()
        .selectExpr(
            "*", "concat('F', player_id % 7) AS first_name", "concat('L', player_id) AS last_name",
            "concat('Team ', team_id) AS team_name",
        )
    )


cte("rosters", """
SELECT DISTINCT player_id, game_id, team_id, 'F' || CAST(player_id % 7 AS VARCHAR) AS first_name,
  'L' || CAST(player_id AS VARCHAR) AS last_name, 'Team ' || CAST(team_id AS VARCHAR) AS team_name
FROM {actions} WHERE team_id <> 0""")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.date_diff("ts", F.lit("2023-12-31").cast("date")).alias("game_id"), F.to_date("ts").alias("game_date")
    ).distinct()


cte("schedule", "SELECT DISTINCT game_id, CAST(ts AS DATE) AS game_date FROM {ev}")


POINTS = """CASE WHEN parameters_made = 'made' AND type = 'freeThrow' THEN 1
  WHEN parameters_made = 'made' THEN parameters_points ELSE 0 END"""
EVENT_TEXT = """CASE
  WHEN type IN ('shot', 'freeThrow') THEN concat('P', user_id % 20,
    if(parameters_made = 'made', ' makes ', ' misses '), if(type = 'shot',
      concat(parameters_type, ' shot from ', k % 28 + 1, ' ft'), concat('free throw ', k % 2 + 1, ' of 2')))
  WHEN type = 'rebound' THEN concat(initcap(parameters_type), ' rebound by P', user_id % 20)
  WHEN type = 'turnover' THEN concat('Turnover by P', user_id % 20)
  ELSE concat(type, ' P', user_id % 20) END"""


def raw_pbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text play-by-play of the same events: "MM:SS" clock of a 48-minute game,
    one text cell per side, running score (absent on substitutions)."""
    told = actions(spark, sf_dir, source=True).selectExpr(
        "game_id", "event_id AS seq", "type", "user_id % 2 = 0 AS _visit", f"{POINTS} AS _pts",
        "if((sod div 30) % 720 < 12, 720, 720 - (sod div 30) % 720) AS _clock",
        f"{EVENT_TEXT} AS _event",
    )
    scored = ordered_pass(
        told, ["game_id"], ["seq"], bucket_of("seq"),
        {
            "_visit_run": running(F.expr("if(_visit, _pts, 0)")),
            "_home_run": running(F.expr("if(_visit, 0, _pts)")),
        },
    )
    return scored.selectExpr(
        "game_id", "seq",
        "concat(lpad(_clock div 60, 2, '0'), ':', lpad(_clock % 60, 2, '0')) AS time",
        "if(_visit, _event, '') AS visit_team",
        "if(type <> 'substitution', concat(_visit_run, '-', _home_run), NULL) AS score",
        "if(_visit, '', _event) AS home_team",
    )


cte("raw_pts", """
SELECT t.*, a.parameters_type, a.parameters_made,
  CASE WHEN a.parameters_made = 'made' AND t.type = 'freeThrow' THEN 1
    WHEN a.parameters_made = 'made' THEN a.parameters_points ELSE 0 END AS pts,
  t.user_id % 2 = 0 AS visit,
  CASE WHEN (t.sod // 30) % 720 < 12 THEN 720 ELSE 720 - (t.sod // 30) % 720 END AS clk
FROM {typed} t JOIN {actions} a ON a.id = t.event_id""")
cte("raw_pbp", """
SELECT game_id, event_id AS seq,
  lpad(CAST(clk // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(clk % 60 AS VARCHAR), 2, '0') AS time,
  CASE WHEN visit THEN txt ELSE '' END AS visit_team,
  CASE WHEN type <> 'substitution' THEN CAST(vr AS VARCHAR) || '-' || CAST(hr AS VARCHAR) END AS score,
  CASE WHEN visit THEN '' ELSE txt END AS home_team
FROM (
  SELECT *, 'P' || CAST(user_id % 20 AS VARCHAR) AS who,
    CASE WHEN parameters_made = 'made' THEN 'makes' ELSE 'misses' END AS verb,
    CASE WHEN type = 'shot' THEN who || ' ' || verb || ' ' || parameters_type || ' shot from '
           || CAST(k % 28 + 1 AS VARCHAR) || ' ft'
      WHEN type = 'freeThrow' THEN who || ' ' || verb || ' free throw ' || CAST(k % 2 + 1 AS VARCHAR) || ' of 2'
      WHEN type = 'rebound' AND parameters_type = 'offensive' THEN 'Offensive rebound by ' || who
      WHEN type = 'rebound' THEN 'Defensive rebound by ' || who
      WHEN type = 'turnover' THEN 'Turnover by ' || who ELSE type || ' ' || who END AS txt,
    sum(CASE WHEN visit THEN pts ELSE 0 END) OVER (PARTITION BY game_id ORDER BY event_id) AS vr,
    sum(CASE WHEN visit THEN 0 ELSE pts END) OVER (PARTITION BY game_id ORDER BY event_id) AS hr
  FROM {raw_pts})""")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final score and team names per game."""
    scored = actions(spark, sf_dir, source=True).selectExpr(
        "game_id", "user_id % 2 = 0 AS _visit", f"{POINTS} AS _pts"
    )
    return scored.groupBy("game_id").agg(
        F.expr("sum(if(_visit, _pts, 0))").alias("visitor_pts"),
        F.expr("sum(if(_visit, 0, _pts))").alias("home_pts"),
    ).selectExpr(
        "*", "concat('V', game_id % 5) AS visitor_team_name", "concat('H', game_id % 7) AS home_team_name"
    )


cte("games", """
SELECT game_id, sum(CASE WHEN visit THEN pts ELSE 0 END) AS visitor_pts,
  sum(CASE WHEN visit THEN 0 ELSE pts END) AS home_pts,
  'V' || CAST(game_id % 5 AS VARCHAR) AS visitor_team_name,
  'H' || CAST(game_id % 7 AS VARCHAR) AS home_team_name
FROM {raw_pts} GROUP BY game_id""")
