"""Queries on the action-tree log: possessions, lineups, stints, on/off."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import lineups as L
from ..plans import onoff as O
from ..plans import pbp as B
from ..plans import possessions as P
from ..session import checkpoint_root, stage
from ..sources.tables import read_sheet, write_csv
from .adapters import SUB_EVENTS, actions, rosters, schedule
from .registry import ORACLES, cte, query

SIDED_KEEP = ["id", "game_id", "quarter", "type", "team_score", "final_end_poss", "segment_id"]
WANTED_TEAMS = ["Team 1"]
DATES = ("2024-01-03", "2024-01-27")
ONE_PLAYER = 7

# ---- possessions -----------------------------------------------------------

cte("prepared", """
SELECT * REPLACE (CASE WHEN parent_action_id = 0 THEN id ELSE parent_action_id END AS parent_action_id,
    CASE WHEN parameters_made = 'made' AND type = 'freeThrow' THEN 1 ELSE parameters_points END AS parameters_points),
  parameters_free_throw_number::DOUBLE / parameters_free_throws_awarded AS pct_ft,
  CASE WHEN quarter < 5 THEN 0 ELSE quarter END AS q_bucket,
  CASE WHEN parameters_made = 'made' THEN CASE WHEN type = 'freeThrow' THEN 1 ELSE parameters_points END END AS team_score
FROM {actions}""")
cte("flagged", """
SELECT *, lead(end_poss) OVER w AS next_end,
  count(*) FILTER (WHERE end_poss) OVER p AS sum_poss_poss,
  count(*) FILTER (WHERE parameters_made = 'blocked') OVER p AS sum_block,
  count(*) FILTER (WHERE parameters_type = 'technical') OVER p AS sum_tech
FROM (SELECT *, CASE WHEN type = 'shot' AND parameters_made = 'made' THEN TRUE
    WHEN lead(parameters_type) OVER w = 'defensive' AND lead(type) OVER w = 'rebound' THEN TRUE
    WHEN type = 'freeThrow' AND parameters_made = 'made' AND pct_ft = 1 THEN TRUE
    WHEN type = 'turnover' THEN TRUE ELSE FALSE END AS end_poss
  FROM {prepared}
  WINDOW w AS (PARTITION BY game_id, parent_action_id ORDER BY id))
WINDOW w AS (PARTITION BY game_id, parent_action_id ORDER BY id),
  p AS (PARTITION BY game_id, parent_action_id)""")
cte("base", """
SELECT *, CASE WHEN sum_poss_poss >= 2 AND id = parent_action_id THEN NULL
  WHEN sum_block >= 1 THEN next_end WHEN sum_tech >= 1 THEN NULL ELSE end_poss END AS final_base
FROM {flagged}""")
cte("targets", """
SELECT DISTINCT game_id, quarter, mark AS id FROM (
  SELECT game_id, quarter, CASE
    WHEN nxt = 'end-of-quarter' AND type = 'shot' AND parameters_made = 'missed' THEN id
    WHEN nxt = 'end-of-quarter' AND type = 'rebound' AND parameters_type = 'offensive' THEN id
    WHEN nxt = 'end-of-quarter' AND type = 'block' AND prev_parent = parent_action_id THEN prev_id END AS mark
  FROM (SELECT *, lead(parameters_type) OVER w AS nxt, lag(id) OVER w AS prev_id,
      lag(parent_action_id) OVER w AS prev_parent
    FROM {prepared} WINDOW w AS (PARTITION BY game_id, quarter ORDER BY id)))
WHERE mark IS NOT NULL""")
cte("poss", """
SELECT b.*, CASE WHEN t.id IS NOT NULL THEN TRUE ELSE b.final_base END AS final_end_poss
FROM {base} b LEFT JOIN {targets} t USING (game_id, quarter, id)""")


@query("team_ppp", """
SELECT team_id, round(avg(ppp), 1) AS mean_ppp FROM (
  SELECT team_id, game_id,
    100.0 * sum(team_score)::DOUBLE / nullif(count(*) FILTER (WHERE final_end_poss), 0) AS ppp
  FROM {poss} WHERE team_id <> 0 GROUP BY team_id, game_id)
GROUP BY team_id""")
def team_ppp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.team_ppp(P.possessions(actions(spark, sf_dir)))


@query("possession_flags", """
SELECT game_id, id, team_id, parent_action_id, team_score::BIGINT AS team_score, end_poss,
  sum_poss_poss, sum_block, sum_tech, final_end_poss FROM {poss}""")
def possession_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.possessions(actions(spark, sf_dir)).select(
        "game_id", "id", "team_id", "parent_action_id", F.col("team_score").cast("long"), "end_poss",
        "sum_poss_poss", "sum_block", "sum_tech", "final_end_poss",
    )


@query("eoq_overrides", "SELECT game_id, quarter, id FROM {targets}")
def eoq_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.end_of_period_overrides(P.prepare_actions(actions(spark, sf_dir)))


# ---- lineups ---------------------------------------------------------------

cte("subs", """
SELECT id, game_id, team_id, quarter, quarter_time, end_game_seconds_remaining,
  end_quarter_seconds_remaining,
  CASE WHEN parameters_player_in IS NOT NULL THEN player_id END AS player_in,
  CASE WHEN parameters_player_out IS NOT NULL THEN player_id END AS player_out
FROM {actions} WHERE type = 'substitution'""")
cte("state", """
SELECT game_id, team_id, quarter, end_game_seconds_remaining, quarter_time,
  end_quarter_seconds_remaining, player_id, id, is_on_verdict
FROM (SELECT *, row_number() OVER (PARTITION BY game_id, quarter, quarter_time,
      end_game_seconds_remaining, end_quarter_seconds_remaining, player_id, team_id ORDER BY id DESC) AS rn
  FROM (SELECT s.*, r.player_id, last_value(CASE WHEN r.player_id = s.player_in THEN TRUE
          WHEN r.player_id = s.player_out THEN FALSE END IGNORE NULLS)
        OVER (PARTITION BY s.game_id, r.player_id ORDER BY s.id ROWS UNBOUNDED PRECEDING) AS is_on_verdict
    FROM {subs} s JOIN (SELECT DISTINCT player_id, game_id, team_id FROM {rosters}) r USING (game_id, team_id)))
WHERE rn = 1""")
cte("lineups", """
SELECT *, md5(lineup_id) AS lineup_hash FROM (
  SELECT s.*, t.n_on, nullif(t.ids, '') AS lineup_id
  FROM {state} s JOIN (
    SELECT game_id, team_id, quarter, end_game_seconds_remaining,
      count(*) FILTER (WHERE is_on_verdict) AS n_on,
      array_to_string(list_sort(list(DISTINCT player_id::BIGINT) FILTER (WHERE is_on_verdict)), '_') AS ids
    FROM {state} GROUP BY ALL) t USING (game_id, team_id, quarter, end_game_seconds_remaining))""")
cte("segments", """
SELECT *, end_game_seconds_remaining AS start_segment,
  CASE WHEN lead(quarter) OVER w > quarter AND lead(quarter) OVER w >= 5 THEN 0
    ELSE coalesce(lead(end_game_seconds_remaining) OVER w, 0) END AS end_segment,
  id AS start_id, coalesce(lead(id) OVER w, last_id) AS end_id
FROM (SELECT DISTINCT id, game_id, team_id, quarter, end_game_seconds_remaining, lineup_id, lineup_hash FROM {lineups})
LEFT JOIN (SELECT game_id, quarter, max(id) AS last_id FROM {actions} WHERE quarter >= 4 GROUP BY ALL)
  USING (game_id, quarter)
WINDOW w AS (PARTITION BY game_id, team_id ORDER BY quarter, end_game_seconds_remaining DESC, id)""")
cte("stints", """
SELECT o.team_id, o.game_id, least(o.start_segment, d.start_segment) AS final_start_seg,
  greatest(o.end_segment, d.end_segment) AS final_end_seg,
  dense_rank() OVER (PARTITION BY o.game_id ORDER BY greatest(o.start_id, d.start_id), least(o.end_id, d.end_id)) AS segment_id,
  o.lineup_hash AS lineup_hash_offense, d.lineup_hash AS lineup_hash_defense, d.team_id AS team_id_defense,
  CASE WHEN least(o.quarter, d.quarter) < 5 THEN 0 ELSE least(o.quarter, d.quarter) END AS q_bucket,
  greatest(o.start_id, d.start_id) AS final_start_id, least(o.end_id, d.end_id) AS final_end_id
FROM {segments} o JOIN {segments} d ON o.game_id = d.game_id AND o.team_id <> d.team_id
  AND ((o.quarter < 5 AND d.quarter < 5) OR (o.quarter >= 5 AND o.quarter = d.quarter))
  AND o.end_id IS NOT NULL AND d.end_id IS NOT NULL
  AND least(o.end_id, d.end_id) > greatest(o.start_id, d.start_id)""")
cte("assigned", """
SELECT p.*, s.segment_id, s.lineup_hash_offense, s.lineup_hash_defense, s.team_id_defense
FROM {poss} p LEFT JOIN {stints} s ON p.team_id = s.team_id AND p.game_id = s.game_id
  AND p.q_bucket = s.q_bucket AND p.id >= s.final_start_id AND p.id < s.final_end_id""")
cte("sided", """
SELECT * FROM (
  SELECT id, game_id, quarter, type, team_score, final_end_poss, segment_id, 'offense' AS type_lineup,
    team_id, lineup_hash_offense AS lineup_hash FROM {assigned}
  UNION ALL
  SELECT id, game_id, quarter, type, team_score, final_end_poss, segment_id, 'defense' AS type_lineup,
    team_id_defense AS team_id, lineup_hash_defense AS lineup_hash FROM {assigned})
WHERE lineup_hash IS NOT NULL""")


def court_state(spark: SparkSession, sf_dir: str, roster: DataFrame | None = None) -> DataFrame:
    """On-court states from the staged substitution and roster tables, which the
    chain reads several times and which are far smaller than the log."""
    if roster is None:
        roster = stage(rosters(actions(spark, sf_dir)), "full_rosters")
    subs = L.substitutions(actions(spark, sf_dir, only=SUB_EVENTS))
    return L.on_court_state(roster, stage(subs, "subs"))


def lineup_table(spark: SparkSession, sf_dir: str, roster: DataFrame | None = None) -> DataFrame:
    """On-court states with lineup keys, staged: segments and ratings reuse them."""
    return stage(L.lineup_key(court_state(spark, sf_dir, roster)), "lineups_lookup")


def stint_table(acts: DataFrame, lineups: DataFrame) -> DataFrame:
    return L.stints(stage(L.lineup_segments(lineups, acts), "segments"))


def assigned_table(acts: DataFrame, stints: DataFrame) -> DataFrame:
    return L.assign_stints(P.possessions(acts), stage(stints, "stints"))


def game_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(staged lineups, two-sided possessions, rosters)."""
    acts = actions(spark, sf_dir)
    roster = stage(rosters(acts), "full_rosters")
    lineups = lineup_table(spark, sf_dir, roster)
    assigned = assigned_table(acts, stint_table(acts, lineups))
    return lineups, L.two_sided(assigned, SIDED_KEEP), roster


@query("on_court_state", "SELECT * FROM {state}")
def on_court_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court_state(spark, sf_dir)


@query("lineup_keys", "SELECT * FROM {lineups}")
def lineup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lineup_key(court_state(spark, sf_dir))


@query("lineup_dim", "SELECT DISTINCT lineup_hash, lineup_id FROM {lineups}")
def lineup_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lineup_dim(lineup_keys(spark, sf_dir))


@query("lineup_players", "SELECT DISTINCT lineup_hash, player_id FROM {lineups} WHERE is_on_verdict")
def lineup_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lineup_players(lineup_keys(spark, sf_dir))


@query("lineup_segments", """
SELECT game_id, team_id, quarter, lineup_hash, start_segment, end_segment, start_id, end_id FROM {segments}""")
def lineup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = actions(spark, sf_dir)
    return L.lineup_segments(lineup_table(spark, sf_dir), acts).select(
        "game_id", "team_id", "quarter", "lineup_hash", "start_segment", "end_segment",
        "start_id", "end_id",
    )


@query("stints", "SELECT * FROM {stints}")
def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = actions(spark, sf_dir)
    return stint_table(acts, lineup_table(spark, sf_dir))


@query("assign_stints", """
SELECT game_id, id, team_id, final_end_poss, segment_id, lineup_hash_offense, lineup_hash_defense,
  team_id_defense FROM {assigned}""")
def assign_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = actions(spark, sf_dir)
    return assigned_table(acts, stint_table(acts, lineup_table(spark, sf_dir))).select(
        "game_id", "id", "team_id", "final_end_poss", "segment_id", "lineup_hash_offense",
        "lineup_hash_defense", "team_id_defense",
    )


@query("two_sided", """
SELECT id, game_id, quarter, type, team_score::BIGINT AS team_score, final_end_poss, segment_id,
  type_lineup, team_id, lineup_hash FROM {sided} WHERE game_id NOT IN (5, 11)""")
def two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = actions(spark, sf_dir)
    assigned = assigned_table(acts, stint_table(acts, lineup_table(spark, sf_dir)))
    sided = L.two_sided(assigned, SIDED_KEEP, exclude_games=(5, 11))
    return sided.withColumn("team_score", F.col("team_score").cast("long"))


# ---- on/off ----------------------------------------------------------------

cte("side_sums", """
SELECT player_id, team_id, is_on_verdict, type_lineup, sum(pts)::BIGINT AS total_pts,
  sum(poss)::BIGINT AS total_poss,
  round(100.0 * sum(pts)::DOUBLE / nullif(sum(poss), 0)::DOUBLE, 1) AS ppp_calc
FROM (SELECT DISTINCT player_id, team_id, lineup_hash, coalesce(is_on_verdict, FALSE) AS is_on_verdict FROM {lineups}) l
JOIN (SELECT lineup_hash, type_lineup, game_id, sum(team_score) AS pts, sum(final_end_poss::INT) AS poss
  FROM {sided} GROUP BY ALL) s USING (lineup_hash)
GROUP BY ALL""")
cte("names", "SELECT DISTINCT player_id, team_id, team_name, first_name, last_name FROM {rosters}")


@query("on_off_ratings", """
SELECT player_id, team_id, is_on_verdict, type_lineup, total_pts, total_poss, ppp_calc, first_name,
  last_name, net_rtg, round(net_rtg - lag(net_rtg) OVER (PARTITION BY player_id, team_id, is_on_verdict
    ORDER BY type_lineup), 2) AS total_net_rtg
FROM (SELECT *, round(ppp_calc - lag(ppp_calc) OVER (PARTITION BY player_id, team_id, type_lineup
    ORDER BY is_on_verdict), 6) AS net_rtg
  FROM (SELECT s.*, first_name, last_name,
      bool_and(coalesce(total_poss >= 100, FALSE)) OVER (PARTITION BY player_id) AS ok
    FROM {side_sums} s JOIN {names} USING (player_id, team_id)) WHERE ok)""")
def on_off_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineups, sided, roster = game_tables(spark, sf_dir)
    return O.on_off_ratings(lineups, sided, roster)


cte("dated_sums", """
SELECT player_id, team_id, is_on_verdict, type_lineup, sum(team_score) AS total_pts,
  sum(final_end_poss::INT) AS total_poss,
  round(100.0 * sum(team_score)::DOUBLE / nullif(sum(final_end_poss::INT), 0)::DOUBLE, 1) AS ppp_calc
FROM (SELECT DISTINCT player_id, team_id, lineup_hash, coalesce(is_on_verdict, FALSE) AS is_on_verdict FROM {lineups}) l
JOIN (SELECT * EXCLUDE (team_id) FROM {sided} JOIN {schedule} USING (game_id)
  WHERE game_date >= DATE '2024-01-03' AND game_date <= DATE '2024-01-27') s USING (lineup_hash)
GROUP BY ALL""")
cte("onoff_wide", """
SELECT player_id, team_id,
  max(CASE WHEN type_lineup = 'offense' AND is_on_verdict THEN ppp_calc END) AS offense_on_ppp,
  max(CASE WHEN type_lineup = 'offense' AND NOT is_on_verdict THEN ppp_calc END) AS offense_off_ppp,
  max(CASE WHEN type_lineup = 'defense' AND is_on_verdict THEN ppp_calc END) AS defense_on_ppp,
  max(CASE WHEN type_lineup = 'defense' AND NOT is_on_verdict THEN ppp_calc END) AS defense_off_ppp,
  max(CASE WHEN type_lineup = 'offense' AND is_on_verdict THEN net_rtg END) AS offense_on_net,
  max(CASE WHEN type_lineup = 'defense' AND is_on_verdict THEN net_rtg END) AS defense_on_net,
  max(total_net_rtg) AS total_net_rtg,
  max(CASE WHEN is_on_verdict THEN total_poss END)::DOUBLE AS on_poss,
  max(CASE WHEN NOT is_on_verdict THEN total_poss END)::DOUBLE AS off_poss
FROM (SELECT *, round(lag(net_rtg) OVER (PARTITION BY player_id, team_id, is_on_verdict
    ORDER BY type_key) - net_rtg, 2) AS total_net_rtg
  FROM (SELECT *, CASE type_lineup WHEN 'offense' THEN 1 ELSE 2 END AS type_key,
      round(ppp_calc - lag(ppp_calc) OVER (PARTITION BY player_id, team_id, type_lineup
        ORDER BY is_on_verdict::INT), 6) AS net_rtg FROM {dated_sums}))
GROUP BY player_id, team_id
HAVING min(total_poss) >= 3 AND max(CASE WHEN is_on_verdict THEN total_poss ELSE 0 END) >= 5""")


def _table(spark: SparkSession, sf_dir: str, min_net: float | None, teams: list[str] | None) -> DataFrame:
    """Possessions and stints are built for the wanted games alone (whole games, by a time range that reaches
    the scan); which lineups a player belongs to is asked of all games."""
    acts, games = actions(spark, sf_dir), schedule(spark, sf_dir)
    roster = stage(rosters(acts), "full_rosters")
    lineups = lineup_table(spark, sf_dir, roster)
    first, after = (F.to_date(F.lit(DATES[0])), F.date_add(F.to_date(F.lit(DATES[1])), 1))
    kind = dict(acts.dtypes)["user_time"]
    played = acts.where((F.col("user_time") >= first.cast(kind)) & (F.col("user_time") < after.cast(kind)))
    wanted = games.where((F.col("game_date") >= first) & (F.col("game_date") < after))
    segments = stint_table(played, lineups.join(wanted, "game_id", "left_semi"))
    sided = L.two_sided(assigned_table(played, segments), SIDED_KEEP)
    return O.on_off_table(lineups, sided, roster, games, DATES, teams, 3, 5, min_net)


@query("on_off_table", """
SELECT w.*, team_name, first_name, last_name FROM {onoff_wide} w JOIN {names} USING (player_id, team_id)
WHERE total_net_rtg >= -50 AND team_name = 'Team 1'""")
def on_off_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, -50.0, WANTED_TEAMS)


@query("on_off_percentiles", """
SELECT player_id, team_id, total_net_rtg,
  """ + ",\n  ".join(
    f"CASE WHEN {m} IS NOT NULL THEN round({'1 - ' if m in O.LOWER_BETTER else ''}percent_rank() OVER "
    f"(PARTITION BY {m} IS NULL ORDER BY {m}), 6) END AS pct_{m}"
    for m in [*O.HIGHER_BETTER, *O.LOWER_BETTER]
) + "\nFROM {onoff_wide}")
def on_off_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = O.on_off_display(stage(_table(spark, sf_dir, None, None), "on_off_table"))
    return shown.select(
        "player_id", "team_id", "total_net_rtg",
        *[F.round(f"pct_{m}", 6).alias(f"pct_{m}") for m in [*O.HIGHER_BETTER, *O.LOWER_BETTER]],
    )


@query("on_off_export", ORACLES["on_off_percentiles"])
def on_off_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display as the sorted file that users download, read back."""
    shown = O.on_off_display(stage(_table(spark, sf_dir, None, None), "on_off_table"))
    shown = shown.select(
        "player_id", "team_id", "total_net_rtg", "team_name", "last_name", "first_name",
        *[F.round(f"pct_{m}", 6).alias(f"pct_{m}") for m in [*O.HIGHER_BETTER, *O.LOWER_BETTER]])
    path = f"{checkpoint_root(spark).rstrip('/')}/courtside/on_off_export-{uuid.uuid4().hex}"
    write_csv(shown, path, [F.desc("total_net_rtg"), "team_name", "last_name", "first_name"])
    return read_sheet(spark, path, shown.schema).drop("team_name", "last_name", "first_name")


@query("lineup_leaderboard", """
SELECT player_id, team_id, lineup_hash, type_lineup, total_pts::BIGINT AS total_pts,
  total_poss::BIGINT AS total_poss, round(total_pts::DOUBLE / total_poss::DOUBLE, 6) AS pts_per_poss, first_name, last_name
FROM (SELECT lineup_hash, type_lineup, sum(team_score) AS total_pts, sum(final_end_poss::INT) AS total_poss
  FROM {sided} GROUP BY ALL HAVING sum(final_end_poss::INT) >= 4)
JOIN (SELECT DISTINCT lineup_hash, team_id, player_id FROM {lineups} WHERE is_on_verdict) USING (lineup_hash)
JOIN {names} USING (player_id, team_id)""".replace("team_name, ", ""))
def lineup_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineups, sided, roster = game_tables(spark, sf_dir)
    return O.lineup_leaderboard(lineups, sided, roster, min_poss=4).withColumn(
        "pts_per_poss", F.round("pts_per_poss", 6)
    )


@query("player_on_off", """
SELECT type_lineup, is_on, team_id, sum(final_end_poss::INT)::BIGINT AS total_poss,
  sum(team_score)::BIGINT AS total_pts,
  round(100.0 * sum(team_score)::DOUBLE / nullif(sum(final_end_poss::INT), 0)::DOUBLE, 1) AS pts_per_poss
FROM (SELECT s.*, l.lineup_hash IS NOT NULL AS is_on FROM {sided} s
  LEFT JOIN (SELECT DISTINCT team_id, lineup_hash FROM {lineups} WHERE is_on_verdict AND player_id = 7) l
  USING (team_id, lineup_hash))
GROUP BY ALL""")
def player_on_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineups, sided, _ = game_tables(spark, sf_dir)
    return O.player_on_off(lineups, sided, ONE_PLAYER)


@query("lineup_breakdown", """
SELECT team_id, type_lineup, lineup_hash, game_id, quarter, sum(team_score)::BIGINT AS total_pts,
  sum(final_end_poss::INT)::BIGINT AS total_poss FROM {sided} GROUP BY ALL""")
def lineup_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.lineup_game_breakdown(game_tables(spark, sf_dir)[1])


@query("segment_drilldown", """
SELECT game_id, team_id, type, sum(team_score)::BIGINT AS total_pts, sum(final_end_poss::INT)::BIGINT AS total_poss
FROM {assigned} WHERE (game_id, segment_id) IN (SELECT (s.game_id, s.segment_id) FROM {stints} s
  JOIN (SELECT game_id, min(lineup_hash_offense) AS h FROM {stints} GROUP BY game_id) w ON w.game_id = s.game_id AND w.h = s.lineup_hash_offense)
GROUP BY ALL""")
def segment_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offensive lineup of every game (the first by hash), its segments."""
    acts = actions(spark, sf_dir)
    table = stage(stint_table(acts, lineup_table(spark, sf_dir)), "stints")
    wanted = table.groupBy("game_id").agg(F.min("lineup_hash_offense").alias("lineup_hash"))
    return O.segment_drilldown(table, assigned_table(acts, table), wanted)


# ---- data quality ----------------------------------------------------------


@query("dq_clock", """
SELECT * FROM (SELECT game_id, id, quarter, type, end_game_seconds_remaining,
    lag(end_game_seconds_remaining) OVER w AS prev_clock,
    end_game_seconds_remaining - lag(end_game_seconds_remaining) OVER w AS how_bigger
  FROM {actions} WINDOW w AS (PARTITION BY game_id ORDER BY id)) WHERE how_bigger > 0""")
def dq_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.clock_increases(actions(spark, sf_dir))


@query("dq_parent_order", """
SELECT a.game_id, a.id, a.parent_action_id, a.end_game_seconds_remaining,
  p.end_game_seconds_remaining AS parent_clock,
  a.end_game_seconds_remaining - p.end_game_seconds_remaining AS time_diff
FROM {actions} a JOIN {actions} p ON a.game_id = p.game_id AND a.parent_action_id = p.id
WHERE a.parent_action_id <> 0 AND a.end_game_seconds_remaining > p.end_game_seconds_remaining""")
def dq_parent_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.child_before_parent(actions(spark, sf_dir)).where("time_diff > 0")


cte("dirty", """
SELECT * REPLACE (end_game_seconds_remaining + CASE WHEN id % 97 = 0 THEN 500 ELSE 0 END AS end_game_seconds_remaining)
FROM {actions}""")


def dirty_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with clocks that run ahead, so that the checks have something to find."""
    ahead = F.when(F.col("id") % 97 == 0, 500).otherwise(0)
    return actions(spark, sf_dir).withColumn("end_game_seconds_remaining", F.col("end_game_seconds_remaining") + ahead)


@query("dq_clock_dirty", """
SELECT * FROM (SELECT game_id, id, quarter, type, end_game_seconds_remaining,
    lag(end_game_seconds_remaining) OVER w AS prev_clock,
    end_game_seconds_remaining - lag(end_game_seconds_remaining) OVER w AS how_bigger
  FROM {dirty} WINDOW w AS (PARTITION BY game_id ORDER BY id)) WHERE how_bigger > 0""")
def dq_clock_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.clock_increases(dirty_actions(spark, sf_dir))


@query("dq_parent_order_dirty", """
SELECT c.game_id, c.id, c.parent_action_id, c.end_game_seconds_remaining, p.end_game_seconds_remaining AS parent_clock,
  c.end_game_seconds_remaining - p.end_game_seconds_remaining AS time_diff
FROM {dirty} c, {dirty} p WHERE c.parent_action_id <> 0 AND p.game_id = c.game_id AND p.id = c.parent_action_id
  AND c.end_game_seconds_remaining > p.end_game_seconds_remaining""")
def dq_parent_order_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.child_before_parent(dirty_actions(spark, sf_dir)).where("time_diff > 0")


@query("parent_child", """
SELECT a.game_id, a.id, a.parent_action_id, a.end_game_seconds_remaining,
  p.end_game_seconds_remaining AS parent_clock,
  a.end_game_seconds_remaining - p.end_game_seconds_remaining AS time_diff
FROM {actions} a JOIN {actions} p ON a.game_id = p.game_id AND a.parent_action_id = p.id
WHERE a.parent_action_id <> 0""")
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.child_before_parent(actions(spark, sf_dir))


@query("dq_repeated_marks", """
SELECT game_id, quarter, count(*) AS n FROM {actions} WHERE parameters_type = 'end-of-quarter'
GROUP BY ALL HAVING count(*) > 1""")
def dq_repeated_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.repeated_marks(actions(spark, sf_dir))


@query("dq_duplicates", "SELECT game_id, id, count(*) AS n FROM {assigned} GROUP BY ALL HAVING count(*) > 1")
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = actions(spark, sf_dir)
    return B.repeated_ids(assigned_table(acts, stint_table(acts, lineup_table(spark, sf_dir))))


@query("dq_duplicates_dirty", """
SELECT p.game_id, p.id, count(*) AS n FROM {poss} p
JOIN (SELECT * FROM {stints} UNION ALL SELECT * FROM {stints} WHERE segment_id % 5 = 0) s ON p.team_id = s.team_id
  AND p.game_id = s.game_id AND p.q_bucket = s.q_bucket AND p.id >= s.final_start_id AND p.id < s.final_end_id
GROUP BY p.game_id, p.id HAVING count(*) > 1""")
def dq_duplicates_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth stint of a game is listed twice, which multiplies its events."""
    acts = actions(spark, sf_dir)
    table = stage(stint_table(acts, lineup_table(spark, sf_dir)), "stints")
    return B.repeated_ids(assigned_table(acts, table.unionByName(table.where("segment_id % 5 = 0"))))


@query("dq_unmatched", """
SELECT game_id, count(*) AS n FROM {assigned}
WHERE team_id <> 0 AND type <> 'substitution' AND game_id NOT IN (5, 11) AND lineup_hash_defense IS NULL
GROUP BY game_id""")
def dq_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = actions(spark, sf_dir)
    assigned = assigned_table(acts, stint_table(acts, lineup_table(spark, sf_dir)))
    return L.unmatched_possessions(assigned, exclude_games=(5, 11))


@query("dq_id_gap", """
SELECT game_id, median(id - parent_action_id)::DOUBLE AS med_diff, count(*) AS n FROM {actions}
WHERE parent_action_id <> 0 AND id - parent_action_id > 1 GROUP BY game_id""")
def dq_id_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parent_gaps(actions(spark, sf_dir), min_gap=1)


@query("dq_players_on", """
SELECT n_on, count(DISTINCT (game_id, team_id, quarter, end_game_seconds_remaining)) AS n_ticks
FROM {lineups} GROUP BY n_on""")
def dq_players_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = lineup_keys(spark, sf_dir).select(*L.TICK, "n_on").distinct()
    return ticks.groupBy("n_on").agg(F.count(F.lit(1)).alias("n_ticks"))


@query("score_reconciliation", """
SELECT game_id, team_id, coalesce(sum(team_score), 0)::BIGINT AS final_score FROM {poss}
WHERE team_id <> 0 GROUP BY ALL""")
def score_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.score_reconciliation(P.prepare_actions(actions(spark, sf_dir)))
