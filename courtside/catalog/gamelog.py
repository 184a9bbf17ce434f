"""Queries on the text log and score log: comebacks, clutch, droughts, endings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import bucket_of, fill_down, fill_up, ordered_pass, running
from ..plans import games as G
from ..plans import pbp as B
from ..session import stage
from .adapters import POINTS, actions, events, games, raw_pbp, read
from .registry import ORACLES, cte, query

DEFICIT = 8

cte("parsed0", r"""
SELECT game_id, seq, coalesce(visit_team, 'NA') || '_' || coalesce(home_team, 'NA') AS event,
  CASE WHEN regexp_matches(visit_team, '[A-Za-z]') THEN 'visit_team' ELSE 'home_team' END AS team,
  CAST(split_part(time, ':', 1) AS INTEGER) * 60 + CAST(split_part(time, ':', 2) AS INTEGER) AS clock,
  CAST(split_part(score, '-', 1) AS INTEGER) AS visit_score,
  CAST(split_part(score, '-', 2) AS INTEGER) AS home_score
FROM {raw_pbp}""")
cte("parsed1", """
SELECT *, visit_score - home_score AS visit_adv,
  lead(event) OVER w AS next_event,
  coalesce((clock = 720 AND lead(clock) OVER w <> 720)::INT, 0)
    + coalesce((clock = 300 AND (visit_score - home_score) IS NULL AND lead(clock) OVER w <> 300)::INT, 0) AS opens
FROM {parsed0} WINDOW w AS (PARTITION BY game_id ORDER BY seq)""")
cte("parsed2", """
SELECT *, CASE WHEN period BETWEEN 1 AND 4 THEN 720 - clock + 720 * (period - 1)
  WHEN period > 4 THEN 300 - clock + 2880 + 300 * (period - 5) END AS time
FROM (SELECT *, (sum(opens) OVER (PARTITION BY game_id ORDER BY seq))::INT AS period FROM {parsed1})""")
cte("parsed", r"""
SELECT *, lag(time) OVER (PARTITION BY game_id ORDER BY seq) AS prev_time,
  round_even(time / 60.0, 0)::DOUBLE AS time_minutes, -visit_adv AS home_adv,
  nullif(regexp_extract(event, '[0-9]{1}-pt|free throw'), '') AS shot_type,
  CASE WHEN regexp_matches(event, 'misses|makes') THEN regexp_extract(event, 'misses|makes') = 'makes' END AS has_made,
  CASE WHEN event LIKE '%makes 2-pt%' THEN 2 WHEN event LIKE '%makes 3-pt%' THEN 3
    WHEN event LIKE '%makes free throw%' THEN 1 ELSE 0 END AS points,
  TRY_CAST(trim(nullif(regexp_extract(event, 'from(.*)ft', 1), '')) AS DOUBLE) AS distance
FROM {parsed2}""")
cte("textlog", r"""
SELECT p.*, g.visitor_pts, g.home_pts,
  CASE WHEN team = 'visit_team' THEN visit_adv ELSE home_adv END AS adv,
  CASE WHEN team = 'visit_team' THEN visit_adv > 0 ELSE visit_adv < 0 END AS is_leading,
  CASE WHEN team = 'visit_team' THEN visitor_team_name ELSE home_team_name END AS team_offense,
  CASE WHEN team = 'visit_team' THEN home_team_name ELSE visitor_team_name END AS team_defense,
  time - prev_time AS time_offense,
  CASE WHEN team = 'visit_team' THEN visitor_pts > home_pts ELSE home_pts > visitor_pts END AS has_won,
  (regexp_matches(event, 'makes [2-3]-pt')
   OR (regexp_matches(event, 'misses [2-3]-pt') AND coalesce(next_event LIKE '%Defensive rebound%', FALSE))
   OR (regexp_matches(event, 'misses free throw (2 of 2|3 of 3)') AND coalesce(next_event LIKE '%Defensive rebound%', FALSE))
   OR regexp_matches(event, 'makes free throw (2 of 2|3 of 3)') OR event LIKE '%Turnover%') AS end_poss
FROM {parsed} p LEFT JOIN {games} g USING (game_id)""")
cte("scores", """
SELECT a.game_id, a.id, a.quarter AS qtr, a.end_game_seconds_remaining AS clock, p.pts, a.type,
  a.game_id % 3 + 2022 AS season,
  sum(CASE WHEN p.visit THEN 0 ELSE p.pts END) OVER (PARTITION BY a.game_id ORDER BY a.id) AS home_score,
  sum(CASE WHEN p.visit THEN p.pts ELSE 0 END) OVER (PARTITION BY a.game_id ORDER BY a.id) AS away_score
FROM {actions} a JOIN {raw_pts} p ON p.event_id = a.id""")


def text_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, possession-flagged and oriented text play-by-play."""
    parsed = B.parse_pbp(stage(raw_pbp(spark, sf_dir), "raw_pbp"))
    return B.orient_events(B.flag_possessions_text(parsed), games(spark, sf_dir))


def staged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(text_log(spark, sf_dir), "text_log")


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running score per game."""
    rows = actions(spark, sf_dir, source=True).selectExpr(
        "game_id", "id", "quarter AS qtr", "type", "end_game_seconds_remaining AS clock",
        "game_id % 3 + 2022 AS season", f"{POINTS} AS pts", "user_id % 2 = 0 AS _visit",
    )
    return ordered_pass(
        rows, ["game_id"], ["id"], bucket_of("id"),
        {
            "home_score": running(F.expr("if(_visit, 0, pts)")),
            "away_score": running(F.expr("if(_visit, pts, 0)")),
        },
    ).drop("_visit")


@query("pbp_clock", "SELECT game_id, seq, clock, period, time, time_minutes FROM {parsed}")
def pbp_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parse_pbp(stage(raw_pbp(spark, sf_dir), "raw_pbp")).select(
        "game_id", "seq", "clock", "period", "time", "time_minutes"
    )


@query("period_inference", """
SELECT game_id, period, count(*) AS n_events, min(time) AS first_time, max(time) AS last_time
FROM {parsed} GROUP BY ALL""")
def period_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parse_pbp(stage(raw_pbp(spark, sf_dir), "raw_pbp")).groupBy("game_id", "period").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )


@query("pbp_text_features", """
SELECT game_id, seq, team, shot_type, has_made, points, distance, end_poss, adv, is_leading,
  team_offense, team_defense, time_offense, has_won FROM {textlog}""")
def pbp_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_log(spark, sf_dir).select(
        "game_id", "seq", "team", "shot_type", "has_made", "points", "distance", "end_poss",
        "adv", "is_leading", "team_offense", "team_defense", "time_offense", "has_won",
    )


@query("conversation_features", r"""
SELECT conv_id, turn, nullif(regexp_extract(text, '[0-9]{1}-pt|free throw'), '') AS shot_type,
  CASE WHEN regexp_matches(text, 'misses|makes') THEN regexp_extract(text, 'misses|makes') = 'makes' END AS has_made,
  CASE WHEN text LIKE '%makes 2-pt%' THEN 2 WHEN text LIKE '%makes 3-pt%' THEN 3
    WHEN text LIKE '%makes free throw%' THEN 1 ELSE 0 END AS points
FROM conversations""")
def conversation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = B.event_features(F.col("text"))
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", *[feats[c].alias(c) for c in ("shot_type", "has_made", "points")]
    )


cte("windows", """
SELECT game_id, t0 AS min_lead_time, d AS minimal_comeback, t0 + d AS max_time_comeback
FROM (SELECT game_id, min(time) AS t0 FROM {textlog} WHERE has_won AND adv < -8 GROUP BY game_id)
LEFT JOIN (SELECT l.game_id, min(l.time - w.t0) AS d FROM {textlog} l
  JOIN (SELECT game_id, min(time) AS t0 FROM {textlog} WHERE has_won AND adv < -8 GROUP BY game_id) w USING (game_id)
  WHERE l.has_won AND l.adv > 0 AND l.time > w.t0 GROUP BY l.game_id) USING (game_id)""")
cte("comeback_rows", """
SELECT l.* FROM {textlog} l JOIN {windows} w USING (game_id)
WHERE l.time >= w.min_lead_time AND l.time <= w.max_time_comeback""")


@query("comeback_windows", "SELECT * FROM {windows}")
def comeback_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.comeback_windows(staged_log(spark, sf_dir), DEFICIT)


@query("comeback_shot_mix", """
SELECT has_won, shot_type, n, total_made, n_1, round(total_made::DOUBLE / n, 6) AS pct,
  round(n_1 / sum(n_1) OVER (PARTITION BY has_won), 6) AS freq
FROM (SELECT has_won, shot_type, count(*) AS n, count(*) FILTER (WHERE has_made) AS total_made,
    (CASE WHEN shot_type = 'free throw' THEN count(*) * 0.44::DOUBLE ELSE count(*)::DOUBLE END) AS n_1
  FROM {comeback_rows} WHERE shot_type IS NOT NULL GROUP BY has_won, shot_type)""")
def comeback_shot_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = staged_log(spark, sf_dir)
    mix = G.comeback_shot_mix(log, G.comeback_windows(log, DEFICIT))
    return mix.withColumns({c: F.round(c, 6) for c in ("pct", "freq")})


@query("comeback_efficiency", """
SELECT * REPLACE (round(pts_per_poss_off, 6) AS pts_per_poss_off, round(pts_per_poss_def, 6) AS pts_per_poss_def),
  round(total_poss_off::DOUBLE / total_team_poss_off, 6) AS freq_off,
  round(total_poss_def::DOUBLE / total_team_poss_def, 6) AS freq_def,
  round(pts_per_poss_off - 112.9, 6) AS diff_off, round(pts_per_poss_def - 112.9, 6) AS diff_def,
  round(total_poss_off::DOUBLE / total_team_poss_off * (pts_per_poss_off - 112.9), 6) AS weighted_off,
  round(total_poss_def::DOUBLE / total_team_poss_def * (pts_per_poss_def - 112.9), 6) AS weighted_def
FROM (SELECT w.game_id, w.team_offense AS winner, w.team_defense AS loser,
    w.ppp AS pts_per_poss_off, w.pts::BIGINT AS total_points_off, w.poss AS total_poss_off,
    l.ppp AS pts_per_poss_def, l.pts::BIGINT AS total_points_def, l.poss AS total_poss_def,
    sum(w.poss) OVER ()::BIGINT AS total_team_poss_off, sum(l.poss) OVER ()::BIGINT AS total_team_poss_def
  FROM (SELECT *, 100.0 * pts::DOUBLE / nullif(poss, 0) AS ppp FROM (SELECT game_id, team_offense, team_defense, has_won, sum(points) AS pts,
      count(*) FILTER (WHERE end_poss) AS poss FROM {comeback_rows} GROUP BY ALL) WHERE has_won) w
  LEFT JOIN (SELECT *, 100.0 * pts::DOUBLE / nullif(poss, 0) AS ppp FROM (SELECT game_id, team_offense, team_defense, has_won, sum(points) AS pts,
      count(*) FILTER (WHERE end_poss) AS poss FROM {comeback_rows} GROUP BY ALL) WHERE NOT has_won) l USING (game_id))""")
def comeback_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = staged_log(spark, sf_dir)
    out = G.comeback_efficiency(log, G.comeback_windows(log, DEFICIT))
    rounded = ("pts_per_poss_off", "pts_per_poss_def", "freq_off", "freq_def", "diff_off",
               "diff_def", "weighted_off", "weighted_def")
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query("comeback_means", f"""
SELECT avg(pts_per_poss_off - 112.9) AS mean_diff_off, avg(pts_per_poss_def - 112.9) AS mean_diff_def, count(*) AS n_games,
  sum(total_poss_off::DOUBLE / total_team_poss_off * (pts_per_poss_off - 112.9)) AS weighted_off,
  sum(total_poss_def::DOUBLE / total_team_poss_def * (pts_per_poss_def - 112.9)) AS weighted_def
FROM ({ORACLES["comeback_efficiency"].replace("round(pts_per_poss_off, 6)", "pts_per_poss_off").replace("round(pts_per_poss_def, 6)", "pts_per_poss_def")})""")
def comeback_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = staged_log(spark, sf_dir)
    return G.comeback_means(G.comeback_efficiency(log, G.comeback_windows(log, DEFICIT)))


cte("led", """
SELECT season, game_id, max(CASE WHEN abs(home_score - away_score) >= 8 AND qtr < 3 THEN clock END) AS first_big,
  min(CASE WHEN abs(home_score - away_score) >= 8 AND qtr < 3 THEN clock END) AS last_big
FROM {scores} GROUP BY ALL""")


@query("blown_leads", """
SELECT season, n_comeback, n_total_leads, n_total,
  round(n_comeback::DOUBLE / nullif(n_total_leads, 0), 6) AS comeback_pct,
  round(n_total_leads::DOUBLE / n_total, 6) AS lead_pct
FROM (SELECT l.season, count(DISTINCT l.game_id) AS n_total,
    count(DISTINCT CASE WHEN first_big IS NOT NULL THEN l.game_id END) AS n_total_leads,
    count(DISTINCT CASE WHEN c.clock < first_big THEN l.game_id END) AS n_comeback
  FROM {led} l LEFT JOIN {scores} c ON c.game_id = l.game_id AND abs(c.home_score - c.away_score) <= 3
  GROUP BY l.season)""")
def blown_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_log(spark, sf_dir).withColumnRenamed("clock", "start_game_seconds_remaining")
    return G.blown_leads(scores, big=DEFICIT).withColumns(
        {c: F.round(c, 6) for c in ("comeback_pct", "lead_pct")}
    )


@query("quickest_comebacks", """
SELECT a.season, a.game_id, last_big, max(c.clock) AS first_close, last_big - max(c.clock) AS min_time
FROM {led} a LEFT JOIN {scores} c ON c.game_id = a.game_id AND abs(c.home_score - c.away_score) <= 3
WHERE last_big IS NOT NULL GROUP BY a.season, a.game_id, last_big""")
def quickest_comebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_log(spark, sf_dir).withColumnRenamed("clock", "start_game_seconds_remaining")
    return G.quickest_comebacks(scores, big=DEFICIT)


def _mix_sql(groups: str, where: str) -> str:
    return f"""SELECT {groups}, shot_type, n, n_1, n_1 / sum(n_1) OVER (PARTITION BY {groups}) AS freq
FROM (SELECT {groups}, shot_type, count(*) AS n,
    CASE WHEN shot_type = 'free throw' THEN count(*) * 0.44::DOUBLE ELSE count(*)::DOUBLE END AS n_1
  FROM {{textlog}} WHERE shot_type IS NOT NULL AND {where} GROUP BY {groups}, shot_type)"""


IN_CLUTCH = "(adv BETWEEN -5 AND 5 AND time_minutes BETWEEN 43 AND 53)"
cte("mix_clutch", _mix_sql("team_offense", IN_CLUTCH))
cte("mix_lead", _mix_sql("team_offense, is_leading", IN_CLUTCH))
cte("mix_rest", _mix_sql("team_offense", f"NOT {IN_CLUTCH}"))


@query("clutch_shift", """
SELECT team_offense, shot_type, round(c.freq, 6) AS freq_clutch, round(r.freq, 6) AS freq_reg,
  r.freq - c.freq < 0 AS pos_neg, round(c.freq - r.freq, 6) AS delta, off_rtg
FROM {mix_clutch} c LEFT JOIN {mix_rest} r USING (team_offense, shot_type)
LEFT JOIN (SELECT team_offense, round(avg(points), 6) AS off_rtg FROM {textlog} GROUP BY ALL) USING (team_offense)""")
def clutch_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = staged_log(spark, sf_dir)
    ratings = log.groupBy("team_offense").agg(F.round(F.avg("points"), 6).alias("off_rtg"))
    return G.clutch_shift(log, ratings).withColumns(
        {c: F.round(c, 6) for c in ("freq_clutch", "freq_reg", "delta")}
    )


@query("clutch_shift_by_lead", """
SELECT team_offense, shot_type, is_leading, round(c.freq, 6) AS freq_clutch, round(r.freq, 6) AS freq_reg,
  r.freq - c.freq < 0 AS pos_neg, round(c.freq - r.freq, 6) AS delta
FROM {mix_rest} r LEFT JOIN {mix_lead} c USING (team_offense, shot_type)""")
def clutch_shift_by_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clutch_shift(staged_log(spark, sf_dir), by_lead=True).withColumns(
        {c: F.round(c, 6) for c in ("freq_clutch", "freq_reg", "delta")}
    )


cte("mix_minute", _mix_sql("time_minutes", "TRUE"))
cte("mix_grid", _mix_sql("time_minutes, adv", "TRUE"))


@query("shot_mix_by_minute", """
SELECT time_minutes, shot_type, n, n_1, round(freq, 6) AS freq, time_minutes BETWEEN 43 AND 48 AS is_clutch
FROM {mix_minute} WHERE time_minutes IS NOT NULL""")
def shot_mix_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = staged_log(spark, sf_dir).where(F.col("time_minutes").isNotNull())
    return G.shot_mix_by_minute(log).withColumn("freq", F.round("freq", 6))


@query("minute_score_grid", """
SELECT time_minutes, adv, shot_type, round(freq, 6) AS freq, round(max_freq, 6) AS max_freq
FROM (SELECT *, max(freq) OVER (PARTITION BY time_minutes, adv) AS max_freq FROM {mix_grid})
WHERE time_minutes IS NOT NULL AND adv IS NOT NULL AND n_1 > 0.4 AND shot_type = 'free throw'
  AND adv > -20 AND adv < 20""")
def minute_score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = staged_log(spark, sf_dir).dropna(subset=["time_minutes", "adv"])
    return G.minute_score_grid(log, min_n=0.4).withColumns(
        {c: F.round(c, 6) for c in ("freq", "max_freq")}
    )


@query("day_part_win_pct", """
SELECT league_year, team, week_day, time_of_day, count(*) FILTER (WHERE has_won) AS wins, count(*) AS games,
  round(count(*) FILTER (WHERE has_won)::DOUBLE / count(*), 6) AS pct_success
FROM (SELECT unnest([{'team': vt, 'has_won': vp > hp}, {'team': ht, 'has_won': NOT (vp > hp)}], recursive := true),
    dayname(d) AS week_day, CASE WHEN m <= 960 THEN 'Noon' ELSE 'Else' END AS time_of_day,
    CASE WHEN month(d) >= 10 THEN CAST(year(d) AS VARCHAR) || '-' || CAST(year(d) + 1 AS VARCHAR)
      WHEN month(d) <= 5 THEN CAST(year(d) - 1 AS VARCHAR) || '-' || CAST(year(d) AS VARCHAR) END AS league_year
  FROM (SELECT CAST(ts AS DATE) AS d, sod // 60 AS m, 'V' || CAST(user_id % 5 AS VARCHAR) AS vt,
      'H' || CAST(user_id % 7 AS VARCHAR) AS ht, k % 40 AS vp, CAST(floor(value) AS INTEGER) % 40 AS hp FROM ev))
WHERE time_of_day = 'Noon' GROUP BY ALL HAVING count(*) >= 5""".replace("FROM ev)", "FROM {ev})").replace(
    "{'team': vt, 'has_won': vp > hp}", "struct_pack(team := vt, has_won := vp > hp)").replace(
    "{'team': ht, 'has_won': NOT (vp > hp)}", "struct_pack(team := ht, has_won := NOT (vp > hp))"))
def day_part_win_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.col("user_id")
    rows = events(spark, sf_dir).select(
        F.to_date("ts").alias("game_date"),
        F.expr("sod div 60").alias("start_minute"),
        F.concat(F.lit("V"), (uid % 5).cast("string")).alias("visitor_team_name"),
        F.concat(F.lit("H"), (uid % 7).cast("string")).alias("home_team_name"),
        (F.col("k") % 40).alias("visitor_pts"),
        (F.floor("value").cast("int") % 40).alias("home_pts"),
    )
    return G.day_part_win_pct(rows).withColumn("pct_success", F.round("pct_success", 6))


@query("scoring_droughts", """
SELECT *, dense_rank() OVER (ORDER BY time_no_score DESC) AS rank_time
FROM (SELECT *, rank() OVER (ORDER BY time_no_score DESC) AS rk FROM (
  SELECT game_id, id, total_score, score_diff, stint_type,
    abs(clock - lag(clock) OVER (PARTITION BY game_id ORDER BY id)) AS time_no_score
  FROM (SELECT *, CASE WHEN score_diff = 0 AND prev <> 0 THEN 'start_stint'
      WHEN score_diff <> 0 AND prev = 0 THEN 'end_stint' END AS stint_type
    FROM (SELECT *, lag(score_diff) OVER (PARTITION BY game_id ORDER BY id) AS prev
      FROM (SELECT game_id, id, clock, (home_score + away_score)::BIGINT AS total_score,
          (home_score + away_score - lag(home_score + away_score) OVER (PARTITION BY game_id ORDER BY id))::BIGINT AS score_diff
        FROM {scores})))
  WHERE stint_type IS NOT NULL)
  WHERE time_no_score IS NOT NULL AND time_no_score <> 300)
WHERE rk <= 100""".replace("SELECT *, dense_rank", "SELECT * EXCLUDE (rk), dense_rank"))
def scoring_droughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_log(spark, sf_dir).withColumns(
        {"total_score": F.col("home_score") + F.col("away_score"), "season_type": F.lit(2)}
    )
    return G.scoring_droughts(stage(scores, "scores")).select(
        "game_id", "id", "total_score", "score_diff", "stint_type", "time_no_score", "rank_time"
    )


@query("scoring_droughts_by_season", """
SELECT game_id, id, season, season_type, time_no_score, dense_rank() OVER (PARTITION BY season, season_type ORDER BY time_no_score DESC) AS rank_time
FROM (SELECT *, rank() OVER (PARTITION BY season, season_type ORDER BY time_no_score DESC) AS rk FROM (
  SELECT game_id, id, season, season_type, abs(clock - lag(clock) OVER (PARTITION BY game_id ORDER BY id)) AS time_no_score
  FROM (SELECT *, CASE WHEN score_diff = 0 AND prev <> 0 THEN 'start_stint' WHEN score_diff <> 0 AND prev = 0 THEN 'end_stint' END AS stint_type
    FROM (SELECT *, lag(score_diff) OVER (PARTITION BY game_id ORDER BY id) AS prev
      FROM (SELECT game_id, id, season, game_id % 2 + 2 AS season_type, clock,
          home_score + away_score - lag(home_score + away_score) OVER (PARTITION BY game_id ORDER BY id) AS score_diff FROM {scores})))
  WHERE stint_type IS NOT NULL) WHERE time_no_score IS NOT NULL AND time_no_score <> 300)
WHERE rk <= 10""")
def scoring_droughts_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest of every season and type (playoffs on odd days), ties of the tenth kept."""
    scores = score_log(spark, sf_dir).withColumns(
        {"total_score": F.col("home_score") + F.col("away_score"), "season_type": F.col("game_id") % 2 + 2})
    return G.scoring_droughts(stage(scores, "scores"), n=10, within=["season", "season_type"]).select(
        "game_id", "id", "season", "season_type", "time_no_score", "rank_time")


@query("buzzer_beaters", """
SELECT team_offense, count(*) AS n_shots, count(*) FILTER (WHERE has_won) AS n_won FROM {textlog}
WHERE time >= 2880 - 1500 AND has_made AND points > 0 AND adv > 0 AND adv <= points GROUP BY team_offense""")
def buzzer_beaters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.buzzer_beaters(text_log(spark, sf_dir), last=1500)


@query("wire_to_wire", """
SELECT game_id, team_offense, min(adv) AS min_adv, max(adv) AS max_adv FROM {textlog}
WHERE has_won AND adv IS NOT NULL AND visit_score + home_score > 0 GROUP BY ALL HAVING min(adv) > 0""")
def wire_to_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.wire_to_wire(text_log(spark, sf_dir))


@query("margin_quartiles", """
SELECT season, quantile_cont(m, 0.0)::DOUBLE AS p0, quantile_cont(m, 0.25)::DOUBLE AS p25,
  quantile_cont(m, 0.5)::DOUBLE AS p50, quantile_cont(m, 0.75)::DOUBLE AS p75, quantile_cont(m, 1.0)::DOUBLE AS p100
FROM (SELECT season, abs(home_score - away_score)::DOUBLE AS m FROM {scores}) GROUP BY season""")
def margin_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_log(spark, sf_dir).withColumn(
        "margin", F.abs(F.col("home_score") - F.col("away_score"))
    )
    return G.margin_quartiles(scores, ["season"], "margin")


@query("halftime_deficit", """
SELECT g.game_id, gap, s.id, s.type AS text FROM (
  SELECT game_id, CASE WHEN 'H' || CAST(game_id % 3 AS VARCHAR) = 'H1' THEN (h - a)::BIGINT END AS gap
  FROM (SELECT game_id, max_by(home_score, id) AS h, max_by(away_score, id) AS a FROM {scores} WHERE qtr = 2 GROUP BY game_id)
  WHERE 'H' || CAST(game_id % 3 AS VARCHAR) = 'H1') g
JOIN {scores} s USING (game_id)
WHERE gap BETWEEN -20 AND 20 AND s.qtr <= 2 AND regexp_matches(s.type, 'shot')""")
def halftime_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = (F.col("game_id") % 3).cast("string")
    scores = stage(
        score_log(spark, sf_dir).withColumns(
            {
                "home_team": F.concat(F.lit("H"), third),
                "away_team": F.concat(F.lit("A"), third),
                "text": F.col("type"),
            }
        ),
        "scores",
    )
    found = G.halftime_deficit_games(scores, "H1", -20, 20)
    return G.events_of_games(scores, found, "shot").select("game_id", "gap", "id", "text")


@query("fill_updown", """
SELECT game_id, id, down, up, coalesce(down, up) AS updown, coalesce(up, down) AS downup FROM (
  SELECT game_id, id, last_value(x IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS down,
    first_value(x IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up
  FROM (SELECT game_id, id, CASE WHEN type = 'quarter' THEN id END AS x FROM {actions}))""")
def fill_updown(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("type") == "quarter", F.col("id"))
    rows = actions(spark, sf_dir).select("game_id", "id", mark.alias("x"))
    out = ordered_pass(
        rows, ["game_id"], ["id"], bucket_of("id"), {"down": fill_down("x"), "up": fill_up("x")}
    )
    return out.select(
        "game_id", "id", "down", "up",
        F.coalesce("down", "up").alias("updown"), F.coalesce("up", "down").alias("downup"),
    )
