"""Queries on players, teams, careers, matchups and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import ratio
from ..operators import stats as S
from ..operators.ranking import exact_quantiles
from ..operators.reshape import cut, longer
from ..plans import players as P
from ..session import stage
from .adapters import events, read
from .registry import ORACLES, cte, query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


# ---- names and duos --------------------------------------------------------


cte("named", """
SELECT *, substr(player, 1, 1) || substr(player, instr(player, ' ') + 1, 1) AS initials
FROM (SELECT p_name || CAST(p_partkey AS VARCHAR) AS player, p_size, p_retailprice FROM part)""")


@query("initials_rate", """
SELECT initials, total_players, total_above, CAST(CAST(total_above AS DECIMAL(7, 2)) / total_players AS DECIMAL(7, 2)) AS rate
FROM (SELECT initials, count(DISTINCT player) AS total_players,
    count(DISTINCT player) FILTER (WHERE p_size > 44 OR p_retailprice > 1000) AS total_above FROM {named} GROUP BY initials)
WHERE total_players > 10 AND total_above > 0""")
def initials_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = read(spark, sf_dir, "part").withColumn(
        "player", F.concat("p_name", F.col("p_partkey").cast("string"))
    )
    return P.initials_rate(seasons, (F.col("p_size") > 44) | (F.col("p_retailprice") > 1000))


TEAM_CODES = ["NOK", "NOP", "NJN", "WSB", "LALA", "LALB", "TOT"]


@query("duo_teams", """
WITH member AS (SELECT DISTINCT l_suppkey AS player, l_orderkey AS squad,
    ['NOH', 'NOH', 'BRK', 'WAS', 'LALA', 'LALB'][l_orderkey % 7 + 1] AS team FROM lineitem WHERE l_orderkey % 7 < 6),
mates AS (SELECT DISTINCT x.player AS one, y.player AS other, team FROM member x JOIN member y USING (squad, team) WHERE x.player <> y.player)
SELECT concat_ws(' ', one, other) AS duo, count(*) AS dis_teams FROM mates GROUP BY one, other""")
def duo_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("player"),
        _pick(F.col("l_orderkey"), TEAM_CODES).alias("team_id"),
        F.lit(1999).alias("year"),
        F.col("l_orderkey").cast("string").alias("squad"),
    )
    return P.duo_teams(lines)


CODES = ["PG", "SG-PG", "SF", "PF-C", "C", "X", "SF-PF"]


def player_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        o.alias("player"),
        (o % 37 + 1985).cast("int").alias("year"),
        _pick(o, CODES).alias("pos"),
        (F.col("o_totalprice") / 100).alias("mp"),
    )


@query("era_groups", """
SELECT "group", real_pos, count(*) AS n, min(player) AS min_player, max(year) AS max_year FROM (
  SELECT player, year, CASE WHEN year >= 1985 AND year < 1995 THEN '80s' WHEN year >= 1995 AND year < 2005 THEN '90s'
      WHEN year >= 2005 AND year < 2015 THEN '00s' WHEN year >= 2015 AND year < 2020 THEN '10s' END AS "group",
    CASE WHEN pos IN ('PG', 'SG', 'PG-SG', 'SG-PG', 'SG-SF') THEN 'G' WHEN pos IN ('SF', 'SF-SG', 'SF-PF', 'PF-SF', 'PF') THEN 'F'
      WHEN pos IN ('C-PF', 'PF-C', 'C') THEN 'C' END AS real_pos
  FROM (SELECT o_orderkey AS player, CAST(o_orderkey % 37 + 1985 AS INTEGER) AS year,
      ['PG', 'SG-PG', 'SF', 'PF-C', 'C', 'X', 'SF-PF'][o_orderkey % 7 + 1] AS pos, o_totalprice / 100 AS mp FROM orders)
  WHERE mp > 1000)
WHERE "group" IS NOT NULL AND real_pos IS NOT NULL GROUP BY ALL""")
def era_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.era_position_groups(player_seasons(spark, sf_dir)).groupBy("group", "real_pos").agg(
        F.count(F.lit(1)).alias("n"), F.min("player").alias("min_player"), F.max("year").alias("max_year")
    )


# ---- timing ----------------------------------------------------------------

cte("box", """
SELECT user_id AS player, game_id, count(*) FILTER (WHERE event_type = 'purchase') AS points,
  count(*) FILTER (WHERE event_type = 'view') AS rebounds, count(*) FILTER (WHERE event_type = 'click') AS assists
FROM {ev} GROUP BY ALL""")


@query("milestone_timing", """
SELECT player, n, round(freq, 6) AS freq, n_total_trips, round(n::DOUBLE / n_total_trips, 6) AS freq_under_minute
FROM (SELECT player, late, n, n::DOUBLE / sum(n) OVER (PARTITION BY player) AS freq FROM (
    SELECT player, sod > 43200 AS late, count(*) AS n
    FROM (SELECT e.user_id AS player, e.sod, row_number() OVER (PARTITION BY e.user_id, e.game_id ORDER BY event_id) AS rn
      FROM {ev} e JOIN {box} b ON b.player = e.user_id AND b.game_id = e.game_id
      WHERE e.event_type = 'view' AND rebounds = 2 AND assists >= 1 AND points >= 0) WHERE rn = 2 GROUP BY ALL))
JOIN (SELECT player, count(*) AS n_total_trips FROM {box} WHERE rebounds >= 2 AND assists >= 1 GROUP BY ALL) USING (player)
WHERE late""")
def milestone_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, kind = events(spark, sf_dir).withColumnRenamed("user_id", "player"), F.col("event_type")
    box = ev.groupBy("player", "game_id").agg(
        F.count_if(kind == "purchase").alias("points"),
        F.count_if(kind == "view").alias("rebounds"),
        F.count_if(kind == "click").alias("assists"),
    )
    rebounds = ev.where(kind == "view").select(
        "player", "game_id", F.col("event_id").alias("id"), (86_400 - F.col("sod")).alias("clock")
    )
    out = P.milestone_timing(box, rebounds, nth=2, min_points=0, min_assists=1, late=43_200)
    return rounded(out, "freq", "freq_under_minute")


cte("breaks", """
SELECT *, user_id % 2 AS team_id, user_id % 20 AS player, sod // 21600 + 1 AS qtr, event_type = 'error' AS is_break,
  event_type IN ('click', 'purchase') AND k >= 5 AS shooting, k % 10 = 3 AS skip, k % 10 = 4 AS miss
FROM {ev}""")
cte("break_first", """
SELECT team_id, player, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id, team_id, qtr, num ORDER BY event_id) AS rn
  FROM (SELECT *, coalesce(up, down) AS num FROM (
    SELECT *, first_value(own IGNORE NULLS) OVER (PARTITION BY game_id, qtr ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up,
      last_value(own IGNORE NULLS) OVER (PARTITION BY game_id, qtr ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS down
    FROM (SELECT *, CASE WHEN is_break THEN count(*) FILTER (WHERE is_break) OVER (PARTITION BY game_id, qtr ORDER BY event_id) END AS own FROM {breaks})))
  WHERE NOT skip AND shooting) WHERE rn = 1 AND NOT miss GROUP BY ALL""")


@query("first_action_after_break", """
SELECT *, rank_in_team_per_game - rank_team_shot AS diff_start_finish FROM (
  SELECT team_id, player, total_games, n, total_plays, round(pct, 6) AS pct_plays, round(per_game, 6) AS per_game_play,
    row_number() OVER sh AS rank_in_team_per_play,
    row_number() OVER (PARTITION BY team_id ORDER BY per_game DESC, player) AS rank_in_team_per_game,
    round(pct - lead(pct) OVER sh, 6) AS diff_1_2
  FROM (SELECT *, n::DOUBLE / total_plays AS pct, n::DOUBLE / total_games AS per_game FROM (
    SELECT f.*, g.total_games, (sum(n) OVER (PARTITION BY team_id))::BIGINT AS total_plays FROM {break_first} f
    JOIN (SELECT team_id, player, count(DISTINCT game_id) AS total_games FROM {breaks} GROUP BY ALL) g USING (team_id, player)))
  WINDOW sh AS (PARTITION BY team_id ORDER BY pct DESC, player))
LEFT JOIN (SELECT team_id, player, row_number() OVER (PARTITION BY team_id ORDER BY count(*) DESC, player) AS rank_team_shot
  FROM {breaks} WHERE shooting GROUP BY team_id, player) USING (team_id, player)""")
def first_action_after_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    rows = events(spark, sf_dir).select(
        "game_id",
        F.expr("sod div 21600 + 1").alias("qtr"),
        F.col("event_id").alias("id"),
        (F.col("user_id") % 2).alias("team_id"),
        (F.col("user_id") % 20).alias("player"),
        (kind == "error").alias("is_break"),
        (kind.isin("click", "purchase") & (k >= 5)).alias("shooting"),
        (k % 10 == 3).alias("skip"),
        (k % 10 == 4).alias("miss"),
    )
    return rounded(P.first_action_after_break(rows), "pct_plays", "per_game_play", "diff_1_2")


# ---- fantasy tables --------------------------------------------------------

BINS_SQL = """CASE WHEN p_size > 0 AND p_size <= 12 THEN '(0,12]' WHEN p_size > 12 AND p_size <= 24 THEN '(12,24]'
  WHEN p_size > 24 AND p_size <= 36 THEN '(24,36]' WHEN p_size > 36 AND p_size <= 48 THEN '(36,48]' END"""


@query("position_mix", f"""
SELECT cut_bins, pos, count(*) AS n, count(*) / 12.0::DOUBLE AS freq
FROM (SELECT {BINS_SQL} AS cut_bins, unnest(string_split(concat_ws(' ', p_name, p_type, p_brand, p_name, p_type), ' ')) AS pos FROM part)
WHERE cut_bins IS NOT NULL GROUP BY ALL""")
def position_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = read(spark, sf_dir, "part").select(
        F.col("p_size").alias("rank"),
        F.replace(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name", "p_type"), F.lit(" "), F.lit("/")).alias("pos"),
    )
    return P.position_mix_by_rank_bin(listed, breaks=(0, 12, 24, 36, 48))


@query("bin_medians", f"""
SELECT cut_bins, name, median(value) AS value FROM (
  SELECT {BINS_SQL} AS cut_bins, unnest(['price', 'key', 'size']) AS name,
    unnest([p_retailprice, p_partkey::DOUBLE, p_size::DOUBLE]) AS value FROM part)
WHERE cut_bins IS NOT NULL GROUP BY ALL""")
def bin_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = read(spark, sf_dir, "part").select(
        cut("p_size", (0, 12, 24, 36, 48)).alias("cut_bins"),
        F.col("p_retailprice").alias("price"),
        F.col("p_partkey").cast("double").alias("key"),
        F.col("p_size").cast("double").alias("size"),
    ).where(F.col("cut_bins").isNotNull())
    long = longer(binned, ["cut_bins"], ["price", "key", "size"], "name", "value")
    return exact_quantiles(long, ["cut_bins", "name"], "value", {"value": 0.5})


cte("ours", "SELECT p_name AS name, p_brand AS team, p_type AS pos, max(p_size) AS value FROM part GROUP BY ALL")
cte("theirs", """SELECT p_name AS name, p_brand AS team, p_type AS pos, min(p_size) AS value FROM part
  WHERE p_retailprice > 950 GROUP BY ALL""")


def _projections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("team"), F.col("p_type").alias("pos"),
        "p_size", "p_retailprice",
    )
    keys = ["name", "team", "pos"]
    return (
        part.groupBy(*keys).agg(F.max("p_size").alias("value")),
        part.where("p_retailprice > 950").groupBy(*keys).agg(F.min("p_size").alias("value")),
    )


@query("projection_compare", """
SELECT name, team, pos, o.value, t.value AS other_value, o.value - t.value AS diff
FROM {ours} o JOIN {theirs} t USING (name, team, pos)""")
def projection_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.projection_compare(*_projections(spark, sf_dir))[0]


@query("projection_stacked", """
SELECT s.*, o.value - t.value AS diff FROM (SELECT *, 'ours' AS type FROM {ours} UNION ALL SELECT *, 'theirs' AS type FROM {theirs}) s
LEFT JOIN {ours} o USING (name, team, pos) LEFT JOIN {theirs} t USING (name, team, pos)""")
def projection_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.projection_compare(*_projections(spark, sf_dir))[1]


# ---- careers ---------------------------------------------------------------

cte("spans", """
SELECT 'T' || CAST(year(o_orderdate) // 2 AS VARCHAR) || '-' || CAST(c_nationkey % 5 AS VARCHAR) AS team_id,
  min(year(o_orderdate)) AS min_year, max(year(o_orderdate)) AS max_year
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")


@query("franchise_succession", """
SELECT a.team_id, a.min_year, a.max_year, b.team_id AS next_team, b.max_year AS next_max_year
FROM {spans} a JOIN {spans} b ON b.min_year - a.max_year = 1""")
def franchise_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    seasons = (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("T"), F.floor(year / 2).cast("string"), F.lit("-"),
                     (F.col("c_nationkey") % 5).cast("string")).alias("team_id"),
            year.alias("year"),
        )
    )
    return P.franchise_succession(seasons)


@query("coach_reunions", """
SELECT coach, count(*) AS total_players, count(*) FILTER (WHERE total_teams >= 2) AS total_players_over_2,
  round(count(*) FILTER (WHERE total_teams >= 2)::DOUBLE / count(*), 6) AS pct_over_2
FROM (SELECT l_partkey AS player, s_nationkey AS coach, count(DISTINCT l_suppkey) AS total_teams
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
GROUP BY coach HAVING count(*) FILTER (WHERE total_teams >= 2) > 0""")
def coach_reunions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.coach_player_reunions(*_coached(spark, sf_dir)), "pct_over_2")


def _coached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(player seasons, coaches)"""
    seasons = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("player"), F.col("l_suppkey").cast("string").alias("team_id"),
        F.year("l_shipdate").alias("year"),
    )
    links = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("/teams/"), F.col("s_suppkey").cast("string"), F.lit("/1999.html")).alias("team_name"),
        F.col("s_nationkey").alias("coach"),
        F.explode(F.sequence(F.lit(1995), F.lit(2002)).cast("array<string>")).alias("season"),
    )
    return seasons, P.clean_coaches(links)


@query("coach_reunions_succession", """
WITH step AS (SELECT CAST(s_suppkey AS VARCHAR) AS team_id, CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 1 ELSE s_suppkey + 2 END AS VARCHAR) AS next_team
  FROM supplier WHERE s_suppkey % 5 < 2),
met AS (SELECT DISTINCT l_partkey AS player, s_nationkey AS coach, coalesce(b.next_team, a.next_team, CAST(l_suppkey AS VARCHAR)) AS team_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN step a ON a.team_id = CAST(l_suppkey AS VARCHAR) LEFT JOIN step b ON b.team_id = a.next_team)
SELECT coach, count(*) AS total_players, count(*) FILTER (WHERE total_teams >= 2) AS total_players_over_2,
  round(count(*) FILTER (WHERE total_teams >= 2)::DOUBLE / count(*), 6) AS pct_over_2
FROM (SELECT player, coach, count(*) AS total_teams FROM met GROUP BY ALL) GROUP BY coach HAVING count(*) FILTER (WHERE total_teams >= 2) > 0""")
def coach_reunions_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with franchises that were renamed, some of them twice: the dimension is joined two times."""
    team = F.col("s_suppkey")
    succession = read(spark, sf_dir, "supplier").where(team % 5 < 2).select(
        team.cast("string").alias("team_id"), F.when(team % 5 == 0, team + 1).otherwise(team + 2).cast("string").alias("next_team"))
    return rounded(P.coach_player_reunions(*_coached(spark, sf_dir), succession), "pct_over_2")


RULES = ((1996, "0001"), (1997, "0012"), (1999, "0003"))
cte("selected", """
SELECT name, year, injury_replacement, year = min(year) OVER (PARTITION BY name) AS is_first,
  min(year) OVER (PARTITION BY name) AS first_year
FROM (SELECT DISTINCT c_name AS name, year(o_orderdate) AS year, CASE WHEN (year(o_orderdate) = 1996 AND contains(c_name, '0001'))
    OR (year(o_orderdate) = 1997 AND contains(c_name, '0012')) OR (year(o_orderdate) = 1999 AND contains(c_name, '0003')) THEN TRUE
    ELSE o_orderpriority = '1-URGENT' END AS injury_replacement
  FROM orders JOIN customer ON o_custkey = c_custkey)""")


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_name").alias("name"), F.year("o_orderdate").alias("year"),
            (F.col("o_orderpriority") == "1-URGENT").alias("injury_replacement"),
        )
    )


@query("first_selection_share", """
SELECT injury_replacement, count(*) FILTER (WHERE is_first) AS sum_first, count(*) AS sum_players,
  round(count(*) FILTER (WHERE is_first)::DOUBLE / count(*), 6) AS freq
FROM {selected} GROUP BY ALL""")
def first_selection_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.first_share(P.allstar_first_time(_selections(spark, sf_dir), RULES)), "freq")


@query("decade_means", """
SELECT decade, count(*) AS num_first, round(sum(age)::DOUBLE / count(*), 6) AS mean_age, round(sum(exp)::DOUBLE / count(*), 6) AS mean_exp,
  round(sum(mp)::DOUBLE / sum(g), 6) AS mean_min, round(sum(pts)::DOUBLE / sum(g), 6) AS mean_pts,
  round(sum(fg)::DOUBLE / sum(fga), 6) AS mean_pct, round(sum(trb)::DOUBLE / sum(g), 6) AS mean_reb, round(sum(ast)::DOUBLE / sum(g), 6) AS mean_ast
FROM (SELECT *, year - start_year + 1 AS exp, CASE WHEN year > 1979 AND year <= 1989 THEN '80s' WHEN year > 1989 AND year <= 1999 THEN '90s'
    WHEN year > 1999 AND year <= 2009 THEN '00s' WHEN year > 2009 AND year <= 2023 THEN '10s' END AS decade
  FROM (SELECT * FROM {selected} WHERE is_first) JOIN (
    SELECT c_name AS name, year(o_orderdate) AS year, max(c_custkey % 20 + 19) AS age, count(*) * 30 AS mp, count(*) AS g,
      sum(o_orderkey % 40) AS pts, max(1990) AS start_year, sum(o_orderkey % 9) AS fg, sum(o_orderkey % 9 + 8) AS fga, sum(o_orderkey % 13) AS trb, sum(o_orderkey % 7) AS ast
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) USING (name, year))
WHERE decade IS NOT NULL GROUP BY decade""")
def decade_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_name").alias("name"), F.year("o_orderdate").alias("year"))
        .agg(
            F.max(F.col("c_custkey") % 20 + 19).alias("age"),
            (F.count(F.lit(1)) * 30).alias("mp"),
            F.count(F.lit(1)).alias("g"),
            F.sum(F.col("o_orderkey") % 40).alias("pts"),
            F.lit(1990).alias("start_year"),
            F.sum(F.col("o_orderkey") % 9).alias("fg"),
            F.sum(F.col("o_orderkey") % 9 + 8).alias("fga"),
            F.sum(F.col("o_orderkey") % 13).alias("trb"),
            F.sum(F.col("o_orderkey") % 7).alias("ast"),
        )
    )
    marked = P.allstar_first_time(_selections(spark, sf_dir), RULES)
    return rounded(P.decade_means(marked, stats), "mean_age", "mean_exp", "mean_min", "mean_pts", "mean_pct", "mean_reb", "mean_ast")


# ---- game logs -------------------------------------------------------------


@query("cumulative_wins", """
SELECT user_id % 20 AS team_id, event_id AS id, CAST(ts AS DATE) AS game_date, k::DOUBLE AS passes_made,
  sum((event_type = 'purchase')::INT::DOUBLE) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS num_wins FROM {ev}""")
def cumulative_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("team_id"), F.col("event_id").alias("id"),
        F.concat(F.lit("/stats?DateFrom="), F.to_date("ts").cast("string"), F.lit("&Mode=x")).alias("url"),
        F.col("k").cast("string").alias("passes_made"),
        F.when(F.col("event_type") == "purchase", "1").otherwise("0").alias("w"),
    )
    return P.cumulative_wins(log, ["team_id"]).drop("w")


cte("team_days", "SELECT user_id % 2 AS team_id, CAST(ts AS DATE) AS game_date, sum(k)::DOUBLE AS rate FROM {ev} GROUP BY ALL")


@query("played_vs_missed", """
WITH played AS (SELECT user_id % 2 AS team_id, CAST(ts AS DATE) AS game_date, user_id AS player, avg(k) AS own FROM {ev} WHERE event_type = 'purchase' GROUP BY ALL),
grid AS (SELECT p.team_id, p.player, t.game_date, t.rate, pl.own, pl.player IS NOT NULL AS has_played
  FROM (SELECT DISTINCT team_id, player FROM played) p JOIN {team_days} t USING (team_id)
  LEFT JOIN played pl ON pl.team_id = p.team_id AND pl.player = p.player AND pl.game_date = t.game_date),
sums AS (SELECT team_id, player, avg(own) AS mean_own, count(*) FILTER (WHERE has_played) AS games_played_true,
    count(*) FILTER (WHERE NOT has_played) AS games_played_false,
    sum(rate) FILTER (WHERE has_played) / count(*) FILTER (WHERE has_played) AS mean_true,
    sum(rate) FILTER (WHERE NOT has_played) / nullif(count(*) FILTER (WHERE NOT has_played), 0) AS mean_false
  FROM grid GROUP BY ALL)
SELECT team_id, player, games_played_true, games_played_false, round(mean_true, 6) AS mean_true, round(mean_false, 6) AS mean_false, round(mean_own, 6) AS mean_own, on_off, rank_passing
FROM (SELECT *, dense_rank() OVER (ORDER BY on_off DESC) AS rank_passing
  FROM (SELECT *, round(mean_true - mean_false, 6) AS on_off FROM sums WHERE games_played_false >= 5 AND games_played_true > 5 AND mean_own >= 50))
WHERE rank_passing <= 15""")
def played_vs_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select(
        (F.col("user_id") % 2).alias("team_id"), F.to_date("ts").alias("game_date"),
        F.col("user_id").alias("player"), "event_type", "k",
    )
    team_games = ev.groupBy("team_id", "game_date").agg(F.sum("k").cast("double").alias("rate"))
    played = ev.where(F.col("event_type") == "purchase")
    out = P.played_vs_missed(team_games, played, min_played=5, min_missed=5, own="k", min_own=50)
    return rounded(out, "mean_true", "mean_false", "mean_own")


@query("win_loss_shift", """
WITH s AS (SELECT l_suppkey AS team_id, l_returnflag = 'R' AS won, sum(l_quantity)::BIGINT AS passes_made,
    sum(l_linenumber)::BIGINT AS potential_ast FROM lineitem GROUP BY ALL)
SELECT team_id, x.passes_made AS passes_made_x, x.potential_ast AS potential_ast_x, y.passes_made AS passes_made_y,
  y.potential_ast AS potential_ast_y, x.passes_made - y.passes_made AS pass_change, x.potential_ast - y.potential_ast AS pot_ast_change,
  round(round(x.potential_ast::DOUBLE / x.passes_made - y.potential_ast::DOUBLE / y.passes_made, 3) * 100, 4) AS pass_ratio_change,
  dense_rank() OVER (ORDER BY y.passes_made DESC) AS rank_pass_win, dense_rank() OVER (ORDER BY x.passes_made DESC) AS rank_pass_loss
FROM (SELECT * FROM s WHERE NOT won) x JOIN (SELECT * FROM s WHERE won) y USING (team_id)""")
def win_loss_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "team_id")
    side = lambda cond: lines.where(cond).groupBy("team_id").agg(
        F.sum("l_quantity").cast("long").alias("passes_made"),
        F.sum("l_linenumber").alias("potential_ast"),
    )
    out = P.win_loss_shift(side("l_returnflag <> 'R'"), side("l_returnflag = 'R'"))
    return rounded(out, "pass_ratio_change", digits=4)


@query("rate_regression", """
SELECT l_returnflag AS team, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  round(sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / (count(*) - 2)
    / regr_sxx(l_extendedprice, l_quantity)), 4) AS slope_se, count(*) AS n
FROM lineitem GROUP BY l_returnflag""")
def rate_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "team")
    fit = S.regression_lines(lines, ["team"], "l_extendedprice", "l_quantity")
    return fit.withColumns({
        "slope": F.round("slope", 4), "intercept": F.round("intercept", 3),
        "r2": F.round("r2", 6), "slope_se": F.round("slope_se", 4),
    })


@query("threshold_split", """
SELECT l_returnflag AS team, l_quantity > 28 AS above, round(avg(l_extendedprice), 4) AS mean_rating,
  count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL""")
def threshold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("team"), (F.col("l_quantity") > 28).alias("above"),
        "l_orderkey", "l_extendedprice",
    )
    per_game = lines.groupBy("team", "above", "l_orderkey").agg(
        F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("c")
    )
    return per_game.groupBy("team", "above").agg(
        F.round(F.sum("s") / F.sum("c"), 4).alias("mean_rating"), F.count(F.lit(1)).alias("n")
    )


@query("correlation", """
SELECT l_returnflag AS team, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n,
  round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) ** 2)), 3) AS t, count(*) - 2 AS df
FROM lineitem GROUP BY l_returnflag""")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "team")
    out = S.correlation(lines, ["team"], "l_quantity", "l_extendedprice")
    return out.withColumns({"r": F.round("r", 6), "t": F.round("t", 3)})


# ---- matchups --------------------------------------------------------------


@query("matchup_bins", """
WITH m AS (SELECT l_returnflag AS team_id, year(l_shipdate) AS year, p_size % 25 + 68 AS ho, (s_suppkey % 25 + 68) AS hd,
    l_quantity AS poss, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS blk, l_linenumber % 5 + 2 AS fga, l_linenumber % 2 + 1 AS fgm, l_linenumber % 3 AS fg3a,
    l_linenumber % 3 // 2 AS fg3m, l_linenumber AS pts, l_linenumber + 2 AS team_pts
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT *, round(sum_blk::DOUBLE / sum_poss, 6) AS blocks_per_poss, round(f, 6) AS freq,
  round(sum_fgm::DOUBLE / sum_fga, 6) AS fg_pct, round((sum_fgm - sum_fg3m)::DOUBLE / (sum_fga - sum_fg3a), 6) AS two_pct, round(sum_fg3m::DOUBLE / sum_fg3a, 6) AS three_pct,
  round(sum_pts::DOUBLE / sum_poss, 6) AS pts_per_poss_player, round(sum_team_pts::DOUBLE / sum_poss, 6) AS pts_per_poss_team, round(sum_fga::DOUBLE / sum_poss, 6) AS shot_freq,
  round(f - lag(f) OVER (PARTITION BY team_id, type_diff ORDER BY year), 6) AS diff_freq
FROM (SELECT team_id, year, type_diff, sum(poss)::BIGINT AS sum_poss, sum(blk)::BIGINT AS sum_blk, sum(fga)::BIGINT AS sum_fga, sum(fgm)::BIGINT AS sum_fgm,
    sum(fg3a)::BIGINT AS sum_fg3a, sum(fg3m)::BIGINT AS sum_fg3m, sum(pts)::BIGINT AS sum_pts, sum(team_pts)::BIGINT AS sum_team_pts,
    sum(poss)::DOUBLE / sum(sum(poss)) OVER (PARTITION BY team_id, year) AS f
  FROM (SELECT *, CASE WHEN ho - hd >= 3 THEN 'up' WHEN ho - hd <= -3 THEN 'down' ELSE 'same' END AS type_diff FROM m WHERE ho > 67 AND ho <= 92)
  GROUP BY team_id, year, type_diff)""".replace("SELECT *, round(sum_blk", "SELECT * EXCLUDE (f), round(sum_blk"))
def matchup_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    rows = (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_returnflag").alias("team_id"), F.year("l_shipdate").alias("year"),
            (F.col("p_size") % 25 + 68).alias("height_off"), (F.col("s_suppkey") % 25 + 68).alias("height_def"),
            F.col("l_quantity").cast("long").alias("poss"), (F.col("l_discount") > 0.05).cast("int").alias("blk"),
            (line % 5 + 2).alias("fga"), (line % 2 + 1).alias("fgm"), (line % 3).alias("fg3a"), F.expr("l_linenumber % 3 div 2").alias("fg3m"),
            line.alias("pts"), (line + 2).alias("team_pts"),
        )
    )
    out = P.matchup_height(rows, ["poss", "blk", "fga", "fgm", "fg3a", "fg3m", "pts", "team_pts"])
    return rounded(out, "freq", "blocks_per_poss", "diff_freq", "fg_pct", "two_pct", "three_pct", "pts_per_poss_player", "pts_per_poss_team", "shot_freq")


@query("matchup_blocks", """
WITH p AS (SELECT l_returnflag AS team_id, year(l_shipdate) AS year, CASE WHEN p_size % 25 + 68 > 87 THEN '(87,92]' WHEN p_size % 25 + 68 > 82 THEN '(82,87]'
    WHEN p_size % 25 + 68 > 77 THEN '(77,82]' WHEN p_size % 25 + 68 > 72 THEN '(72,77]' ELSE '(67,72]' END AS height_bin,
    p_brand AS off_player, s_suppkey AS def_player, count(*) AS total_blocks, sum(l_quantity)::BIGINT AS total_poss
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE (p_size % 25 + 68) - (s_suppkey % 25 + 68) >= 3 AND l_discount > 0.05 GROUP BY ALL HAVING sum(l_quantity) >= 30)
SELECT team_id, year, height_bin, off_player, def_player, total_blocks, total_poss, round(r, 6) AS blocks_per_poss, rank_blk FROM (
  SELECT *, total_blocks::DOUBLE / total_poss AS r, dense_rank() OVER (ORDER BY total_blocks::DOUBLE / total_poss DESC) AS rank_blk FROM p)
WHERE rank_blk <= 100""")
def matchup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_returnflag").alias("team_id"), F.year("l_shipdate").alias("year"),
            F.col("p_brand").alias("off_player"), F.col("s_suppkey").alias("def_player"),
            (F.col("p_size") % 25 + 68).alias("height_off"), (F.col("s_suppkey") % 25 + 68).alias("height_def"),
            F.col("l_quantity").cast("long").alias("poss"), (F.col("l_discount") > 0.05).cast("int").alias("blk"),
        )
    )
    return rounded(P.matchup_blocks(rows, keys=["team_id", "year", "height_bin"]), "blocks_per_poss")


RATE_SQL = {
    "pts": "pts / poss", "fga": "fga / poss", "teampts": "team_pts / poss", "pct": "fgm / fga", "ast": "ast / poss",
    "tov": "tov / poss", "fta": "fta / poss", "ts": "pts / (2 * (fga + 0.44 * fta))", "ts_att": "2 * (fga + 0.44 * fta) / poss",
    "fg3a": "fg3a / poss", "fg3m": "fg3m / poss",
}


@query("defender_effect", """
WITH m AS (SELECT p_brand AS player, g.s_suppkey IS NOT NULL AS best_defender, sum(l_quantity)::DOUBLE AS poss, sum(l_linenumber)::DOUBLE AS pts,
    sum(l_linenumber + 2)::DOUBLE AS team_pts, sum(l_linenumber % 3 + 1)::DOUBLE AS fga, sum(l_linenumber % 2)::DOUBLE AS fgm,
    sum(l_partkey % 3)::DOUBLE AS ast, sum(l_suppkey % 2)::DOUBLE AS tov, sum(l_orderkey % 4)::DOUBLE AS fta,
    sum(l_partkey % 4)::DOUBLE AS fg3a, sum(l_partkey % 4 // 2)::DOUBLE AS fg3m
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal > 5000) g ON l_suppkey = g.s_suppkey
  GROUP BY ALL),
r AS (SELECT player, best_defender, poss::BIGINT AS total_poss, """ + ", ".join(f"{e} AS {n}" for n, e in RATE_SQL.items()) + """ FROM m)
SELECT player, best_defender, total_poss, """ + ", ".join(f"round({n}, 6) AS {n}_rate" for n in RATE_SQL) + ", "
       + ", ".join(f"round({n} - lag({n}) OVER w, 6) AS {n}_prev" for n in RATE_SQL)
       + " FROM r WINDOW w AS (PARTITION BY player ORDER BY best_defender)")
def defender_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    best = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(
        F.col("s_suppkey").alias("l_suppkey")
    )
    lines = read(spark, sf_dir, "lineitem").join(
        read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    rows = P.flag_listed(lines, best, "l_suppkey", "best_defender").select(
        F.col("p_brand").alias("player"), "best_defender", F.col("l_quantity").cast("long").alias("poss"),
        line.alias("pts"), (line + 2).alias("team_pts"), (line % 3 + 1).alias("fga"), (line % 2).alias("fgm"),
        (F.col("l_partkey") % 3).alias("ast"), (F.col("l_suppkey") % 2).alias("tov"), (F.col("l_orderkey") % 4).alias("fta"),
        (F.col("l_partkey") % 4).alias("fg3a"), F.expr("l_partkey % 4 div 2").alias("fg3m"),
    )
    cols = [f"{n}_{s}" for s in ("rate", "prev") for n in RATE_SQL]
    out = P.defender_effect(rows).select("player", "best_defender", "total_poss", *cols)
    return rounded(out, *cols)


@query("rolling_form", """
SELECT player, opponent, id, round(mp, 6) AS roll_mean_points, round(ma, 6) AS roll_mean_fga, round(mm, 6) AS roll_mean_fgm, round(pct, 6) AS roll_mean_pct
FROM (SELECT *, max(pct) OVER (PARTITION BY player, opponent) AS best FROM (
  SELECT *, mm / nullif(ma, 0) AS pct FROM (
    SELECT player, opponent, id, CASE WHEN count(*) OVER w = 6 THEN avg(points) OVER w END AS mp,
      CASE WHEN count(*) OVER w = 6 THEN avg(fga) OVER w END AS ma, CASE WHEN count(*) OVER w = 6 THEN avg(fgm) OVER w END AS mm
    FROM (SELECT user_id % 20 AS player, event_type AS opponent, event_id AS id, k AS points, k % 17 + 1 AS fga, k % 13 AS fgm FROM {ev})
    WINDOW w AS (PARTITION BY player, opponent ORDER BY id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)))) WHERE pct = best""")
def rolling_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = events(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("player"), F.col("event_type").alias("opponent"), F.col("event_id").alias("id"),
        F.col("k").alias("points"), (F.col("k") % 17 + 1).alias("fga"), (F.col("k") % 13).alias("fgm"),
    )
    cols = ["roll_mean_points", "roll_mean_fga", "roll_mean_fgm", "roll_mean_pct"]
    return rounded(P.rolling_form(box, ["player", "opponent"]).select("player", "opponent", "id", *cols), *cols)


@query("rolling_form_full", """
SELECT player, opponent, id, round(mp, 6) AS roll_mean_points, round(mr, 6) AS roll_mean_rebounds, round(mt, 6) AS roll_mean_assists, round(pct, 6) AS roll_mean_pct
FROM (SELECT *, max(pct) OVER (PARTITION BY player, opponent) AS best FROM (
  SELECT *, mm / nullif(ma, 0) AS pct FROM (
    SELECT player, opponent, id, CASE WHEN count(*) OVER w = 4 THEN avg(points) OVER w END AS mp, CASE WHEN count(*) OVER w = 4 THEN avg(rebounds) OVER w END AS mr,
      CASE WHEN count(*) OVER w = 4 THEN avg(assists) OVER w END AS mt, CASE WHEN count(*) OVER w = 4 THEN avg(fga) OVER w END AS ma, CASE WHEN count(*) OVER w = 4 THEN avg(fgm) OVER w END AS mm
    FROM (SELECT user_id % 20 AS player, event_type AS opponent, event_id AS id, k AS points, k % 11 AS rebounds, k % 7 AS assists, k % 17 + 1 AS fga, k % 13 AS fgm FROM {ev})
    WINDOW w AS (PARTITION BY player, opponent ORDER BY id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)))) WHERE pct = best AND mp >= 30""")
def rolling_form_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics over four games, the best rates among spans of 30 points a game."""
    k = F.col("k")
    box = events(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("player"), F.col("event_type").alias("opponent"), F.col("event_id").alias("id"),
        k.alias("points"), (k % 11).alias("rebounds"), (k % 7).alias("assists"), (k % 17 + 1).alias("fga"), (k % 13).alias("fgm"))
    cols = ["roll_mean_points", "roll_mean_rebounds", "roll_mean_assists", "roll_mean_pct"]
    return rounded(P.rolling_form(box, ["player", "opponent"], 4, 30).select("player", "opponent", "id", *cols), *cols)


@query("player_vs_opponent", """
SELECT user_id % 20 AS player, event_type AS opponent, count(*) AS n, round(sum(k % 13)::DOUBLE / sum(k % 17 + 1), 6) AS fg_pct
FROM {ev} GROUP BY ALL""")
def player_vs_opponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(
        (F.col("user_id") % 20).alias("player"), F.col("event_type").alias("opponent")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(ratio(F.sum(F.col("k") % 13), F.sum(F.col("k") % 17 + 1)), 6).alias("fg_pct"),
    )


@query("with_without", """
SELECT b.l_orderkey IS NULL AS missing, a.l_returnflag = 'R' AS team_winner, round(avg(a.l_quantity), 6) AS mean_minutes, count(*) AS n
FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) a LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 5) b ON a.l_orderkey = b.l_orderkey
GROUP BY ALL""")
def with_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("player"),
        F.col("l_quantity").alias("minutes"), (F.col("l_returnflag") == "R").alias("team_winner"),
    )
    return rounded(P.with_without_teammate(box, 1, 5), "mean_minutes")


# ---- team tables, statistics -----------------------------------------------

cte("contest", """
SELECT team_name, slug, round(fg3m / fg3a, 6) AS opp_fg3_pct, round(def_rating, 6) AS def_rating, round(c3 / fg3a, 6) AS pct_three_contested,
  round(c2 / (fga - fg3a), 6) AS pct_two_contested, round(fg3a / fga, 6) AS freq_3pt, round((fgm + 0.5 * fg3m) / fga, 6) AS opp_efg,
  round(100 * defl / pace, 6) AS deflections_per_100
FROM (SELECT s_name AS team_name, 'S' || CAST(s_suppkey AS VARCHAR) AS slug, sum(l_quantity) AS fga, sum(l_linenumber)::DOUBLE AS fg3a,
    sum(l_linenumber % 2)::DOUBLE AS fg3m, sum(l_linenumber % 3)::DOUBLE AS fgm, sum(l_orderkey % 3)::DOUBLE AS c3, sum(l_partkey % 4)::DOUBLE AS c2,
    sum(l_orderkey % 5)::DOUBLE AS defl, count(*)::DOUBLE AS pace, (max(l_orderkey) % 100)::DOUBLE AS def_rating
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, s_suppkey)""")


def _contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("team_name")
    )
    line, order, part = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey")
    totals = stage(
        read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("team_id")).agg(
            F.sum("l_quantity").alias("opp_fga"), F.sum(line).alias("opp_fg3a"), F.sum(line % 2).alias("opp_fg3m"),
            F.sum(line % 3).alias("opp_fgm"), F.sum(order % 3).alias("contested_3pt"), F.sum(part % 4).alias("contested_2pt"),
            F.sum(order % 5).alias("deflections"), F.count(F.lit(1)).alias("pace"), (F.max(order) % 100).alias("def_rating"),
        ).join(sup, "team_id"),
        "team_totals",
    )
    text = lambda *cols: totals.select("team_id", "team_name", *[F.col(c).cast("string").alias(c) for c in cols])
    opponent = text("opp_fga", "opp_fg3a", "opp_fg3m", "opp_fgm").withColumn(
        "opp_fg3_pct", ratio(F.col("opp_fg3m").cast("double"), F.col("opp_fg3a").cast("double")).cast("string")
    )
    slugs = sup.select("team_name", F.concat(F.lit("S"), F.col("team_id").cast("string")).alias("slug"))
    out = P.contest_effect(
        text("contested_3pt", "contested_2pt", "deflections"), text("pace", "def_rating"), opponent, slugs
    )
    return rounded(out, *[c for c in out.columns if c not in ("team_name", "slug")])


@query("contest_effect", "SELECT * FROM {contest}")
def contest_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contest(spark, sf_dir)


@query("contest_correlation", """
SELECT 1 AS grp, round(corr(pct_three_contested, opp_fg3_pct), 5) AS r, count(*) AS n FROM {contest}""")
def contest_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _contest(spark, sf_dir).withColumn("grp", F.lit(1))
    return rounded(S.correlation(table, ["grp"], "pct_three_contested", "opp_fg3_pct").select("grp", "r", "n"), "r", digits=5)


@query("rank_sum_matrix", """
WITH long AS (SELECT o_orderpriority AS g, unnest(['o_totalprice', 'o_custkey', 'day']) AS metric,
    unnest([o_totalprice, o_custkey::DOUBLE, day(o_orderdate)::DOUBLE]) AS value FROM orders),
pairs AS (SELECT DISTINCT a.g AS group_1, b.g AS group_2 FROM long a JOIN (SELECT DISTINCT g FROM long) b ON a.g < b.g),
ranked AS (SELECT group_1, group_2, metric, g, rank() OVER w + (count(*) OVER (PARTITION BY group_1, group_2, metric, value) - 1) / 2.0 AS mid,
    count(*) OVER (PARTITION BY group_1, group_2, metric, value) AS t
  FROM pairs JOIN long ON g = group_1 OR g = group_2 WINDOW w AS (PARTITION BY group_1, group_2, metric ORDER BY value)),
u AS (SELECT group_1, group_2, metric, count(*) FILTER (WHERE g = group_1)::DOUBLE AS n1, count(*) FILTER (WHERE g = group_2)::DOUBLE AS n2,
    sum(mid) FILTER (WHERE g = group_1)::DOUBLE - n1 * (n1 + 1) / 2 AS w, sum(t::DOUBLE * t - 1) AS ties FROM ranked GROUP BY ALL),
z AS (SELECT *, (w - n1 * n2 / 2 - 0.5 * sign(w - n1 * n2 / 2)) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)
SELECT metric, group_1, group_2, n1::BIGINT AS n1, n2::BIGINT AS n2, w, round(z, 5) AS z,
  round(2 * 0.3989422804014327 * exp(-z * z / 2) * (0.319381530 * t + -0.356563782 * t ** 2 + 1.781477937 * t ** 3 + -1.821255978 * t ** 4 + 1.330274429 * t ** 5), 6) AS p_value
FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z)""")
def rank_sum_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("day", F.dayofmonth("o_orderdate"))
    out = S.rank_sum_matrix(orders, "o_orderpriority", PRIORITIES, ["o_totalprice", "o_custkey", "day"])
    return out.withColumns({"z": F.round("z", 5), "p_value": F.round("p_value", 6)})


@query("rank_sum_holm", f"""
SELECT metric, group_1, group_2, round(max(step) OVER (PARTITION BY metric ORDER BY p_value, group_1, group_2 ROWS UNBOUNDED PRECEDING), 6) AS p_holm
FROM (SELECT *, least(1, (count(*) OVER (PARTITION BY metric) + 1 - row_number() OVER (PARTITION BY metric ORDER BY p_value, group_1, group_2)) * p_value) AS step
  FROM ({ORACLES["rank_sum_matrix"]}))""")
def rank_sum_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.with_holm(rank_sum_matrix(spark, sf_dir), ["metric"])
    return out.select("metric", "group_1", "group_2", F.round("p_holm", 6).alias("p_holm"))


@query("glm_binomial", """
WITH cell AS (SELECT l_returnflag = 'R' AS a, l_linenumber > 3 AS b, avg(l_quantity / 50.0) AS m FROM lineitem GROUP BY ALL),
z AS (SELECT max(ln(m / (1 - m))) FILTER (NOT a AND NOT b) AS z00, max(ln(m / (1 - m))) FILTER (a AND NOT b) AS z10,
  max(ln(m / (1 - m))) FILTER (NOT a AND b) AS z01, max(ln(m / (1 - m))) FILTER (a AND b) AS z11 FROM cell)
SELECT unnest(['(Intercept)', 'comeback_win', 'late', 'comeback_win:late']) AS term,
  round(unnest([z00, z10 - z00, z01 - z00, z11 - z10 - z01 + z00]), 3) AS estimate FROM z""")
def glm_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """freq ~ comeback_win * late on line items: the model is saturated, so its terms are differences of the cells' logits."""
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50.0).alias("freq"),
        (F.col("l_returnflag") == "R").cast("double").alias("comeback_win"),
        (F.col("l_linenumber") > 3).cast("double").alias("late"),
    )
    return rounded(S.binomial_glm(rows, "freq ~ comeback_win + late + comeback_win:late"), "estimate", digits=3)


# ---- dictionaries ----------------------------------------------------------


@query("draft_clean", r"""
SELECT player, seasons, year, r[4] AS real_name FROM (
  SELECT *, regexp_split_to_array(link, '[^A-Za-z0-9]+') AS r FROM (
    SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'Player' WHEN s_suppkey % 15 = 1 THEN 'Round 2' ELSE s_name END AS player,
      CASE WHEN s_nationkey = 3 THEN 'Minnesota 4' ELSE CAST(s_nationkey AS VARCHAR) END AS seasons, 1990 + s_nationkey AS year,
      '/players/a/p' || CAST(s_suppkey AS VARCHAR) || '.html' AS link FROM supplier)
  WHERE player NOT IN ('Player', 'Round 2') AND NOT regexp_matches(seasons, 'Minnesota'))""")
def draft_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    draft = read(spark, sf_dir, "supplier").select(
        F.when(key % 10 == 0, "Player").when(key % 15 == 1, "Round 2").otherwise(F.col("s_name")).alias("player"),
        F.when(nation == 3, "Minnesota 4").otherwise(nation.cast("string")).alias("seasons"),
        (nation + 1990).alias("year"),
        F.concat(F.lit("/players/a/p"), key.cast("string"), F.lit(".html")).alias("link"),
    )
    return P.draft_clean(draft)


@query("id_dictionary", r"""
SELECT DISTINCT p_name AS name, ' ' || p_type AS pos, '/nba/player/_/id/' || CAST(p_size * 100 AS VARCHAR) || '/x' AS link,
  CAST(p_size * 100 AS VARCHAR) AS id FROM part""")
def id_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "part").select(
        F.concat_ws(", ", "p_name", "p_type").alias("cell"),
        F.concat(F.lit("/nba/player/_/id/"), (F.col("p_size") * 100).cast("string"), F.lit("/x")).alias("link"),
    )
    return P.id_dictionary(pages)
