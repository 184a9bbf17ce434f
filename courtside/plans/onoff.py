"""On/off impact of players and lineups.

Ratings only need sums per (lineup, side), so the possession table is summed
per lineup hash before it meets the player rows: the join carries one row per
lineup and side instead of every event of a heavily used lineup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import ratio
from ..operators.ranking import value_ranks
from ..operators.reshape import longer
from ..operators.verbs import keep_groups_where_all

SUMS = {
    "total_pts": lambda: F.sum("team_score"),
    "total_poss": lambda: F.sum(F.col("final_end_poss").cast("int")),
}
HIGHER_BETTER = ["total_net_rtg", "offense_on_ppp", "offense_off_ppp", "offense_on_net"]
LOWER_BETTER = ["defense_on_ppp", "defense_off_ppp", "defense_on_net"]


def _sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[f().alias(n) for n, f in SUMS.items()])


def _ppp() -> Column:
    return F.round(ratio(F.col("total_pts"), F.col("total_poss"), 100), 1)


def player_side_sums(lineups: DataFrame, sided: DataFrame) -> DataFrame:
    """Points, possessions and PPP per (player, team, on/off, side)."""
    on_off = lineups.select(
        "player_id", "team_id", "lineup_hash",
        F.coalesce("is_on_verdict", F.lit(False)).alias("is_on_verdict"),
    ).distinct()
    per_lineup = _sums(sided, ["lineup_hash", "type_lineup"])
    return (
        on_off.join(per_lineup, "lineup_hash")
        .groupBy("player_id", "team_id", "is_on_verdict", "type_lineup")
        .agg(F.sum("total_pts").alias("total_pts"), F.sum("total_poss").alias("total_poss"))
        .withColumn("ppp_calc", _ppp())
    )


def _net_columns(rated: DataFrame) -> DataFrame:
    """On minus off per side, then offense net minus defense net.

    The windows hold two rows each: off/on of a side, defense/offense of a state.
    """
    state = Window.partitionBy("player_id", "team_id", "type_lineup").orderBy("is_on_verdict")
    side = Window.partitionBy("player_id", "team_id", "is_on_verdict").orderBy("type_lineup")
    net = F.round(F.col("ppp_calc") - F.lag("ppp_calc").over(state), 6)
    return rated.withColumn("net_rtg", net).withColumn(
        "total_net_rtg", F.round(F.col("net_rtg") - F.lag("net_rtg").over(side), 2)
    )


def on_off_ratings(
    lineups: DataFrame, sided: DataFrame, rosters: DataFrame, min_poss: int = 100
) -> DataFrame:
    """Ratings of the players who have enough possessions in every state."""
    names = rosters.select("player_id", "team_id", "first_name", "last_name").distinct()
    rated = player_side_sums(lineups, sided).join(names, ["player_id", "team_id"])
    eligible = keep_groups_where_all(rated, ["player_id"], F.col("total_poss") >= min_poss)
    return _net_columns(eligible)


def on_off_table(
    lineups: DataFrame,
    sided: DataFrame,
    rosters: DataFrame,
    schedule: DataFrame,
    date_range: tuple[str, str] | None = None,
    teams: Sequence[str] | None = None,
    min_all: int = 0,
    min_on: int = 0,
    min_net: float | None = None,
) -> DataFrame:
    """One row per player and team: on/off PPP by side, nets, possessions.

    Team and date filters come first; the team list is resolved by a semi-join,
    so nothing returns to the driver.
    """
    if teams:
        wanted = rosters.where(F.col("team_name").isin(list(teams))).select("team_id").distinct()
        lineups = lineups.join(wanted, "team_id", "left_semi")
    games = schedule.select("game_id", "game_date").distinct()
    if date_range:
        games = games.where(
            F.col("game_date").between(F.to_date(F.lit(date_range[0])), F.to_date(F.lit(date_range[1])))
        )
    played = sided.join(games, "game_id", "left_semi")
    names = rosters.select("player_id", "team_id", "team_name", "first_name", "last_name").distinct()
    rated = player_side_sums(lineups, played)
    on, off = F.col("is_on_verdict"), ~F.col("is_on_verdict")
    cell = lambda side, cond, c: F.max(
        F.when((F.col("type_lineup") == side) & cond, F.col(c).cast("double"))
    )
    poss = F.col("total_poss")
    wide = (
        _net_columns(rated)
        .groupBy("player_id", "team_id")
        .agg(
            cell("offense", on, "ppp_calc").alias("offense_on_ppp"),
            cell("offense", off, "ppp_calc").alias("offense_off_ppp"),
            cell("defense", on, "ppp_calc").alias("defense_on_ppp"),
            cell("defense", off, "ppp_calc").alias("defense_off_ppp"),
            cell("offense", on, "net_rtg").alias("offense_on_net"),
            cell("defense", on, "net_rtg").alias("defense_on_net"),
            F.max("total_net_rtg").alias("total_net_rtg"),
            F.max(F.when(on, poss.cast("double"))).alias("on_poss"),
            F.max(F.when(off, poss.cast("double"))).alias("off_poss"),
            F.min(poss).alias("_min_all"),
            F.max(F.when(on, poss).otherwise(0)).alias("_max_on"),
        )
        .where((F.col("_min_all") >= min_all) & (F.col("_max_on") >= min_on))
        .drop("_min_all", "_max_on")
    )
    if min_net is not None:
        wide = wide.where(F.col("total_net_rtg") >= min_net)
    return wide.join(names, ["player_id", "team_id"])


def on_off_display(table: DataFrame) -> DataFrame:
    """Percentile of each metric among its non-null values.

    The metrics are ranked together in long form, keyed by metric; for the
    defensive ones lower is better.
    """
    ids = ["player_id", "team_id"]
    metrics = [*HIGHER_BETTER, *LOWER_BETTER]
    long = longer(table, ids, metrics, "metric", "value", drop_null=True)
    ranks = value_ranks(long, ["metric"], "value")
    up = F.when(F.col("n_total") == 1, F.lit(0.0)).otherwise(
        (F.col("rank_min") - 1) / (F.col("n_total") - 1)
    )
    pct = F.when(F.col("metric").isin(LOWER_BETTER), 1 - up).otherwise(up)
    scored = long.join(ranks.select("metric", "value", pct.alias("pct")), ["metric", "value"])
    wide = scored.groupBy(*ids).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(f"pct_{m}") for m in metrics]
    )
    return table.join(wide, ids, "left")


def lineup_leaderboard(
    lineups: DataFrame, sided: DataFrame, rosters: DataFrame, min_poss: int = 100
) -> DataFrame:
    """Lineups with enough possessions, points per possession, and their members."""
    best = _sums(sided, ["lineup_hash", "type_lineup"]).where(F.col("total_poss") >= min_poss)
    members = lineups.where("is_on_verdict").select("lineup_hash", "team_id", "player_id").distinct()
    names = rosters.select("player_id", "team_id", "first_name", "last_name").distinct()
    return (
        best.withColumn("pts_per_poss", ratio(F.col("total_pts"), F.col("total_poss")))
        .join(members, "lineup_hash")
        .join(names, ["player_id", "team_id"])
    )


def player_on_off(lineups: DataFrame, sided: DataFrame, player_id: int) -> DataFrame:
    """One player's team by side, with the player on the floor against off."""
    with_player = (
        lineups.where("is_on_verdict")
        .where(F.col("player_id") == player_id)
        .select("team_id", "lineup_hash")
        .distinct()
        .withColumn("_on", F.lit(True))
    )
    per_lineup = _sums(sided, ["team_id", "lineup_hash", "type_lineup"])
    return (
        per_lineup.join(with_player, ["team_id", "lineup_hash"], "left")
        .withColumn("is_on", F.col("_on").isNotNull())
        .groupBy("type_lineup", "is_on", "team_id")
        .agg(F.sum("total_poss").alias("total_poss"), F.sum("total_pts").alias("total_pts"))
        .withColumn("pts_per_poss", _ppp())
    )


def lineup_game_breakdown(sided: DataFrame, lineup_hash: str | None = None) -> DataFrame:
    """Lineups by game and quarter (one lineup when a hash is given)."""
    rows = sided if lineup_hash is None else sided.where(F.col("lineup_hash") == lineup_hash)
    return _sums(rows, ["team_id", "type_lineup", "lineup_hash", "game_id", "quarter"])


def segment_drilldown(
    stint_table: DataFrame, assigned: DataFrame, wanted: DataFrame
) -> DataFrame:
    """Points and possessions by team and event type over the segments that the
    wanted offensive lineups (lineup_hash, game_id) played."""
    segments = (
        stint_table.withColumnRenamed("lineup_hash_offense", "lineup_hash")
        .join(wanted, ["lineup_hash", "game_id"], "left_semi")
        .select("game_id", "segment_id")
        .distinct()
    )
    rows = assigned.join(segments, ["game_id", "segment_id"], "left_semi")
    return _sums(rows, ["game_id", "team_id", "type"])
