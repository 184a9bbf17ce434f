"""Game-level questions: comebacks, clutch, droughts, shot mix, margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import league_year, weekday
from ..functions.maths import ratio, shot_weight
from ..operators.ordered import (
    DEFAULT_WIDTH, bucket_of, lag, ordered_pass, running, with_block,
)
from ..operators.ranking import exact_quantiles, top_n_ties, with_rank
from ..operators.reshape import mirror
from ..operators.verbs import first_per_key
from ..session import stage

# fixed values: league mean efficiency the comebacks are compared with
LEAGUE_EFFICIENCY = 112.9
CLUTCH_MARGIN, CLUTCH_MINUTES = (-5, 5), (43, 53)


def shares(counts: DataFrame, within: Sequence[str], n: str, out: str) -> DataFrame:
    """``n`` over its group total. The input is an aggregate with one row per
    shot type in each group, so the window over a group holds a few rows."""
    return counts.withColumn(
        out, ratio(F.col(n), F.sum(n).over(Window.partitionBy(*within)))
    )


def weighted_mix(events: DataFrame, groups: Sequence[str], shot: str = "shot_type") -> DataFrame:
    """Shot-type counts per group, free throws weighted, share within the group."""
    counts = (
        events.where(F.col(shot).isNotNull())
        .groupBy(*groups, shot)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_1", shot_weight(shot, "n"))
    )
    return shares(counts, list(groups), "n_1", "freq")


# ---- comebacks -------------------------------------------------------------


def comeback_windows(log: DataFrame, deficit: int = 15) -> DataFrame:
    """Per game: when the eventual winner first trailed by more than ``deficit``
    and how long until that side led. NULL when no lead follows on its events."""
    winner = log.where("has_won").select("game_id", "time", "adv")
    low = winner.where(F.col("adv") < -deficit).groupBy("game_id").agg(
        F.min("time").alias("min_lead_time")
    )
    back = (
        winner.where("adv > 0")
        .join(low, "game_id")
        .where(F.col("time") > F.col("min_lead_time"))
        .groupBy("game_id")
        .agg(F.min(F.col("time") - F.col("min_lead_time")).alias("minimal_comeback"))
    )
    return low.join(back, "game_id", "left").withColumn(
        "max_time_comeback", F.col("min_lead_time") + F.col("minimal_comeback")
    )


def in_comeback(log: DataFrame, windows: DataFrame) -> DataFrame:
    """Events inside their game's comeback window."""
    return log.join(windows, "game_id").where(
        F.col("time").between(F.col("min_lead_time"), F.col("max_time_comeback"))
    )


def comeback_shot_mix(log: DataFrame, windows: DataFrame) -> DataFrame:
    """Shot share and make rate in the windows, winners against losers."""
    shots = in_comeback(log, windows).where(F.col("shot_type").isNotNull())
    counts = (
        shots.groupBy("has_won", "shot_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("has_made").alias("total_made"))
        .withColumn("n_1", shot_weight("shot_type", "n"))
        .withColumn("pct", ratio(F.col("total_made"), F.col("n")))
    )
    return shares(counts, ["has_won"], "n_1", "freq")


def comeback_efficiency(
    log: DataFrame, windows: DataFrame, league: float = LEAGUE_EFFICIENCY
) -> DataFrame:
    """Winner beside loser per game, with possession-weighted gaps to the league.

    Sides are told apart by team, so a side that never had the ball in the
    window leaves NULLs.
    """
    per_side = (
        in_comeback(log, windows)
        .groupBy("game_id", "team_offense", "team_defense", "has_won")
        .agg(F.sum("points").alias("pts"), F.count_if("end_poss").alias("poss"))
        .withColumn("ppp", ratio(F.col("pts"), F.col("poss"), 100))
    )
    won = per_side.where("has_won").select(
        "game_id",
        F.col("team_offense").alias("winner"),
        F.col("team_defense").alias("loser"),
        F.col("ppp").alias("pts_per_poss_off"),
        F.col("pts").alias("total_points_off"),
        F.col("poss").alias("total_poss_off"),
    )
    lost = per_side.where("NOT has_won").select(
        "game_id",
        F.col("ppp").alias("pts_per_poss_def"),
        F.col("pts").alias("total_points_def"),
        F.col("poss").alias("total_poss_def"),
    )
    both = stage(won.join(lost, "game_id", "left"), "comeback_sides")
    sums = both.agg(F.sum("total_poss_off").alias("o"), F.sum("total_poss_def").alias("d"))
    weight = lambda own, tot: ratio(F.col(own), tot)
    return both.withColumns(
        {
            "total_team_poss_off": sums.select("o").scalar(),
            "total_team_poss_def": sums.select("d").scalar(),
        }
    ).withColumns(
        {
            "freq_off": weight("total_poss_off", F.col("total_team_poss_off")),
            "freq_def": weight("total_poss_def", F.col("total_team_poss_def")),
            "diff_off": F.col("pts_per_poss_off") - league,
            "diff_def": F.col("pts_per_poss_def") - league,
        }
    ).withColumns(
        {
            "weighted_off": F.col("freq_off") * F.col("diff_off"),
            "weighted_def": F.col("freq_def") * F.col("diff_def"),
        }
    )


def blown_leads(
    scores: DataFrame, big: int = 15, close: int = 3, first_half: int = 2
) -> DataFrame:
    """Per season: games with a big first-half lead, and those later made close.

    A close row after a big lead exists exactly when the latest close row is
    later than the earliest big one, so each game is reduced first and the
    row-by-row pairing is never built.
    """
    lead = F.abs(F.col("home_score") - F.col("away_score"))
    clock = F.col("start_game_seconds_remaining")
    per_game = scores.groupBy("season", "game_id").agg(
        F.max(F.when((lead >= big) & (F.col("qtr") <= first_half), clock)).alias("first_big"),
        F.min(F.when(lead <= close, clock)).alias("last_close"),
    )
    led = F.col("first_big").isNotNull()
    return (
        per_game.groupBy("season")
        .agg(
            F.count_if(led & (F.col("first_big") > F.col("last_close"))).alias("n_comeback"),
            F.count_if(led).alias("n_total_leads"),
            F.count(F.lit(1)).alias("n_total"),
        )
        .withColumns(
            {
                "comeback_pct": ratio(F.col("n_comeback"), F.col("n_total_leads")),
                "lead_pct": ratio(F.col("n_total_leads"), F.col("n_total")),
            }
        )
    )


def quickest_comebacks(scores: DataFrame, big: int = 15, close: int = 3) -> DataFrame:
    """Per game with a big first-half lead: shortest drop from a big-lead row to a
    close row, the minimum over all row pairs being a difference of extremes."""
    lead = F.abs(F.col("home_score") - F.col("away_score"))
    clock = F.col("start_game_seconds_remaining")
    return (
        scores.groupBy("season", "game_id")
        .agg(
            F.min(F.when((lead >= big) & (F.col("qtr") <= 2), clock)).alias("last_big"),
            F.max(F.when(lead <= close, clock)).alias("first_close"),
        )
        .where(F.col("last_big").isNotNull())
        .withColumn("min_time", F.col("last_big") - F.col("first_close"))
    )


# ---- clutch and shot mix ---------------------------------------------------


def is_clutch() -> Column:
    return F.col("adv").between(*CLUTCH_MARGIN) & F.col("time_minutes").between(*CLUTCH_MINUTES)


def clutch_shift(
    log: DataFrame, ratings: DataFrame | None = None, by_lead: bool = False
) -> DataFrame:
    """Shot mix in the clutch against the rest, per team (and leading/trailing)."""
    clutch, rest = log.where(is_clutch()), log.where(~is_clutch())
    extra = ["is_leading"] if by_lead else []
    now = weighted_mix(clutch, ["team_offense", *extra]).select(
        "team_offense", *extra, "shot_type", F.col("freq").alias("freq_clutch")
    )
    reg = weighted_mix(rest, ["team_offense"]).select(
        "team_offense", "shot_type", F.col("freq").alias("freq_reg")
    )
    left, right = (reg, now) if by_lead else (now, reg)
    out = left.join(right, ["team_offense", "shot_type"], "left").withColumns(
        {
            "pos_neg": F.col("freq_reg") - F.col("freq_clutch") < 0,
            "delta": F.col("freq_clutch") - F.col("freq_reg"),
        }
    )
    return out if ratings is None else out.join(ratings, "team_offense", "left")


def shot_mix_by_minute(log: DataFrame) -> DataFrame:
    mix = weighted_mix(log, ["time_minutes"])
    return mix.withColumn("is_clutch", F.col("time_minutes").between(43, 48))


def minute_score_grid(
    log: DataFrame, min_n: float = 10, shot: str = "free throw", margin: int = 20
) -> DataFrame:
    """Share of one shot type by minute and margin, cells with enough attempts."""
    mix = weighted_mix(log, ["time_minutes", "adv"])
    cell = Window.partitionBy("time_minutes", "adv")
    return mix.withColumn("max_freq", F.max("freq").over(cell)).where(
        (F.col("n_1") > min_n)
        & (F.col("shot_type") == shot)
        & (F.col("adv") > -margin)
        & (F.col("adv") < margin)
    ).select("time_minutes", "adv", "shot_type", "freq", "max_freq")


# ---- schedules -------------------------------------------------------------


def day_part_win_pct(
    games: DataFrame, part: str = "Noon", min_games: int = 5, noon: int = 16 * 60
) -> DataFrame:
    """Win share by season, team, weekday and start slot.

    ``games``: game_date, start_minute, visitor/home team and points.
    """
    rows = mirror(
        games.where(F.col("visitor_pts").isNotNull() & F.col("home_pts").isNotNull()),
        ["game_date", "start_minute"],
        [
            {"team": F.col("visitor_team_name"), "has_won": F.col("visitor_pts") > F.col("home_pts")},
            {"team": F.col("home_team_name"), "has_won": ~(F.col("visitor_pts") > F.col("home_pts"))},
        ],
    )
    return (
        rows.withColumns(
            {
                "league_year": league_year(F.col("game_date")),
                "week_day": weekday(F.col("game_date")),
                "time_of_day": F.when(F.col("start_minute") <= noon, "Noon").otherwise("Else"),
            }
        )
        .groupBy("league_year", "team", "week_day", "time_of_day")
        .agg(F.count_if("has_won").alias("wins"), F.count(F.lit(1)).alias("games"))
        .withColumn("pct_success", ratio(F.col("wins"), F.col("games")))
        .where((F.col("time_of_day") == part) & (F.col("games") >= min_games))
    )


def comeback_means(sides: DataFrame) -> DataFrame:
    """Closing row of :func:`comeback_efficiency`: plain means of both gaps to the league, and the weighted ones in all."""
    return sides.agg(
        F.avg("diff_off").alias("mean_diff_off"), F.avg("diff_def").alias("mean_diff_def"),
        F.sum("weighted_off").alias("weighted_off"), F.sum("weighted_def").alias("weighted_def"), F.count(F.lit(1)).alias("n_games"))


# ---- droughts --------------------------------------------------------------


def scoring_droughts(
    scores: DataFrame,
    n: int = 100,
    max_qtr: int = 4,
    period_break: float = 300.0,
    width: int = DEFAULT_WIDTH,
    within: Sequence[str] = (),
) -> DataFrame:
    """Longest stretches without a score change, ties of the n-th kept; with ``within`` (season, season_type) the longest of each such group.

    ``scores`` (read twice): game_id, season, season_type, qtr, id, total_score,
    clock. The change and a dense position come from one ordered pass, the
    change before it from block halos; only the start and end rows of a stretch
    go on to the second pass.
    """
    keys = ["game_id", "season", "season_type"]
    numbered = ordered_pass(
        scores.where(F.col("qtr") <= max_qtr), keys, ["id"], bucket_of("id", width),
        {"_prev_total": lag("total_score"), "_pos": running(F.lit(1))},
    ).withColumn("score_diff", F.col("total_score") - F.col("_prev_total"))
    rows, w, keep = with_block(numbered, keys, "_pos", 1, width)
    diff, prev = F.col("score_diff"), F.col("_prev")
    kind = F.when((diff == 0) & (prev != 0), "start_stint").when(
        (diff != 0) & (prev == 0), "end_stint"
    )
    edges = stage(
        rows.withColumn("_prev", F.lag("score_diff").over(w))
        .where(keep)
        .withColumn("stint_type", kind)
        .where(F.col("stint_type").isNotNull())
        .drop("_prev", "_prev_total", "_pos", "_block"),
        "drought_edges",
    )
    timed = ordered_pass(
        edges, keys, ["id"], bucket_of("id", width), {"_prev_clock": lag("clock")}
    ).withColumn("time_no_score", F.abs(F.col("clock") - F.col("_prev_clock")))
    real = timed.where(F.col("time_no_score") != period_break).drop("_prev_clock")
    real = stage(real, "droughts")
    if not within:
        return top_n_ties(real, "time_no_score", n, rank_as="rank_time")
    placed = with_rank(with_rank(real, within, "time_no_score", "_place", "rank", True), within, "time_no_score", "rank_time", "dense", True)
    return placed.where(F.col("_place") <= n).drop("_place")


# ---- endings ---------------------------------------------------------------


def buzzer_beaters(log: DataFrame, game_seconds: int = 2880, last: int = 60) -> DataFrame:
    """Made shots in the last seconds after which the shooter's side leads by no
    more than the shot's points, counted per team."""
    late = log.where(
        (F.col("time") >= game_seconds - last)
        & F.col("has_made")
        & (F.col("points") > 0)
        & (F.col("adv") > 0)
        & (F.col("adv") <= F.col("points"))
    )
    return late.groupBy("team_offense").agg(
        F.count(F.lit(1)).alias("n_shots"), F.count_if("has_won").alias("n_won")
    )


def wire_to_wire(log: DataFrame) -> DataFrame:
    """Games whose winner never trailed or was level once anyone had scored."""
    rows = log.where(F.col("has_won") & F.col("adv").isNotNull()).where(
        (F.col("visit_score") + F.col("home_score")) > 0
    )
    return rows.groupBy("game_id", "team_offense").agg(
        F.min("adv").alias("min_adv"), F.max("adv").alias("max_adv")
    ).where("min_adv > 0")


def margin_quartiles(margins: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Exact five-number summary per group."""
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    return exact_quantiles(margins, keys, col, probs)


def halftime_deficit_games(
    scores: DataFrame, team: str, low: int = -20, high: int = -15
) -> DataFrame:
    """Games a team trailed in by ``low``..``high`` at the half (last row of the
    second quarter), found by keeping one row per game."""
    half = first_per_key(scores.where("qtr = 2"), ["game_id"], ["id"], last=True)
    gap = F.col("home_score") - F.col("away_score")
    sides = mirror(
        half,
        ["game_id"],
        [
            {"team": F.col("away_team"), "gap": -gap},
            {"team": F.col("home_team"), "gap": gap},
        ],
    )
    return sides.where((F.col("team") == team) & F.col("gap").between(low, high)).select(
        "game_id", "gap"
    )


def events_of_games(
    events: DataFrame, game_ids: DataFrame, pattern: str, max_qtr: int = 2
) -> DataFrame:
    """Events of the given games up to a quarter whose text matches."""
    return events.join(game_ids, "game_id").where(
        (F.col("qtr") <= max_qtr) & F.col("text").rlike(pattern)
    )
