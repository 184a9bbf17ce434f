"""Substitutions to lineups, lineup segments, stints and stint assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import DEFAULT_CELL, overlap_join, range_join
from ..operators.ordered import DEFAULT_WIDTH, bucket_of, fill_down, ordered_pass
from ..operators.reshape import mirror

CLOCK = "end_game_seconds_remaining"
TICK = ["game_id", "team_id", "quarter", CLOCK]


def substitutions(actions: DataFrame) -> DataFrame:
    """Substitution rows with the acting player as the one in or out."""
    subs = actions.where(F.col("type") == "substitution")
    acting = lambda c: F.when(F.col(c).isNotNull(), F.col("player_id")).alias(c)
    return subs.select(
        "id", "game_id", "team_id", "quarter", "quarter_time", CLOCK,
        "end_quarter_seconds_remaining", "user_time",
        acting("parameters_player_in"), acting("parameters_player_out"),
    )


def on_court_state(rosters: DataFrame, subs: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Last known on/off state of every roster player at every substitution tick.

    A substitution changes the state of the one or two players it names; only
    the ticks (at most one per second of the clock) are listed for the whole
    roster. Changes and ticks are ordered together by id, filled down per
    (game, player) in id buckets, and the tick rows kept. ``id`` must be unique
    within a game.
    """
    tick = [*TICK, "quarter_time", "end_quarter_seconds_remaining"]
    player_in, player_out = F.col("parameters_player_in"), F.col("parameters_player_out")
    change = lambda who, on: F.struct(who.alias("player_id"), F.lit(on).alias("_state"))
    named = F.array(
        F.when(player_in.isNotNull(), change(player_in, True)),
        F.when(
            player_out.isNotNull() & ~player_out.eqNullSafe(player_in), change(player_out, False)
        ),
    )
    roster = rosters.select("player_id", "game_id", "team_id").distinct()
    changes = (
        subs.select("game_id", "team_id", "id", F.explode(F.array_compact(named)).alias("_n"))
        .select("game_id", "team_id", "id", "_n.*")
        .join(roster, ["player_id", "game_id", "team_id"], "left_semi")
    )
    ticks = subs.groupBy(*tick).agg(F.max("id").alias("id")).join(roster, ["team_id", "game_id"])
    rows = ticks.withColumn("_at", F.col("id") * 2 + 1).unionByName(
        changes.withColumn("_at", F.col("id") * 2), allowMissingColumns=True
    )
    filled = ordered_pass(
        rows, ["game_id", "player_id"], ["_at"], bucket_of("_at", width),
        {"is_on_verdict": fill_down("_state")},
    )
    return filled.where(F.col("_at") % 2 == 1).select(
        *tick, "player_id", "id", "is_on_verdict"
    )


def lineup_key(state: DataFrame) -> DataFrame:
    """Lineup id (on-court ids in numeric order), head count and hash per tick.

    The window over a tick holds one roster, so it costs a single shuffle and
    no join back.
    """
    on, tick = F.col("is_on_verdict"), Window.partitionBy(*TICK)
    ids = F.collect_set(F.when(on, F.col("player_id").cast("bigint"))).over(tick)
    return state.withColumns(
        {
            "lineup_id": F.nullif(F.array_join(F.array_sort(ids), "_"), F.lit("")),
            "n_on": F.count_if(on).over(tick),
        }
    ).withColumn("lineup_hash", F.md5("lineup_id"))


def lineup_dim(lineups: DataFrame) -> DataFrame:
    return lineups.select("lineup_hash", "lineup_id").distinct()


def lineup_players(lineups: DataFrame) -> DataFrame:
    return lineups.where("is_on_verdict").select("lineup_hash", "player_id").distinct()


def lineup_segments(
    lineups: DataFrame, actions: DataFrame, include_last: bool = False
) -> DataFrame:
    """Half-open [start_id, end_id) per lineup of a team.

    A team has at most one row per clock tick here, so the per-(game, team)
    window is bounded by the length of the game clock, not by the event count.
    The last segment ends before the last id; ``include_last`` closes it after.
    """
    last_id = F.max("id") + (1 if include_last else 0)
    ends = actions.where(F.col("quarter") >= 4).groupBy("game_id", "quarter").agg(
        last_id.alias("_last_id")
    )
    ticks = lineups.select(
        "id", *TICK, "quarter_time", "end_quarter_seconds_remaining", "lineup_id", "lineup_hash"
    ).distinct()
    along = Window.partitionBy("game_id", "team_id").orderBy(
        "quarter", F.col(CLOCK).desc(), "id"
    )
    next_quarter = F.lead("quarter").over(along)
    into_overtime = (next_quarter > F.col("quarter")) & (next_quarter >= 5)
    return (
        ticks.join(ends, ["game_id", "quarter"], "left")
        .withColumns(
            {
                "start_segment": F.col(CLOCK),
                "end_segment": F.when(into_overtime, 0).otherwise(
                    F.coalesce(F.lead(CLOCK).over(along), F.lit(0))
                ),
                "start_id": F.col("id"),
                "end_id": F.coalesce(F.lead("id").over(along), F.col("_last_id")),
            }
        )
        .drop("_last_id")
    )


def stints(segments: DataFrame, width: int = DEFAULT_CELL) -> DataFrame:
    """Offense x defense lineup pairs of a game over the ids they share.

    Ids ascend (latest start, earliest end) while clocks descend.
    """
    cols = ["game_id", "team_id", "quarter", "start_segment", "end_segment", "start_id",
            "end_id", "lineup_hash"]
    side = lambda tag: segments.select(
        *[F.col(c).alias(c if c == "game_id" else f"{c}_{tag}") for c in cols]
    )
    q_off, q_def = F.col("quarter_offense"), F.col("quarter_defense")
    comparable = (F.col("team_id_offense") != F.col("team_id_defense")) & (
        ((q_off < 5) & (q_def < 5)) | ((q_off >= 5) & (q_off == q_def))
    )
    pairs = overlap_join(
        side("offense"), side("defense"), ["game_id"],
        ("start_id_offense", "end_id_offense"), ("start_id_defense", "end_id_defense"),
        comparable, width,
    )
    both = lambda fn, c: fn(F.col(f"{c}_offense"), F.col(f"{c}_defense"))
    first_quarter = both(F.least, "quarter")
    cut = pairs.select(
        F.col("team_id_offense").alias("team_id"),
        "game_id",
        both(F.least, "start_segment").alias("final_start_seg"),
        both(F.greatest, "end_segment").alias("final_end_seg"),
        "lineup_hash_offense",
        "lineup_hash_defense",
        "team_id_defense",
        F.when(first_quarter < 5, 0).otherwise(first_quarter).alias("q_bucket"),
        both(F.greatest, "start_id").alias("final_start_id"),
        both(F.least, "end_id").alias("final_end_id"),
    )
    # stints of a game are bounded by its clock ticks, like the segments
    along = Window.partitionBy("game_id").orderBy("final_start_id", "final_end_id")
    return cut.withColumn("segment_id", F.dense_rank().over(along))


def assign_stints(poss: DataFrame, stint_table: DataFrame, width: int = DEFAULT_CELL) -> DataFrame:
    """Possession rows with the stint whose id range holds them (left join). Stage ``stint_table``: it is read twice."""
    clock = F.col(CLOCK)
    nudged = poss.withColumn(CLOCK, F.when(clock == 0, F.lit(0.00001)).otherwise(clock))
    return range_join(
        nudged, stint_table, ["team_id", "game_id", "q_bucket"], "id",
        "final_start_id", "final_end_id", "left", width,
    )


def two_sided(
    assigned: DataFrame, keep: Sequence[str], exclude_games: Sequence[int] = ()
) -> DataFrame:
    """One row for the offense's and one for the defense's lineup, in one scan."""
    if exclude_games:
        assigned = assigned.where(~F.col("game_id").isin(list(exclude_games)))
    sides = [
        {"type_lineup": F.lit("offense"), "team_id": F.col("team_id"),
         "lineup_hash": F.col("lineup_hash_offense")},
        {"type_lineup": F.lit("defense"), "team_id": F.col("team_id_defense"),
         "lineup_hash": F.col("lineup_hash_defense")},
    ]
    return mirror(assigned, keep, sides).where(F.col("lineup_hash").isNotNull())


def unmatched_possessions(
    assigned: DataFrame, exclude_games: Sequence[int] = ()
) -> DataFrame:
    """Team rows (no substitutions) without a defending lineup, per game."""
    rows = assigned.where((F.col("team_id") != 0) & (F.col("type") != "substitution"))
    if exclude_games:
        rows = rows.where(~F.col("game_id").isin(list(exclude_games)))
    return (
        rows.where(F.col("lineup_hash_defense").isNull())
        .groupBy("game_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def score_reconciliation(poss: DataFrame) -> DataFrame:
    """Final score per (game, team) from scored points."""
    return (
        poss.where(F.col("team_id") != 0)
        .groupBy("game_id", "team_id")
        .agg(F.coalesce(F.sum("team_score"), F.lit(0)).alias("final_score"))
    )
