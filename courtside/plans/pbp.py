"""Text play-by-play: parsing, possession ends, orientation; data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import clock_seconds, elapsed_seconds
from ..functions.text import extract
from ..operators.ordered import DEFAULT_WIDTH, bucket_of, lag, lead, ordered_pass, running
from ..operators.ranking import exact_quantiles
from ..operators.verbs import separate, unite
from ..session import stage

# fixed values: wording of the play-by-play text
SHOT_TYPE = "[0-9]{1}-pt|free throw"
OUTCOME = "misses|makes"
DISTANCE = "(?<=from)(.*)(?=ft)"
LAST_FREE_THROWS = ("free throw 2 of 2", "free throw 3 of 3")


def event_features(event: Column) -> dict[str, Column]:
    """Shot type, made flag, points and distance read off the event text."""
    outcome = extract(event, OUTCOME)
    points = (
        F.when(event.contains("makes 2-pt"), 2)
        .when(event.contains("makes 3-pt"), 3)
        .when(event.contains("makes free throw"), 1)
        .otherwise(0)
    )
    return {
        "shot_type": extract(event, SHOT_TYPE),
        "has_made": F.when(outcome.isNotNull(), outcome == "makes"),
        "points": points,
        "distance": F.trim(extract(event, DISTANCE)).try_cast("double"),
    }


def parse_pbp(raw: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Raw text rows to typed events.

    The period is inferred from clock resets: a 12:00 (or, without a score, a
    5:00 overtime) clock followed by another reading opens a period. One pass
    reads the neighbours, a second one counts the openings.
    """
    typed = separate(raw, "score", ["visit_score", "home_score"], "-")
    typed = typed.withColumns(
        {
            "clock": clock_seconds(F.col("time")),
            "event": unite(["visit_team", "home_team"]),
            "team": F.when(F.col("visit_team").rlike(r"\p{Alpha}"), "visit_team").otherwise(
                "home_team"
            ),
            "visit_score": F.col("visit_score").try_cast("int"),
            "home_score": F.col("home_score").try_cast("int"),
        }
    ).withColumn("visit_adv", F.col("visit_score") - F.col("home_score"))
    near = ordered_pass(
        typed.drop("time", "visit_team", "home_team"),
        ["game_id"],
        ["seq"],
        bucket_of("seq", width),
        {"_next_clock": lead("clock"), "_prev_clock": lag("clock"), "next_event": lead("event")},
    )
    opens = lambda length: (F.col("clock") == length) & (F.col("_next_clock") != length)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    near = near.withColumn(
        "_opens", flag(opens(720)) + flag(opens(300) & F.col("visit_adv").isNull())
    )
    counted = ordered_pass(
        stage(near, "pbp_clock"),
        ["game_id"],
        ["seq"],
        bucket_of("seq", width),
        {"period": running("_opens")},
    )
    period = F.col("period").cast("int")
    elapsed = elapsed_seconds(F.col("clock"), period)
    return counted.withColumns(
        {
            "period": period,
            "time": elapsed,
            "prev_time": elapsed_seconds(F.col("_prev_clock"), period - F.col("_opens")),
            "time_minutes": F.bround(elapsed / 60, 0),
            "home_adv": -F.col("visit_adv"),
            **event_features(F.col("event")),
        }
    ).drop("_next_clock", "_prev_clock", "_opens")


def flag_possessions_text(parsed: DataFrame) -> DataFrame:
    """``end_poss``: whether the event ends a possession."""
    event = F.col("event")
    rebounded = F.coalesce(F.col("next_event").contains("Defensive rebound"), F.lit(False))
    last_ft = lambda verb: event.contains(f"{verb} {LAST_FREE_THROWS[0]}") | event.contains(
        f"{verb} {LAST_FREE_THROWS[1]}"
    )
    ends = (
        event.rlike("makes [2-3]-pt")
        | (event.rlike("misses [2-3]-pt") & rebounded)
        | (last_ft("misses") & rebounded)
        | last_ft("makes")
        | event.contains("Turnover")
    )
    return parsed.withColumn("end_poss", ends)


def orient_events(parsed: DataFrame, games: DataFrame) -> DataFrame:
    """Own-side margin, offense and defense, time used, eventual winner."""
    visit = F.col("team") == "visit_team"
    own = lambda if_visit, if_home: F.when(visit, F.col(if_visit)).otherwise(F.col(if_home))
    return parsed.join(games, "game_id", "left").withColumns(
        {
            "adv": own("visit_adv", "home_adv"),
            "is_leading": F.when(visit, F.col("visit_adv") > 0).otherwise(F.col("visit_adv") < 0),
            "team_offense": own("visitor_team_name", "home_team_name"),
            "team_defense": own("home_team_name", "visitor_team_name"),
            "time_offense": F.col("time") - F.col("prev_time"),
            "has_won": F.coalesce(
                own("visitor_pts", "home_pts") > own("home_pts", "visitor_pts"), F.lit(False)
            ),
        }
    )


def clock_increases(actions: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Rows whose game clock is above the previous row's (should be none)."""
    clock = "end_game_seconds_remaining"
    seen = ordered_pass(
        actions.select("game_id", "id", "quarter", "type", clock),
        ["game_id"],
        ["id"],
        bucket_of("id", width),
        {"prev_clock": lag(clock)},
    )
    return seen.withColumn("how_bigger", F.col(clock) - F.col("prev_clock")).where("how_bigger > 0")


def child_before_parent(actions: DataFrame) -> DataFrame:
    """Child actions with more time on the clock than their parent."""
    child = actions.select("game_id", "id", "parent_action_id", "end_game_seconds_remaining")
    parent = actions.select(
        F.col("game_id"),
        F.col("id").alias("parent_action_id"),
        F.col("end_game_seconds_remaining").alias("parent_clock"),
    )
    gap = F.col("end_game_seconds_remaining") - F.col("parent_clock")
    return (
        child.where(F.col("parent_action_id") != 0)
        .join(parent, ["game_id", "parent_action_id"])
        .withColumn("time_diff", gap)
    )


def repeated_marks(actions: DataFrame, mark: str = "end-of-quarter") -> DataFrame:
    """(game, quarter) pairs with more than one row of the given kind."""
    return (
        actions.where(F.col("parameters_type") == mark)
        .groupBy("game_id", "quarter")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def repeated_ids(assigned: DataFrame) -> DataFrame:
    """Event ids that a range join multiplied."""
    return assigned.groupBy("game_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def parent_gaps(actions: DataFrame, min_gap: int = 50) -> DataFrame:
    """Per game: rows far from their parent action and the median distance."""
    far = (
        actions.where(F.col("parent_action_id") != 0)
        .withColumn("id_diff", F.col("id") - F.col("parent_action_id"))
        .where(F.col("id_diff") > min_gap)
    )
    return exact_quantiles(far, ["game_id"], "id_diff", {"med_diff": 0.5}).join(
        far.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")), "game_id"
    )
