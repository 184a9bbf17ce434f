"""Action-tree possessions: flags, end-of-quarter overrides, points per possession."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import ratio
from ..operators.ordered import DEFAULT_WIDTH, bucket_of, lag, lead, ordered_pass
from ..sources.tables import write_bucketed


def prepare_actions(actions: DataFrame) -> DataFrame:
    """Free-throw share, regulation bucket, scored points, own parent id."""
    made = F.col("parameters_made") == "made"
    points = F.when(made & (F.col("type") == "freeThrow"), 1).otherwise(F.col("parameters_points"))
    parent = F.col("parent_action_id")
    return actions.withColumns(
        {
            "pct_ft": ratio(
                F.col("parameters_free_throw_number"), F.col("parameters_free_throws_awarded")
            ),
            "q_bucket": F.when(F.col("quarter") < 5, 0).otherwise(F.col("quarter")),
            "parameters_points": points,
            "team_score": F.when(made, points),
            "parent_action_id": F.when(parent == 0, F.col("id")).otherwise(parent),
        }
    )


#: Keys by which prepared actions are stored so that action trees stay together: a game alone may hold a third of all rows.
TREE = ("game_id", "parent_action_id")


def store_prepared(actions: DataFrame, name: str, buckets: int) -> DataFrame:
    """Prepared actions as a table bucketed by action tree: :func:`flag_possessions` and :func:`with_parent` read it without an exchange."""
    return write_bucketed(prepare_actions(actions), name, buckets, TREE, [*TREE, "id"])


def with_parent(prepared: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Children of prepared actions beside ``columns`` of their parent (as ``parent_<column>``).

    A parent is its own ``parent_action_id``, so both sides join on the action tree.
    """
    parent = prepared.where(F.col("id") == F.col("parent_action_id")).select(*TREE, *[F.col(c).alias(f"parent_{c}") for c in columns])
    return prepared.where(F.col("id") != F.col("parent_action_id")).join(parent.hint("merge"), list(TREE))


def flag_possessions(prepared: DataFrame) -> DataFrame:
    """Possession ends per action tree.

    Windows are over one action and its children (a handful of rows): the
    ordered one only for look-ahead, the unordered one for whole-tree counts.
    """
    tree = Window.partitionBy("game_id", "parent_action_id")
    along = tree.orderBy(
        "id", "quarter", F.col("end_game_seconds_remaining").desc(), "user_time"
    )
    kind, made = F.col("type"), F.col("parameters_made")
    rebounded = (F.lead("parameters_type").over(along) == "defensive") & (
        F.lead("type").over(along) == "rebound"
    )
    ends = F.coalesce(
        ((kind == "shot") & (made == "made")), F.lit(False)
    ) | F.coalesce(rebounded, F.lit(False)) | F.coalesce(
        (kind == "freeThrow") & (made == "made") & (F.col("pct_ft") == 1), F.lit(False)
    ) | F.coalesce(kind == "turnover", F.lit(False))
    flagged = prepared.withColumn("end_poss", ends).withColumns(
        {
            "sum_poss_poss": F.count_if("end_poss").over(tree),
            "sum_block": F.count_if(made == "blocked").over(tree),
            "sum_tech": F.count_if(F.col("parameters_type") == "technical").over(tree),
            "_next_end": F.lead("end_poss").over(along),
        }
    )
    is_parent = F.col("id") == F.col("parent_action_id")
    base = (
        F.when((F.col("sum_poss_poss") >= 2) & is_parent, F.lit(None).cast("boolean"))
        .when(F.col("sum_block") >= 1, F.col("_next_end"))
        .when(F.col("sum_tech") >= 1, F.lit(None).cast("boolean"))
        .otherwise(F.col("end_poss"))
    )
    return flagged.withColumn("final_end_poss_base", base).drop("_next_end")


def end_of_period_overrides(prepared: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Ids (game, quarter, id) that end a possession because the quarter ends."""
    near = ordered_pass(
        prepared.select(
            "game_id", "quarter", "id", "type", "parameters_type", "parameters_made",
            "parent_action_id",
        ),
        ["game_id", "quarter"],
        ["id"],
        bucket_of("id", width),
        {
            "_next": lead("parameters_type"),
            "_prev_id": lag("id"),
            "_prev_parent": lag("parent_action_id"),
        },
    ).where(F.col("_next") == "end-of-quarter")
    kind = F.col("type")
    missed = (kind == "shot") & (F.col("parameters_made") == "missed")
    offensive = (kind == "rebound") & (F.col("parameters_type") == "offensive")
    block = (kind == "block") & (F.col("_prev_parent") == F.col("parent_action_id"))
    target = F.when(missed | offensive, F.col("id")).when(block, F.col("_prev_id"))
    return (
        near.select("game_id", "quarter", target.alias("id"))
        .where(F.col("id").isNotNull())
        .distinct()
    )


def possessions(actions: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Actions with ``final_end_poss``; end-of-quarter overrides come first."""
    prepared = prepare_actions(actions)
    overrides = end_of_period_overrides(prepared, width).withColumn("_eoq", F.lit(True))
    flagged = flag_possessions(prepared).join(overrides, ["game_id", "quarter", "id"], "left")
    return flagged.withColumn(
        "final_end_poss", F.when(F.col("_eoq"), F.lit(True)).otherwise(F.col("final_end_poss_base"))
    ).drop("_eoq", "final_end_poss_base")


def team_ppp(poss: DataFrame) -> DataFrame:
    """Points per 100 possessions: per game, then the mean per team."""
    per_game = (
        poss.where(F.col("team_id") != 0)
        .groupBy("team_id", "game_id")
        .agg(F.sum("team_score").alias("pts"), F.count_if("final_end_poss").alias("poss"))
        .withColumn("ppp", ratio(F.col("pts"), F.col("poss"), 100))
    )
    return per_game.groupBy("team_id").agg(F.round(F.avg("ppp"), 1).alias("mean_ppp"))
