"""Queries on stored tables: ordered publishing, bucketed action trees, season sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import exact_quantiles
from ..operators.sketches import merged, season_sketches
from ..plans import possessions as P
from ..session import checkpoint_root, own_database
from ..sources.tables import files_in_order, publish
from .adapters import actions, read
from .registry import query

#: Buckets of stored tables here. A bucket should hold a few hundred MB, so a table of a terabyte takes some thousands.
BUCKETS = 8


def _table_name(spark: SparkSession, name: str) -> str:
    return f"{own_database(spark)}.{name}_{uuid.uuid4().hex}"


@query("publish_ordered", """
SELECT o_orderkey, o_orderdate, o_totalprice, TRUE AS in_order, TRUE AS staging_gone FROM orders""")
def publish_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders take the place of a table that holds the finished ones; read back with the proof of their order by files."""
    orders, order = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"), ["o_orderdate", "o_orderkey"]
    name = _table_name(spark, "orders_published")
    publish(orders.where("o_orderstatus = 'F'"), name, order)
    publish(orders, name, order)
    gone = not (spark.catalog.tableExists(f"{name}_stage") or spark.catalog.tableExists(f"{name}_old"))
    table = spark.table(name)
    return table.select(
        "o_orderkey", "o_orderdate", "o_totalprice", files_in_order(table, order).select("in_order").scalar().alias("in_order"), F.lit(gone).alias("staging_gone"))


@query("parent_child_bucketed", """
SELECT a.game_id, a.id, a.parent_action_id, a.end_game_seconds_remaining, p.end_game_seconds_remaining AS parent_clock,
  a.end_game_seconds_remaining - p.end_game_seconds_remaining AS time_diff
FROM {actions} a JOIN {actions} p ON a.game_id = p.game_id AND a.parent_action_id = p.id WHERE a.parent_action_id <> 0""")
def parent_child_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children beside their parents out of stored action trees, without an exchange."""
    stored = P.store_prepared(actions(spark, sf_dir), _table_name(spark, "prepared"), BUCKETS)
    both = P.with_parent(stored, ["end_game_seconds_remaining"])
    clock = "end_game_seconds_remaining"
    return both.select("game_id", "id", "parent_action_id", clock, F.col(f"parent_{clock}").alias("parent_clock"), (F.col(clock) - F.col(f"parent_{clock}")).alias("time_diff"))


@query("tree_flags_bucketed", """
SELECT game_id, id, team_id, parent_action_id, end_poss, sum_poss_poss, sum_block, sum_tech, final_base AS final_end_poss_base FROM {base}""")
def tree_flags_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possession flags of stored action trees, without an exchange."""
    stored = P.store_prepared(actions(spark, sf_dir), _table_name(spark, "prepared"), BUCKETS)
    return P.flag_possessions(stored).select(
        "game_id", "id", "team_id", "parent_action_id", "end_poss", "sum_poss_poss", "sum_block", "sum_tech", "final_end_poss_base")


@query("sketch_seasons", """
SELECT (1985 + o_orderkey % 37) // 10 * 10 AS decade, count(*) AS n, TRUE AS distinct_close, TRUE AS median_close, TRUE AS tail_close FROM orders GROUP BY ALL""")
def sketch_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored per season and merged per decade, held against the exact values: distinct customers within 3 %, quantiles of
    the price within 2 % of the ranks."""
    rows = read(spark, sf_dir, "orders").withColumn("season", F.col("o_orderkey") % 37 + 1985)
    decade = F.floor(F.col("season") / 10).cast("long") * 10
    path = f"{checkpoint_root(spark).rstrip('/')}/courtside/season_sketches-{uuid.uuid4().hex}"
    season_sketches(rows, ["season"], "o_custkey", "o_totalprice").write.parquet(path)
    told = merged(spark.read.parquet(path).withColumn("decade", decade), ["decade"], {"median": 0.5, "tail": 0.9})
    dated = rows.withColumn("decade", decade)
    exact = dated.groupBy("decade").agg(F.countDistinct("o_custkey").alias("customers"))
    bounds = exact_quantiles(dated, ["decade"], "o_totalprice", {"m0": 0.48, "m1": 0.52, "t0": 0.88, "t1": 0.92})
    both = told.join(exact, "decade").join(bounds, "decade")
    return both.select(
        "decade", "n", (F.abs(F.col("n_distinct") / F.col("customers") - 1) < 0.03).alias("distinct_close"),
        F.col("median").between(F.col("m0"), F.col("m1")).alias("median_close"), F.col("tail").between(F.col("t0"), F.col("t1")).alias("tail_close"))
