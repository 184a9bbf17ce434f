"""Ordered passes against plain windows and brute force, at several bucket widths."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.operators import ordered
from courtside.operators.ordered import (
    bucket_of, fill_down, fill_up, lag, lead, ordered_pass, rolling_mean, running, total, with_block,
)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    # one hot group holds most rows; ids have gaps; values have NULLs
    data, i = [], 0
    for _ in range(300):
        i += rng.choice([1, 1, 2, 9, 40])
        key = rng.choice(["hot"] * 4 + ["a", "b"])
        data.append((key, i, rng.choice([None, 0, 1, 5, 7]), rng.choice([None, "x", "y"])))
    return spark.createDataFrame(data, "g string, id long, v int, s string").cache()


@pytest.mark.parametrize("width, levels", [(1, 1), (7, 0), (7, 1), (7, 3), (1, 2), (100_000, 1)])
def test_matches_plain_windows(log, width, levels, monkeypatch):
    monkeypatch.setattr(ordered, "LEVEL_BITS", 2)
    got = ordered_pass(
        log, ["g"], ["id"], bucket_of("id", width),
        {
            "lag_s": lag("s"), "lead_v": lead("v"), "run_v": running("v"), "down": fill_down("s"),
            "up": fill_up("v"), "tot": total("v"), "low": total("v", "min"), "rn": running(F.lit(1)),
        },
        levels,
    )
    w = Window.partitionBy("g").orderBy("id")
    whole = Window.partitionBy("g")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = log.withColumns(
        {
            "lag_s": F.lag("s").over(w), "lead_v": F.lead("v").over(w), "run_v": F.sum("v").over(upto),
            "down": F.last("s", True).over(upto),
            "up": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            "tot": F.sum("v").over(whole), "low": F.min("v").over(whole),
            "rn": F.row_number().over(w).cast("long"),
        }
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("levels", [1, 2])
def test_numbers_alone_match_plain_windows(log, levels, monkeypatch):
    monkeypatch.setattr(ordered, "LEVEL_BITS", 2)
    got = ordered_pass(log, ["g"], ["id"], bucket_of("id", 3), {
        "p": lag("v"), "n": lead("v"), "down": fill_down("v"), "up": fill_up("v"), "high": total("v", "max"), "run": running("v")}, levels)
    w = Window.partitionBy("g").orderBy("id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = log.withColumns({
        "p": F.lag("v").over(w), "n": F.lead("v").over(w), "down": F.last("v", True).over(upto),
        "up": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)), "high": F.max("v").over(Window.partitionBy("g")), "run": F.sum("v").over(upto)})
    assert rows(got) == rows(want)


@pytest.mark.parametrize("value", ["s", "v"])
def test_one_scan_and_one_row_exchange(spark, tmp_path, value):
    cols = {"p": lag(value), "n": lead("v"), "run": running("v")}
    path = str(tmp_path / "log")
    spark.range(5000).selectExpr("id % 3 as g", "id", "id % 11 as v", "cast(id % 7 as string) as s", "id * 2 as unused").write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ordered_pass(spark.read.parquet(path), ["g"], ["id"], bucket_of("id", 64), cols).select("id", "p")
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange [") == 1
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(_key" in x and "_bucket" in x and "_row" not in x and "REPARTITION" in x]) == 1


def test_a_sparse_log_is_cut_twice(spark):
    """A million rows, each a bucket of its own: with two levels no window holds more than a block of them."""
    log = spark.range(1_000_000).selectExpr("0 as g", "id * 100000 as id", "id % 5 as v")
    done = ordered_pass(log, ["g"], ["id"], bucket_of("id"), {"p": lag("v"), "run": running("v")}, levels=2)
    got = done.agg(F.sum("p"), F.count("p"), F.max("run"), F.sum(F.col("run") % 1000)).first()
    want = sum(i % 5 for i in range(999_999)), 999_999, 2_000_000
    assert tuple(got)[:3] == want
    run, check = 0, 0
    for i in range(1_000_000):
        run += i % 5
        check += run % 1000
    assert got[3] == check


def test_without_keys_rows_spread_over_tasks(spark):
    log = spark.range(4000).selectExpr("id", "id % 9 as v").repartition(3)
    done = ordered_pass(log, [], ["id"], bucket_of("id", 100), {"run": running("v"), "p": lag("id")})
    assert done.where("coalesce(p, -1) <> id - 1").count() == 0 and done.agg(F.max("run")).first()[0] == sum(i % 9 for i in range(4000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = done.select(F.spark_partition_id().alias("t")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 1


def test_columns_may_have_any_name(spark):
    names = ["_key", "_bucket", "_row", "_o0", "_v0", "_first", "_last", "a.b"]
    log = spark.createDataFrame([(i % 2, i, *[f"{n}{i}" for n in names]) for i in range(9)], ["g", "id", *names])
    got = {r.id: r for r in ordered_pass(log, ["g"], ["id"], bucket_of("id", 2), {"p": lag("_key"), "n": running(F.lit(1))}).collect()}
    assert all(got[i][n] == f"{n}{i}" for i in range(9) for n in names)
    assert got[5].p == "_key3" and got[0].p is None and got[8].n == 5


def test_replaces_a_column_of_the_same_name(log):
    got = ordered_pass(log, ["g"], ["id"], bucket_of("id", 9), {"v": running("v")})
    assert sorted(got.columns) == ["g", "id", "s", "v"]


@pytest.mark.parametrize("width", [6, 11, 1000])
def test_rolling_mean(log, width):
    numbered = ordered_pass(log, ["g"], ["id"], bucket_of("id", 20), {"pos": running(F.lit(1))})
    got = rolling_mean(numbered, ["g"], "pos", {"m": "v"}, 6, width)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(-5, 0)
    want = log.withColumn("m", F.when(F.count(F.lit(1)).over(w) == 6, F.avg("v").over(w)))
    assert rows(got, "g", "id", "m") == rows(want, "g", "id", "m")


def test_block_halo_sees_its_look_back(log):
    numbered = ordered_pass(log, ["g"], ["id"], bucket_of("id", 20), {"pos": running(F.lit(1))})
    got, w, keep = with_block(numbered, ["g"], "pos", 2, width=5)
    got = got.withColumn("two_back", F.lag("id", 2).over(w)).where(keep)
    plain = Window.partitionBy("g").orderBy("id")
    want = log.withColumn("two_back", F.lag("id", 2).over(plain))
    assert rows(got, "g", "id", "two_back") == rows(want, "g", "id", "two_back")


def test_no_window_spans_a_whole_group(log):
    plan = ordered_pass(
        log, ["g"], ["id"], bucket_of("id", 10), {"p": lag("v")}
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "_bucket" in plan


def test_null_keys_and_null_order_values_keep_their_rows(spark):
    frame = spark.createDataFrame([("a", 1, 10), (None, 1, 20), (None, 2, 30), ("a", None, 40), (None, None, 50)], "k string, t int, v int")
    got = rows(ordered_pass(frame, ["k"], ["t"], bucket_of("t", 1), {"prev": lag("v"), "sum": running("v")}), "k", "t", "v", "prev", "sum")
    assert got == [("a", 1, 10, 40, 50), ("a", None, 40, None, 40), (None, 1, 20, 50, 70), (None, 2, 30, 20, 100), (None, None, 50, None, 50)]
