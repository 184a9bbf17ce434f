import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.operators import ranking
from courtside.operators.ranking import (
    exact_quantiles, quantile_buckets, range_buckets, top_dense, top_n_ties, value_ranks, with_rank,
)
from courtside.operators.verbs import attach, keep_groups_where_all


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    # a third of the rows share one value
    data = [
        (rng.choice("ab"), i, None if i % 17 == 0 else (3.5 if i % 3 == 0 else round(rng.random() * 40, 1)))
        for i in range(400)
    ]
    return spark.createDataFrame(data, "g string, id int, x double").cache()


def test_buckets_follow_the_order(values):
    got = [
        (r.x, r.b) for r in quantile_buckets(values.where("x is not null"), "x", "b", 4).collect()
    ]
    got.sort()
    assert [b for _, b in got] == sorted(b for _, b in got)
    assert len({b for _, b in got}) > 4


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("kind,fn", [("rank", F.rank), ("dense", F.dense_rank), ("percent", F.percent_rank)])
def test_ranks(values, keys, kind, fn):
    got = with_rank(values, keys, "x", "r", kind, descending=True)
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.col("x").desc())
    want = values.where("x is not null").withColumn("r", fn().over(w))
    clean = lambda df: [(a, b, round(float(c), 9)) for a, b, c in rows(df, "g", "id", "r")]
    assert clean(got.where("x is not null")) == clean(want)
    assert got.where("x is null and r is not null").count() == 0


def test_exact_quantiles(values):
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.g: r for r in exact_quantiles(values, ["g"], "x", probs).collect()}
    for g in "ab":
        xs = [r.x for r in values.where(F.col("g") == g).collect() if r.x is not None]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(float(np.quantile(xs, p)))


def test_top_n_keeps_all_ties(spark):
    df = spark.createDataFrame([(i, [9, 8, 8, 8, 5, 1][i]) for i in range(6)], "id int, x int")
    assert rows(top_n_ties(df, "x", 2, "rk")) == [(0, 9, 1), (1, 8, 2), (2, 8, 2), (3, 8, 2)]
    assert [r[0] for r in rows(top_dense(df, "x", 3, "rk"))] == [0, 1, 2, 3, 4]


def test_null_groups_and_descending_text(spark):
    frame = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), (None, "z", 3.0), (None, "zz", 5.0), (None, None, None)], "k string, s string, v double")
    got = with_rank(frame, ["k"], "s", "r", "dense", descending=True)
    assert rows(got, "k", "s", "r") == [("a", "x", 2), ("a", "y", 1), (None, "z", 2), (None, "zz", 1), (None, None, None)]
    assert rows(exact_quantiles(frame, ["k"], "v", {"m": 0.5})) == [("a", 1.5), (None, 4.0)]


def test_groups_of_nulls_keep_a_row(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, None)], "g string, v double")
    assert rows(exact_quantiles(frame, ["g"], "v", {"m": 0.5})) == [("a", 2.0), ("b", None), (None, None)]
    assert rows(exact_quantiles(frame, [], "v", {"m": 0.5})) == [(2.0,)]


def test_columns_may_have_internal_names(spark):
    names = ["_key", "_value", "k", "v", "o", "b", "n_rows", "_cuts", "_all"]
    frame = spark.createDataFrame([("a", i, *[f"{n}{i}" for n in names]) for i in range(4)], ["g", "x", *names])
    for got in (with_rank(frame, ["g"], "x", "r"), attach(frame, ["g"], top=F.max("x")), keep_groups_where_all(frame, ["g"], F.col("x") >= 0)):
        kept = {r.x: r for r in got.collect()}
        assert len(kept) == 4 and all(kept[i][n] == f"{n}{i}" for i in range(4) for n in names)
    assert {(r.v, r.rank_min) for r in value_ranks(frame, ["k"], "v").collect()} == {(f"v{i}", 1) for i in range(4)}
    assert [r[0] for r in rows(with_rank(frame, ["g"], "x", "x"), "x")] == [1, 2, 3, 4]


def test_buckets_beyond_one_row_of_cuts_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_VALUES", 100)
    monkeypatch.setattr(ranking, "MOST_BITS", 5)
    values = spark.range(60_000).selectExpr("id", "pow(id, 1.5) as x")
    sized = range_buckets(values, "x", "b", 60_000)
    assert sized.columns == ["id", "x", "b"]
    most, n = sized.groupBy("b").count().agg(F.max("count"), F.count("*")).first()
    assert most < 400 and n > 400
    assert sized.agg(F.max("x").alias("m")).count() == 1
    edges = sorted((r.lo, r.hi) for r in sized.groupBy("b").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    order = [r.b for r in sized.orderBy("x").select("b").collect()]
    assert order == sorted(order)
    ranked = with_rank(values, [], "x", "r")
    assert ranked.where("r <> id + 1").count() == 0
