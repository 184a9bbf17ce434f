"""Distribution functions against tabulated values, tests and fits against numpy."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from courtside.functions.maths import beta_cdf, fisher_p, ln_gamma, student_p
from courtside.operators import stats as S


def values(spark, frame, column):
    return [r[0] for r in frame.select(column).collect()]


def test_student_p_of_tabulated_points(spark):
    # (t, df, two-sided p) from the usual tables
    table = [(12.706204736, 1, 0.05), (4.302652730, 2, 0.05), (2.228138852, 10, 0.05), (3.169272673, 10, 0.01), (1.959963985, 10**9, 0.05),
             (2.042272456, 30, 0.05), (3.291, 10**7, 0.000998311), (0.0, 5, 1.0), (-2.228138852, 10, 0.05), (63.65674116, 1, 0.01)]
    frame = spark.createDataFrame([(float(t), d) for t, d, _ in table], "t double, d long")
    for got, (_, _, want) in zip(values(spark, frame, student_p(F.col("t"), F.col("d"))), table):
        assert got == pytest.approx(want, abs=2e-7)
    assert values(spark, frame.limit(1), student_p(F.col("t"), F.lit(0))) == [None]


def test_fisher_p_of_tabulated_points(spark):
    table = [(4.964602744, 1, 10, 0.05), (3.325834530, 5, 10, 0.05), (2.705543455, 1, 10**9, 0.10), (6.944271910, 2, 4, 0.05), (0.0, 3, 7, 1.0)]
    frame = spark.createDataFrame([(float(f), a, b) for f, a, b, _ in table], "f double, a long, b long")
    for got, (*_, want) in zip(values(spark, frame, fisher_p(F.col("f"), F.col("a"), F.col("b"))), table):
        assert got == pytest.approx(want, abs=1e-6)


def test_gamma_and_beta(spark):
    frame = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.5, 10.0, 1234.5)], "x double")
    assert values(spark, frame, ln_gamma(F.col("x"))) == pytest.approx([math.lgamma(x) for x in (0.5, 1.0, 2.5, 10.0, 1234.5)], rel=1e-10, abs=1e-10)
    grid = [(x, a, b) for x in (0.0, 0.05, 0.5, 0.95, 1.0) for a in (0.5, 2.0, 30.0) for b in (0.5, 4.0)]
    got = values(spark, spark.createDataFrame(grid, "x double, a double, b double"), beta_cdf(F.col("x"), F.col("a"), F.col("b")))
    for (x, a, b), y in zip(grid, got):
        u = (np.arange(200_000) + 0.5) / 200_000 * math.pi / 2  # t = sin(u)^2 takes the ends' poles away
        weight = 2 * np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)
        assert y == pytest.approx(weight[np.sin(u) ** 2 <= x].sum() / weight.sum(), abs=1e-4)


def test_correlation_test_and_its_edges(spark):
    rng = random.Random(1)
    data = [("many", x, x + rng.gauss(0, 40)) for x in range(40)] + [("line", x, 2.0 * x) for x in range(5)] + [("down", x, -2.0 * x) for x in range(3)]
    data += [("two", 1, 2.0), ("two", 2, 5.0), ("flat", 1, 2.0), ("flat", 1, 3.0), ("flat", 1, 4.0), ("none", None, 1.0), ("three", 1, 1.0), ("three", 2, 5.0), ("three", 3, 4.0)]
    got = {r.g: r for r in S.correlation_test(spark.createDataFrame([(g, None if x is None else float(x), y) for g, x, y in data], "g string, x double, y double"), ["g"], "x", "y").collect()}
    x, y = np.array([(x, y) for g, x, y in data if g == "many"]).T
    r = np.corrcoef(x, y)[0, 1]
    assert got["many"].r == pytest.approx(r) and got["many"].low == pytest.approx(math.tanh(math.atanh(r) - 1.959963985 / math.sqrt(37)), abs=1e-8)
    assert 0 < got["many"].p_value < 1 and got["many"].low < r < got["many"].high
    assert (got["line"].r, got["line"].p_value, got["line"].low, got["line"].high) == (1.0, 0.0, 1.0, 1.0)
    assert (got["down"].r, got["down"].p_value, got["down"].low) == (-1.0, 0.0, None)
    assert got["two"].p_value is None and got["flat"].r is None and got["flat"].p_value is None and "none" not in got
    assert got["three"].p_value is not None and got["three"].low is None


def test_regression_interaction_equals_one_dense_fit(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, 200)
    x = rng.normal(size=200) * 5 + 20
    y = np.array([1.0, 2.0, -1.0])[g] + np.array([0.5, 0.7, 0.5])[g] * x + rng.normal(size=200)
    frame = spark.createDataFrame([("f", f"g{a}", float(b), float(c)) for a, b, c in zip(g, x, y)] + [("f", None, 1.0, 1.0), ("f", "g0", None, 1.0), ("f", "lone", 3.0, 3.0)], "fam string, grp string, x double, y double")
    got = {r.term: r for r in S.regression_interaction(frame, ["fam"], "grp", "y", "x", "g0").collect()}
    design = np.stack([np.ones(200), x, g == 1, (g == 1) * x, g == 2, (g == 2) * x], axis=1).astype(float)
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 194)
    for term, b, e in zip(["(Intercept)", "x", "g1", "x:g1", "g2", "x:g2"], beta, se):
        assert got[term].estimate == pytest.approx(b, rel=1e-6) and got[term].std_error == pytest.approx(e, rel=1e-6)
    _, common, *_ = np.linalg.lstsq(design[:, [0, 1, 2, 4]], y, rcond=None)
    assert got["x"].f == pytest.approx((common[0] - rss[0]) / 2 / (rss[0] / 194), rel=1e-6) and got["x"].df == 194 and len(got) == 6


def test_logistic_table_equals_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    frame = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = {r.term: r for r in S.logistic_table(frame, "y", {"a": F.col("a"), "b": F.col("b")}).collect()}
    design, beta = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        info = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, design.T @ (y - p))
    for term, b, e in zip(["(Intercept)", "a", "b"], beta, np.sqrt(np.diag(np.linalg.inv(info)))):
        assert got[term].estimate == pytest.approx(b, rel=1e-6) and got[term].std_error == pytest.approx(e, rel=1e-6)
        assert got[term].z == pytest.approx(b / e, rel=1e-6) and got[term].df == 297
    assert got["a"].deviance == pytest.approx(-2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), rel=1e-8)
    with pytest.raises(ValueError, match="dependent"):
        S.logistic_table(frame, "y", {"a": F.col("a"), "twice": 2 * F.col("a")})
    with pytest.raises(ValueError, match="no rows"):
        S.logistic_table(frame.limit(0), "y", {"a": F.col("a")})


def test_rank_sums_of_all_groups_equal_the_listed_ones(spark):
    rng = random.Random(6)
    frame = spark.createDataFrame([(rng.choice("abcd"), float(rng.randrange(30))) for _ in range(400)] + [("a", None), (None, 3.0), ("e", 7.0)], "g string, v double")
    listed = S.rank_sum_matrix(frame, "g", ["a", "b", "c", "d", "e"], ["v"]).drop("metric")
    found = S.rank_sum_all_groups(frame, "g", "v")
    tidy = lambda df: [(a, b, n, m, w, round(z, 9), round(p, 9)) for a, b, n, m, w, z, p in rows(df, "group_1", "group_2", "n1", "n2", "w", "z", "p_value")]
    assert tidy(found) == tidy(listed) and found.count() == 10


def test_rank_sum_plan_does_not_grow_with_the_groups(spark):
    few, many = (spark.range(3000).selectExpr(f"id % {n} as g", "id % 97 as v") for n in (3, 100))
    size = lambda df: len(S.rank_sum_all_groups(df, "g", "v")._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(few) - size(many)) < 500
