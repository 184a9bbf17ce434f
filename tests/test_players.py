import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from courtside.functions import text as X
from courtside.functions.clock import league_year, season_label, start_minutes
from courtside.operators.stats import binomial_glm, rank_sum_matrix, regression_lines, with_holm
from courtside.plans import players as P


@pytest.mark.parametrize("block", [1, 3, 512])
def test_duo_blocks_give_every_pair(spark, block):
    rng = random.Random(4)
    data = sorted({(f"P{rng.randrange(9)}", rng.choice(["NOK", "NOP", "LAL", "TOT"]), rng.choice([1990, 1995, 1996]))
                   for _ in range(60)})
    df = spark.createDataFrame(data, "player string, team_id string, year int")
    got = dict(rows(P.duo_teams(df, block=block), "duo", "dis_teams"))
    canon = lambda t: {"NOK": "NOH", "NOP": "NOH"}.get(t, t)
    kept = {(p, canon(t), y) for p, t, y in data if y > 1990 and t != "TOT"}
    want = {}
    for a, t, y in kept:
        for b, t2, y2 in kept:
            if a != b and (t, y) == (t2, y2):
                want.setdefault(f"{b} {a}", set()).add(t)
    assert got == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("block", [4, 512])
def test_duo_tasks_follow_the_pairs(spark, block):
    rng = random.Random(11)
    data = {(f"P{rng.randrange(40)}", "LAL", y) for y in range(1991, 2021) for _ in range(9)}
    data |= {(p, rng.choice(["LAL", "NOK", "NOP"]), y) for y in range(1991, 2021) for p in ("hot", "pair")}
    data |= {(None, "LAL", 1999), ("P1", None, 1999), ("P1", "LAL", None)}
    df = spark.createDataFrame(sorted(data, key=str), "player string, team_id string, year int")
    out = P.duo_teams(df.union(df), block=block, most=50).select("duo", "dis_teams", F.spark_partition_id().alias("task"))
    canon = lambda t: {"NOK": "NOH", "NOP": "NOH"}.get(t, t)
    kept = {(p, canon(t), y) for p, t, y in data if p and t and y}
    want = {}
    for a, t, y in kept:
        for b, t2, y2 in kept:
            if a != b and (t, y) == (t2, y2):
                want.setdefault(f"{b} {a}", set()).add(t)
    got = out.collect()
    assert {r.duo: r.dis_teams for r in got} == {k: len(v) for k, v in want.items()} and len(got) == len(want)
    pairs = sum(len([1 for k in kept if k[1:] == r]) * (len([1 for k in kept if k[1:] == r]) - 1) // 2 for r in {k[1:] for k in kept})
    assert pairs > 1000 and len({r.task for r in got}) > pairs // 50 // 2 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_initials(spark):
    df = spark.createDataFrame([("LeBron James",), ("Nene",)], "n string")
    assert rows(df.select(X.initials(F.col("n")))) == [("LJ",), ("NN",)]


def test_rank_sum_against_pooled_ranks(spark):
    rng = random.Random(8)
    data = [(rng.choice("abc"), float(rng.randrange(6)), rng.random()) for _ in range(150)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = {(r.metric, r.group_1, r.group_2): r for r in rank_sum_matrix(df, "g", list("abc"), ["x", "y"]).collect()}
    assert len(got) == 6
    for (metric, g1, g2), r in got.items():
        col = 1 if metric == "x" else 2
        a = [d[col] for d in data if d[0] == g1]
        b = [d[col] for d in data if d[0] == g2]
        pool = sorted(a + b)
        mid = {v: pool.index(v) + (pool.count(v) + 1) / 2 for v in set(pool)}
        w = sum(mid[v] for v in a) - len(a) * (len(a) + 1) / 2
        assert r.w == pytest.approx(w) and (r.n1, r.n2) == (len(a), len(b))
        n = len(pool)
        ties = sum(pool.count(v) ** 3 - pool.count(v) for v in set(pool))
        var = len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1)))
        gap = w - len(a) * len(b) / 2
        z = (gap - 0.5 * (gap > 0) + 0.5 * (gap < 0)) / var**0.5
        from statistics import NormalDist

        assert r.z == pytest.approx(z)
        assert r.p_value == pytest.approx(2 * (1 - NormalDist().cdf(abs(z))), abs=2e-7)


def test_holm_with_ties_and_nulls(spark):
    data = [("x", "a", 0.01), ("x", "b", 0.04), ("x", "c", 0.03), ("x", "d", 0.03), ("x", "e", None), ("y", "a", 0.7), ("y", "b", 0.6)]
    got = {(r.m, r.t): r.p_holm for r in with_holm(spark.createDataFrame(data, "m string, t string, p_value double"), ["m"]).collect()}
    want = {"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.09}
    assert {t: pytest.approx(p) for t, p in want.items()} == {t: got["x", t] for t in want}
    assert got["x", "e"] is None and got["y", "a"] == got["y", "b"] == 1.0


def test_regression_line(spark):
    df = spark.createDataFrame([("a", float(x), 3.0 * x + 1) for x in range(5)], "g string, x double, y double")
    r = regression_lines(df, ["g"], "y", "x").first()
    assert (r.slope, r.intercept, r.n) == (pytest.approx(3), pytest.approx(1), 5)
    assert r.slope_se == pytest.approx(0, abs=1e-6)


def test_glm_terms(spark):
    rng = random.Random(1)
    df = spark.createDataFrame(
        [(rng.random(), float(rng.randrange(2)), rng.random(), rng.random()) for _ in range(200)],
        "freq double, win double, time double, adv double")
    got = binomial_glm(df, "freq ~ win + time + adv + time:adv")
    assert [r.term for r in got.collect()][0] == "(Intercept)" and got.count() == 5


def test_milestones(spark):
    box = spark.createDataFrame(
        [("a", 1, 20, 3, 11), ("a", 2, 20, 3, 11), ("a", 3, 20, 5, 11), ("b", 1, 2, 3, 11)],
        "player string, game_id int, points int, rebounds int, assists int")
    reb = spark.createDataFrame(
        [("a", 1, i, c) for i, c in ((1, 900), (2, 700), (3, 20))] + [("a", 2, i, c) for i, c in ((1, 900), (2, 60), (3, 51))],
        "player string, game_id int, id long, clock int")
    got = P.milestone_timing(box, reb, nth=3, width=2).collect()
    assert [(r.player, r.n, r.freq, r.n_total_trips) for r in got] == [("a", 1, 0.5, 3)]


def test_break_numbers_fill_up_then_down(spark):
    data = [
        # id, is_break, shooting, player: shots before, between and after two timeouts
        (1, False, True, "a"), (2, False, True, "b"), (3, True, False, None), (4, False, True, "b"),
        (5, True, False, None), (6, False, True, "a"),
    ]
    df = spark.createDataFrame(
        [(1, 1, i, 9, p, b, s, False, False) for i, b, s, p in data],
        "game_id int, qtr int, id long, team_id int, player string, is_break boolean, shooting boolean, "
        "skip boolean, miss boolean")
    for width in (2, 100):
        got = {r.player: r.n for r in P.first_action_after_break(df, width).collect()}
        # first shot up to timeout 1 is a's, up to timeout 2 (and after) b's
        assert got == {"a": 1, "b": 1}


def test_played_vs_missed_equals_the_grid(spark):
    games = [(1, f"2024-01-{d:02d}", float(d * d % 11)) for d in range(1, 13)]
    played = [(1, f"2024-01-{d:02d}", p) for p in ("a", "b") for d in range(1, 13) if (d + len(p) + ord(p)) % 3]
    got = P.played_vs_missed(
        spark.createDataFrame(games, "team_id int, game_date string, rate double"),
        spark.createDataFrame(played, "team_id int, game_date string, player string"), 1, 1).collect()
    for r in got:
        on = {g for _, g, p in played if p == r.player}
        rates = {g: v for _, g, v in games}
        miss = [v for g, v in rates.items() if g not in on]
        assert r.mean_true == pytest.approx(sum(rates[g] for g in on) / len(on))
        assert r.mean_false == pytest.approx(sum(miss) / len(miss))


def test_succession_and_reunions(spark):
    seasons = spark.createDataFrame(
        [("p", "AAA", 2000), ("p", "BBB", 2001), ("q", "AAA", 2000)], "player string, team_id string, year int")
    coaches = spark.createDataFrame([("AAA", 2000, "c"), ("BBB", 2001, "c")], "team_id string, year int, coach string")
    assert rows(P.coach_player_reunions(seasons, coaches)) == [("c", 2, 1, 0.5)]
    chain = P.franchise_succession(seasons)
    assert rows(chain, "team_id", "next_team") == [("AAA", "BBB")]
    # the two teams are one franchise, so nobody was met twice
    assert P.coach_player_reunions(seasons, coaches, chain).count() == 0


def test_dates(spark):
    df = spark.createDataFrame([("2020-11-02", "7:30p"), ("2021-04-02", "12:05a"), ("2021-07-01", "12:00p")], "d string, t string")
    day = F.to_date("d")
    assert rows(df.select(league_year(day), start_minutes(F.col("t")), season_label(F.year(day)))) == [
        ("2020-2021", 1170, "2020-21"), ("2020-2021", 5, "2021-22"), (None, 720, "2021-22")]
