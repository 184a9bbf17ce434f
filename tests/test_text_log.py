"""Text play-by-play parsing on a hand-made game with overtime."""

from conftest import rows

from courtside.plans import games as G
from courtside.plans import pbp as B

RAW = [
    ("12:00", "Jump ball", "0-0", ""), ("11:40", "P1 makes 2-pt shot from 4 ft", "2-0", ""),
    ("11:20", "", "2-0", "P2 misses 3-pt shot from 25 ft"), ("11:18", "Defensive rebound by P1", "2-0", ""),
    ("0:01", "", "2-0", "Turnover by P2"),
    ("12:00", "", "2-0", "Start"), ("10:00", "", "2-3", "P2 makes 3-pt shot from 26 ft"),
    ("12:00", "", "2-3", "Start"), ("6:00", "P1 misses free throw 2 of 2", "2-3", ""),
    ("5:58", "Offensive rebound by P1", "2-3", ""),
    ("12:00", "", "2-3", "Start"), ("0:10", "P1 makes free throw 1 of 2", "3-3", ""),
    ("5:00", "", None, "Start of overtime"), ("4:00", "P1 makes free throw 2 of 2", "4-3", ""),
]


def log(spark, width=3):
    raw = spark.createDataFrame(
        [("20240101A", i, t, v, s, h) for i, (t, v, s, h) in enumerate(RAW)],
        "game_id string, seq long, time string, visit_team string, score string, home_team string",
    )
    games = spark.createDataFrame(
        [("20240101A", "V", "H", 4, 3)],
        "game_id string, visitor_team_name string, home_team_name string, visitor_pts int, home_pts int",
    )
    return B.orient_events(B.flag_possessions_text(B.parse_pbp(raw, width)), games)


def test_clock_and_periods(spark):
    got = log(spark).orderBy("seq").collect()
    assert [r.period for r in got] == [1] * 5 + [2, 2, 3, 3, 3, 4, 4, 5, 5]
    assert [r.time for r in got] == [0, 20, 40, 42, 719, 720, 840, 1440, 1800, 1802, 2160, 2870, 2880, 2940]
    assert [r.time_offense for r in got][:3] == [None, 20, 20]
    assert got[4].time_minutes == 12 and got[1].time_minutes == 0


def test_features_and_possessions(spark):
    got = {r.seq: r for r in log(spark).collect()}
    assert (got[1].shot_type, got[1].has_made, got[1].points, got[1].distance) == ("2-pt", True, 2, 4.0)
    assert (got[2].shot_type, got[2].has_made, got[2].points, got[2].distance) == ("3-pt", False, 0, 25.0)
    assert [s for s, r in got.items() if r.end_poss] == [1, 2, 4, 6, 13]
    assert (got[2].team_offense, got[2].adv, got[2].is_leading) == ("H", -2, False)
    assert got[13].has_won and not got[6].has_won


def test_every_width_agrees(spark):
    assert rows(log(spark, 1)) == rows(log(spark, 1000))


def test_comeback_window(spark):
    events = [
        ("g", 10, -20, True), ("g", 12, -18, True), ("g", 15, 18, False), ("g", 30, -1, True),
        ("g", 44, 2, True), ("g", 50, 6, True), ("h", 10, -3, True), ("k", 9, -16, True),
    ]
    df = spark.createDataFrame(events, "game_id string, time int, adv int, has_won boolean")
    assert rows(G.comeback_windows(df)) == [("g", 10, 34, 44), ("k", 9, None, None)]


def test_blown_leads_equals_pairwise(spark):
    import random

    rng = random.Random(2)
    data = [
        (2022 + g % 2, g, rng.randrange(1, 5), 2880 - 60 * i, rng.randrange(0, 40), rng.randrange(0, 40))
        for g in range(20) for i in range(12)
    ]
    df = spark.createDataFrame(
        data, "season int, game_id int, qtr int, start_game_seconds_remaining int, home_score int, away_score int")
    got = {r.season: (r.n_comeback, r.n_total_leads, r.n_total) for r in G.blown_leads(df).collect()}
    for season in (2022, 2023):
        mine = [d for d in data if d[0] == season]
        big = [d for d in mine if abs(d[4] - d[5]) >= 15 and d[2] < 3]
        near = [d for d in mine if abs(d[4] - d[5]) <= 3]
        back = {b[1] for b in big for c in near if b[1] == c[1] and b[3] > c[3]}
        assert got[season] == (len(back), len({b[1] for b in big}), len({d[1] for d in mine}))


def test_droughts(spark):
    totals = [0, 2, 2, 2, 5, 5, 7]
    clocks = [700, 690, 650, 600, 500, 480, 180]
    df = spark.createDataFrame(
        [(1, 2024, 2, 1, i + 1, t, float(c)) for i, (t, c) in enumerate(zip(totals, clocks))],
        "game_id int, season int, season_type int, qtr int, id long, total_score int, clock double")
    for width in (3, 1000):
        got = rows(G.scoring_droughts(df, width=width), "stint_type", "time_no_score", "rank_time")
        # start at 650, end at 500 (150 s), start at 480 (20 s), end at 180 is the dropped 300 s
        assert got == [("end_stint", 150.0, 1), ("start_stint", 20.0, 2)]
