"""Rule-heavy possession logic on a hand-made game."""

from conftest import rows
from pyspark.sql import functions as F

from courtside.plans import possessions as P
from courtside.schemas import ACTIONS

KEEP = [
    "game_id", "id", "parent_action_id", "quarter", "type", "parameters_type", "parameters_made",
    "parameters_points", "parameters_free_throw_number", "parameters_free_throws_awarded", "team_id",
    "end_game_seconds_remaining",
]


def actions(spark, data):
    df = spark.createDataFrame(
        data,
        "game_id int, id long, parent_action_id long, quarter int, type string, parameters_type string, "
        "parameters_made string, parameters_points int, parameters_free_throw_number int, "
        "parameters_free_throws_awarded int, team_id int, end_game_seconds_remaining int",
    )
    missing = [f for f in ACTIONS if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


GAME = [
    # made shot
    (1, 10, 0, 1, "shot", "2-pt", "made", 2, None, None, 1, 2390),
    # miss, defensive rebound
    (1, 20, 0, 1, "shot", "2-pt", "missed", 2, None, None, 2, 2370),
    (1, 21, 20, 1, "rebound", "defensive", None, None, None, None, 1, 2369),
    # miss, offensive rebound
    (1, 30, 0, 1, "shot", "3-pt", "missed", 3, None, None, 1, 2350),
    (1, 31, 30, 1, "rebound", "offensive", None, None, None, None, 1, 2349),
    # and-one: made shot and last free throw under one parent
    (1, 40, 0, 1, "shot", "2-pt", "made", 2, None, None, 1, 2330),
    (1, 41, 40, 1, "foul", "personal", None, None, None, None, 2, 2330),
    (1, 42, 40, 1, "freeThrow", None, "made", None, 1, 1, 1, 2330),
    # blocked shot, block, defensive rebound
    (1, 50, 0, 1, "shot", "2-pt", "blocked", 2, None, None, 2, 2310),
    (1, 51, 50, 1, "block", None, None, None, None, None, 1, 2310),
    (1, 52, 50, 1, "rebound", "defensive", None, None, None, None, 1, 2309),
    # technical: no possession
    (1, 60, 0, 1, "foul", "technical", None, None, None, None, 2, 2300),
    (1, 61, 60, 1, "freeThrow", None, "made", None, 1, 1, 1, 2300),
    # turnover
    (1, 70, 0, 1, "turnover", "bad pass", None, None, None, None, 1, 2290),
    # end of quarter right after a missed shot
    (1, 80, 0, 1, "shot", "2-pt", "missed", 2, None, None, 1, 1801),
    (1, 81, 0, 1, "quarter", "end-of-quarter", None, None, None, None, 0, 1800),
    # end of quarter after an offensive rebound
    (1, 90, 0, 2, "shot", "2-pt", "missed", 2, None, None, 1, 1202),
    (1, 91, 90, 2, "rebound", "offensive", None, None, None, None, 1, 1201),
    (1, 92, 0, 2, "quarter", "end-of-quarter", None, None, None, None, 0, 1200),
    # end of quarter after a block of the same action: the shot is marked
    (1, 100, 0, 3, "shot", "2-pt", "blocked", 2, None, None, 2, 601),
    (1, 101, 100, 3, "block", None, None, None, None, None, 1, 601),
    (1, 102, 0, 3, "quarter", "end-of-quarter", None, None, None, None, 0, 600),
    # a block of another action marks nothing
    (1, 110, 0, 4, "shot", "2-pt", "missed", 2, None, None, 2, 2),
    (1, 111, 0, 4, "block", None, None, None, None, None, 1, 1),
    (1, 112, 0, 4, "quarter", "end-of-quarter", None, None, None, None, 0, 0),
]
WANT = {
    10: True, 20: True, 21: False, 30: False, 31: False, 40: None, 41: False, 42: True,
    # in an action with a block every row takes the flag of the row after it
    50: True, 51: False, 52: None, 60: None, 61: None, 70: True, 80: True, 81: False,
    90: False, 91: True, 92: False, 100: True, 101: None, 102: False, 110: False, 111: False, 112: False,
}


def test_final_flags(spark):
    for width in (1, 1000):
        got = P.possessions(actions(spark, GAME), width).select("id", "final_end_poss").collect()
        assert {r.id: r.final_end_poss for r in got} == WANT


def test_overrides(spark):
    got = P.end_of_period_overrides(P.prepare_actions(actions(spark, GAME)), 16)
    assert rows(got, "quarter", "id") == [(1, 80), (2, 91), (3, 100)]


def test_team_ppp(spark):
    # team 1: 2 + 2 + 1 + 1 points over its five counted possessions
    got = dict(rows(P.team_ppp(P.possessions(actions(spark, GAME))), "team_id", "mean_ppp"))
    ends = [i for i, e in WANT.items() if e and dict((a[1], a[10]) for a in GAME)[i] == 1]
    assert got[1] == round(100 * 6 / len(ends), 1)
    # no point scored at all: the sum, and so the rate, is NULL
    assert got[2] is None
