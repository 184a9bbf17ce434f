"""Lineups, segments, stints and their assignment, overtime included."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from courtside.plans import lineups as L
from courtside.plans import onoff as O
from courtside.sources.tables import publish_lineups

ROSTER = [(p, 1, 1) for p in (2, 9, 10)] + [(p, 1, 2) for p in (21, 22)]
# id, team, quarter, clock, player in, player out
SUBS = [
    (1, 1, 1, 2400, 9, None), (2, 1, 1, 2400, 10, None), (3, 2, 1, 2400, 21, None),
    (20, 1, 2, 1700, 2, 10), (30, 2, 3, 900, 22, 21), (40, 1, 5, 300, 10, 2), (41, 2, 5, 300, 21, 22),
]


@pytest.fixture(scope="module")
def tables(spark):
    roster = spark.createDataFrame(ROSTER, "player_id int, game_id int, team_id int")
    subs = spark.createDataFrame(
        [(i, 1, t, q, f"{c % 600 // 60}:00", c, c % 600, None, a, b) for i, t, q, c, a, b in SUBS],
        "id long, game_id int, team_id int, quarter int, quarter_time string, end_game_seconds_remaining int, "
        "end_quarter_seconds_remaining int, user_time timestamp, parameters_player_in int, parameters_player_out int",
    )
    lineups = L.lineup_key(L.on_court_state(roster, subs, width=8)).cache()
    acts = spark.createDataFrame(
        [(1, q, i) for q, i in ((1, 1), (2, 20), (3, 30), (4, 39), (5, 60))], "game_id int, quarter int, id long"
    )
    return roster, subs, lineups, acts


def test_states_match_listing_every_player_with_every_substitution(spark, tables):
    roster, subs, lineups, _ = tables
    want = {}
    for p, _, team in ROSTER:
        state = None
        for i, t, q, c, a, b in SUBS:
            if t != team:
                continue
            state = True if p == a else False if p == b else state
            want[(team, q, c, p)] = (i, state)
    got = {
        (r.team_id, r.quarter, r.end_game_seconds_remaining, r.player_id): (r.id, r.is_on_verdict)
        for r in lineups.collect()
    }
    assert got == want


def test_lineup_ids_are_numeric_and_hashed(tables):
    lineups = tables[2]
    first = lineups.where("team_id = 1 and quarter = 1").first()
    assert (first.lineup_id, first.n_on) == ("9_10", 2)
    assert first.lineup_hash == hashlib.md5(b"9_10").hexdigest()
    assert lineups.where("size(split(lineup_id, '_')) <> n_on").count() == 0


def test_empty_lineup_has_no_hash(spark):
    state = spark.createDataFrame(
        [(1, 1, 1, 100, 5, False), (1, 1, 1, 100, 6, None)],
        "game_id int, team_id int, quarter int, end_game_seconds_remaining int, player_id int, is_on_verdict boolean",
    )
    assert {(r.lineup_id, r.n_on, r.lineup_hash) for r in L.lineup_key(state).collect()} == {(None, 0, None)}


def test_segments_tile_and_reset_before_overtime(tables):
    seg = L.lineup_segments(tables[2], tables[3])
    got = rows(seg, "team_id", "quarter", "start_segment", "end_segment", "start_id", "end_id")
    assert got == [
        (1, 1, 2400, 1700, 2, 20), (1, 2, 1700, 0, 20, 40), (1, 5, 300, 0, 40, 60),
        (2, 1, 2400, 900, 3, 30), (2, 3, 900, 0, 30, 41), (2, 5, 300, 0, 41, 60),
    ]
    last = L.lineup_segments(tables[2], tables[3], include_last=True).where("quarter = 5")
    assert {r.end_id for r in last.collect()} == {61}


def test_stints_and_assignment(spark, tables):
    stints = L.stints(L.lineup_segments(tables[2], tables[3]), width=4).cache()
    spans = rows(stints.where("team_id = 1"), "q_bucket", "final_start_id", "final_end_id",
                 "final_start_seg", "final_end_seg", "segment_id")
    assert spans == [
        (0, 20, 30, 1700, 900, 2), (0, 3, 20, 2400, 1700, 1), (0, 30, 40, 900, 0, 3), (5, 41, 60, 300, 0, 4),
    ]
    poss = spark.createDataFrame(
        [(1, 1, 1, 0, i, 0, 2, True) for i in (2, 3, 19, 20, 39)]
        + [(1, 1, 5, 5, i, 10, 3, True) for i in (45, 59, 60)],
        "game_id int, team_id int, quarter int, q_bucket int, id long, end_game_seconds_remaining int, "
        "team_score int, final_end_poss boolean",
    )
    got = L.assign_stints(poss, stints, width=4)
    assert set(rows(got, "id", "segment_id")) == {
        (2, None), (3, 1), (19, 1), (20, 2), (39, 3), (45, 4), (59, 4), (60, None)}
    assert got.where("id = 2").first().end_game_seconds_remaining == pytest.approx(0.00001)

    sided = L.two_sided(got, ["id", "game_id", "quarter", "team_score", "final_end_poss"]).cache()
    assert sided.count() == 12
    assert rows(sided.groupBy("type_lineup", "team_id").count()) == [("defense", 2, 6), ("offense", 1, 6)]
    assert L.two_sided(got, ["id"], exclude_games=[1]).count() == 0

    # on plus off equals the team's possessions, for every player
    total = O.player_side_sums(tables[2], sided)
    for side, team in (("offense", 1), ("defense", 2)):
        per = total.where((F.col("type_lineup") == side) & (F.col("team_id") == team))
        assert {r.s for r in per.groupBy("player_id").agg(F.sum("total_poss").alias("s")).collect()} == {6}


def test_net_columns(spark):
    data = [
        (7, 1, on, side, pts, 100, float(pts))
        for on, side, pts in (
            (True, "offense", 110), (False, "offense", 100), (True, "defense", 95), (False, "defense", 99))
    ]
    rated = spark.createDataFrame(
        data, "player_id int, team_id int, is_on_verdict boolean, type_lineup string, total_pts int, "
              "total_poss int, ppp_calc double")
    got = {(r.is_on_verdict, r.type_lineup): (r.net_rtg, r.total_net_rtg) for r in O._net_columns(rated).collect()}
    assert got[(True, "offense")] == (10.0, 14.0)
    assert got[(True, "defense")] == (-4.0, None)
    assert got[(False, "offense")] == (None, None)


def test_publish_lineups_and_dimensions(spark, tables):
    publish_lineups(tables[2])
    assert spark.table("lineups_lookup").count() == tables[2].count()
    dim = rows(spark.table("lineup_dim"), "lineup_id")
    assert ("9_10",) in dim and len(dim) == len(set(dim))
    members = spark.table("lineup_players").join(spark.table("lineup_dim"), "lineup_hash")
    assert {r.player_id for r in members.where("lineup_id = '9_10'").collect()} == {9, 10}


def test_one_lineup_and_one_player(spark):
    sided = spark.createDataFrame(
        [("h1", "offense", 1, 1, 1, 2, True), ("h1", "offense", 1, 1, 2, 3, True), ("h2", "offense", 1, 1, 1, 0, True)],
        "lineup_hash string, type_lineup string, team_id int, game_id int, quarter int, team_score int, final_end_poss boolean")
    lineups = spark.createDataFrame(
        [(5, 1, "h1", True), (6, 1, "h2", True), (5, 1, "h2", False)],
        "player_id int, team_id int, lineup_hash string, is_on_verdict boolean")
    assert rows(O.player_on_off(lineups, sided, 5), "is_on", "total_pts", "total_poss", "pts_per_poss") == [
        (False, 0, 1, 0.0), (True, 5, 2, 250.0)]
    assert O.lineup_game_breakdown(sided, "h1").count() == 2
