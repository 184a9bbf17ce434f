import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions import text as X
from courtside.operators import verbs as V
from courtside.operators.reshape import cut
from courtside.operators.sketches import merged, season_sketches
from courtside.plans import possessions as P
from courtside.session import checkpoint_root, own_database, stage
from courtside.sources import json_docs as J
from courtside.sources import pages as H
from courtside.sources import tables as S
from courtside.sources.tables import file_ranges, files_in_order, publish


def docs(spark, *bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "body string")


def test_result_sets(spark):
    one = {"resultSets": [{"headers": ["PLAYER_ID", "PTS"], "rowSet": [[7, 10.5], [8, None]]}], "parameters": {"Season": "2020-21"}}
    empty = {"resultSets": [{"headers": ["PTS"], "rowSet": []}], "parameters": {"Season": "x"}}
    late = {"resultSets": [{"headers": ["PTS", "PLAYER_ID"], "rowSet": [["n/a", 9]]}], "parameters": {"SeasonYear": "2021-22"}}
    got = J.result_sets(docs(spark, one, empty, late, "not json"), "body", ["PLAYER_ID", "PTS"], ["player_id"])
    assert rows(got) == [("7", 10.5, "2020-21"), ("8", None, "2020-21"), ("9", None, "2021-22")]


def test_nested_actions_and_rosters(spark):
    game = {"result": {"gameInfo": {"gameId": 5, "homeTeam": {"id": 1, "players": [{"id": 3}, {"id": 3}]},
                                    "awayTeam": {"id": 2, "players": [{"id": 4}]}},
                       "actions": [{"id": 1, "type": "shot", "quarter": 2, "quarterTime": "09:30", "parameters": {"points": 2}},
                                   {"id": 2, "type": "clock", "quarter": 2, "quarterTime": "09:00", "parameters": {}},
                                   {"id": 3, "type": "foul", "quarter": 5, "quarterTime": "01:10"}]}}
    acts = J.nested_actions(docs(spark, game), "body", "id:bigint,type:string,quarter:int,quarterTime:string", [("points", "int")])
    assert rows(acts, "game_id", "id", "parameters_points", "end_game_seconds_remaining") == [(5, 1, 2, 1770), (5, 3, None, 70)]
    bare = {"result": {"gameInfo": {"gameId": 6, "homeTeam": {"id": 1, "players": [{"id": 3}]}}}}
    assert rows(J.rosters(docs(spark, game, bare), "body", "id:int"), "player_id", "team_id", "game_id") == [(3, 1, 5), (4, 2, 5)]


def test_pages(spark):
    page = spark.createDataFrame([(1, '<a href="/x">a</a><td>1</td><td>2</td><a href="/y">b</a><td>3</td>'), (2, "none")], "id int, h string")
    assert rows(H.cells_to_rows(page, "h", 2, "id")) == [(1, 0, "1", "2"), (1, 1, "3", None)]
    assert rows(H.links(page, "h", "id", skip=1), "link") == [("/y",)]
    bound = H.bind_lists(page, "h", "id", {"link": H.LINK, "cell": H.TABLE_CELL})
    assert rows(bound, "pos", "link", "cell") == [(0, "/x", "1"), (1, "/y", "2"), (2, None, "3")]


def test_urls(spark):
    df = spark.createDataFrame([("http://a/b?x=1&Season=2019",), ("http://a/b?game_id=1&z=2?game_id=3",), ("http://a/b",)], "u string")
    got = df.select(X.override_param(X.url_params(F.col("u")), "Season", F.lit("N"))["Season"].alias("s"),
                    X.dedupe_param(F.col("u"), "game_id").alias("d"))
    assert rows(got) == [("N", "http://a/b?game_id=3"), ("N", "http://a/b?x=1&Season=2019"), (None, "http://a/b")]


def test_verbs(spark):
    assert [V.snake(c) for c in ("PlayerName", "3PM", "FG%", "off.rtg ", "x3v")] == ["player_name", "x3pm", "fg_percent", "off_rtg", "x3v"]
    df = spark.createDataFrame([("a,b,c", None, 12), ("d", "z", 24)], "p string, q string, n int")
    assert rows(V.separate(df, "p", ["x", "y"], ",").select("x", "y")) == [("a", "b"), ("d", None)]
    assert rows(df.select(V.unite(["p", "q"]))) == [("a,b,c_NA",), ("d_z",)]
    assert rows(df.select(cut("n", (0, 12, 20)))) == [("(0,12]",), (None,)]
    assert V.relocate(df, ["n"], after="p").columns == ["p", "n", "q"]
    assert V.first_per_key(df.withColumn("k", F.lit(1)), ["k"], ["n"], last=True).first().p == "d"


def test_publish_replaces_the_table_in_order(spark):
    S.publish(spark.range(10).withColumn("g", F.col("id") % 2), "pub_t", ["g", "id"], 2)
    S.publish(spark.range(4).withColumn("g", F.col("id") % 2), "pub_t", ["g", "id"], 2)
    assert spark.table("pub_t").count() == 4
    assert not spark.catalog.tableExists("pub_t_stage")


def test_csv_and_seasons(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "a")], "id int, s string")
    S.write_csv(df, str(tmp_path / "c"), [F.col("id")])
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text.split() == ["id,s", "1,a", "2,"]
    sheet = S.read_sheet(spark, str(tmp_path / "c"), T.StructType([T.StructField("id", T.IntegerType()), T.StructField("s", T.StringType())]))
    assert rows(sheet) == [(1, "a"), (2, None)]
    S.write_seasons(spark.range(9).withColumn("season", F.lit(2020) + (F.col("id") % 3).cast("int")), str(tmp_path / "s"))
    picked = S.read_seasons(spark, str(tmp_path / "s"), 2021, 2022)
    assert picked.count() == 6
    assert "PartitionFilters: [isnotnull(season" in picked._jdf.queryExecution().executedPlan().toString()


def test_stage_uses_one_folder(spark):
    a = stage(spark.range(3), "t")
    assert a.count() == 3 and a.inputFiles()[0].split("/courtside/")[0].endswith(checkpoint_root(spark))


def test_a_failed_publish_leaves_the_old_table(spark):
    name = f"{own_database(spark)}.kept"
    publish(spark.range(20).selectExpr("id", "id % 3 as g"), name, ["g", "id"], 3)
    failing = spark.range(20).selectExpr("if(id = 7, raise_error('broken'), id) as id", "id % 3 as g")
    with pytest.raises(Exception, match="broken"):
        publish(failing, name, ["g", "id"], 3)
    assert spark.table(name).count() == 20 and not spark.catalog.tableExists(f"{name}_stage") and not spark.catalog.tableExists(f"{name}_old")


def test_published_files_are_in_order_and_few_are_read(spark):
    name = f"{own_database(spark)}.ordered"
    publish(spark.range(4000).selectExpr("(id * 37) % 4000 as id", "(id * 37) % 4000 div 1000 as g"), name, ["g", "id"], 8)
    table = spark.table(name)
    order = files_in_order(table, ["g", "id"]).first()
    assert order.in_order and order.n_files == 8
    ranges = [r for r in file_ranges(table, ["g"]).collect() if r.lowest.g <= 2 <= r.highest.g]
    assert len(ranges) <= 3 and sum(r.n_rows for r in ranges) >= 1000
    shuffled = spark.range(4000).selectExpr("(id * 37) % 4000 as id", "id % 7 as g").repartition(8)
    shuffled.write.saveAsTable(f"{name}_not")
    assert not files_in_order(spark.table(f"{name}_not"), ["g", "id"]).first().in_order
    assert files_in_order(spark.table(name).where("id < 0"), ["g", "id"]).first().n_files == 0


def test_bucketed_trees_need_no_exchange(spark):
    actions = spark.createDataFrame([(1, i, 0 if i % 4 == 0 else i - i % 4, 1, 100 - i, None, "shot", 1, "2-pt", "made", 2, None, None) for i in range(4, 44)], (
        "game_id int, id long, parent_action_id long, quarter int, end_game_seconds_remaining int, user_time string, type string, team_id int, "
        "parameters_type string, parameters_made string, parameters_points int, parameters_free_throw_number int, parameters_free_throws_awarded int"))
    stored = P.store_prepared(actions, f"{own_database(spark)}.trees", 4)
    for df in (P.with_parent(stored, ["end_game_seconds_remaining"]), P.flag_possessions(stored)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and df.count() == (30 if "parent_end_game_seconds_remaining" in df.columns else 40)
    assert rows(P.flag_possessions(stored).drop("user_time")) == rows(P.flag_possessions(P.prepare_actions(actions)).drop("user_time"))


def test_merged_sketches_equal_those_of_all_rows(spark):
    rows_ = spark.range(30_000).selectExpr("id % 5 as season", "id % 7000 as who", "cast(id % 1000 as double) as v")
    parts = season_sketches(rows_, ["season"], "who", "v").withColumn("all", F.lit(1))
    got = merged(parts, ["all"], {"med": 0.5, "p90": 0.9}).first()
    assert got.n == 30_000 and abs(got.n_distinct / 7000 - 1) < 0.03 and abs(got.med - 500) < 20 and abs(got.p90 - 900) < 20
    empty = season_sketches(spark.createDataFrame([(1, None, None)], "season int, who long, v double"), ["season"], "who", "v").withColumn("all", F.lit(1))
    assert merged(empty, ["all"], {}).first().n == 1
