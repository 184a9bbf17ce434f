"""Nested JSON documents to tables; documents arrive as a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import clock_seconds, game_seconds_remaining
from ..operators.verbs import cast_except, snake

RESULT_SET = (
    "struct<resultSets:array<struct<headers:array<string>,rowSet:array<array<string>>>>,"
    "parameters:struct<Season:string,SeasonYear:string>>"
)


def _cell(row: Column, headers: Column, name: str) -> Column:
    at = F.nullif(F.array_position(headers, name), F.lit(0)).cast("int")
    return F.try_element_at(row, at)


def result_sets(bodies: DataFrame, body: str, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Header + row-matrix documents to a table of the declared columns.

    Cells are placed by header name, an empty matrix leaves no row, the season
    of the request is attached, and all but ``keep`` are cast to numbers.
    """
    parsed = bodies.select(F.from_json(body, RESULT_SET).alias("d")).select(
        F.coalesce("d.parameters.SeasonYear", "d.parameters.Season").alias("year"),
        F.try_element_at("d.resultSets", F.lit(1)).alias("s"),
    )
    rows = parsed.select(
        "year", F.col("s.headers").alias("h"), F.explode("s.rowSet").alias("r")
    )
    table = rows.select(
        *[_cell(F.col("r"), F.col("h"), c).alias(snake(c)) for c in columns], "year"
    )
    return cast_except(table, [*keep, "year"])


def nested_actions(
    docs: DataFrame, body: str, action: str, parameters: Sequence[tuple[str, str]],
    n_periods: int = 4, length: int = 600,
) -> DataFrame:
    """Game documents to action rows: the parameter struct spread into
    ``parameters_*`` columns, the game id attached, clock rows dropped, seconds
    remaining computed. ``action`` lists the plain action fields as DDL."""
    inner = ",".join(f"{n}:{t}" for n, t in parameters)
    schema = (
        f"struct<result:struct<gameInfo:struct<gameId:int>,"
        f"actions:array<struct<{action},parameters:struct<{inner}>>>>>"
    )
    parsed = docs.select(F.from_json(body, schema).alias("d"))
    acts = parsed.select(
        F.col("d.result.gameInfo.gameId").alias("game_id"), F.explode("d.result.actions").alias("a")
    )
    spread = [F.col(f"a.parameters.{n}").alias(f"parameters_{snake(n)}") for n, _ in parameters]
    plain = [n.split(":")[0] for n in action.split(",")]
    flat = acts.select("game_id", *[F.col(f"a.{n}").alias(snake(n)) for n in plain], *spread)
    left = clock_seconds(F.col("quarter_time"))
    return flat.where(F.col("type") != "clock").withColumns(
        {
            "end_quarter_seconds_remaining": left,
            "end_game_seconds_remaining": game_seconds_remaining(
                F.col("quarter"), left, n_periods, length
            ),
        }
    )


def rosters(docs: DataFrame, body: str, player: str) -> DataFrame:
    """Home and away player lists to (player, team, game) rows; documents that
    lack either side give none."""
    side = f"struct<id:int,players:array<struct<{player}>>>"
    schema = f"struct<result:struct<gameInfo:struct<gameId:int,homeTeam:{side},awayTeam:{side}>>>"
    info = docs.select(F.from_json(body, schema).alias("d")).select("d.result.gameInfo.*")
    both = info.where(F.col("homeTeam").isNotNull() & F.col("awayTeam").isNotNull())
    teams = both.select("gameId", F.explode(F.array("awayTeam", "homeTeam")).alias("t"))
    players = teams.select("gameId", F.col("t.id").alias("team_id"), F.explode("t.players").alias("p"))
    fields = [f.split(":")[0] for f in player.split(",")]
    return players.select(
        *[F.col(f"p.{f}").alias("player_id" if f == "id" else snake(f)) for f in fields],
        "team_id", F.col("gameId").alias("game_id"), F.lit(False).alias("is_on"),
    ).distinct()


def flat_array(docs: DataFrame, body: str, fields: str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON array of flat objects to rows."""
    return docs.select(*keep, F.inline(F.from_json(body, f"array<struct<{fields}>>")))
