"""Queries on pages, JSON documents and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.clock import season_label, start_minutes
from ..operators.joins import pattern_join, pattern_join_indexed, word_join
from ..operators.verbs import clean_names, separate, unite
from ..sources import json_docs as J
from ..sources import pages as H
from .adapters import events, read
from .registry import query

# ---- pages -----------------------------------------------------------------


@query("link_extract", r"""
SELECT page_id, pos, link FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))
WHERE pos >= 1 AND regexp_matches(link, '^/[a-zA-Z]')""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.links(read(spark, sf_dir, "pages"), "html", "page_id", skip=1, match="^/[a-zA-Z]")


@query("cells_to_rows", r"""
SELECT page_id, r AS row, c[r * 3 + 1] AS v1, c[r * 3 + 2] AS v2, c[r * 3 + 3] AS v3
FROM (SELECT page_id, c, unnest(range(0, (len(c) + 2) // 3)) AS r FROM (
  SELECT page_id, regexp_extract_all(html, '<li>(?:<a [^>]*>)?([^<]*)(?:</a>)?</li>', 1) AS c FROM pages))""")
def cells_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cells_to_rows(read(spark, sf_dir, "pages"), "html", 3, "page_id", H.LIST_CELL)


@query("bind_columns", r"""
SELECT page_id, i AS pos, a[i + 1] AS link, b[i + 1] AS label FROM (
  SELECT *, unnest(range(0, greatest(len(a), len(b)))) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS a,
      regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a>', 1) AS b FROM pages))""")
def bind_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.bind_lists(
        read(spark, sf_dir, "pages"), "html", "page_id",
        {"link": r'<li><a href="([^"]*)">', "label": r"<li><a [^>]*>([^<]*)</a>"},
    )


@query("url_params", r"""
SELECT page_id, url, CASE WHEN q <> '' THEN nullif(regexp_extract(q, '(?:^|&)page=([^&]*)', 1), '') END AS page,
  CASE WHEN q <> '' THEN nullif(regexp_extract(q, '(?:^|&)ref=([^&]*)', 1), '') END AS ref,
  CASE WHEN q <> '' THEN '2020-21' END AS season
FROM (SELECT page_id, url, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)""")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = X.url_params(F.col("url"))
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    label = season_label(F.lit(2020))
    return read(spark, sf_dir, "pages").select(
        "page_id", "url", at(params, "page").alias("page"), at(params, "ref").alias("ref"),
        at(X.override_param(params, "Season", label), "Season").alias("season"),
    )


@query("url_dedupe", r"""
SELECT page_id, url || '?game_id=' || CAST(page_id + 1 AS VARCHAR) || '&lang=he' AS link FROM pages""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with a doubled game_id and language parameter, cleaned."""
    pid = F.col("page_id")
    link = F.concat(
        "url", F.lit("?game_id="), pid.cast("string"), F.lit("&lang=he"), F.lit("?game_id="),
        (pid + 1).cast("string"), F.lit("&lang=he"),
    )
    cleaned = X.dedupe_param(F.col("link"), "game_id")
    return read(spark, sf_dir, "pages").select("page_id", link.alias("link")).select(
        "page_id", F.regexp_replace(cleaned, "&lang=he(?=.*&lang=he)", "").alias("link")
    )


# ---- JSON ------------------------------------------------------------------


@query("json_result_sets", """
SELECT o_orderkey::VARCHAR AS player_id, o_totalprice AS total_price, NULL::DOUBLE AS bonus,
  CASE WHEN o_orderkey % 2 = 0 THEN '2019-20' ELSE '2020-21' END AS year FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'x' || o_orderkey::VARCHAR, NULL, NULL, CASE WHEN o_orderkey % 2 = 0 THEN '2019-20' ELSE '2020-21' END
FROM orders WHERE o_orderstatus <> 'P'""")
def json_result_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response body per order (header + row matrix; empty for status P)."""
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    matrix = F.when(
        F.col("o_orderstatus") != "P",
        F.array(F.array(price, key), F.array(F.lit("n/a"), F.concat(F.lit("x"), key))),
    ).otherwise(F.array().cast("array<array<string>>"))
    season = F.when(F.col("o_orderkey") % 2 == 0, "2019-20").otherwise("2020-21")
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.array(F.lit("TOTAL_PRICE"), F.lit("PLAYER_ID")).alias("headers"),
                    matrix.alias("rowSet"),
                )
            ).alias("resultSets"),
            F.struct(season.alias("Season")).alias("parameters"),
        )
    )
    bodies = read(spark, sf_dir, "orders").select(body.alias("body"))
    return J.result_sets(bodies, "body", ["PLAYER_ID", "TOTAL_PRICE", "BONUS"], ["player_id"])


@query("nested_actions", """
SELECT game_id, event_id AS id, event_type AS type, CAST(sod // 21600 + 1 AS INTEGER) AS quarter,
  lpad(CAST(sod % 600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sod % 60 AS VARCHAR), 2, '0') AS quarter_time,
  k AS parameters_points, event_type AS parameters_kind,
  CAST(sod % 600 AS INTEGER) AS end_quarter_seconds_remaining,
  CAST(sod % 600 + (4 - (sod // 21600 + 1)) * 600 AS INTEGER) AS end_game_seconds_remaining
FROM {ev}""")
def nested_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game document per event, with a clock action that must be dropped."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(two(F.expr("sod % 600 div 60")), F.lit(":"), two(F.col("sod") % 60))
    act = lambda kind: F.struct(
        F.col("event_id").alias("id"), kind.alias("type"), F.expr("sod div 21600 + 1").alias("quarter"),
        clock.alias("quarterTime"),
        F.struct(F.col("k").alias("points"), F.col("event_type").alias("kind")).alias("parameters"),
    )
    body = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.col("game_id").alias("gameId")).alias("gameInfo"),
                F.array(act(F.col("event_type")), act(F.lit("clock"))).alias("actions"),
            ).alias("result")
        )
    )
    docs = events(spark, sf_dir).select(body.alias("body"))
    return J.nested_actions(
        docs, "body", "id:bigint,type:string,quarter:int,quarterTime:string",
        [("points", "int"), ("kind", "string")],
    )


@query("roster_flatten", """
SELECT DISTINCT CAST(p AS INTEGER) AS player_id, 'N' || CAST(p AS VARCHAR) AS first_name,
  CAST(t AS INTEGER) AS team_id, game_id, FALSE AS is_on
FROM (SELECT game_id, unnest([user_id % 20, user_id % 20 + 100]) AS p, unnest([1, 2]) AS t FROM {ev} WHERE event_type <> 'error')""")
def roster_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game document per event; errors lack the home side and give nothing."""
    man = lambda c: F.array(
        F.struct(c.cast("int").alias("id"), F.concat(F.lit("N"), c.cast("string")).alias("firstName"))
    )
    uid = F.col("user_id") % 20
    team = lambda i, c: F.struct(F.lit(i).alias("id"), man(c).alias("players"))
    info = F.struct(
        F.col("game_id").alias("gameId"),
        F.when(F.col("event_type") != "error", team(1, uid)).alias("homeTeam"),
        team(2, uid + 100).alias("awayTeam"),
    )
    body = F.to_json(F.struct(F.struct(info.alias("gameInfo")).alias("result")))
    return J.rosters(events(spark, sf_dir).select(body.alias("body")), "body", "id:int,firstName:string")


@query("json_flat_array", r"""
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""")
def json_flat_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("body")
    )
    return J.flat_array(docs, "body", "k:int", ["event_id"])


# ---- text ------------------------------------------------------------------


@query("fuzzy_join", r"""
SELECT page_id, url, lang FROM pages LEFT JOIN (SELECT DISTINCT lang FROM documents) d
  ON regexp_matches(lower(url), '\b' || d.lang || '\b')""")
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return word_join(pages, read(spark, sf_dir, "documents").select("lang").distinct(), "url", "lang", "page_id")


@query("pattern_join", r"""
SELECT p_partkey, p_name, n.r_name FROM part LEFT JOIN (
  SELECT r_name, '^' || ['red', 'blue', 'small', 'gre', 'l[ai]'][r_regionkey + 1] AS pattern FROM region) n
  ON regexp_matches(p_name, n.pattern)""")
def pattern_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.array(*[F.lit(s) for s in ("red", "blue", "small", "gre", "l[ai]")])
    patterns = read(spark, sf_dir, "region").select(
        "r_name", F.concat(F.lit("^"), F.get(starts, F.col("r_regionkey"))).alias("pattern")
    )
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return pattern_join(parts, patterns, "p_name", "pattern").drop("pattern")


@query("pattern_join_indexed", r"""
SELECT doc_id, item_id FROM documents JOIN (SELECT item_id, regexp_replace(array_to_string(string_split_regex(text, '[^A-Za-z]+')[2:7], ' '), ' ', '[^A-Za-z]+', 'g') AS pattern
  FROM benchmark) ON regexp_matches(text, pattern)""")
def pattern_join_indexed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts that hold six words of a benchmark passage in a row, whatever stands between them."""
    words = F.slice(F.split("text", "[^A-Za-z]+"), 2, 6)
    patterns = read(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, "[^A-Za-z]+").alias("pattern"))
    return pattern_join_indexed(read(spark, sf_dir, "documents").select("doc_id", "text"), patterns, "text", "pattern", "inner").select("doc_id", "item_id")


@query("pattern_join_named", r"""
SELECT p_partkey, p_name, r_name FROM part LEFT JOIN (
  SELECT r_name, ['^red', 'bl[aeiou]e', 'sm?all', 'wid+get$', '^.r.e{2}n'][r_regionkey + 1] AS pattern FROM region) n ON regexp_matches(p_name, n.pattern)""")
def pattern_join_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short patterns: some have a literal of three characters, the others go through the broadcast."""
    some = F.array(*[F.lit(s) for s in ("^red", "bl[aeiou]e", "sm?all", "wid+get$", "^.r.e{2}n")])
    patterns = read(spark, sf_dir, "region").select("r_name", F.get(some, F.col("r_regionkey")).alias("pattern"))
    return pattern_join_indexed(read(spark, sf_dir, "part").select("p_partkey", "p_name"), patterns, "p_name", "pattern").drop("pattern")


@query("whole_word", r"""
SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || lower(lang) || '($|[^\p{L}\p{N}_])') AS names_lang FROM documents""")
def whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        "doc_id", X.whole_word(F.col("text"), F.col("lang")).alias("names_lang")
    )


@query("text_functions", r"""
SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title, length(p_name) AS n_chars,
  len(regexp_extract_all(p_name, 'e')) AS n_e, regexp_replace(p_name, 'e', '') AS first_e_removed,
  regexp_replace(p_name, 'e', '', 'g') AS all_e_removed, string_split(p_name, ' ')[1] AS word_1,
  string_split(p_name, ' ')[2] AS word_2, string_split(p_name, ' ')[3] AS word_3,
  p_name || '_' || coalesce(nullif(p_type, 'SMALL'), 'NA') AS united, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS brand_no,
  TRY_CAST(p_brand AS DOUBLE) AS brand_number, md5(p_name) AS name_hash,
  CAST(1995 + p_size AS VARCHAR) || '-' || lpad(CAST((1996 + p_size) % 100 AS VARCHAR), 2, '0') AS season
FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").withColumns(
        {"_kind": F.nullif("p_type", F.lit("SMALL")), "_name": F.col("p_name")}
    )
    name = F.col("p_name")
    return separate(rows, "_name", ["word_1", "word_2", "word_3"], " ").select(
        "p_partkey",
        F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2))).alias("title"),
        F.length(name).cast("long").alias("n_chars"),
        F.regexp_count(name, F.lit("e")).cast("long").alias("n_e"),
        X.remove_first(name, "e").alias("first_e_removed"),
        F.regexp_replace(name, "e", "").alias("all_e_removed"),
        "word_1", "word_2", "word_3",
        unite(["p_name", "_kind"]).alias("united"),
        X.extract(F.col("p_brand"), "[0-9]+").alias("brand_no"),
        F.col("p_brand").try_cast("double").alias("brand_number"),
        F.md5("p_name").alias("name_hash"),
        season_label(F.col("p_size") + 1995).alias("season"),
    )


@query("clean_names", """
SELECT p_partkey AS player_id, p_name AS x3pm, p_brand AS fg_percent, p_type AS off_rtg, p_size AS off_rtg_2 FROM part""")
def clean_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return clean_names(part.toDF("PlayerId", "3PM", "FG%", "Off Rtg", "off.rtg"))


@query("start_times", """
SELECT event_id, (h % 12 + CASE WHEN h >= 12 THEN 12 ELSE 0 END) * 60 + m AS start_minute
FROM (SELECT event_id, sod // 3600 AS h, sod // 60 % 60 AS m FROM {ev})""")
def start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-hour start times ("7:30p") back to minutes."""
    hour = F.expr("sod div 3600")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    minute = F.lpad(F.expr("sod div 60 % 60").cast("string"), 2, "0")
    half = F.when(hour >= 12, "p").otherwise("a")
    label = F.concat(shown.cast("string"), F.lit(":"), minute, half)
    return events(spark, sf_dir).select("event_id", start_minutes(label).alias("start_minute"))
