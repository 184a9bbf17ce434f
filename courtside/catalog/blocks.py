"""Queries for the building blocks: joins, windows, reshaping, ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import ratio, shot_weight
from ..operators import reshape as R
from ..operators.joins import overlap_join, range_join
from ..operators.ordered import bucket_of, lag, lead, ordered_pass, rolling_mean, running
from ..operators.ranking import exact_quantiles, top_dense, top_n_ties, with_rank
from ..operators.verbs import (
    attach, cast_except, first_per_key, keep_groups_where_all, numeric_columns, pick, relocate,
    strip_suffix,
)
from ..plans.games import shares
from ..plans.players import overlay_rules
from ..schemas import ACTIONS
from ..session import checkpoint_root, stage
from ..sources.tables import read_seasons, read_sheet, write_csv, write_seasons
from .adapters import actions, events, games, read
from .registry import query

# ---- joins -----------------------------------------------------------------


@query("semi_join", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)""")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


@query("anti_join", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@query("full_outer", """
SELECT coalesce(a.n, b.n) AS nation, n_suppliers, n_customers
FROM (SELECT s_nationkey AS n, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) a
FULL JOIN (SELECT c_nationkey AS n, count(*) AS n_customers FROM customer WHERE c_acctbal > 9900 GROUP BY ALL) b ON a.n = b.n""")
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    sup = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(
        F.col("s_nationkey").alias("nation")).agg(n.alias("n_suppliers"))
    cust = read(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy(
        F.col("c_nationkey").alias("nation")).agg(n.alias("n_customers"))
    return sup.join(cust, "nation", "full_outer")


@query("range_join", """
SELECT e.game_id, e.event_id, s.event_id AS span_id FROM {ev} e
LEFT JOIN {ev} s ON s.event_type = 'signup' AND s.game_id = e.game_id AND e.event_id >= s.event_id AND e.event_id < s.event_id + s.k % 7""")
def range_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    spans = ev.where("event_type = 'signup'").select(
        "game_id", F.col("event_id").alias("span_id"), F.col("event_id").alias("lo"),
        (F.col("event_id") + F.col("k") % 7).alias("hi"),
    )
    out = range_join(ev.select("game_id", "event_id"), spans, ["game_id"], "event_id", "lo", "hi", "left", 64, longest=6)
    return out.drop("lo", "hi")


@query("interval_overlap", """
SELECT a.game_id, a.event_id AS a_id, b.event_id AS b_id, greatest(a.event_id, b.event_id) AS lo,
  least(a.event_id + a.k % 9, b.event_id + b.k % 11) AS hi
FROM {ev} a JOIN {ev} b ON a.game_id = b.game_id AND a.event_type = 'signup' AND b.event_type = 'error'
WHERE least(a.event_id + a.k % 9, b.event_id + b.k % 11) > greatest(a.event_id, b.event_id)""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    side = lambda kind, tag, m: ev.where(F.col("event_type") == kind).select(
        "game_id", F.col("event_id").alias(f"{tag}_id"), (F.col("event_id") + F.col("k") % m).alias(f"{tag}_end")
    )
    pairs = overlap_join(
        side("signup", "a", 9), side("error", "b", 11), ["game_id"], ("a_id", "a_end"), ("b_id", "b_end"), width=64, longest=10
    )
    return pairs.select(
        "game_id", "a_id", "b_id", F.greatest("a_id", "b_id").alias("lo"), F.least("a_end", "b_end").alias("hi")
    )


LENGTHS = "CAST(power(10, k % 7) AS BIGINT)"


@query("range_join_long", f"""
SELECT s.event_id AS span_id, count(*) AS n, min(e.event_id) AS first_id, max(e.event_id) AS last_id
FROM {{ev}} s JOIN {{ev}} e ON s.event_type = 'signup' AND e.event_id * 1000 >= s.event_id * 1000 AND e.event_id * 1000 < s.event_id * 1000 + {LENGTHS.replace("k", "s.k")}
GROUP BY s.event_id""")
def range_join_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of lengths from 1 to a million over events a thousand apart: how many each holds, its first and last."""
    ev = events(spark, sf_dir).withColumns({"one": F.lit(1), "at": F.col("event_id") * 1000})
    spans = ev.where("event_type = 'signup'").select(
        "one", F.col("event_id").alias("span_id"), F.col("at").alias("lo"), (F.col("at") + F.expr(LENGTHS)).alias("hi"))
    found = range_join(ev.select("one", "event_id", "at"), spans, ["one"], "at", "lo", "hi", "inner", 1024)
    return found.groupBy("span_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("overlap_long", f"""
SELECT a.event_id AS a_id, count(*) AS n, sum(least(a.event_id * 1000 + {LENGTHS.replace("k", "a.k")}, b.event_id * 1000 + {LENGTHS.replace("k", "b.k")})
  - greatest(a.event_id, b.event_id) * 1000)::BIGINT AS shared
FROM {{ev}} a JOIN {{ev}} b ON a.event_type = 'signup' AND b.event_type = 'error' AND a.event_id * 1000 < b.event_id * 1000 + {LENGTHS.replace("k", "b.k")}
  AND b.event_id * 1000 < a.event_id * 1000 + {LENGTHS.replace("k", "a.k")} GROUP BY a.event_id""")
def overlap_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two kinds, of lengths from 1 to a million: how many of the other kind each meets, and for how long in all."""
    ev = events(spark, sf_dir).withColumns({"one": F.lit(1), "at": F.col("event_id") * 1000})
    side = lambda kind, tag: ev.where(F.col("event_type") == kind).select(
        "one", F.col("event_id").alias(f"{tag}_id"), F.col("at").alias(f"{tag}_lo"), (F.col("at") + F.expr(LENGTHS)).alias(f"{tag}_hi"))
    pairs = overlap_join(side("signup", "a"), side("error", "b"), ["one"], ("a_lo", "a_hi"), ("b_lo", "b_hi"), width=1024)
    shared = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")
    return pairs.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"), F.sum(shared).alias("shared"))


@query("existence_flag", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS is_listed FROM customer""")
def existence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(
        F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_x", F.lit(True))
    return read(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left").select(
        "c_custkey", F.col("_x").isNotNull().alias("is_listed"))


@query("rule_overlay", """
SELECT c_custkey, CASE WHEN (c_nationkey = 3 AND contains(c_name, '00')) OR (c_nationkey = 7 AND contains(c_name, '1')) THEN TRUE
  ELSE c_acctbal > 9000 END AS flag FROM customer""")
def rule_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").withColumn("flag", F.col("c_acctbal") > 9000)
    return overlay_rules(rows, "flag", ((3, "00"), (7, "1")), "c_nationkey", "c_name").select("c_custkey", "flag")


# ---- filters, windows, ranks -----------------------------------------------


@query("group_all_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, bool_and(l_quantity >= 10) OVER (PARTITION BY l_orderkey) AS ok FROM lineitem) WHERE ok""")
def group_all_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return keep_groups_where_all(lines, ["l_orderkey"], F.col("l_quantity") >= 10)


@query("first_per_key", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_per_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return first_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("last_in_order", """
SELECT user_id, max_by(event_type, event_id) AS last_type, max_by(value, event_id) AS last_value FROM events GROUP BY user_id""")
def last_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last_type"), F.max_by("value", "event_id").alias("last_value"))


@query("nth_occurrence", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'view') WHERE rn = 3""")
def nth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = read(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id")
    return ordered_pass(
        views, ["user_id"], ["event_id"], bucket_of("event_id"), {"rn": running(F.lit(1))}
    ).where("rn = 3").drop("rn")


@query("group_extremes", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
WHERE l_extendedprice = m""")
def group_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return attach(lines, ["l_returnflag"], m=F.max("l_extendedprice")).where("l_extendedprice = m").drop("m")


@query("top_n_ties", """
SELECT l_orderkey, l_linenumber, l_quantity, 1::BIGINT AS rank_q FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)""")
def top_n_ties_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest quantities: at every scale tied at the maximum."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return top_n_ties(lines, "l_quantity", 10, rank_as="rank_q")


@query("top_n_counts", """
WITH per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
ladder AS (SELECT n, dense_rank() OVER (ORDER BY n DESC) AS rank_n, sum(count(*)) OVER (ORDER BY n DESC) AS reached, count(*) AS own FROM per GROUP BY n)
SELECT o_custkey, n, rank_n FROM per JOIN ladder USING (n) WHERE reached - own < 10""")
def top_n_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten customers with most orders and whoever ties with the tenth."""
    per = stage(read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "orders_per_customer")
    return top_n_ties(per, "n", 10, rank_as="rank_n")


@query("top_bottom_dense", """
SELECT l_suppkey, total, rk, side FROM (
  SELECT *, dense_rank() OVER (ORDER BY total DESC) AS rk, 'top' AS side FROM (SELECT l_suppkey, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY ALL)
  UNION ALL SELECT *, dense_rank() OVER (ORDER BY total) AS rk, 'bottom' FROM (SELECT l_suppkey, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY ALL))
WHERE rk <= 15""")
def top_bottom_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = stage(read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").cast("long").alias("total")), "supplier_totals")
    best = top_dense(totals, "total", 15, "rk").withColumn("side", F.lit("top"))
    return best.unionByName(top_dense(totals, "total", 15, "rk", descending=False).withColumn("side", F.lit("bottom")))


@query("global_ranks", """
SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS rk, dense_rank() OVER (ORDER BY p_size DESC) AS dense_rk,
  round(percent_rank() OVER (ORDER BY p_size), 6) AS pct FROM part""")
def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    out = with_rank(part, [], "p_size", "rk", "rank", True)
    out = with_rank(out, [], "p_size", "dense_rk", "dense", True)
    return with_rank(out, [], "p_size", "pct", "percent").withColumn("pct", F.round("pct", 6)).drop("p_size")


@query("grouped_ranks", """
SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS rk FROM orders""")
def grouped_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return with_rank(orders, ["o_orderpriority"], "o_totalprice", "rk", "rank", True).select("o_orderkey", "rk")


@query("lag_lead", """
SELECT event_id, lag(event_type) OVER w AS prev_type, lead(event_type) OVER w AS next_type, value - lag(value) OVER w AS diff
FROM {ev} WINDOW w AS (PARTITION BY game_id ORDER BY event_id)""")
def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("game_id", "event_id", "event_type", "value")
    out = ordered_pass(ev, ["game_id"], ["event_id"], bucket_of("event_id"),
                       {"prev_type": lag("event_type"), "next_type": lead("event_type"), "_pv": lag("value")})
    return out.select("event_id", "prev_type", "next_type", (F.col("value") - F.col("_pv")).alias("diff"))


@query("lag_lead_sparse", """
SELECT event_id, lag(k) OVER w AS prev_k, lead(event_type) OVER w AS next_type, sum(k) OVER w::BIGINT AS run_k FROM {ev} WINDOW w AS (PARTITION BY game_id ORDER BY event_id)""")
def lag_lead_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids so far apart that every row is a bucket of its own: the summaries are cut into blocks as well."""
    ev = events(spark, sf_dir).select("game_id", "event_id", "event_type", "k", (F.col("event_id") * 1_000_000).alias("at"))
    out = ordered_pass(ev, ["game_id"], ["at"], bucket_of("at"), {"prev_k": lag("k"), "next_type": lead("event_type"), "run_k": running("k")}, levels=2)
    return out.select("event_id", "prev_k", "next_type", "run_k")


@query("running_sum", """
SELECT event_id, sum(k) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run_k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {ev}""")
def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("user_id", "event_id", "k")
    return ordered_pass(ev, ["user_id"], ["event_id"], bucket_of("event_id"),
                        {"run_k": running("k"), "rn": running(F.lit(1))}).select("event_id", "run_k", "rn")


@query("rolling_mean", """
SELECT event_id, CASE WHEN count(*) OVER w = 6 THEN round(avg(k) OVER w, 6) END AS roll_k
FROM {ev} WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def rolling_mean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("event_type", "event_id", "k")
    numbered = ordered_pass(ev, ["event_type"], ["event_id"], bucket_of("event_id"), {"pos": running(F.lit(1))})
    out = rolling_mean(numbered, ["event_type"], "pos", {"roll_k": "k"}, 6)
    return out.select("event_id", F.round("roll_k", 6).alias("roll_k"))


@query("state_changes", """
SELECT game_id, event_id, hit, CASE WHEN hit AND NOT prev THEN 'start' ELSE 'end' END AS change FROM (
  SELECT *, lag(hit) OVER (PARTITION BY game_id ORDER BY event_id) AS prev FROM (SELECT game_id, event_id, event_type IN ('click', 'purchase') AS hit FROM {ev}))
WHERE hit <> prev""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("game_id", "event_id", F.col("event_type").isin("click", "purchase").alias("hit"))
    out = ordered_pass(ev, ["game_id"], ["event_id"], bucket_of("event_id"), {"prev": lag("hit")})
    return out.where(F.col("hit") != F.col("prev")).select(
        "game_id", "event_id", "hit", F.when(F.col("hit"), "start").otherwise("end").alias("change"))


@query("share_of_group", """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) * CASE WHEN l_linestatus = 'F' THEN 0.44::DOUBLE ELSE 1 END AS n_1,
  round(count(*) * CASE WHEN l_linestatus = 'F' THEN 0.44::DOUBLE ELSE 1 END
    / sum(count(*) * CASE WHEN l_linestatus = 'F' THEN 0.44::DOUBLE ELSE 1 END) OVER (PARTITION BY l_returnflag), 6) AS freq
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n")).withColumn("n_1", shot_weight("l_linestatus", "n", "F"))
    return shares(counts, ["l_returnflag"], "n_1", "freq").withColumn("freq", F.round("freq", 6))


@query("shot_chart", """
SELECT team, minute, shot_type, n, n_made, round(n_made::DOUBLE / n, 6) AS pct, round(n::DOUBLE / sum(n) OVER (PARTITION BY team, minute), 6) AS freq
FROM (SELECT l_returnflag AS team, l_linenumber AS minute, l_linestatus AS shot_type, count(*) AS n, count(*) FILTER (WHERE l_discount < 0.05) AS n_made
  FROM lineitem GROUP BY ALL)""")
def shot_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("team"), F.col("l_linenumber").alias("minute"), F.col("l_linestatus").alias("shot_type")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") < 0.05).alias("n_made"))
    out = shares(counts, ["team", "minute"], "n", "freq")
    return out.withColumns({"pct": F.round(ratio(F.col("n_made"), F.col("n")), 6), "freq": F.round("freq", 6)})


@query("weighted_totals", """
SELECT l_returnflag, l_linestatus, q, round(q / sum(q) OVER (), 6) AS share, round(m / c, 6) AS mean_price, round(q / sum(q) OVER () * (m / c), 6) AS weighted
FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, sum(l_extendedprice) AS m, count(*) AS c FROM lineitem GROUP BY ALL)""")
def weighted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stage(read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("q"), F.avg("l_extendedprice").alias("mean_price")), "totals")
    whole = parts.agg(F.sum("q")).scalar()
    share = ratio(F.col("q"), F.col("_q"))
    return parts.withColumn("_q", whole).select(
        "l_returnflag", "l_linestatus", "q", F.round(share, 6).alias("share"), F.round("mean_price", 6).alias("mean_price"),
        F.round(share * F.col("mean_price"), 6).alias("weighted"))


@query("two_level_mean", """
SELECT c_mktsegment, round(avg(per), 4) AS mean_per_customer, count(*) AS n FROM (
  SELECT c_mktsegment, c_custkey, sum(o_totalprice) / count(*) AS per FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_mktsegment""")
def two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("per"))
    return per.join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment").agg(
        F.round(F.avg("per"), 4).alias("mean_per_customer"), F.count(F.lit(1)).alias("n"))


# ---- reshape ---------------------------------------------------------------


@query("mirror_rows", """
SELECT game_id, unnest(['away', 'home']) AS side, unnest([visitor_team_name, home_team_name]) AS team,
  unnest([visitor_pts - home_pts, home_pts - visitor_pts])::BIGINT AS gap FROM {games}""")
def mirror_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("visitor_pts") - F.col("home_pts")
    return R.mirror(games(spark, sf_dir), ["game_id"], [
        {"side": F.lit("away"), "team": F.col("visitor_team_name"), "gap": gap},
        {"side": F.lit("home"), "team": F.col("home_team_name"), "gap": -gap},
    ])


@query("unpivot_long", """
SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) AS name, unnest([nullif(l_discount, 0), nullif(l_tax, 0)]) AS value FROM lineitem""")
def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")])
    return R.longer(lines, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "name", "value")


@query("unpivot_drop_null", """
SELECT * FROM (SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) AS name, unnest([nullif(l_discount, 0), nullif(l_tax, 0)]) AS value FROM lineitem)
WHERE value IS NOT NULL""")
def unpivot_drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivot_long(spark, sf_dir).where(F.col("value").isNotNull())


EVENT_KINDS = ["view", "click", "purchase", "signup", "error"]


@query("pivot_wide", """
SELECT game_id, """ + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{t}') AS {t}_n, sum(k) FILTER (WHERE event_type = '{t}')::BIGINT AS {t}_k"
    for t in EVENT_KINDS) + " FROM {ev} GROUP BY game_id")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = R.wider(events(spark, sf_dir), ["game_id"], "event_type", EVENT_KINDS, {"n": F.count(F.lit(1)), "k": F.sum("k")})
    return wide.fillna(0, subset=[f"{t}_n" for t in EVENT_KINDS])


@query("densify_dates", """
WITH seen AS (SELECT user_id, CAST(ts AS DATE) AS game_date, count(*) AS n FROM events WHERE day(ts) NOT IN (7, 8, 20) GROUP BY ALL)
SELECT u.user_id, d.game_date, n FROM (SELECT DISTINCT user_id FROM seen) u, (SELECT DISTINCT game_date FROM seen) d LEFT JOIN seen c ON c.user_id = u.user_id AND c.game_date = d.game_date""")
def densify_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player x date grid with NULL where absent, over the dates on which there is a game (three days have none).

    The dates are one array (a century has 36,525), onto which each player's row is exploded in place."""
    ev = read(spark, sf_dir, "events").where(~F.dayofmonth("ts").isin(7, 8, 20)).select("user_id", F.to_date("ts").alias("game_date"))
    seen = ev.groupBy("user_id", "game_date").agg(F.count(F.lit(1)).alias("n"))
    dates = ev.agg(F.collect_set("game_date").alias("dates")).scalar()
    grid = ev.select("user_id").distinct().select("user_id", F.explode(dates).alias("game_date"))
    return grid.join(seen, ["user_id", "game_date"], "left")


@query("date_spine", """
SELECT game_id, CAST(unnest(generate_series(a, a + INTERVAL (game_id % 4) DAY, INTERVAL 1 DAY)) AS DATE) AS date,
  date_diff('day', DATE '2023-10-25', a) AS days_in
FROM (SELECT game_id, min(CAST(ts AS DATE)) AS a FROM {ev} GROUP BY game_id)""")
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = events(spark, sf_dir).groupBy("game_id").agg(F.min(F.to_date("ts")).alias("a")).withColumn(
        "b", F.date_add("a", F.col("game_id") % 4))
    return R.date_spine(first, "a", "b").select(
        "game_id", "date", F.date_diff("a", F.lit("2023-10-25").cast("date")).cast("long").alias("days_in"))


@query("cut_bins", """
SELECT bin, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM (SELECT l_quantity, CASE WHEN l_quantity > 5 AND l_quantity <= 20 THEN 'low'
  WHEN l_quantity > 20 AND l_quantity <= 35 THEN 'mid' WHEN l_quantity > 35 AND l_quantity <= 45 THEN 'high' END AS bin FROM lineitem) GROUP BY bin""")
def cut_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_quantity", R.cut("l_quantity", (5, 20, 35, 45), ("low", "mid", "high")).alias("bin"))
    return lines.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("union_by_name", """
SELECT s_name AS name, s_nationkey AS nation, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL SELECT c_name, c_nationkey, NULL, c_mktsegment FROM customer""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    cust = read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return sup.unionByName(cust, allowMissingColumns=True)


@query("players_on_wide", """
SELECT game_id, quarter, """ + ", ".join(
    f"coalesce(count(*) FILTER (WHERE player_id = {p}), 0) > 0 AS on_{p}" for p in range(20)) + ", "
    + " + ".join(f"(coalesce(count(*) FILTER (WHERE player_id = {p}), 0) > 0)::INT" for p in range(20))
    + " AS row_sum FROM {actions} GROUP BY game_id, quarter")
def players_on_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide form: missing cells filled, matched columns to booleans, row-wise sum."""
    wide = actions(spark, sf_dir).groupBy("game_id", "quarter").pivot("player_id", list(range(20))).count().fillna(0)
    names = pick(wide, r"^\d+$")
    flags = wide.select("game_id", "quarter", *[(F.col(c) > 0).alias(f"on_{c}") for c in names])
    return flags.withColumn("row_sum", sum((F.col(c).cast("int") for c in pick(flags, r"^on_\d+$")), F.lit(0)))


@query("across_sums", """
SELECT l_returnflag, sum(l_quantity)::BIGINT AS sum_l_quantity, sum(l_linenumber)::BIGINT AS sum_l_linenumber, max(l_linestatus) AS status FROM lineitem GROUP BY l_returnflag""")
def across_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    sums = [F.sum(c).cast("long").alias(f"sum_{c}") for c in numeric_columns(lines)]
    out = lines.groupBy("l_returnflag").agg(*sums, F.max("l_linestatus").alias("status"))
    return relocate(out, ["status"], after="l_returnflag")


@query("suffixed_join", """
SELECT o_custkey AS custkey, f.total AS total, f.n AS n, o.total AS total_open FROM
  (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) f
LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) o USING (o_custkey)""")
def suffixed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    side = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy("custkey")
    total = F.round(F.sum("o_totalprice"), 2)
    left = side("F").agg(total.alias("total.x"), F.count(F.lit(1)).alias("n.x"))
    right = side("O").agg(total.alias("total_open"))
    return strip_suffix(left.join(right, "custkey", "left"), ".x")


@query("bulk_cast", """
SELECT p_partkey, p_name, TRY_CAST(regexp_replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand, TRY_CAST(p_type AS DOUBLE) AS kind, p_size::DOUBLE AS size FROM part""")
def bulk_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = read(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.regexp_replace("p_brand", "Brand#", "").alias("brand"), F.col("p_type").alias("kind"),
        F.col("p_size").cast("string").alias("size"))
    return cast_except(text, ["p_partkey", "p_name"])


@query("filters", """
SELECT o_orderkey FROM orders WHERE NOT (o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus = 'F')
  AND o_orderpriority NOT IN ('5-LOW') AND NOT regexp_matches(o_orderpriority, 'SPEC') AND contains(lower(o_orderpriority), 'h') AND o_custkey IS NOT NULL""")
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.col("o_totalprice").between(100_000, 300_000) & (F.col("o_orderstatus") == "F")
    level = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").where(
        ~band & ~level.isin("5-LOW") & ~level.rlike("SPEC") & F.lower(level).contains("h") & F.col("o_custkey").isNotNull()
    ).select("o_orderkey")


@query("top_k", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25""")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(
        F.col("l_extendedprice").desc_nulls_last(), "l_orderkey", "l_linenumber").limit(25)


@query("category_order", """
SELECT c_mktsegment, n, rank() OVER (ORDER BY n) AS place FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)""")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stage(read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "segments")
    return with_rank(counts, [], "n", "place", "rank")


# ---- NULL keys ---------------------------------------------------------------

NULL_KEYS = "SELECT *, CASE WHEN user_id % 7 <> 0 THEN user_id END AS u, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events"


def _null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumns({
        "u": F.when(F.col("user_id") % 7 != 0, F.col("user_id")), "kind": F.when(F.col("event_type") != "click", F.col("event_type"))})


@query("lag_lead_null_keys", f"""
SELECT event_id, u, lag(value) OVER w AS prev, lead(event_id) OVER w AS next, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS n
FROM ({NULL_KEYS}) WINDOW w AS (PARTITION BY u ORDER BY event_id)""")
def lag_lead_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered_pass(_null_keys(spark, sf_dir), ["u"], ["event_id"], bucket_of("event_id", 4096), {
        "prev": lag("value"), "next": lead("event_id"), "n": running(F.lit(1))})
    return out.select("event_id", "u", "prev", "next", "n")


@query("grouped_ranks_null_group", f"""
SELECT event_id, kind, rank() OVER (PARTITION BY kind ORDER BY value DESC) AS r, dense_rank() OVER (PARTITION BY kind ORDER BY CAST(ts AS DATE) DESC) AS day_r
FROM ({NULL_KEYS})""")
def grouped_ranks_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _null_keys(spark, sf_dir).withColumn("day", F.to_date("ts"))
    ranked = with_rank(rows, ["kind"], "value", "r", "rank", descending=True)
    return with_rank(ranked, ["kind"], "day", "day_r", "dense", descending=True).select("event_id", "kind", "r", "day_r")


@query("quantiles_null_group", f"""
SELECT kind, quantile_cont(v, 0.25) AS q1, median(v) AS med FROM (SELECT kind, CASE WHEN event_type <> 'signup' THEN value END AS v FROM ({NULL_KEYS})) GROUP BY kind""")
def quantiles_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group has a NULL key, another NULL values alone."""
    rows = _null_keys(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "signup", F.col("value")))
    return exact_quantiles(rows, ["kind"], "v", {"q1": 0.25, "med": 0.5})


@query("group_extremes_null_group", f"""
SELECT event_id, u FROM ({NULL_KEYS}) QUALIFY event_id = max(event_id) OVER (PARTITION BY u)
UNION ALL SELECT -count(*), NULL FROM ({NULL_KEYS}) WHERE kind IS NULL""")
def group_extremes_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user, and (as a negative count) the rows of the groups that hold clicks alone."""
    rows = _null_keys(spark, sf_dir)
    last = attach(rows, ["u"], last=F.max("event_id")).where(F.col("event_id") == F.col("last")).select("event_id", "u")
    clicks = keep_groups_where_all(rows, ["kind"], F.col("event_type") == "click")
    return last.unionByName(clicks.agg((-F.count(F.lit(1))).alias("event_id")).withColumn("u", F.lit(None).cast(dict(rows.dtypes)["u"])))


# ---- readers and sinks -------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/courtside/{name}-{uuid.uuid4().hex}"


@query("season_partitions", """
SELECT o_orderkey, o_totalprice, 1985 + o_orderkey % 37 AS season FROM orders WHERE 1985 + o_orderkey % 37 BETWEEN 1990 AND 2021""")
def season_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by season, read back by a range of seasons (other folders are not listed)."""
    path = _folder(spark, "seasons")
    write_seasons(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 37 + 1985).alias("season")), path)
    return read_seasons(spark, path, 1990, 2021).withColumn("season", F.col("season").cast("long"))


@query("csv_roundtrip", "SELECT p_partkey, p_name, nullif(p_type, 'SMALL') AS kind, p_retailprice FROM part")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.nullif("p_type", F.lit("SMALL")).alias("kind"), "p_retailprice")
    path = _folder(spark, "csv")
    write_csv(part, path, ["p_name", "p_partkey"])
    return read_sheet(spark, path, part.schema)


@query("declared_schema", """
SELECT id, game_id, quarter, type, parameters_points, CAST(NULL AS INTEGER) AS parameters_coord_x, CAST(NULL AS VARCHAR) AS score FROM {actions}""")
def declared_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action table read by its 35 declared columns; those the files lack are NULL."""
    path = _folder(spark, "actions")
    actions(spark, sf_dir).withColumn("user_time", F.col("user_time").cast("timestamp")).write.parquet(path)
    return spark.read.schema(ACTIONS).parquet(path).select(
        "id", "game_id", "quarter", "type", "parameters_points", "parameters_coord_x", "score")
