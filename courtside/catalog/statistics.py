"""Queries of the statistical tests, with oracles that integrate densities and solve least squares in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from .adapters import read
from .registry import query

NORMAL_TAIL = """2 * 0.3989422804014327 * exp(-z * z / 2) * (0.319381530 * k - 0.356563782 * k ** 2 + 1.781477937 * k ** 3
  - 1.821255978 * k ** 4 + 1.330274429 * k ** 5)"""


def student_tail(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided p of Student's t in SQL: Simpson's rule over the density from 0 to |t|."""
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * (1 + power(x, 2) / {df}) ** (-({df} + 1) / 2)"
    return f"""CASE WHEN abs({t}) > 40 THEN 0 ELSE greatest(0, 1 - 2 * abs({t}) / {3 * steps} * list_sum(list_transform(
      list_transform(range(0, {steps + 1}), lambda i: {{'x': abs({t}) * i / {steps}, 'w': CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END}}),
      lambda s: s.w * {density.replace('power(x, 2)', 'power(s.x, 2)')}))) END"""


def fisher_tail(f: str, d1: str, d2: str, steps: int = 4000) -> str:
    """Upper p of F in SQL: Simpson's rule over the density of sqrt(F)."""
    constant = f"exp(lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2)) * power({d1} / {d2}, {d1} / 2)"
    density = f"2 * power(s.u, {d1} - 1) * power(1 + {d1} * s.u * s.u / {d2}, -({d1} + {d2}) / 2)"
    return f"""greatest(0, 1 - {constant} * sqrt({f}) / {3 * steps} * list_sum(list_transform(
      list_transform(range(0, {steps + 1}), lambda i: {{'u': sqrt({f}) * i / {steps}, 'w': CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END}}),
      lambda s: s.w * {density})))"""


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("correlation_test", f"""
WITH c AS (SELECT l_linenumber AS line, corr(l_discount, l_tax) AS r, count(*) AS n, (count(*) - 2)::DOUBLE AS df FROM lineitem GROUP BY ALL),
t AS (SELECT *, r * sqrt(df / (1 - r * r)) AS t FROM c)
SELECT line, round(r, 6) AS r, n, round(t, 5) AS t, round({student_tail('t', 'df')}, 6) AS p_value,
  round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM t""")
def correlation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "line")
    out = S.correlation_test(lines, ["line"], "l_discount", "l_tax").drop("df")
    return rounded(out, {"r": 6, "t": 5, "p_value": 6, "low": 6, "high": 6})


@query("regression_interaction", f"""
WITH g AS (SELECT l_linestatus AS status, l_linenumber AS line, count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
    regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_syy(l_extendedprice, l_quantity) AS syy
  FROM lineitem GROUP BY ALL),
l AS (SELECT *, sxy / sxx AS b, my - sxy / sxx * mx AS a FROM g),
s AS (SELECT status, sum(n) - 2 * count(*) AS df, (count(*) - 1)::DOUBLE AS d1, sum(syy - sxy * sxy / sxx) AS rss, sum(syy) - sum(sxy) ** 2 / sum(sxx) AS common FROM l GROUP BY status),
v AS (SELECT l.*, df, d1, rss / df AS s2, ((common - rss) / d1) / (rss / df) AS f, rss / df / sxx AS vb, rss / df * (1 / n + mx * mx / sxx) AS va FROM l JOIN s USING (status)),
terms AS (
  SELECT status, '(Intercept)' AS term, a AS estimate, sqrt(va) AS std_error, df, d1, f FROM v WHERE line = 1
  UNION ALL SELECT status, 'l_quantity', b, sqrt(vb), df, d1, f FROM v WHERE line = 1
  UNION ALL SELECT v.status, CAST(v.line AS VARCHAR), v.a - o.a, sqrt(v.va + o.va), v.df, v.d1, v.f FROM v JOIN v o ON o.status = v.status AND o.line = 1 AND v.line <> 1
  UNION ALL SELECT v.status, 'l_quantity:' || CAST(v.line AS VARCHAR), v.b - o.b, sqrt(v.vb + o.vb), v.df, v.d1, v.f FROM v JOIN v o ON o.status = v.status AND o.line = 1 AND v.line <> 1),
t AS (SELECT *, estimate / std_error AS t FROM terms)
SELECT status, term, round(estimate, 3) AS estimate, round(std_error, 4) AS std_error, round(t, 4) AS t, round({student_tail('t', 'df')}, 5) AS p_value,
  df::BIGINT AS df, round(f, 4) AS f, round({fisher_tail('f', 'd1', 'df')}, 5) AS f_p FROM t""")
def regression_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity with a line of its own for every line number, one model per status."""
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "status")
    out = S.regression_interaction(lines, ["status"], "l_linenumber", "l_extendedprice", "l_quantity", 1)
    return rounded(out, {"estimate": 3, "std_error": 4, "t": 4, "p_value": 5, "f": 4, "f_p": 5})


GLM_TERMS = ["(Intercept)", "comeback_win", "time", "adv", "time:adv"]


def _glm_oracle(steps: int = 7) -> str:
    """Reweighted least squares with a fixed number of steps: each one sums the cross products and eliminates the 5 x 5 system in SQL."""
    k = len(GLM_TERMS)
    ctes = ["""d AS MATERIALIZED (SELECT l_quantity / 50.0 AS y, 1.0::DOUBLE AS x0, (l_returnflag = 'R')::INT::DOUBLE AS x1, l_linenumber::DOUBLE AS x2,
      l_discount AS x3, l_linenumber * l_discount AS x4, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL)""",
            "b0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(k)) + ")"]
    cells = [f"m{i}_{j}" for i in range(k) for j in range(k)] + [f"r{i}" for i in range(k)] + [f"e{i}_{j}" for i in range(k) for j in range(k)]
    for s in range(1, steps + 1):
        eta = " + ".join(f"b{i} * x{i}" for i in range(k))
        sums = [f"sum(v * x{i} * x{j}) AS m{i}_{j}" for i in range(k) for j in range(k)] + [f"sum(w * (y - p) * x{i}) AS r{i}" for i in range(k)]
        unit = [f"{float(i == j)}::DOUBLE AS e{i}_{j}" for i in range(k) for j in range(k)]
        deviance = "sum(2 * w * (CASE WHEN y > 0 THEN y * ln(y / p) ELSE 0 END + CASE WHEN y < 1 THEN (1 - y) * ln((1 - y) / (1 - p)) ELSE 0 END)) AS deviance"
        ctes.append(f"s{s}_0 AS MATERIALIZED (SELECT {', '.join(sums + unit)}, {deviance} FROM (SELECT *, w * p * (1 - p) AS v FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM d, b{s - 1})))")
        for p in range(k):
            row = lambda i, c, p=p: f"{c(p)} / m{p}_{p}" if i == p else f"{c(i)} - m{i}_{p} / m{p}_{p} * {c(p)}"
            out = []
            for cell in cells:
                name, i = cell[0], int(cell[1])
                rest = cell[2:]
                out.append(f"{row(i, lambda q, n=name, r=rest: f'{n}{q}{r}')} AS {cell}")
            ctes.append(f"s{s}_{p + 1} AS MATERIALIZED (SELECT {', '.join(out)}, deviance FROM s{s}_{p})")
        if s < steps:
            ctes.append(f"b{s} AS MATERIALIZED (SELECT {', '.join(f'b{i} + r{i} AS b{i}' for i in range(k))} FROM b{s - 1}, s{s}_{k})")
    terms = "\n  UNION ALL ".join(f"SELECT '{t}' AS term, b{i} AS estimate, sqrt(e{i}_{i}) AS std_error, deviance FROM b{steps - 1}, s{steps}_{k}" for i, t in enumerate(GLM_TERMS))
    return "WITH " + ",\n".join(ctes) + f""",
t AS (SELECT *, estimate / std_error AS z, 1 / (1 + 0.2316419::DOUBLE * abs(estimate / std_error)) AS k FROM ({terms}))
SELECT term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, round(z, 3) AS z, round({NORMAL_TAIL}, 4) AS p_value, round(deviance, 2) AS deviance FROM t"""


@query("glm_full", _glm_oracle())
def glm_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """share ~ comeback_win + time * adv on line items."""
    line, discount = F.col("l_linenumber"), F.col("l_discount")
    rows = read(spark, sf_dir, "lineitem").withColumn("share", F.col("l_quantity") / 50.0)
    out = S.logistic_table(rows, "share", {"comeback_win": F.col("l_returnflag") == "R", "time": line, "adv": discount, "time:adv": line * discount})
    return rounded(out.select("term", "estimate", "std_error", "z", "p_value", "deviance"), {"estimate": 4, "std_error": 4, "z": 3, "p_value": 4, "deviance": 2})


@query("rank_sum_all_groups", f"""
WITH cells AS (SELECT o_custkey % 100 AS g, round(o_totalprice / 1000) AS v, count(*)::DOUBLE AS c FROM orders GROUP BY ALL),
own AS (SELECT g, sum(c) AS n, sum(c ** 3 - c) AS s FROM cells GROUP BY g),
u AS (SELECT a.g AS group_1, b.g AS group_2, sum(CASE WHEN a.v > b.v THEN a.c * b.c WHEN a.v = b.v THEN a.c * b.c / 2 ELSE 0 END) AS w,
    sum(CASE WHEN a.v = b.v THEN (a.c + b.c) ** 3 - (a.c + b.c) - (a.c ** 3 - a.c) - (b.c ** 3 - b.c) ELSE 0 END) AS s
  FROM cells a JOIN cells b ON a.g < b.g GROUP BY ALL),
t AS (SELECT group_1, group_2, x.n AS n1, y.n AS n2, w, u.s + x.s + y.s AS ties FROM u JOIN own x ON x.g = group_1 JOIN own y ON y.g = group_2),
z AS (SELECT *, (w - n1 * n2 / 2 - 0.5 * sign(w - n1 * n2 / 2)) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM t)
SELECT group_1, group_2, n1::BIGINT AS n1, n2::BIGINT AS n2, w, round(z, 5) AS z, round({NORMAL_TAIL}, 6) AS p_value
FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS k FROM z)""")
def rank_sum_all_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a hundred groups of customers, by the thousands of their orders' prices."""
    orders = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("g"), F.round(F.col("o_totalprice") / 1000).alias("v"))
    return rounded(S.rank_sum_all_groups(orders, "g", "v"), {"z": 5, "p_value": 6})
