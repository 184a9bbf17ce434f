"""Statistics as aggregates: rank-sum tests, regression lines, correlation, GLM."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import fisher_p, ratio, student_p, two_sided_p
from ..session import stage
from .ordered import key_of, ordered_pass, running, total
from .ranking import bits_for, quantile_buckets
from .reshape import longer

# fixed value: 97.5 % point of the normal distribution
NORMAL_975 = 1.959963984540054


def rank_sum_matrix(
    df: DataFrame, group: str, groups: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Two-sample rank-sum test for every pair of groups and every column.

    With c(v) rows of a group at value v and C(v) below it, the statistic of a
    pair is sum over v of c1(v) * (C2(v) + c2(v) / 2): running counts over the
    distinct values replace pooled ranks, so all pairs come out of one ordered
    pass and no group is ever joined with another. Normal form with tie and
    continuity correction; ``p_value`` is not adjusted (see :func:`with_holm`).
    """
    names = [f"g{i}" for i in range(len(groups))]
    long = longer(df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]),
                  [group], cols, "metric", "value", drop_null=True)
    counts = stage(
        long.groupBy("metric", "value").agg(
            *[F.count_if(F.col(group) == g).alias(n) for g, n in zip(groups, names)]
        ),
        "rank_sum_counts",
    )
    cum = ordered_pass(
        quantile_buckets(counts, "value", "_range", bits_for(counts.count())),
        ["metric"],
        ["value"],
        F.col("_range"),
        {
            **{f"c_{n}": running(n) for n in names},
            **{f"n_{n}": total(n) for n in names},
        },
    )
    pairs = list(combinations(range(len(groups)), 2))
    aggs = []
    for i, j in pairs:
        a, b = names[i], names[j]
        below = F.col(f"c_{b}") - F.col(b)
        tied = (F.col(a) + F.col(b)).cast("double")
        aggs += [
            F.sum(F.col(a) * (below + F.col(b) / 2)).alias(f"u_{i}_{j}"),
            F.sum(tied * tied * tied - tied).alias(f"t_{i}_{j}"),
        ]
    sizes = [F.max(f"n_{n}").alias(f"n_{n}") for n in names]
    wide = cum.groupBy("metric").agg(*aggs, *sizes)
    rows = F.array(
        *[
            F.struct(
                F.lit(groups[i]).alias("group_1"),
                F.lit(groups[j]).alias("group_2"),
                F.col(f"n_{names[i]}").alias("n1"),
                F.col(f"n_{names[j]}").alias("n2"),
                F.col(f"u_{i}_{j}").cast("double").alias("w"),
                F.col(f"t_{i}_{j}").alias("_ties"),
            )
            for i, j in pairs
        ]
    )
    return _normal_form(wide.select("metric", F.explode(rows).alias("_r")).select("metric", "_r.*"))


def _normal_form(tests: DataFrame) -> DataFrame:
    """z and p_value of rank sums ``w`` with group sizes n1, n2 and the tie term ``_ties``."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    mean = n1 * n2 / 2
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1)))
    gap = F.col("w") - mean
    z = F.try_divide(gap - F.lit(0.5) * F.signum(gap), F.sqrt(var))
    return tests.withColumn("z", z).withColumn("p_value", two_sided_p(F.col("z"))).drop("_ties")


def rank_sum_all_groups(df: DataFrame, group: str, col: str) -> DataFrame:
    """Two-sample rank-sum test of ``col`` for every pair of the groups that the data hold (one row a pair, group_1 < group_2).

    Counts stay long, one row per (value, group): the plan does not grow with the groups. Running totals per group are laid over all
    distinct values, and a cell of one group meets the totals of the others at its value. That is (cells * groups) rows, summed per pair
    before they are exchanged. Rows with a NULL group or value are left out.
    """
    cells = stage(
        df.select(F.col(group).alias("g"), F.col(col).cast("double").alias("v")).where("g is not null and v is not null")
        .groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), "rank_sum_cells")
    groups = cells.groupBy("g").agg(F.sum("c").alias("n"), F.sum(_cubed(F.col("c"))).alias("ties"))
    listed = groups.agg(F.collect_list("g")).scalar()
    grid = cells.select("v").distinct().withColumn("g", F.explode(listed)).join(cells, ["v", "g"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    grid = stage(grid, "rank_sum_grid")
    cum = ordered_pass(quantile_buckets(grid, "v", "_range", bits_for(grid.count())), ["g"], ["v"], F.col("_range"), {"upto": running("c")})
    one, two = cells.select(F.col("g").alias("group_1"), "v", F.col("c").alias("a")), cum.select(F.col("g").alias("group_2"), "v", F.col("c").alias("b"), "upto")
    met = one.join(two, "v").where("group_1 < group_2").groupBy("group_1", "group_2").agg(
        F.sum(F.col("a") * (F.col("upto") - F.col("b") / 2)).alias("w"),
        F.sum(_cubed(F.col("a") + F.col("b")) - _cubed(F.col("b"))).alias("t"))
    sizes = lambda i: groups.select(F.col("g").alias(f"group_{i}"), F.col("n").alias(f"n{i}"), F.col("ties").alias(f"t{i}"))
    both = met.join(sizes(1), "group_1").join(sizes(2), "group_2")
    return _normal_form(both.select("group_1", "group_2", "n1", "n2", F.col("w").cast("double").alias("w"), (F.col("t") + F.col("t2")).alias("_ties")))


def _cubed(n: Column) -> Column:
    x = n.cast("double")
    return x * x * x - x


def with_holm(tests: DataFrame, family: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values of ``p_value`` within each family of tests.

    A family has one row per pair of groups, so a window holds few rows. Tests
    without a p-value keep none and do not count.
    """
    p, rows = F.col("p_value"), Window.partitionBy(*family)
    along = rows.orderBy(p.asc_nulls_last())
    step = F.least(F.lit(1.0), (F.count(p).over(rows) - F.row_number().over(along) + 1) * p)
    adjusted = F.max("_step").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("_step", step).withColumn(out, F.when(p.isNotNull(), adjusted)).drop("_step")


def regression_lines(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line per group with r2, slope standard error and count.

    One line per group is the model with a factor interaction.
    """
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_count(y, x).alias("n"),
    )
    residual = (1 - F.col("r2")) * F.col("_syy")
    error = F.sqrt(F.try_divide(F.try_divide(residual, F.col("n") - 2), F.col("_sxx")))
    return fit.withColumn("slope_se", error).drop("_syy", "_sxx")


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson r with its t statistic and degrees of freedom."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    # the built-in correlation divides by zero where a side does not vary
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return df.where(both).groupBy(*keys).agg(
        F.try_divide(F.covar_pop(x, y), spread).alias("r"), F.count(F.lit(1)).alias("n")
    ).withColumns(
        {
            "t": F.col("r") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("r") * F.col("r"))),
            "df": F.col("n") - 2,
        }
    )


def correlation_test(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """:func:`correlation` with the two-sided p-value of Student's t and Fisher's 95 % interval ``low`` to ``high``.

    With r = 1 or -1 (to 14 digits) the p-value is 0 and the interval is that point. A group of fewer than three pairs has no p-value, one of
    fewer than four no interval; where one side does not vary, r and all else is NULL.
    """
    r, n = F.col("r"), F.col("n")
    tests = correlation(df, keys, x, y).withColumn("r", F.when(F.abs(r) > 1 - 1e-14, F.signum(r)).otherwise(r))
    exact = F.abs(r) == 1
    z = F.when(~exact, F.atanh(F.when(~exact, r)))
    half = F.lit(NORMAL_975) / F.sqrt(F.when(n > 3, n - 3))
    edge = lambda side: F.when(exact & (n > 3), r).otherwise(F.tanh(z + side * half))
    return tests.withColumns({
        "p_value": F.when((n > 2) & exact, F.lit(0.0)).when(n > 2, student_p(F.col("t"), F.col("df"))),
        "low": edge(-1), "high": edge(1)})


def regression_interaction(df: DataFrame, keys: Sequence[str], group: str, y: str, x: str, baseline: object) -> DataFrame:
    """Least squares of ``y`` on ``x``, a factor and their interaction, one model per family ``keys``: one row per term.

    Columns: ``term`` ((Intercept), x, then the difference of every other group from ``baseline`` in intercept, ``group``, and slope,
    ``x:group``), estimate, std_error, t, p_value, df (residual), and for the test of equal slopes f, f_p.

    All cross products come from one aggregate. The model splits into one line per group with a common residual variance, so
    the normal equations are solved per group, centred, as column expressions. A group of equal ``x`` has no slope and is left out, rows with
    a NULL in any of the columns count for nothing, and without a baseline group only that family's terms are NULL. Families may be any number;
    a family's groups are few beside its rows.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull())
    fit = both.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(group).cast("string").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    names = [f"k{i}" for i in range(len(keys))]
    fit = stage(fit.where("sxx > 0").withColumn("slope", F.col("sxy") / F.col("sxx")), "group_lines")
    lines = fit.withColumns({"fam": key_of(names), "intercept": F.col("my") - F.col("slope") * F.col("mx"), "rss": F.col("syy") - F.col("slope") * F.col("sxy")})
    base = F.col("g") == F.lit(str(baseline))
    pooled = lambda c: F.sum(c)
    totals = lines.groupBy("fam").agg(
        pooled("rss").alias("rss"), (F.sum("n") - 2 * F.count(F.lit(1))).alias("df"), (F.count(F.lit(1)) - 1).alias("df_slopes"),
        (F.sum("syy") - F.sum("sxy") * F.sum("sxy") / F.sum("sxx")).alias("rss_common"),
        *[F.max(F.when(base, F.col(c))).alias(f"base_{c}") for c in ("slope", "intercept", "n", "mx", "sxx")])
    s2 = F.try_divide(F.col("rss"), F.col("df").cast("double"))
    slope_var = lambda p: s2 / F.col(f"{p}sxx")
    intercept_var = lambda p: s2 * (1 / F.col(f"{p}n") + F.col(f"{p}mx") * F.col(f"{p}mx") / F.col(f"{p}sxx"))
    term = lambda name, estimate, var: F.struct(name.alias("term"), estimate.alias("estimate"), F.sqrt(var).alias("std_error"))
    own = F.array(term(F.lit("(Intercept)"), F.col("base_intercept"), intercept_var("base_")), term(F.lit(x), F.col("base_slope"), slope_var("base_")))
    others = F.array(term(F.col("g"), F.col("intercept") - F.col("base_intercept"), intercept_var("") + intercept_var("base_")),
                     term(F.concat(F.lit(f"{x}:"), F.col("g")), F.col("slope") - F.col("base_slope"), slope_var("") + slope_var("base_")))
    f = F.try_divide(F.try_divide(F.col("rss_common") - F.col("rss"), F.col("df_slopes").cast("double")), s2)
    joined = lines.drop("rss").join(totals, "fam")
    rows = joined.select(*names, "df", "df_slopes", f.alias("f"), F.explode(F.when(base, own).otherwise(others)).alias("_t")).select(*names, "_t.*", "df", "df_slopes", "f")
    t = F.try_divide(F.col("estimate"), F.col("std_error"))
    out = rows.withColumns({"t": t, "p_value": student_p(t, F.col("df")), "f_p": fisher_p(F.greatest(F.col("f"), F.lit(0.0)), F.col("df_slopes"), F.col("df"))})
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "term", "estimate", "std_error", "t", "p_value", "df", "f", "f_p")


def logistic_table(df: DataFrame, y: str, terms: dict[str, Column], steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """Logistic regression of ``y`` (a share from 0 to 1) with an intercept: estimate, std_error, z, p_value per term, and the model's deviances.

    Iteratively reweighted least squares: rows collapse to their distinct values first, and every step is one aggregate of
    the weighted cross products, so only matrices of the terms' size reach the driver. Rows with a NULL are left out. Ends when the deviance
    moves by less than ``tolerance`` of itself. Terms that are linear combinations of others are an error.
    """
    names = ["(Intercept)", *terms]
    flat = df.select(F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values(), 1)])
    k = len(names)
    rows = stage(flat.dropna().groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("w")), "glm_rows")
    beta, deviance = np.zeros(k), None
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    entropy = lambda y, p: F.when(y > 0, y * F.ln(y / p)).otherwise(0.0)
    totals = rows.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("sy")).first()
    if not totals.n:
        raise ValueError("no rows without NULL")
    y_col, w = F.col("y"), F.col("w")
    for _ in range(steps):
        eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.col("eta")))
        at = rows.withColumn("eta", eta).withColumn("p", p).withColumn("v", w * F.col("p") * (1 - F.col("p")))
        sums = at.agg(
            *[F.sum(F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs],
            *[F.sum(w * (y_col - F.col("p")) * F.col(f"x{i}")).alias(f"u{i}") for i in range(k)],
            F.sum(2 * w * (entropy(y_col, F.col("p")) + entropy(1 - y_col, 1 - F.col("p")))).alias("deviance")).first()
        information = np.zeros((k, k))
        for i, j in pairs:
            information[i, j] = information[j, i] = sums[f"h{i}_{j}"]
        if np.linalg.matrix_rank(information / np.sqrt(np.outer(np.diag(information), np.diag(information)))) < k:
            raise ValueError("the terms are linearly dependent, or the fit has run to its bounds")
        settled = deviance is not None and abs(sums.deviance - deviance) <= tolerance * (abs(sums.deviance) + 0.1)
        deviance = sums.deviance
        if settled:
            break
        beta = beta + np.linalg.solve(information, np.array([sums[f"u{i}"] for i in range(k)]))
    error = np.sqrt(np.diag(np.linalg.inv(information)))
    mean = totals.sy / totals.n
    null = rows.agg(F.sum(2 * w * (entropy(y_col, F.lit(mean)) + entropy(1 - y_col, F.lit(1 - mean))))).first()[0]
    table = [(n, float(b), float(e), float(b / e), float(deviance), float(null), int(totals.n - k)) for n, b, e in zip(names, beta, error)]
    out = df.sparkSession.createDataFrame(table, "term string, estimate double, std_error double, z double, deviance double, null_deviance double, df long")
    return out.withColumn("p_value", two_sided_p(F.col("z")))


def binomial_glm(df: DataFrame, formula: str) -> DataFrame:
    """Logistic regression from a formula: one row per term.

    The fit iterates distributed aggregates; only the coefficients reach the
    driver.
    """
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    prepared = RFormula(formula=formula).fit(df)
    features = prepared.transform(df).select("features", "label")
    model = GeneralizedLinearRegression(family="binomial", link="logit").fit(features)
    attrs = features.schema["features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for _, a in sorted((a["idx"], a) for k in attrs.values() for a in k)]
    terms = [("(Intercept)", float(model.intercept)), *zip(names, map(float, model.coefficients))]
    return df.sparkSession.createDataFrame(terms, "term string, estimate double")
