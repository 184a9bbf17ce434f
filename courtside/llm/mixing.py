"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Rates stay as close as
possible, in relative entropy, to one copy each, subject to one constraint a source (its
words times their rates are the source's target) and to at most ``most`` copies. The solution is an
exponential tilt: a document of ``x`` times its source's mean size has the rate
``min(most, exp(lambda * x))`` with one multiplier a source. The multipliers solve the convex dual by safeguarded
Newton steps; each step is one Spark job over the counts of (source, size), all sources at once.

Rates become whole copies: everyone gets the integer part; then documents in the order of
a hash over their fractional part get one more until the source's words reach the target. The order is cut into cells of about
``CELL`` documents, whose prefix sums say which cells are in; only the one cell at the edge is filled document by document.
No window or array holds more than a cell, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import GAP
from courtside.session import stage

CELL = 1024
LEVELS = 16
WEIGHTS = (1.0, 2.0, 3.0)


def n_words(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{GAP}|{GAP}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def prepared(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` and what mixing needs of each row, in columns whose names begin with ``_mix``."""
    spread = F.pmod(F.xxhash64("doc_id", F.xxhash64(text_column)), F.lit(2**40))
    return docs.withColumns({
        "_mix_size": n_words(F.col(text_column)),
        "_mix_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")),
        "_mix_u": (spread + 0.5) / 2.0**40})


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Per source: documents n, words s, smallest positive size, target t.

    ``sizes`` has _mix_source, _mix_size, n. Sources in the order of their code points, NULL last, have the weights in turn.
    The windows run over one row a source.
    """
    per = sizes.groupBy("_mix_source").agg(
        F.sum("n").alias("n"), F.sum(F.col("_mix_size") * F.col("n")).alias("s"),
        F.min(F.when(F.col("_mix_size") > 0, F.col("_mix_size"))).alias("least"))
    place = F.row_number().over(Window.orderBy(F.col("_mix_source") == "", "_mix_source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", most * F.col("s")).withColumn("r", F.col("cap") / F.col("w"))
    up = Window.orderBy("r", "_mix_source")
    level = ((F.sum("s").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", level).withColumn("free", F.col("r") > F.col("level"))
    first = F.min(F.when(F.col("free"), F.struct("r", "_mix_source", "level"))).over(Window.partitionBy())
    return per.withColumn("first", first).select(
        "_mix_source", "n", "s", "least",
        F.when(F.col("free"), F.least(F.col("cap"), F.col("w") * F.col("first.level"))).otherwise(F.col("cap")).alias("t"))


def rate(multiplier: Column, size: Column, mean: Column, most: float) -> Column:
    """The tilt, which stays below overflow where it is capped anyway; a NULL multiplier stands for the cap."""
    tilt = F.exp(F.least(multiplier * size / mean, F.lit(float(most) + 1.0)))
    return F.when(multiplier.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), tilt))


def solve(sizes: DataFrame, goals: DataFrame, most: float = 3.0, within: float = 1e-9, steps: int = 80) -> DataFrame:
    """``goals`` with ``mean`` and the multiplier ``lam`` of every source (NULL where the target needs ``most`` of everything)."""
    full = (F.col("t") >= most * F.col("s") * (1 - 1e-9)) | (F.col("s") == 0)
    state = goals.withColumn("mean", F.col("s") / F.col("n")).withColumns({
        "lam": F.when(~full, F.lit(0.0)), "lo": F.when(~full, -700 * F.col("mean") / F.col("least")),
        "hi": F.when(~full, F.log(F.lit(most)) * F.col("mean") / F.col("least")), "off": F.when(~full, F.lit(1.0))})
    state = stage(state, "multipliers")
    words = F.col("n_docs") * F.col("_mix_size")
    for _ in range(steps):
        if not state.where(F.col("off") > within).limit(1).count():
            break
        e = rate(F.col("lam"), F.col("_mix_size"), F.col("mean"), most)
        at = (sizes.withColumnRenamed("n", "n_docs").join(state.where("lam is not null"), "_mix_source")
              .groupBy("_mix_source").agg(
                  F.sum(words * e).alias("m"), F.sum(F.when(e < most, words * F.col("_mix_size") / F.col("mean") * e).otherwise(0.0)).alias("d")))
        now = state.join(at, "_mix_source", "left")
        lo = F.when(F.col("m") < F.col("t"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("m") > F.col("t"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.when((F.col("d") > 0) & (F.col("m") > 0), F.col("lam") - F.log(F.col("m") / F.col("t")) * F.col("m") / F.col("d"))
        now = now.withColumns({"lo": lo, "hi": hi, "newton": newton, "gap": F.abs(F.col("m") / F.col("t") - 1)})
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        step = F.when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        now = now.withColumns({
            "off": F.when(F.col("hi") - F.col("lo") <= 1e-14 * F.abs(F.col("lam")), F.lit(0.0)).otherwise(F.col("gap")),
            "lam": F.when(F.col("gap") <= within, F.col("lam")).otherwise(step)})
        state = stage(now.select(*state.columns), "multipliers")
    return state.drop("lo", "hi", "off")


def greedy(sizes: Column, room: Column) -> Column:
    """Of (size, n) in falling order of size, how many of each n still fit into what is left of ``room``."""
    start = F.struct(room.cast("double").alias("room"), F.array().cast("array<long>").alias("take"))

    def one(got: Column, group: Column) -> Column:
        fit = F.greatest(F.lit(0), F.least(group["n"], F.floor(got["room"] / group["_mix_size"])))
        return F.struct((got["room"] - fit * group["_mix_size"]).alias("room"), F.concat(got["take"], F.array(fit.cast("long"))).alias("take"))

    return F.aggregate(sizes, start, one, lambda got: got["take"])


def with_copies(docs: DataFrame, narrow: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``docs`` (see :func:`prepared`) with _mix_source_size, _mix_target, _mix_rate and _mix_copies.

    ``narrow`` holds the same rows without their texts, if the caller has staged them. NULL texts have size 0, as have
    texts without a word; NULL sources are one source; repeated rows count each; rows that agree in id and text share a
    place in the order. An empty table gives no rows.
    """
    own = ["_mix_size", "_mix_source", "_mix_u"]
    narrow = stage(docs.select(*own), "mix") if narrow is None else narrow.select(*own)
    sizes = stage(narrow.groupBy("_mix_source", "_mix_size").agg(F.count("*").alias("n")), "mix_sizes")
    plan = solve(sizes, targets(sizes, weights, float(most)), float(most))
    plan = stage(plan.withColumn("cells", F.ceil(F.col("n") / CELL)), "mix_plan")

    def placed(rows: DataFrame) -> DataFrame:
        r = F.round(rate(F.col("lam"), F.col("_mix_size"), F.col("mean"), float(most)), 9)
        out = rows.join(plan.select("_mix_source", "lam", "mean", "cells", F.col("s").alias("_mix_source_size"), F.col("t").alias("_mix_target")),
                        "_mix_source").withColumn("_mix_rate", F.when(F.col("_mix_size") > 0, r).otherwise(F.lit(1.0)))
        out = out.withColumn("_mix_whole", F.floor("_mix_rate").cast("int"))
        part = F.col("_mix_rate") - F.col("_mix_whole")
        level = F.floor(LEVELS * F.col("_mix_u") / (F.col("_mix_u") + part))
        cell = F.when((part > 0) & (F.col("_mix_size") > 0), level * F.col("cells") + F.floor(F.col("_mix_u") * F.col("cells")))
        return out.withColumn("_mix_cell", cell.cast("long")).drop("lam", "mean", "cells")

    narrow = placed(narrow)
    whole = narrow.groupBy("_mix_source", "_mix_cell").agg(
        F.sum("_mix_size").alias("words"), F.sum(F.col("_mix_size") * F.col("_mix_whole")).alias("sure"))
    whole = stage(whole, "mix_cells")
    sure = whole.groupBy("_mix_source").agg(F.sum("sure").alias("sure"))
    room = plan.join(sure, "_mix_source", "left").select("_mix_source", (F.col("t") - F.coalesce("sure", F.lit(0))).alias("room"))
    through = F.sum("words").over(Window.partitionBy("_mix_source").orderBy("_mix_cell"))
    at = whole.where("_mix_cell is not null").withColumn("through", through).join(room, "_mix_source")
    edge = at.where(F.col("through") > F.col("room")).groupBy("_mix_source").agg(
        F.min(F.struct("_mix_cell", (F.col("room") - F.col("through") + F.col("words")).alias("left"))).alias("e"))
    edge = stage(edge.select("_mix_source", F.col("e._mix_cell").alias("edge"), F.col("e.left").alias("left")), "mix_edge")
    last = narrow.join(edge, "_mix_source").where(F.col("_mix_cell") == F.col("edge"))
    # rows that agree in id and text share a place: they are counted first, so a cell is as long as it has different documents
    alike = last.groupBy("_mix_source", "left", "_mix_size", "_mix_u").agg(F.count("*").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("_mix_size", "_mix_u", "n")), asc=False).alias("alike")
    taken = alike.groupBy("_mix_source", "left").agg(listed).withColumn("take", greedy(F.col("alike"), F.col("left")))
    taken = taken.select("_mix_source", F.explode(F.arrays_zip("alike", "take")).alias("g"))
    chosen = stage(taken.select("_mix_source", F.col("g.alike._mix_size").alias("_mix_size"), F.col("g.alike._mix_u").alias("_mix_u"), F.col("g.take").alias("take")), "mix_chosen")

    rows = placed(docs).join(edge.drop("left"), "_mix_source", "left")
    at_edge = F.col("_mix_cell").isNotNull() & (F.col("_mix_cell") == F.col("edge"))
    before = F.col("_mix_cell").isNotNull() & (F.col("edge").isNull() | (F.col("_mix_cell") < F.col("edge")))
    plain = rows.where(~F.coalesce(at_edge, F.lit(False))).withColumn("_mix_copies", F.col("_mix_whole") + F.coalesce(before, F.lit(False)).cast("int"))
    number = F.row_number().over(Window.partitionBy("_mix_source", "_mix_size", "_mix_u").orderBy("doc_id"))
    edgy = (rows.where(at_edge).withColumn("_mix_no", number).join(chosen, ["_mix_source", "_mix_size", "_mix_u"])
            .withColumn("_mix_copies", F.col("_mix_whole") + (F.col("_mix_no") <= F.col("take")).cast("int")).drop("take", "_mix_no"))
    return plain.unionByName(edgy).drop("_mix_whole", "_mix_cell", "edge", "_mix_u")
