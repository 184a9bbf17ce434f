"""Ranks, exact quantiles and top-n without a single-task window.

Everything works on value counts: ties collapse before anything is ordered, and
the distinct values are spread over quantile buckets for an ordered pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .names import fresh
from .ordered import key_of, ordered_pass, running, total

#: A bucket is meant to hold about so many distinct values.
BUCKET_VALUES = 65_536
MOST_BITS = 14


def bits_for(n_values: int) -> int:
    """Buckets, as a power of two, for so many distinct values."""
    return min(MOST_BITS, max(4, (n_values // BUCKET_VALUES).bit_length()))


def as_number(df: DataFrame, col: str) -> Column:
    """A number that never decreases along ``col``: text by its first seven bytes, times by their seconds."""
    kind = dict(df.dtypes)[col]
    if kind == "string":
        head = F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("long")
    if kind == "date":
        return F.unix_date(col)
    return F.col(col).cast("double") if kind.startswith("timestamp") else F.col(col)


def _bisect(cuts: Column, value: Column, bits: int) -> Column:
    """How many of ``2 ** bits - 1`` ascending ``cuts`` lie below ``value``."""
    steps = F.array(*[F.lit(2**b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def _quantiles(col: str, bits: int) -> Column:
    return F.percentile_approx(col, [i / 2**bits for i in range(1, 2**bits)])


def quantile_buckets(df: DataFrame, col: str, out: str, bits: int) -> DataFrame:
    """Add a bucket number non-decreasing in ``col``, cut at approximate quantiles.

    Where the cuts fall only affects balance, never results. The cuts are one
    row of ``2 ** bits - 1`` numbers, read as a scalar subquery; a row finds its
    bucket (how many cuts lie below it) by bisection.
    """
    cuts = fresh("_cuts", df)
    bounds = df.agg(_quantiles(col, bits)).scalar()
    return df.withColumn(cuts, bounds).withColumn(out, _bisect(F.col(cuts), F.col(col), bits)).drop(cuts)


def range_buckets(df: DataFrame, col: str, out: str, n_values: int) -> DataFrame:
    """:func:`quantile_buckets` for ``n_values`` rows of mostly distinct values, as many as keep a bucket near ``BUCKET_VALUES``.

    One row of cuts has ``2 ** MOST_BITS`` buckets at most. Beyond that every bucket is cut again at quantiles of its own, which are one row
    per bucket, joined to the bucket's rows. Rows that share one value of ``col`` share a bucket.
    """
    bits = bits_for(n_values)
    wide = quantile_buckets(df, col, out, bits)
    over = n_values // (BUCKET_VALUES << bits)
    if over < 2:
        return wide
    more = min(MOST_BITS, over.bit_length())
    cuts = fresh("_cuts", wide)
    inner = wide.groupBy(out).agg(_quantiles(col, more).alias(cuts))
    cut = wide.join(inner, out)
    return cut.withColumn(out, F.col(out).cast("long") * 2**more + _bisect(F.col(cuts), F.col(col), more)).select(*wide.columns)


def _counts(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Staged: group ``k`` (a struct), value ``v``, its number of rows; NULL values too."""
    return stage(
        df.select(key_of(keys).alias("k"), F.col(col).alias("v"), as_number(df, col).alias("o"))
        .groupBy("k", "v", "o").agg(F.count(F.lit(1)).alias("n_rows")), "value_counts")


def _ranks(counts: DataFrame, descending: bool = False) -> DataFrame:
    """``k``, ``v``, n_rows, rank_min, rank_dense, n_total of the values that are not NULL."""
    values = counts.where("v is not null")
    ranked = ordered_pass(
        range_buckets(values, "o", "b", values.count()),
        ["k"],
        ["v"],
        F.col("b"),
        {"cum": running("n_rows"), "nth": running(F.lit(1)), "n_total": total("n_rows"), "n": total(F.lit(1))},
    )
    if descending:
        first, nth = F.col("n_total") - F.col("cum") + 1, F.col("n") - F.col("nth") + 1
    else:
        first, nth = F.col("cum") - F.col("n_rows") + 1, F.col("nth")
    return ranked.select("k", "v", "n_rows", first.alias("rank_min"), nth.cast("long").alias("rank_dense"), "n_total")


def value_ranks(df: DataFrame, keys: Sequence[str], col: str, descending: bool = False) -> DataFrame:
    """Distinct non-null values per group with ``n_rows``, ``rank_min``
    (competition rank), ``rank_dense`` and ``n_total``. Any orderable column."""
    ranks = _ranks(_counts(df, keys, col), descending)
    return ranks.select(*_unpacked(keys), F.col("v").alias(col), "n_rows", "rank_min", "rank_dense", "n_total")


def _unpacked(keys: Sequence[str]) -> list[Column]:
    return [F.col("k")[k].alias(k) for k in keys]


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    out: str,
    kind: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """Attach ``rank``, ``dense`` or ``percent`` rank; NULL values get NULL. A column named ``out`` is replaced."""
    ranks = _ranks(_counts(df, keys, col), descending)
    expr = {
        "rank": F.col("rank_min"),
        "dense": F.col("rank_dense"),
        "percent": F.when(F.col("n_total") == 1, F.lit(0.0)).otherwise(
            (F.col("rank_min") - 1) / (F.col("n_total") - 1)
        ),
    }[kind]
    kept = [c for c in df.columns if c != out]
    key, value = fresh("_key", df), fresh("_value", df)
    found = ranks.select(F.col("k").alias(key), F.col("v").alias(value), expr.alias(out))
    rows = df.withColumns({key: key_of(keys), value: F.col(col)}).select(*kept, key, value)
    return rows.join(found, [key, value], "left").select(*kept, out)


def top_n_ties(df: DataFrame, col: str, n: int, rank_as: str | None = None) -> DataFrame:
    """Rows whose value is among the n largest, ties of the n-th kept.

    A bounded top-n finds the n-th value; the rows are then only filtered.
    With ``rank_as`` a dense rank is added from the at most n distinct values.
    """
    best = df.select(col).where(F.col(col).isNotNull()).orderBy(F.col(col).desc()).limit(n)
    kept = df.where(F.col(col) >= best.agg(F.min(col)).scalar())
    if rank_as is None:
        return kept
    ladder = best.distinct().withColumn(
        rank_as, F.dense_rank().over(Window.orderBy(F.col(col).desc())).cast("long")
    )
    return kept.join(F.broadcast(ladder), col).select(*df.columns, rank_as)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per group; NULL for a group without a value.

    The order statistics are picked from running value counts, so no task ever
    holds a group's values in memory (unlike the built-in exact percentile).
    """
    counts = _counts(df, keys, col)
    last = F.col("rank_min") + F.col("n_rows") - 1
    picks, finals = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        picks += [
            F.min(F.when(last > F.floor(pos), F.col("v"))).alias(f"lo_{i}"),
            F.min(F.when(last > F.ceil(pos), F.col("v"))).alias(f"hi_{i}"),
            F.max(pos - F.floor(pos)).alias(f"w_{i}"),
        ]
        lo, hi, wt = (F.col(f"{k}_{i}") for k in ("lo", "hi", "w"))
        finals.append((lo + wt * (hi - lo)).cast("double").alias(name))
    if not keys:
        return _ranks(counts).agg(*picks).select(*finals)
    found = _ranks(counts).groupBy("k").agg(*picks)
    return counts.select("k").distinct().join(found, "k", "left").select(*_unpacked(keys), *finals)


def top_dense(
    df: DataFrame, col: str, n: int, rank_as: str, descending: bool = True
) -> DataFrame:
    """Rows whose value is one of the n best distinct values, with their dense rank."""
    order = F.col(col).desc() if descending else F.col(col).asc()
    ladder = (
        df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(order).limit(n)
        .withColumn(rank_as, F.dense_rank().over(Window.orderBy(order)).cast("long"))
    )
    return df.join(F.broadcast(ladder), col).select(*df.columns, rank_as)
