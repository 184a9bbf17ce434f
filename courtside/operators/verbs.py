"""Small table verbs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import fresh
from .ordered import key_of


def snake(name: str) -> str:
    """Column name in lower snake case; a leading digit gets an x."""
    s = name.strip().replace("%", "_percent_")
    s = re.sub(r"([a-z])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    return f"x{s}" if s[:1].isdigit() else s


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case every column; repeats get _2, _3, ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        s = snake(c)
        seen[s] = seen.get(s, 0) + 1
        names.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    return df.toDF(*names)


def pick(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns matching a regular expression."""
    return [c for c in df.columns if re.search(pattern, c)]


def pick_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    """Names of the columns of the given types."""
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return pick_type(df, T.NumericType)


def cast_except(df: DataFrame, keep: Sequence[str], to: str = "double") -> DataFrame:
    """Cast all columns but ``keep``; text that is no number becomes NULL."""
    kept = set(keep)
    return df.select(
        *[F.col(c) if c in kept else F.col(c).try_cast(to).alias(c) for c in df.columns]
    )


def relocate(df: DataFrame, cols: Sequence[str], after: str | None = None) -> DataFrame:
    """Move columns to the front or behind ``after``."""
    rest = [c for c in df.columns if c not in cols]
    at = 0 if after is None else rest.index(after) + 1
    return df.select(*rest[:at], *cols, *rest[at:])


def separate(df: DataFrame, col: str, into: Sequence[str], pattern: str) -> DataFrame:
    """Split text into columns: extra pieces dropped, missing ones NULL."""
    parts = F.split(F.col(col), pattern)
    return df.withColumns(
        {n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(into)}
    ).drop(*([] if col in into else [col]))


def unite(cols: Sequence[str], sep: str = "_") -> Column:
    """Paste columns; a missing one is written NA."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols])


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Remove a literal suffix from the column names that carry it."""
    return df.toDF(*[c.removesuffix(suffix) for c in df.columns])


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False
) -> DataFrame:
    """Whole first (or last) row per key in a total ascending order.

    An aggregate, not a window: the partial step keeps one row per key and task.
    """
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    pick_row = F.max_by if last else F.min_by
    return (
        df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(pick_row(F.struct(*df.columns), rank).alias("_row"))
        .select("_row.*")
    )


def keep_groups_where_all(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Rows of the groups in which every row meets the condition (NULL fails)."""
    key = fresh("_key", df)
    good = (
        df.groupBy(key_of(keys).alias(key))
        .agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("_all"))
        .where("_all")
        .select(key)
    )
    return df.withColumn(key, key_of(keys)).join(good, key, "left_semi").drop(key)


def attach(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group aggregates on every row: partial aggregation, then an equi-join
    (whose hot keys adaptive execution can split), never a window. A column of the same name is replaced."""
    key = fresh("_key", df)
    groups = df.groupBy(key_of(keys).alias(key)).agg(*[a.alias(n) for n, a in aggs.items()])
    rest = [c for c in df.columns if c not in keys and c not in aggs]
    return df.select(*keys, *rest).withColumn(key, key_of(keys)).join(groups, key).select(*keys, *rest, *aggs)
