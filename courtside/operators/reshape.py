"""Row mirroring, long/wide reshaping, densifying, binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mirror(df: DataFrame, keep: Sequence[str], sides: Sequence[dict[str, Column]]) -> DataFrame:
    """One output row per side of each input row, in a single scan."""
    structs = [F.struct(*[c.alias(n) for n, c in side.items()]) for side in sides]
    return df.select(*keep, F.explode(F.array(*structs)).alias("_side")).select(*keep, "_side.*")


def longer(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str,
    drop_null: bool = False,
) -> DataFrame:
    """Columns to rows."""
    out = df.unpivot(list(ids), list(cols), name, value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def wider(
    df: DataFrame, ids: Sequence[str], name: str, values: Sequence, aggs: dict[str, Column]
) -> DataFrame:
    """Rows to columns for a declared list of names (one aggregate per cell)."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(*[a.alias(n) for n, a in aggs.items()])


def date_spine(df: DataFrame, start: str, end: str, out: str = "date") -> DataFrame:
    """One row per day from ``start`` to ``end`` (both included)."""
    return df.withColumn(out, F.explode(F.sequence(F.col(start), F.col(end))))


def cut(col: str, breaks: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins ``(a, b]``; outside the breaks is NULL."""
    if labels is None:
        labels = [f"({a:g},{b:g}]" for a, b in zip(breaks, breaks[1:])]
    x, out = F.col(col), None
    for lo, hi, label in zip(breaks, breaks[1:], labels):
        hit = (x > lo) & (x <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out
