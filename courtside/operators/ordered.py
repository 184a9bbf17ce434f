"""Ordered passes over groups of any size.

A plain ``Window.partitionBy(game).orderBy(id)`` puts a whole game into one
task. Here every group is cut into order buckets (``bucket``: an integer that
never decreases along the order), each (group, bucket) is processed as its own
window partition, and what crosses a bucket edge is carried by a prefix scan:

    rows --exchange on (keys, bucket)--> windows ----------------------------+
                     \\-- the same exchange --> one row per bucket             +--> join on (keys, bucket)
                                              --> the same pass on buckets --+

The rows are read and exchanged once: both branches ask the exchange for the same columns (packed in
one struct), so Spark reuses it. Summaries are hash aggregates, or, where a step reads text, what the last row of a bucket sees. They are
an ordered log themselves, one row per bucket, ordered in a window by group. Where ids are so sparse that a bucket holds few rows,
that log is nearly as long as the first; with ``levels`` above 1 it is cut again, 4,096 buckets to a block, and goes
through the same pass, so that the window by group alone meets one row per block of blocks.

Keys are compared as one struct, in which NULL equals NULL, so NULL keys form groups like any other. Rows whose
order value is NULL come first in their group, in a bucket of their own. Internal names live beside the packed rows only, so the
columns of the caller may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

DEFAULT_WIDTH = 65_536
BUCKET = "_bucket"
KEY = "_key"
#: Bucket of the rows without an order value.
UNORDERED = -(2**63)
#: How many bits of its number a bucket loses per level.
LEVEL_BITS = 12


@dataclass(frozen=True)
class Step:
    """One output column of an ordered pass."""

    kind: str
    col: Column
    fn: str = "sum"


def lag(col: str | Column) -> Step:
    """Value of the previous row of the group."""
    return Step("lag", _col(col))


def lead(col: str | Column) -> Step:
    """Value of the next row of the group."""
    return Step("lead", _col(col))


def running(col: str | Column) -> Step:
    """Running sum up to and including the row (NULL before the first value)."""
    return Step("running", _col(col))


def fill_down(col: str | Column) -> Step:
    """Last non-null value at or before the row."""
    return Step("down", _col(col))


def fill_up(col: str | Column) -> Step:
    """First non-null value at or after the row."""
    return Step("up", _col(col))


def total(col: str | Column, fn: str = "sum") -> Step:
    """Whole-group sum / min / max attached to every row."""
    return Step("total", _col(col), fn)


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def key_of(keys: Sequence[str]) -> Column:
    """One never-NULL column for a list of keys that may be NULL."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def bucket_of(col: str, width: int = DEFAULT_WIDTH) -> Column:
    """Bucket of an integer order key. With a key that is unique inside the
    group, a bucket holds at most ``width`` rows whatever the group's size."""
    return F.expr(f"`{col}` div {int(width)}")


_FIXED = (T.NumericType, T.BooleanType)

#: What carries a kind of step over the edges of buckets; kinds ending in an underscore leave out the row itself.
_CARRIED = {"lag": "lag", "lead": "lead", "running": "running_", "running_": "running_", "down": "down_", "down_": "down_",
            "up": "up_", "up_": "up_", "total": "total"}


def _along(kind: str, value: Column, fn: str, cell: WindowSpec, along: WindowSpec, order: Sequence[Column]) -> Column:
    """The step inside a window partition."""
    # looking ahead is looking back along the reversed order: a frame that grows
    # costs one step per row, one that shrinks rescans its rest for every row
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, -1 if kind.endswith("_") else 0)
    return {
        "lag": lambda: F.lag(value).over(along),
        "lead": lambda: F.lead(value).over(along),
        "running": lambda: F.sum(value).over(frame(along)),
        "down": lambda: F.last(value, ignorenulls=True).over(frame(along)),
        "up": lambda: F.last(value, ignorenulls=True).over(frame(cell.orderBy(*[c.desc() for c in order]))),
        "total": lambda: getattr(F, fn)(value).over(cell),
    }[kind.rstrip("_")]()


def _edge_aggregate(kind: str, value: Column, fn: str, order: Column) -> Column:
    """The bucket's summary as an aggregate."""
    return {
        "lag": lambda: F.max_by(value, order),
        "lead": lambda: F.min_by(value, order),
        "running": lambda: F.sum(value),
        "down": lambda: F.max_by(value, F.when(value.isNotNull(), order)),
        "up": lambda: F.min_by(value, F.when(value.isNotNull(), order)),
        "total": lambda: getattr(F, fn)(value),
    }[kind.rstrip("_")]()


def _edge(kind: str, value: Column, fn: str, upto: WindowSpec) -> Column:
    """The bucket's summary as its last row sees it."""
    return {
        "lag": lambda: value,
        "lead": lambda: F.first(value).over(upto),
        "running": lambda: F.sum(value).over(upto),
        "down": lambda: F.last(value, ignorenulls=True).over(upto),
        "up": lambda: F.first(value, ignorenulls=True).over(upto),
        "total": lambda: getattr(F, fn)(value).over(upto),
    }[kind.rstrip("_")]()


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind == "lag":
        return F.when(F.col("_first"), carry).otherwise(local)
    if kind == "lead":
        return F.when(F.col("_last"), carry).otherwise(local)
    if kind.startswith("running"):
        return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
    return F.coalesce(local, carry)


def _packed(fields: dict[str, Column]) -> Column:
    """One column for everything a pass takes along. The condition always holds, but the optimizer cannot know, so
    the test for NULL below keeps the whole struct, and both branches of a pass ask the exchange for the same."""
    return F.when(F.col(BUCKET) >= F.lit(UNORDERED), F.struct(*[c.alias(n) for n, c in fields.items()])).alias("_row")


def _scan(rows: DataFrame, kinds: Sequence[str], fns: Sequence[str], n_order: int, levels: int) -> DataFrame:
    """Rows (key, bucket, packed row with fields o0.. and v0..) with one result ``_r{i}`` per step."""
    order = [F.col(f"_o{j}") for j in range(n_order)]
    steps = [(i, kind, F.col(f"_v{i}"), fn) for i, (kind, fn) in enumerate(zip(kinds, fns))]
    asked = [*[F.col(f"_row.o{j}").alias(f"_o{j}") for j in range(n_order)], *[F.col(f"_row.v{i}").alias(f"_v{i}") for i, *_ in steps]]
    if levels == 0:
        cell = Window.partitionBy(KEY)
        along = cell.orderBy(*order)
        return rows.select(KEY, BUCKET, "_row", *asked).select(KEY, BUCKET, "_row", "_o0", *[_along(kind, v, fn, cell, along, order).alias(f"_r{i}") for i, kind, v, fn in steps])
    dealt = rows.repartition(KEY, BUCKET)
    cell = Window.partitionBy(KEY, BUCKET)
    along = cell.orderBy(*order)
    here = F.col("_row").isNotNull().alias("_here")

    narrow = dealt.select(KEY, BUCKET, here, *asked)
    types = {f.name: f.dataType for f in narrow.schema}
    if n_order == 1 and all(isinstance(t, _FIXED) for name, t in types.items() if name[:2] in ("_o", "_v")):
        number = F.coalesce(F.col("_o0"), F.lit(0).cast(types["_o0"]))  # rows without one have a bucket of their own
        edges = narrow.groupBy(KEY, BUCKET).agg(
            F.bool_and("_here").alias("_here"), F.lit(True).alias("_last"), *[_edge_aggregate(kind, v, fn, number).alias(f"_e{i}") for i, kind, v, fn in steps])
    else:
        upto, last = along.rowsBetween(Window.unboundedPreceding, 0), F.lead(F.lit(1)).over(along).isNull()
        edges = narrow.select(KEY, BUCKET, "_here", last.alias("_last"), *[_edge(kind, v, fn, upto).alias(f"_e{i}") for i, kind, v, fn in steps])
    fields = {"o0": F.col("_at"), **{f"v{i}": F.col(f"_e{i}") for i, *_ in steps}}
    edges = edges.where(F.col("_last") & F.col("_here")).select(KEY, F.col(BUCKET).alias("_at"), F.shiftright(BUCKET, LEVEL_BITS).alias(BUCKET), *[f"_e{i}" for i, *_ in steps])
    above = _scan(edges.select(KEY, BUCKET, _packed(fields)), [_CARRIED[k] for k in kinds], fns, 1, levels - 1)
    carry = above.select(KEY, F.col("_o0").alias(BUCKET), *[F.col(f"_r{i}").alias(f"_c{i}") for i, *_ in steps])

    # windows along the reversed order come first, so that the last sort, which the join keeps, is along the order
    backward_first = sorted(steps, key=lambda s: not s[1].startswith("up"))
    local = {f"_l{i}": _along(kind, v, fn, cell, along, order) for i, kind, v, fn in backward_first if kind != "total"}
    if "lag" in kinds:
        local["_first"] = F.lag(F.lit(1)).over(along).isNull()
    if "lead" in kinds:
        local["_last"] = F.lead(F.lit(1)).over(along).isNull()
    # every bucket has a carry; asked for as a left join, the rows are never the side that is broadcast
    own = dealt.select(KEY, BUCKET, "_row", *asked).withColumns(local).where(here)
    joined = own.join(carry, [KEY, BUCKET], "left")
    results = [F.col(f"_c{i}") if kind == "total" else _merge(kind, F.col(f"_l{i}"), F.col(f"_c{i}")) for i, kind, *_ in steps]
    return joined.select(KEY, BUCKET, "_row", "_o0", *[r.alias(f"_r{i}") for i, r in enumerate(results)])


def ordered_pass(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    steps: dict[str, Step],
    levels: int = 1,
) -> DataFrame:
    """Add one column per step. ``keys`` may be NULL, ``order`` is ascending (NULLs
    first) and total inside the group, ``bucket`` non-decreasing along ``order``.

    ``df`` is read and exchanged once. ``levels`` is how often a log is cut into buckets before a window by
    group orders the rest: 1 for the rows alone, more for ids so sparse that most buckets hold a row or two.
    """
    order_cols = [_col(c) for c in order]
    kept = [c for c in df.columns if c not in steps]
    fields = {
        **{f"o{j}": c for j, c in enumerate(order_cols)},
        **{f"v{i}": s.col for i, s in enumerate(steps.values())},
        **{f"c{i}": F.col(f"`{c}`") for i, c in enumerate(kept)},
    }
    names = {n: f"_{n}" for n in fields}
    placed = F.coalesce(bucket.cast("long"), F.lit(UNORDERED))
    flat = df.select(key_of(keys).alias(KEY), placed.alias(BUCKET), *[c.alias(names[n]) for n, c in fields.items()])
    rows = flat.select(KEY, BUCKET, _packed({n: F.col(names[n]) for n in fields}))
    done = _scan(rows, [s.kind for s in steps.values()], [s.fn for s in steps.values()], len(order_cols), levels)
    return done.select(
        *[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(kept)],
        *[F.col(f"_r{i}").alias(name) for i, name in enumerate(steps)],
    )


def with_block(
    df: DataFrame, keys: Sequence[str], pos: str, look_back: int, width: int = DEFAULT_WIDTH
) -> tuple[DataFrame, WindowSpec, Column]:
    """Blocks with a halo, for frames that look back at most ``look_back`` rows.

    ``pos`` is a dense row number inside the group. Rows at the end of a block
    are repeated at the head of the next one, so an ordinary window over
    (keys, block) sees its full frame. Returns (rows, window, keep); apply the
    window, then ``where(keep)`` drops the repeated rows.
    """
    own = F.expr(f"`{pos}` div {int(width)}")
    tail = F.col(pos) % width >= width - look_back
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.withColumn("_block", F.explode(blocks))
    return rows, Window.partitionBy(*keys, "_block").orderBy(pos), F.col("_block") == own


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    cols: dict[str, str],
    k: int,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Right-aligned mean of the last ``k`` rows; NULL until ``k`` are there."""
    rows, w, keep = with_block(df, keys, pos, k - 1, width)
    frame = w.rowsBetween(-(k - 1), 0)
    means = {
        out: F.when(F.count(F.lit(1)).over(frame) == k, F.avg(src).over(frame))
        for out, src in cols.items()
    }
    return rows.withColumns(means).where(keep).drop("_block")
