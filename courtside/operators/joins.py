"""Joins Spark has no bounded form for: ranges, interval overlaps, patterns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .names import fresh

DEFAULT_CELL = 64


def dyadic_cover(start: Column, end: Column) -> Column:
    """``[start, end)`` as an array of aligned blocks (level, block): block b of level v is ``[b * 2**v, (b + 1) * 2**v)``.

    Of every level at most two blocks are taken, so there are at most ``2 * log2(length) + 2`` of them; they are
    disjoint and fill the interval. One or two units are listed one by one. NULL or empty intervals have no block.
    """
    unit = lambda at: F.struct(F.lit(0).alias("level"), at.cast("long").alias("block"))
    span = end - start

    def of_level(v: Column) -> Column:
        lo = -F.call_function("shiftright", -start.cast("long"), v)
        hi = F.call_function("shiftright", end.cast("long"), v)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        block = lambda at: F.struct(v.alias("level"), at.alias("block"))
        first = F.when((lo < hi) & odd(lo), block(lo))
        last = F.when((lo < hi) & odd(hi), block(hi - 1))
        return F.array(first, last)

    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(span, F.lit(1)).cast("double"))).cast("int") + 1)
    many = F.array_compact(F.flatten(F.transform(levels, of_level)))
    few = F.filter(F.array(unit(start), unit(start + 1)), lambda b: b["block"] < end)
    return F.when(span > 2, many).when(span > 0, few)


def _cells(start: str, end: str, width: int, one_by_one: bool = False) -> Column:
    """Cover of ``[start, end)`` in cells of ``width`` ids, dyadic or one by one; a cell may stick out at either end."""
    lo, hi = F.floor(F.expr(f"`{start}` / {width}D")), F.floor(F.expr(f"(`{end}` - 1) / {width}D"))
    each = F.transform(F.sequence(lo, hi), lambda b: F.struct(F.lit(0).alias("level"), b.alias("block")))
    return F.when(F.col(start) < F.col(end), each if one_by_one else dyadic_cover(lo, hi + 1))


def _ancestors(at: str, width: int, levels: Sequence[int]) -> Column:
    """The block of every level that holds the id ``at``."""
    cell = F.floor(F.expr(f"`{at}` / {width}D"))
    return F.array(*(F.struct(F.lit(v).alias("level"), F.shiftright(cell, v).alias("block")) for v in levels))


def cover_levels(intervals: DataFrame, start: str, end: str, width: int) -> list[int]:
    """The levels that covers of these intervals use: a small job whose answer has at most 64 numbers."""
    found = intervals.select(F.explode(F.transform(_cells(start, end, width), lambda b: b["level"])).alias("level"))
    return sorted(r.level for r in found.distinct().collect()) or [0]


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    how: str = "left",
    width: int = DEFAULT_CELL,
    longest: int | None = None,
) -> DataFrame:
    """Points to half-open ``[start, end)`` intervals of the same key; ``how`` is inner or left.

    Intervals are cut into dyadic blocks of cells, so one of any length has at most ``2 * log2(length / width) + 4`` copies,
    and a point looks up the block around it on each level that occurs (which a small job asks of the
    intervals first: stage an expensive input). The join key is (keys, level, block), so a hot key is spread over its
    blocks. Where intervals span two cells at most there is one level, and points travel once. With more, only distinct
    (keys, at) look the blocks up, and points are joined to what they found. If the caller knows intervals to be no longer
    than ``longest``, at most twice ``width``, nothing is asked and cells are listed one by one (a longer one would
    be right, with more copies). NULL keys and positions match nothing;
    integer ids below 2**53 in magnitude. Column names must not clash outside ``keys``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    short = longest is not None and longest <= 2 * width
    levels = [0] if short else cover_levels(intervals, start, end, width)
    block = fresh("_block", points, intervals)
    by = [*keys, block]
    listed = intervals.withColumn(block, F.explode(_cells(start, end, width, short)))
    renamed = listed.withColumnsRenamed({k: f"_r_{k}" for k in by})
    cond = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    for k in by:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    gone = [block, *(f"_r_{k}" for k in by)]
    if len(levels) == 1:
        placed = points.withColumn(block, F.get(_ancestors(at, width, levels), 0))
        return placed.join(renamed, cond, how).drop(*gone)
    if how == "inner":
        return points.withColumn(block, F.explode(_ancestors(at, width, levels))).join(renamed, cond).drop(*gone)
    places = points.select(*keys, at).distinct().withColumn(block, F.explode(_ancestors(at, width, levels)))
    hits = places.join(renamed, cond).drop(*gone)
    return points.join(hits, [*keys, at], "left").select(*points.columns, *(c for c in intervals.columns if c not in keys))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    condition: Column | None = None,
    width: int = DEFAULT_CELL,
    longest: int | None = None,
) -> DataFrame:
    """Pairs of the same key whose half-open spans intersect, each pair once.

    Two intervals meet exactly if the left one holds the right one's start, or the right one holds the left one's and
    starts earlier. Both cases are a point in a dyadic cover, and one join does both: a row is listed at the
    blocks of its cover and, for the other case, at the blocks around its start. An interval of any length has a number of
    copies logarithmic in it. ``condition`` may use all columns; ``longest`` is that of :func:`range_join`, for both sides.
    """
    (ls, le), (rs, re) = left_span, right_span
    short = longest is not None and longest <= 2 * width
    block = fresh("_block", left, right)
    by = [*keys, block]

    def listed(df: DataFrame, span: tuple[str, str], levels: Sequence[int], covers: int) -> DataFrame:
        tag = lambda case: lambda b: F.struct(F.lit(case).alias("case"), b["level"].alias("level"), b["block"].alias("block"))
        places = F.concat(F.transform(_cells(*span, width, short), tag(covers)), F.transform(_ancestors(span[0], width, levels), tag(1 - covers)))
        return df.where(F.col(span[0]) < F.col(span[1])).withColumn(block, F.explode(places))

    a = listed(left, left_span, [0] if short else cover_levels(right, rs, re, width), 0)
    b = listed(right, right_span, [0] if short else cover_levels(left, ls, le, width), 1).withColumnsRenamed({k: f"_r_{k}" for k in by})
    holds_start = (F.col(ls) <= F.col(rs)) & (F.col(rs) < F.col(le))
    is_held = (F.col(rs) < F.col(ls)) & (F.col(ls) < F.col(re))
    cond = F.when(F.col(block)["case"] == 0, holds_start).otherwise(is_held)
    for k in by:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    if condition is not None:
        cond = cond & condition
    return a.join(b, cond).drop(block, *[f"_r_{k}" for k in by])


def word_join(
    left: DataFrame, words: DataFrame, text: str, word: str, key: str, how: str = "left"
) -> DataFrame:
    """Rows whose text holds ``word`` as a whole word (case-insensitive).

    The text is cut into words and equi-joined on the first word of ``word``, so
    neither side is broadcast; where ``word`` has several, the text is asked for
    all of them in a row.
    """
    pieces = lambda c: F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), "")
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    cut = left.select(key, F.explode(F.array_distinct(pieces(F.col(text)))).alias("_word"))
    names = words.withColumn("_parts", pieces(F.col(word))).withColumn("_word", F.get("_parts", 0))
    hits = cut.join(names, "_word").drop("_word")
    texts = left.select(key, spaced(pieces(F.col(text))).alias("_text"))
    several = hits.where(F.size("_parts") > 1).join(texts, key).where(F.contains("_text", spaced(F.col("_parts"))))
    hits = hits.where(F.size("_parts") == 1).unionByName(several.drop("_text")).drop("_parts")
    return left.join(hits, key, how)


def pattern_join(
    left: DataFrame,
    patterns: DataFrame,
    text: str,
    pattern: str,
    how: str = "left",
    max_patterns: int = 10_000,
) -> DataFrame:
    """Join on ``text`` matching the regular expression in ``pattern``.

    No equi key exists for a free pattern, so the pattern side is broadcast,
    in hash slices of at most about ``max_patterns`` rows each (its row count
    is measured first). ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    n_slices = -(-patterns.count() // max_patterns) or 1
    match = F.expr(f"`{text}` rlike `{pattern}`")
    if n_slices == 1:
        return left.join(F.broadcast(patterns), match, how)
    columns = left.columns
    left = stage(left.withColumn("_row", F.monotonically_increasing_id()), "pattern_left")
    slice_no = F.pmod(F.xxhash64(pattern), F.lit(n_slices))
    inner = None
    for i in range(n_slices):
        part = left.join(F.broadcast(patterns.where(slice_no == i)), match)
        inner = part if inner is None else inner.unionByName(part)
    if how == "inner":
        return inner.drop("_row")
    rest = left.join(inner.select("_row").distinct(), "_row", "left_anti").select(*columns)
    return inner.drop("_row").unionByName(rest, allowMissingColumns=True)


def _without(pattern: Column, *pieces: str) -> Column:
    """``pattern`` with every match of the expressions ``pieces`` replaced by a gap."""
    for piece in pieces:
        pattern = F.regexp_replace(pattern, F.lit(piece), F.lit(GAP))
    return pattern


#: Stands where a pattern's literal text is interrupted.
GAP = "\u0001"
_TIMES = r"(?:[?*+]|\{[^}]*\})*"


def required_literal(pattern: Column, least: int = 3) -> Column:
    """The longest run of plain characters that every match of a regular expression holds, NULL without one of ``least``.

    Whatever may be absent or vary (classes, groups, escapes, optional characters) counts as a gap; of a pattern with alternatives,
    flags, look-around, numeric escapes or nested classes nothing is taken for sure.
    """
    unsure = pattern.rlike(r"\||\(\?|\\[xucQEkN0-9]|\[[^\]]*\[|" + GAP)
    plain = _without(
        pattern, r"\[\^?\]?(?:\\.|[^\]\\])*\]" + _TIMES, r"\\[pP]\{[^}]*\}" + _TIMES, r"\\." + _TIMES,
        *[r"\([^()]*\)" + _TIMES] * 4)
    unsure = unsure | plain.rlike(r"[()\[\]\\]")
    plain = _without(plain, r".(?:[?*]|\{[^}]*\})[?+]?")
    plain = _without(F.regexp_replace(plain, r"(.)\+[?+]?", F.concat(F.lit("$1"), F.lit(GAP))), r"[.^$]")
    runs = F.transform(F.split(plain, GAP), lambda r: F.struct(F.length(r).alias("n"), r.alias("text")))
    longest = F.array_max(runs)
    return F.when(~unsure & (longest["n"] >= least), longest["text"])


#: Most bytes of a gram, and slots of the tables that tell which grams are wanted (a prime).
_GRAM, _SLOTS = 8, 16_777_213


def _grams(literal: Column) -> Column:
    """The distinct runs of eight bytes of a literal; a shorter one is a run itself."""
    whole = F.encode(literal, "utf-8")
    last = F.greatest(F.octet_length(literal) - _GRAM, F.lit(0)) + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(whole, i, F.lit(_GRAM))))


def _held(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """``h`` (hash of a text ``t``) and ``gram``, once each, for the texts that hold one of ``grams``; few others may be among them.

    Tasks read a text once, with two tables of one bit a slot: of the grams' first three bytes, and of all of them.
    """
    spark = texts.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    number = lambda of: F.conv(F.hex(of), 16, 10).cast("decimal(20,0)")
    slot = lambda which, at: F.struct(F.lit(which).alias("which"), at.cast("long").alias("slot"))
    slots = grams.select(F.explode(F.array(slot(0, number(F.substring("gram", 1, 3))), slot(1, number(F.col("gram")) % _SLOTS))).alias("s")).select("s.*")
    packed = slots.groupBy("which", F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    tables = np.zeros((2, (1 << 24) // 64), np.int64)
    tables[packed.column("which").to_numpy(), packed.column("at").to_numpy()] = packed.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(tables)
    sizes = sorted(r.n for r in grams.select(F.octet_length("gram").alias("n")).distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, wholes = shared.value
        is_set = lambda table, at: (table[at >> 6] >> (at & 63)) & 1 == 1
        for batch in batches:
            hashes, found = [], []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("t").to_pylist()):
                x = np.frombuffer(text, np.uint8).astype(np.int64)
                at = np.flatnonzero(is_set(heads, x[:-2] << 16 | x[1:-1] << 8 | x[2:])) if len(x) > 2 else x[:0]
                for size in sizes:
                    at = at[at + size <= len(x)]
                    v = np.zeros(len(at), np.uint64)
                    for i in range(size):
                        v = v << np.uint64(8) | x[at + i].astype(np.uint64)
                    some = at[is_set(wholes, (v % np.uint64(_SLOTS)).astype(np.int64))]
                    grams_here = {text[a:a + size] for a in some.tolist()}
                    found += grams_here
                    hashes += [h] * len(grams_here)
            if found:
                yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["h", "gram"])

    hashed = texts.select(F.xxhash64("t").alias("h"), F.col("t").cast("binary").alias("t"))
    return hashed.mapInArrow(run, "h long, gram binary").distinct()


def pattern_join_indexed(left: DataFrame, patterns: DataFrame, text: str, pattern: str, how: str = "left") -> DataFrame:
    """Join on ``text`` matching the regular expression in ``pattern``, without comparing every row with every pattern.

    Every match holds the pattern's longest required literal, hence all its grams of up to eight bytes. Hashes of texts and patterns are
    joined on the rarest of them (by how many texts hold it), and only those pairs are tried; a text travels once, not once a gram. Patterns without
    a literal of three characters go through :func:`pattern_join`. NULL texts and patterns match nothing; repeated rows of either side count as often as they occur.
    ``how`` is ``inner`` or ``left``. Column names must not clash.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    texts = left.select(F.col(text).alias("t")).where("t is not null")
    listed = stage(patterns.select(F.col(pattern).alias("p")).where("p is not null").distinct().withColumn("literal", required_literal(F.col("p"))), "patterns")
    wanted = listed.where("literal is not null").select("p", "literal", F.explode(_grams(F.col("literal"))).alias("gram"))
    held = stage(_held(texts, wanted.select("gram").distinct()), "grams")
    rarest = wanted.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram").groupBy("p", "literal").agg(
        F.min(F.struct("n", "gram")).alias("r"), F.count(F.lit(1)).alias("met"))
    # a literal with a gram that no text holds matches nothing
    whole = rarest.join(wanted.groupBy("p").agg(F.count(F.lit(1)).alias("met")), ["p", "met"]).select("p", "literal", F.col("r.gram").alias("gram"))
    tried = held.join(whole, "gram").select("h", "p", "literal")
    hits = texts.withColumn("h", F.xxhash64("t")).join(tried, "h").where(F.expr("contains(t, literal) and t rlike p")).select("t", "p")
    loose = listed.where("literal is null").select("p")
    if loose.limit(1).count():
        hits = hits.unionByName(pattern_join(texts, loose, "t", "p", "inner").select("t", "p"))
    t, p = fresh("_text", left, patterns), fresh("_pattern", left, patterns)
    found = hits.distinct().select(F.col("t").alias(t), F.col("p").alias(p)).join(patterns, F.col(p) == F.col(pattern)).drop(p)
    return left.join(found, F.col(text) == F.col(t), how).drop(t)
