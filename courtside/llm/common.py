"""Helpers the text operators share: words, batches of texts, staged tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder that holds the package; executors that have it elsewhere need it on their path (``--py-files``).
ROOT = str(Path(__file__).resolve().parents[2])
#: A word is a run of anything but the space and the ASCII controls 9 to 13.
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words(text: Column) -> Column:
    """Array of the words of ``text``; NULL counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def byte_words(text: str | None) -> list[bytes]:
    """The words of ``text`` as UTF-8, A-Z lower-cased (``bytes.split`` cuts at the same six bytes)."""
    return (text or "").encode().translate(LOWER_TABLE).split()


class Numbers(dict):
    """Numbers words by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, since a text may be very long (a setting of the user's own stays), and let workers find this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    for key, value, default in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000", "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "16m", None),
    ):
        if spark.conf.get(key, default) in (default, None):
            spark.conf.set(key, value)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes not to be one of ``taken`` (Spark ignores case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def table_bits(expected: int, fewest: int = 16, most: int = 27) -> int:
    """Size of a bit table, as a power of two, for so many slots, between two bounds."""
    return min(most, max(fewest, int(expected).bit_length()))


def bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits booleans, true at the numbers in column ``slot``: at most 2**bits / 64 rows reach the driver."""
    word = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    words = np.zeros(max(1, (1 << bits) // 64), np.int64)
    words[word.column("at").to_numpy()] = word.column("bits").to_numpy()
    return words


def is_set(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 6] >> (slots & 63)) & 1 == 1
