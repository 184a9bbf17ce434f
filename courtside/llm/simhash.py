"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified distances.

A fingerprint is cut into four blocks of 16 bits. Two fingerprints that differ in at
most two bits agree in at least two whole blocks, so each of the six pairs of blocks is a join
key; candidates that share a key are verified by their exact distance.

Keys held by many different fingerprints are not joined, since that would emit all
pairs of a group. Their fingerprints are linked through hubs instead: two fingerprints
differ in at most two bits exactly if some fingerprint is at most one bit away from
both, so each emits itself and its 64 one-bit neighbours and those meeting at a hub are
tied to the smallest of them. A hub has at most 65 members, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import byte_words, map_batches, texts_of
from courtside.llm.components import components
from courtside.session import stage

SEED = 42
#: Keys with more different fingerprints than this are linked through hubs.
JOINED_AT_MOST = 64
_CHUNK = 65_536


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without one."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at:at + _CHUNK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without a word."""
    found = byte_words(text)
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    digest, total, ones = xxhash.xxh64_intdigest, len(found) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = found[at:min(at + _CHUNK, total) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        hashes = np.fromiter((digest(g, SEED) for g in grams), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: str) -> DataFrame:
    """``id_column``, ``f`` (fingerprint as a signed long) and the columns ``more`` of every row."""
    picked = docs.select(id_column, F.col(text_column).alias("text"), *more)
    kept = [c for c in picked.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.record_batch([*(batch.column(c) for c in kept), pa.array(f)], [*kept, "f"])

    types = dict(picked.dtypes)
    return map_batches(picked, run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", f long")


def links(prints: DataFrame, joined_at_most: int = JOINED_AT_MOST) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect all those at 2 or fewer differing bits.

    ``prints`` has distinct non-NULL longs ``f``.
    """
    blocks = [F.shiftrightunsigned("f", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*(
        F.lit(n) * F.lit(1 << 32) + blocks[i] * F.lit(1 << 16) + blocks[j] for n, (i, j) in enumerate(combinations(range(4), 2))))
    keyed = stage(prints.select("f", F.explode(keys).alias("key")), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    few = shared.where(F.col("n") <= joined_at_most).select("key", "f")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = (few.withColumnRenamed("f", "a").join(few.withColumnRenamed("f", "b"), "key")
             .where((F.col("a") < F.col("b")) & close).select("a", "b"))
    many = shared.where(F.col("n") > joined_at_most).select("f").distinct()
    one_off = [F.col("f").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)]
    at_hub = many.select("f", F.explode(F.array("f", *one_off)).alias("hub"))
    members = at_hub.groupBy("hub").agg(F.min("f").alias("a"), F.collect_set("f").alias("all")).where(F.size("all") > 1)
    return pairs.union(members.select("a", F.explode("all").alias("b")).where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    joined_at_most: int = JOINED_AT_MOST) -> DataFrame:
    """One row per row of ``docs``: the id, ``f`` and ``component_id``, the smallest id reachable over links.

    NULL and empty texts have fingerprint 0 and link like any other. Rows with a NULL id are
    linked and returned; a component of such rows only has a NULL component_id. Repeated rows are returned as
    often as they occur. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    table = stage(fingerprints(docs, id_column, text_column), "fingerprints")
    return with_components(table, id_column, joined_at_most)


def with_components(table: DataFrame, id_column: str, joined_at_most: int = JOINED_AT_MOST, edges: DataFrame | None = None) -> DataFrame:
    """``table`` with ``component_id``; ``edges`` (a, b) between values of ``f`` take the place of :func:`links`."""
    prints = stage(table.groupBy("f").agg(F.min(id_column).alias("first_id")), "prints")
    roots = components(links(prints.select("f"), joined_at_most) if edges is None else edges).withColumnRenamed("node", "f")
    placed = prints.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = placed.select("f", "root").join(lowest, "root").select("f", "component_id")
    return table.join(of, "f")
