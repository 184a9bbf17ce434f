"""Lines that many documents share, dropped everywhere: a sharded minimal perfect hash over line hashes.

Counting: every task reduces its documents' distinct lines to 128-bit hashes with a count, Spark sums them, and hashes that reach
the threshold are kept (a line below it can drop nothing). Index: hashes are dealt to shards; in each one a minimal perfect hash numbers
them from 0 without gaps, and two arrays hold, at that number, a 64-bit fingerprint and the count. Probing: documents never meet
lines in a join. A task asks the shards' arrays, and the fingerprint rejects lines that the index does not hold.

Shards are broadcast in groups of at most ``group_bytes``. Where all fit, documents pass once; beyond that the documents pass once per
group and are staged in between, so that no task or driver ever holds more than one group. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.common import LOWER_TABLE, small_batches, texts_of
from courtside.session import stage

BLANK = b" \t\n\x0b\x0c\r"
#: A task's table of counts is sent on when it holds so many hashes.
TABLE = 1 << 19
#: Hashes a shard is meant to hold.
SHARD = 1 << 16
GROUP_BYTES = 64 << 20


def key_of(line: bytes) -> bytes:
    """What is compared of a line: blanks off both ends, A-Z lower-cased."""
    return line.strip(BLANK).translate(LOWER_TABLE)


def key_words(digests: Iterable[bytes]) -> np.ndarray:
    """Digests as two unsigned 64-bit words a row."""
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes of line keys."""
    return key_words(map(xxhash.xxh3_128_digest, keys))


def _place(hashes: np.ndarray, level: int, slots: int) -> np.ndarray:
    """Slot of every hash on a level: a multiply-shift mix of both words."""
    with np.errstate(over="ignore"):
        h = (hashes[:, 0] ^ np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31)) ^ hashes[:, 1]) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(slots)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash by cascaded bit tables: a hash that is alone in its slot of a level owns the slot,
    all others go on to the next level. Its number is the rank of its slot's bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(bits).astype(np.int64) for bits in levels]
        self.before = [np.concatenate([[0], np.cumsum(c)[:-1]]) for c in counts]
        self.start = np.concatenate([[0], np.cumsum([c.sum() for c in counts])]).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """``hashes`` are different from each other."""
        levels, left = [], hashes
        while len(left):
            words = -(-len(left) * 3 // 2 // 64)
            at = _place(left, len(levels), words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64)
            levels.append(bits)
            left = left[~alone[at]]
        return cls(levels)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of every hash; -1, or any number, for one that is not held."""
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = _place(hashes[open_], level, len(bits) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            own = (bits[word] >> bit) & np.uint64(1) == 1
            lower = bits[word[own]] & ((np.uint64(1) << bit[own]) - np.uint64(1))
            out[open_[own]] = self.start[level] + self.before[level][word[own]] + np.bitwise_count(lower)
            open_ = open_[~own]
        return out

    def to_bytes(self) -> bytes:
        return b"".join(np.uint64(len(bits)).tobytes() + bits.tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels, at, words = [], 0, np.frombuffer(data, np.uint64)
        while at < len(words):
            n = int(words[at])
            levels.append(words[at + 1:at + 1 + n])
            at += n + 1
        return cls(levels)


class Shard:
    """A perfect hash with its fingerprint and count arrays."""

    def __init__(self, index: bytes, prints: bytes, counts: bytes):
        self.index = PerfectHash.from_bytes(index)
        self.prints, self.counts = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64)

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Documents that hold each line; 0 for a line the shard does not hold."""
        at = self.index.numbers(hashes)
        held = at >= 0
        held[held] = self.prints[at[held]] == hashes[held, 1]
        out = np.zeros(len(hashes), np.int64)
        out[held] = self.counts[at[held]]
        return out


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``hi``, ``lo``, ``n``: the hash of every line key of one code point or more and how many rows of ``docs`` hold it."""
    small_batches(docs.sparkSession)

    def sent(table: dict[bytes, int]) -> pa.RecordBatch:
        words = key_words(table).view(np.int64)
        return pa.record_batch([pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(list(table.values()), pa.int64())], ["hi", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, int] = {}
        for batch in batches:
            for t in texts_of(batch):
                keys = set(map(key_of, t.encode().split(b"\n")))
                keys.discard(b"")
                for h in map(xxhash.xxh3_128_digest, keys):
                    table[h] = table.get(h, 0) + 1
                if len(table) >= TABLE:
                    yield sent(table)
                    table = {}
        if table:
            yield sent(table)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def build_shards(counted: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """``shard``, ``shards`` (how many), ``index``, ``prints``, ``counts``: one row per shard of ``counted``."""
    small_batches(counted.sparkSession)
    shards = max(1, -(-counted.count() // per_shard))

    def build(table: pa.Table) -> pa.Table:
        hashes = np.stack([table.column(c).to_numpy() for c in ("hi", "lo")], axis=1).view(np.uint64)
        index = PerfectHash.build(hashes)
        at = index.numbers(hashes)
        prints, counts = np.empty(len(at), np.uint64), np.empty(len(at), np.int64)
        prints[at], counts[at] = hashes[:, 1], table.column("n").to_numpy()
        return pa.table({"shard": table.column("shard").slice(0, 1), "shards": pa.array([shards], pa.int32()), "index": pa.array([index.to_bytes()], pa.binary()),
                         "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    dealt = counted.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, shards int, index binary, prints binary, counts binary")


def groups_of(shards: DataFrame, group_bytes: int = GROUP_BYTES) -> list[tuple[int, int]]:
    """Ranges of shard numbers whose arrays have at most ``group_bytes`` together (a single shard always fits one)."""
    sizes = shards.agg(F.max(F.octet_length("index") + F.octet_length("prints") + F.octet_length("counts")).alias("most"), F.max("shards").alias("n")).first()
    if sizes.n is None:
        return []
    step = max(1, group_bytes // sizes.most)
    return [(lo, min(lo + step, sizes.n)) for lo in range(0, sizes.n, step)]


def without_common_lines(docs: DataFrame, shards: DataFrame, span: tuple[int, int], threshold: int) -> DataFrame:
    """``docs`` (``_text``, ``_n_dropped`` and any others) without the lines that the shards of ``span`` count ``threshold`` times or more."""
    spark = docs.sparkSession
    rows = shards.where(F.col("shard").between(span[0], span[1] - 1)).toArrow().to_pylist()
    total = rows[0]["shards"] if rows else 1
    held = spark.sparkContext.broadcast({r["shard"]: (r["index"], r["prints"], r["counts"]) for r in rows})
    columns = docs.columns
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {k: Shard(*v) for k, v in held.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = [t.encode().split(b"\n") for t in texts_of(batch, "_text")]
            numbers: dict[bytes, int] = {}
            places = [[numbers.setdefault(key_of(line), len(numbers)) for line in of] for of in lines]
            hashes = key_hashes(list(numbers))
            shard = hashes[:, 0].view(np.int64) % total
            common = np.zeros(len(hashes), bool)
            for k in np.unique(shard):
                if int(k) in arrays:
                    mine = np.flatnonzero(shard == k)
                    common[mine] = arrays[int(k)].count(hashes[mine]) >= threshold
            if b"" in numbers:
                common[numbers[b""]] = False
            gone = common.tolist()
            texts, dropped = [], []
            for of, at in zip(lines, places):
                kept = [line for line, i in zip(of, at) if not gone[i]]
                texts.append(b"\n".join(kept).decode() if kept else None)
                dropped.append(len(of) - len(kept))
            before = batch.column("_n_dropped").to_numpy()
            # a text that has lost all its lines is marked by NULL, and loses no more
            was_gone = np.array([t is None for t in batch.column("_text").to_pylist()])
            now = {"_text": pa.array([None if g else t for g, t in zip(was_gone, texts)], pa.string()),
                   "_n_dropped": pa.array(before + np.where(was_gone, 0, dropped), pa.int64())}
            yield pa.record_batch([now[c] if c in now else batch.column(c) for c in columns], columns)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def dedup_lines(docs: DataFrame, text: str = "text", threshold: int = 10, per_shard: int = SHARD, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and ``_n_lines`` (before) and ``_n_dropped``.

    A NULL or empty text is one empty line, and comes back as it would: empty. Every row counts as a document, also where ids or
    whole rows repeat. Lines without a key (blank ones) always stay. Other columns are passed through; a column named like one of
    the two added ones is an error. An empty table gives no rows.
    """
    if clash := {"_n_lines", "_n_dropped", "_text"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    full = F.coalesce(F.col(text), F.lit(""))
    common = stage(line_counts(docs, text).where(F.col("n") >= threshold), "line_counts")
    shards = stage(build_shards(common, per_shard), "line_shards")
    rest = docs.withColumns({"_n_lines": (F.length(full) - F.length(F.replace(full, F.lit("\n"))) + 1).cast("long"),
                             "_n_dropped": F.lit(0).cast("long"), "_text": full}).drop(text)
    spans = groups_of(shards, group_bytes)
    for at, span in enumerate(spans):
        rest = without_common_lines(rest, shards, span, threshold)
        if at < len(spans) - 1:
            rest = stage(rest, "lines_left")
    kept = F.coalesce("_text", F.lit(""))
    return rest.select(*(kept.alias(c) if c == text else c for c in docs.columns), "_n_lines", "_n_dropped")
