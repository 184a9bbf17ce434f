"""Brown class-based bigram model of whole texts.

P(text) = product of P(class of word | class of the word before) * P(word | its class), with one end mark a text.

* Frequent words, those with a share of at least ``share`` of the training tokens, are found exactly: a part of the input reports words
  with a quarter of that share in the part, so the reports miss less than a quarter of any word, and the bigram counts settle which of the
  reported ones (at most 4 / 3 / share) have it. File splits play no part. All other words stand for one of 64 shape groups (length, last byte) at first.
* Exchange clustering assigns frequent words and groups to classes: in each round a Spark job counts every unit's neighbours by
  class, and half of the units move to the class that raises the likelihood most. The best assignment of all rounds stays.
* Then every other word that occurs ``least`` times in training is exchanged as well, on the counts of its neighbours' classes. Only words rarer
  than that keep their group's class. One shuffle deals the words of a batch of texts to buckets of bounded size, once a batch
  with their counts and neighbours, so a word has at most one entry a batch however often it occurs. A bucket counts its words, moves them, and answers
  each batch with their classes and counts; the batch's texts, kept packed, are then read as sequences of classes. No table of all words is
  ever broadcast or collected.
* Class transitions are counted again over these sequences, and each text is scored on them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import Numbers, byte_words, small_batches, texts_of
from courtside.session import discard, stage

GROUPS = 64
END = b"\n"  # no word holds a line break
ADD = 0.1
_HELD = 300_000
_PAIRS = 4_000_000
_CHUNK = 512


def held_out(id_column: Column, parts: int = 10) -> Column:
    """True for one part of ``parts``, by the CRC of the id as text; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % parts == 0


def group_of(word: bytes) -> int:
    return (word[-1] & 15) | min(len(word) >> 2, 3) << 4


class Units:
    """Numbers of the units: own words first, then the end mark, then the groups."""

    def __init__(self, own: list[bytes]) -> None:
        self.own = {w: i for i, w in enumerate(own)}
        self.n_own = len(own)
        self.size = self.n_own + 1 + GROUPS

    def of(self, words: list[bytes]) -> np.ndarray:
        """Unit of every word; the first one is the end mark."""
        get, first = self.own.get, self.n_own + 1
        return np.array([self.n_own, *(u if (u := get(w)) is not None else first + group_of(w) for w in words[1:])], np.int64)


def frequent_words(train: DataFrame, share: float = 1e-4) -> tuple[list[bytes], int]:
    """At most 4 / 3 / ``share`` words, among them all with a share of ``share`` of the tokens; and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report() -> pa.RecordBatch:
            n = seen.total()
            often = [(w, k) for w, k in seen.items() if 4 * k >= share * n]
            return pa.record_batch([pa.array([w for w, _ in often] + [None], pa.binary()), pa.array([k for _, k in often] + [n], pa.int64())], ["w", "n"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts_of(batch):
                seen.update(byte_words(text))
                if len(seen) > _HELD:
                    yield report()
                    seen.clear()
        yield report()

    sums = stage(train.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "frequent")
    total = sums.where("w is null").agg(F.sum("n")).first()[0] or 0
    rows = sums.where(F.col("w").isNotNull() & (4 * F.col("n") >= 3 * share * total)).collect() if total else []
    discard(sums)
    return sorted(bytes(r.w) for r in rows), total


def _local(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of all texts, the end mark first; every token as a number among them, texts ended; tokens a text."""
    of, flat, lengths = Numbers({END: 0}), [], []
    for text in texts:
        found = byte_words(text)
        flat.extend(map(of.__getitem__, found))
        flat.append(0)
        lengths.append(len(found) + 1)
    return list(of), np.array(flat, np.int64), np.array(lengths, np.int64)


def bigrams(train: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a, texts beginning after an end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(code // units.size), pa.array(code % units.size), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        held, n = [], 0
        for batch in batches:
            words, ids, _ = _local(texts_of(batch))
            u = units.of(words)[ids]
            if len(u):
                held.append(np.concatenate([[units.n_own], u[:-1]]) * units.size + u)
                n += len(u)
            if n > _PAIRS:
                yield report()
                held, n = [], 0
        if n:
            yield report()

    return train.select("text").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def settled(pairs: DataFrame, reported: list[bytes], least: float) -> tuple[DataFrame, Units]:
    """``pairs`` over the units of ``reported`` words, reduced to the words that really occur ``least`` times; the others join their groups."""
    units = Units(reported)
    counts = np.zeros(units.size)
    for r in pairs.groupBy("b").agg(F.sum("n").alias("n")).collect():
        counts[r.b] = r.n
    kept = [i for i in range(units.n_own) if counts[i] >= least]
    fewer = Units([reported[i] for i in kept])
    to = [fewer.n_own + 1 + group_of(w) for w in reported] + list(range(fewer.n_own, fewer.size))
    for at, i in enumerate(kept):
        to[i] = at
    table = pairs.sparkSession.createDataFrame(list(enumerate(to)), "u long, t long")
    named = lambda side: F.broadcast(table.select(F.col("u").alias(side), F.col("t").alias(f"t{side}")))
    return pairs.join(named("a"), "a").join(named("b"), "b").groupBy(F.col("ta").alias("a"), F.col("tb").alias("b")).agg(F.sum("n").alias("n")), fewer


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def targets(before: np.ndarray, after: np.ndarray, own: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class, of all but the last, that each word's move raises the likelihood of the class bigrams ``m`` for most.

    ``before`` and ``after`` count a word's neighbours by class, ``own`` is the class in which ``m`` counts it.
    """
    rows, cols, best = m.sum(axis=1), m.sum(axis=0), np.empty(len(own), np.int64)
    x, x_rows, x_cols = _xlogx(m), _xlogx(rows), _xlogx(cols)
    for at in range(0, len(own), _CHUNK):
        a, b, o = after[at:at + _CHUNK], before[at:at + _CHUNK], own[at:at + _CHUNK]
        out_n, in_n, each = a.sum(axis=1), b.sum(axis=1), np.arange(len(o))
        value = ((_xlogx(m[None] + a[:, None, :]) - x).sum(axis=2) + (_xlogx(m[None] + b[:, :, None]) - x).sum(axis=1)
                 - (_xlogx(rows + out_n[:, None]) - x_rows) - (_xlogx(cols + in_n[:, None]) - x_cols))
        left = lambda counts, gone: _xlogx(np.maximum(counts - gone, 0))
        value[each, o] = ((x[o] - left(m[o], a)).sum(axis=1) + (x.T[o] - left(m.T[o], b)).sum(axis=1)
                          - (x_rows[o] - left(rows[o], out_n)) - (x_cols[o] - left(cols[o], in_n)))
        best[at:at + _CHUNK] = value[:, :-1].argmax(axis=1)
    return best


def neighbours(pairs: DataFrame, of: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For every unit, how often each class stands before it and after it: one Spark job over the bigrams.

    Both results have (units x classes) cells, bounded by the bound on units.
    """
    spark = pairs.sparkSession
    table = spark.createDataFrame([(int(u), int(c)) for u, c in enumerate(of)], "u long, c int")
    left = pairs.join(F.broadcast(table), F.col("a") == F.col("u")).groupBy(F.col("b").alias("unit"), "c").agg(F.sum("n").alias("n")).withColumn("side", F.lit(0))
    right = pairs.join(F.broadcast(table), F.col("b") == F.col("u")).groupBy(F.col("a").alias("unit"), "c").agg(F.sum("n").alias("n")).withColumn("side", F.lit(1))
    got = left.union(right).toArrow()
    out = np.zeros((2, len(of), n_classes))
    out[got.column("side").to_numpy(), got.column("unit").to_numpy(), got.column("c").to_numpy()] = got.column("n").to_numpy()
    return out[0], out[1]


def exchange(pairs: DataFrame, units: Units, n_classes: int = 32, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every unit, the class bigram matrix and the units' counts. The end mark has a class of its own, the last."""
    of = np.arange(units.size) % n_classes
    of[units.n_own] = n_classes
    best, kept, total = -math.inf, None, n_classes + 1
    for r in range(rounds + 1):
        before, after = neighbours(pairs, of, total)
        m = np.zeros((total, total))
        np.add.at(m.T, of, before)
        count = before.sum(axis=1)
        gain = _xlogx(m).sum() - _xlogx(m.sum(axis=1)).sum() - _xlogx(m.sum(axis=0)).sum()
        if gain > best:
            best, kept = gain, (of.copy(), m, count)
        if r == rounds:
            break
        move = np.arange(r % 2, units.size, 2)
        move = move[(move != units.n_own) & (count[move] > 0)]
        of = of.copy()
        of[move] = targets(before[move], after[move], of[move], m)
    return kept


class Dealt:
    """The words of a batch of texts: what is known of them at once, and which bucket knows the rest.

    Rarer words are told apart by 58 bits of a hash and their group. They are in the order of their buckets.
    """

    def __init__(self, texts: list[str], units: Units, of: np.ndarray, buckets: int):
        words, self.ids, self.lengths = _local(texts)
        self.unit = units.of(words)
        self.classes = of[self.unit]
        rare = np.flatnonzero(self.unit > units.n_own)
        digest = xxhash.xxh64_intdigest
        keys = np.fromiter((digest(words[i]) for i in rare.tolist()), np.uint64, len(rare)) & np.uint64(~(GROUPS - 1) & 0xFFFFFFFFFFFFFFFF)
        keys |= (self.unit[rare] - units.n_own - 1).astype(np.uint64)
        bucket = ((keys >> np.uint64(6)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.rare, self.keys, self.bucket = rare[order], keys[order], bucket[order]

    def packs(self, train: np.ndarray, end: int) -> list[tuple]:
        """Per bucket: keys, their counts in the texts that ``train`` marks, and the classes before and after each such occurrence."""
        place = np.full(len(self.unit), -1)
        place[self.rare] = np.arange(len(self.rare))
        seq = self.classes[self.ids].astype(np.uint8)
        before, after = np.concatenate([[end], seq[:-1]]).astype(np.uint8), np.append(seq[1:], np.uint8(end))
        at = np.flatnonzero((place[self.ids] >= 0) & np.repeat(train, self.lengths))
        word = place[self.ids[at]]
        order = np.argsort(word, kind="stable")
        at, n = at[order], np.bincount(word, minlength=len(self.rare)).astype("<u4")
        edges = [0, *(np.flatnonzero(np.diff(self.bucket)) + 1).tolist(), len(self.bucket)] if len(self.bucket) else [0]
        through = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return [(int(self.bucket[a]), self.keys[a:b].tobytes(), n[a:b].tobytes(), before[(s := at[through[a]:through[b]])].tobytes(), after[s].tobytes())
                for a, b in zip(edges, edges[1:])]


def _pack_texts(texts: list[str]) -> bytes:
    each = [t.encode() for t in texts]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(each), *map(len, each)], "<i8").tobytes() + b"".join(each))


def _unpack_texts(data: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<i8", n, 8)) + 8 * (n + 1)
    return [raw[a:b].decode() for a, b in zip([8 * (n + 1), *ends.tolist()], ends.tolist())]


_BATCH = "batch long, doc_id array<string>, held array<boolean>, texts binary"
_PACK = "bucket int, keys binary, counts binary, before binary, after binary"
_ANSWER = "batch long, bucket int, classes binary, counts binary, n_words array<long>, n_tokens array<long>"
_READ = "doc_id string, held boolean, n_tokens long, n_known long, logs double, classes binary, place int, moved long, words long, tokens long"


def _bucket_of(of: np.ndarray, units: Units, m: np.ndarray, least: int):
    """What a bucket does: count its words, move those that occur ``least`` times, answer every batch."""
    total = len(m)
    home_of = of[units.n_own + 1:]

    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
        packs = read("keys", "<u8")
        distinct, place = np.unique(np.concatenate(packs), return_inverse=True)
        n = np.concatenate(read("counts", "<u4")).astype(np.int64)
        count = np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)
        classes = home_of[(distinct & np.uint64(GROUPS - 1)).astype(np.int64)].astype(np.int64)
        often = np.flatnonzero(count >= least)
        number = np.full(len(distinct), -1)
        number[often] = np.arange(len(often))
        edges = np.cumsum([len(p) for p in packs])[:-1]
        per_pack = np.split(place, edges)
        if len(often):
            beside = np.zeros((2, len(often) * total))
            for words, times, *sides in zip(per_pack, np.split(n, edges), read("before", np.uint8), read("after", np.uint8)):
                word = number[np.repeat(words, times)]
                use = word >= 0
                for side, seen in enumerate(sides):
                    cell, k = np.unique(word[use] * total + seen[use], return_counts=True)
                    beside[side, cell] += k
            before, after = beside.reshape(2, len(often), total)
            classes[often] = targets(before, after, classes[often], m)
        known = count > 0
        of_all = [np.bincount(classes[known], minlength=total).tolist(), np.bincount(classes, weights=count, minlength=total).astype(np.int64).tolist()]
        rest = [None] * (len(packs) - 1)
        return pa.table([
            table.column("batch"), table.column("bucket"), pa.array([classes[p].astype(np.uint8).tobytes() for p in per_pack], pa.binary()),
            pa.array([count[p].astype("<i8").tobytes() for p in per_pack], pa.binary()),
            pa.array([of_all[0], *rest], pa.list_(pa.int64())), pa.array([of_all[1], *rest], pa.list_(pa.int64()))],
            ["batch", "bucket", "classes", "counts", "n_words", "n_tokens"])

    return run


def _reader_of(of: np.ndarray, units: Units, unit_counts: np.ndarray, n_classes: int, buckets: int):
    """What a batch does with its answers: read its texts as classes, and count transitions."""
    total = n_classes + 1
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        row = batch.to_pylist()[0]
        held = np.array(row["held"], bool)
        dealt = Dealt(_unpack_texts(row["texts"]), units, of, buckets)
        count = unit_counts[dealt.unit].astype(float)
        answers = answers.sort_by("bucket")
        told = lambda name, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(b, kind) for b in answers.column(name).to_pylist())])
        dealt.classes[dealt.rare], count[dealt.rare] = told("classes", np.uint8), told("counts", "<i8")
        starts = np.cumsum(dealt.lengths) - dealt.lengths
        seq = dealt.classes[dealt.ids]
        logs = np.add.reduceat(np.log10(count + ADD)[dealt.ids], starts)
        known = np.add.reduceat((count > 0)[dealt.ids].astype(np.int64), starts)
        code = np.concatenate([[n_classes], seq[:-1]]) * total + seq
        moved = np.bincount(code[np.repeat(~held, dealt.lengths)], minlength=total * total)
        data = seq.astype(np.uint8).tobytes()
        spelled = [data[a:a + n] for a, n in zip(starts.tolist(), dealt.lengths.tolist())]
        docs = pa.table([pa.array(v, k) for v, k in zip(
            [row["doc_id"], held, dealt.lengths, known, logs, spelled, *[[None] * len(held)] * 4], kinds)], names)
        sums = np.zeros((2, total * total), np.int64)
        for words, tokens in zip(answers.column("n_words").to_pylist(), answers.column("n_tokens").to_pylist()):
            if words is not None:
                sums[0, :total] += words
                sums[1, :total] += tokens
        used = np.flatnonzero(moved + sums.sum(axis=0))
        facts = pa.table([pa.array(v, k) for v, k in zip([*[[None] * len(used)] * 6, used, moved[used], sums[0, used], sums[1, used]], kinds)], names)
        return pa.concat_tables([docs, facts])

    return run


def score(docs: DataFrame, n_classes: int = 32, rounds: int = 6, share: float = 1e-4, least: int = 3, bucket_words: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, both in log10.

    NULL and empty texts consist of the end mark. NULL ids and repeated rows are scored like any other row, and count
    for training as often as they occur. With nothing to learn from, every word is as likely as an unknown one. At most 255 classes.
    """
    small_batches(docs.sparkSession)
    own_id = dict(docs.dtypes)["doc_id"]
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    train = source.where(~F.col("held"))
    reported, n_words = frequent_words(train, share)
    wide = stage(bigrams(train, Units(reported)), "bigrams")
    pairs, units = settled(wide, reported, share * n_words)
    pairs = stage(pairs, "bigrams")
    discard(wide)
    of, m, count = exchange(pairs, units, n_classes, rounds)
    unit_counts = count.copy()
    unit_counts[units.n_own + 1:] = 0
    buckets, total = max(1, math.ceil(n_words / bucket_words)), n_classes + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, held = texts_of(batch), batch.column("held").to_numpy(zero_copy_only=False)
            packs = Dealt(texts, units, of, buckets).packs(~held.astype(bool), n_classes)
            k = len(packs)
            late = lambda i, kind: pa.array([None, *(p[i] for p in packs)], kind)
            yield pa.record_batch([
                pa.array(np.full(k + 1, batch.column("row")[0].as_py())), pa.array([batch.column("doc_id").to_pylist()] + [None] * k, pa.list_(pa.string())),
                pa.array([held.tolist()] + [None] * k, pa.list_(pa.bool_())), pa.array([_pack_texts(texts)] + [None] * k, pa.binary()),
                late(0, pa.int32()), late(1, pa.binary()), late(2, pa.binary()), late(3, pa.binary()), late(4, pa.binary())],
                ["batch", "doc_id", "held", "texts", "bucket", "keys", "counts", "before", "after"])

    dealt = stage(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(deal, f"{_BATCH}, {_PACK}"), "dealt")
    packs = dealt.where("bucket is not null").select("batch", "bucket", "keys", "counts", "before", "after")
    answers = packs.groupBy("bucket").applyInArrow(_bucket_of(of, units, m, least), _ANSWER)
    texts = dealt.where("bucket is null").select("batch", "doc_id", "held", "texts")
    read = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_reader_of(of, units, unit_counts, n_classes, buckets), _READ)
    read = stage(read, "read")
    discard(dealt, pairs)
    moved, v_class, in_class = np.zeros(total * total), np.zeros(total), np.zeros(total)
    for r in read.where("place is not null").groupBy("place").agg(*(F.sum(c).alias(c) for c in ("moved", "words", "tokens"))).collect():
        moved[r.place] = r.moved
        if r.place < total:
            v_class[r.place], in_class[r.place] = r.words, r.tokens
    moved = moved.reshape(total, total)
    np.add.at(v_class, of[:units.n_own + 1], unit_counts[:units.n_own + 1] > 0)
    np.add.at(in_class, of[:units.n_own + 1], unit_counts[:units.n_own + 1])
    v, n = int(v_class.sum()), int(in_class.sum())
    step = np.log10((moved + 0.5) / (moved.sum(axis=1, keepdims=True) + 0.5 * total)) - np.log10(in_class + ADD * (v_class + 1))[None, :]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for classes in batch.column("classes"):
                seq = np.frombuffer(classes.as_buffer(), np.uint8)
                scores.append(float(step[np.concatenate([[n_classes], seq[:-1]]), seq].sum()))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "held", "n_tokens", "n_known", "logs")), pa.array(scores, pa.float64())], ["doc_id", "held", "n_tokens", "n_known", "logs", "steps"])

    scored = read.where("place is null").select("doc_id", "held", "n_tokens", "n_known", "logs", "classes").mapInArrow(
        judge, "doc_id string, held boolean, n_tokens long, n_known long, logs double, steps double")
    return scored.select(
        F.col("doc_id").cast(own_id).alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(n + ADD * (v + 1))).alias("base_score"), (F.col("logs") + F.col("steps")).alias("score"))
