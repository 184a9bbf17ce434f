"""Collocations: phrases counted in depth-truncated suffix subtrees, built group by group of word prefixes.

The text is cut vertically: every position belongs to the prefix of words that starts there, and prefixes are dealt to groups by a
budget of positions. A prefix is one word, or two or three where a shorter one alone would fill a large part of
a group (a *crowded* prefix). A group's positions travel to one partition as suffixes of at most five words, are sorted there
by Spark (which spills), and read in order: that is the subtree in depth-first order, so the leaves below
a node are neighbours and their totals are the counts of the node's phrase. A partition is read in batches and holds one batch at a time;
nodes cut by a batch's edge, and nodes above a crowded prefix, are added up afterwards.

Before that, prefixes of one word (exactly), two and three words (by slots of tables of bounded size) that occur too rarely are cut off, since no longer phrase
can occur more often than its parts. More prefixes than slots only make that filter weaker, never wrong.
Words are 64-bit hashes until the end. The first pass checks that no two words share one, and takes another seed if they do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import LOWER_TABLE, Numbers, bit_table, is_set, small_batches, table_bits
from courtside.session import stage

DEPTH = 5
#: Positions a group is meant to hold.
BUDGET = 1 << 20
#: A prefix is crowded if it has more than this share of all positions, so at most 1,024 of one length are.
CROWDED = 1 / 1024
#: A task's table of words is sent on when it holds so many.
TABLE = 400_000
#: A task sorts and counts its suffixes when it holds so many, and sends them on if half as many are different.
SUFFIXES = 1 << 20
#: Words a task that sums suffixes is meant to read at most.
READ = 1 << 26

_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_LOWER_AND_ENDS = bytes(_ENDS[c] for c in LOWER_TABLE)


def pieces(text: str) -> list[list[bytes]]:
    """The words of every piece of a text, A-Z lower-cased (a piece has no white space but spaces once tabs are)."""
    return [p.split() for p in text.encode().translate(_LOWER_AND_ENDS).split(b"\n")]


def word_ids(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """64-bit ids of words of one language, never 0 (which stands for the end of a piece)."""
    key = xxhash.xxh64_intdigest(lang, seed)
    ids = np.fromiter((xxhash.xxh64_intdigest(w, key) for w in words), np.uint64, len(words))
    return np.maximum(ids, np.uint64(1))


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (ids >> np.uint64(64 - bits)).astype(np.int64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for pairs of words or prefixes."""
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _tokens(batch: pa.RecordBatch, seed: int) -> np.ndarray:
    """The ids of all words of a batch in order, with a 0 after every piece."""
    vocabulary: dict[str, Numbers] = {}
    flat: list[int] = []
    blocks = []
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        of = vocabulary.setdefault(lang, Numbers({b"": 0}))
        start = len(flat)
        for piece in pieces(text):
            flat.extend(map(of.__getitem__, piece))
            flat.append(0)
        blocks.append((lang, start, len(flat)))
    local = np.array(flat, np.int64)
    ids = {lang: np.append(np.zeros(1, np.uint64), word_ids(lang, list(of)[1:], seed)) for lang, of in vocabulary.items()}
    out = np.empty(len(local), np.uint64)
    for lang, a, b in blocks:
        out[a:b] = ids[lang][local[a:b]]
    return out


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def word_counts(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """``id``, ``lang``, ``word``, ``n`` and ``kinds`` as :func:`merged` says; ``word`` is NULL for a language's total."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[bytes, int]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for of, table in tables.items():
                ids = np.append(word_ids(of, [b""], seed), word_ids(of, list(table), seed)).view(np.int64)
                yield pa.record_batch([pa.array(ids), pa.array([of] * len(ids)), pa.array([None, *(w.decode() for w in table)], pa.string()),
                                       pa.array([sum(table.values()), *table.values()], pa.int64())], ["id", "lang", "word", "n"])

        held = 0
        for batch in batches:
            for of, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                table = tables.setdefault(of, {})
                held -= len(table)
                for piece in pieces(body):
                    for word in piece:
                        table[word] = table.get(word, 0) + 1
                held += len(table)
                if held >= TABLE:
                    yield from sent()
                    tables.clear()
                    held = 0
        yield from sent()

    return merged(texts.mapInArrow(run, "id long, lang string, word string, n long"), least)


def merged(rows: DataFrame, least: int) -> DataFrame:
    """Counts per id of those that occur ``least`` times, and of totals.

    ``kinds`` is how many different words have the id; rows with more than one are kept whatever their count. One exchange serves both steps.
    """
    each = rows.repartition("id").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
    one = each.groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
    return one.where((F.col("n") >= least) | F.col("word").isNull() | (F.col("kinds") > 1))


def _pairs(ids: np.ndarray, words: np.ndarray, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose word and the next one in the piece both may be frequent, and the hashes of these pairs."""
    may = (ids != 0) & is_set(words, _slots(ids, word_bits))
    at = np.flatnonzero(may[:-1] & may[1:])
    return at, _mixed(ids[at], ids[at + 1])


def suffix_nodes(rows: DataFrame, least: int) -> DataFrame:
    """Counts of the phrases in sorted suffixes (``s``: ids of 8 bytes; ``n``; ``own``: words of its group's prefix), in parts.

    A node whose leaves all lie inside one batch, below its group's prefix, is complete and goes if it has fewer than ``least``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, length = _matrix(batch.column("s"))
            n, own = batch.column("n").to_numpy(), batch.column("own").to_numpy()
            new = np.zeros(len(m), bool)
            new[0] = True
            new[1:] = m[1:, 0] != m[:-1, 0]
            keys, counts = [], []
            for d in range(2, DEPTH + 1):
                new[1:] |= m[1:, d - 1] != m[:-1, d - 1]
                start = np.flatnonzero(new)
                total = np.add.reduceat(n, start)
                partial = own[start] > d
                partial[[0, -1]] = True
                keep = (length[start] >= d) & (partial | (total >= least))
                keys += [r.tobytes() for r in m[start[keep], :d]]
                counts.append(total[keep])
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(np.concatenate(counts))], ["s", "n"])

    return rows.mapInArrow(run, "s binary, n long")


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes as rows of ``DEPTH`` ids, 0 beyond their ends, and their numbers of words."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] // 8
    ids = np.frombuffer(column.buffers()[2], np.uint64, int(offsets[-1])) if offsets[-1] else np.empty(0, np.uint64)
    length = np.diff(offsets)
    m = np.zeros((len(length), DEPTH), np.uint64)
    for d in range(DEPTH):
        has = length > d
        m[has, d] = ids[offsets[:-1][has] + d]
    return m, length


def long_tasks(texts: DataFrame, positions: int) -> DataFrame:
    """The texts in as many partitions as there are cores, in more where one would read over ``READ`` words, and in no more than they have.

    Every task that meets a suffix sends it, so with a task a split of the input there would be more suffixes and more tasks to send each of them.
    """
    return texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, -(-positions // READ)))


def summed_suffixes(parts: Iterator[tuple[np.ndarray, ...]], most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """A task's suffixes in order (rows of ``DEPTH`` ids), with whatever arrays follow them and how often each occurs.

    Equal ones are added up whenever ``most`` are held, so a task sends a suffix once however much text it reads, unless ``most`` / 2 different ones are held.
    """
    most = SUFFIXES if most is None else most

    def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        m, *others, n = (np.concatenate(of) for of in zip(*held))
        order = np.lexsort(m.T[::-1])
        m = m[order]
        start = np.flatnonzero(np.append(True, (m[1:] != m[:-1]).any(1)))
        return m[start], *(of[order][start] for of in others), np.add.reduceat(n[order], start)

    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        if len(part[0]):
            held.append((*part, np.ones(len(part[0]), np.int64)))
        if sum(len(of[0]) for of in held) >= most:
            held = [summed(held)]
            if 2 * len(held[0][0]) >= most:
                yield held.pop()
    if held:
        yield summed(held)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Words and phrases that occur ``least`` times or more.

    Words: ``id``, ``lang``, ``word`` (NULL: the total of the language), ``n``. Phrases of 2 to 5 words: ``s`` (the ids of the words), ``n``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, text, lang)
    seed = 0
    while True:
        words = stage(word_counts(texts, least, seed), "words")
        if not words.where("kinds > 1").count():
            break
        seed += 1
    known = words.where(F.col("word").isNotNull())
    facts = words.agg(F.count_if(F.col("word").isNotNull()).alias("words"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("n")).first()
    positions = facts.n or 0
    word_bits, pair_bits = table_bits(8 * facts.words), table_bits(positions // 4)
    top = lambda bits: F.expr(f"shiftrightunsigned(id, {64 - bits})").alias("slot")
    may_be_frequent = bit_table(known.select(top(word_bits)), word_bits)
    shared = spark.sparkContext.broadcast(may_be_frequent)

    def slot_counts(prefixes, bits: int) -> DataFrame:
        """Slots of prefix hashes that ``least`` positions share; ``prefixes`` gives a batch's hashes."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    slot, n = np.unique(_slots(prefixes(batch), bits), return_counts=True)
                    yield pa.record_batch([pa.array(slot), pa.array(n)], ["slot", "n"])

        counted = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        return stage(counted.where(F.col("n") >= least), "prefix_slots")

    counted = slot_counts(lambda batch: _pairs(_tokens(batch, seed), shared.value, word_bits)[1], pair_bits)
    left = counted.agg(F.sum("n")).first()[0] or 0
    crowd = int(left * CROWDED)
    pair_table = spark.sparkContext.broadcast(bit_table(counted, pair_bits))
    # at most 1 / CROWDED of each: they add up to no more than all positions
    crowded_pairs = np.sort(counted.where(F.col("n") > crowd).toArrow().column("slot").to_numpy()) if left else np.empty(0, np.int64)
    crowded_words = np.sort(known.where(F.col("n") > max(crowd, positions * CROWDED)).toArrow().column("id").to_numpy().view(np.uint64))
    groups = max(-(-left // budget), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def frequent_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """All ids of a batch, then of every position that a frequent pair may start at: the position, the pair's hash and slot."""
        ids = np.append(_tokens(batch, seed), np.zeros(DEPTH, np.uint64))
        at, pair = _pairs(ids, shared.value, word_bits)
        slot = _slots(pair, pair_bits)
        good = is_set(pair_table.value, slot)
        return ids, at[good], pair[good], slot[good]

    def triples(ids: np.ndarray, at: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those places of ``at`` where another frequent pair starts at the next word, and the hashes of the three words."""
        goes_on = np.zeros(len(ids), bool)
        goes_on[at] = True
        where = np.flatnonzero(goes_on[at + 1])
        return where, _mixed(pair[where], ids[at[where] + 2])

    triple_bits = table_bits(left // 4)
    thrice = slot_counts(lambda batch: (lambda ids, at, pair, _: triples(ids, at, pair)[1])(*frequent_pairs(batch)), triple_bits)
    triple_table = spark.sparkContext.broadcast(bit_table(thrice, triple_bits))

    def suffixes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix of every position that counts, its first pair's hash and slot."""
        ids, at, pair, slot = frequent_pairs(batch)
        where, triple = triples(ids, at, pair)
        goes_on = np.zeros(len(ids) + DEPTH, bool)
        goes_on[at[where[is_set(triple_table.value, _slots(triple, triple_bits))]]] = True
        m = np.zeros((len(at), DEPTH), np.uint64)
        m[:, 0], m[:, 1] = ids[at], ids[at + 1]
        on = np.ones(len(at), bool)
        for d in range(2, DEPTH):
            on = on & goes_on[at + d - 2]
            m[on, d] = ids[at[on] + d]
        return m, pair, slot

    def packed(m: np.ndarray, pair: np.ndarray, slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        own = np.ones(len(m), np.int32)
        own[np.isin(m[:, 0], crowded_words)] = 2
        own[np.isin(slot, crowded_pairs)] = 3
        prefix = np.select([own == 1, own == 2], [m[:, 0], pair], _mixed(pair, m[:, 2]))
        group = (_mixed(prefix, prefix) % np.uint64(groups)).astype(np.int64)
        length = (m != 0).sum(1)
        offsets = np.append(0, np.cumsum(8 * length)).astype(np.int32)
        s = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m[m != 0].tobytes())])
        return pa.record_batch([pa.array(group), s, pa.array(n), pa.array(own)], ["grp", "s", "n", "own"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counted in summed_suffixes(suffixes_of(batch) for batch in batches if batch.num_rows):
            yield packed(*counted)

    dealt = long_tasks(texts, positions).mapInArrow(suffixes, "grp long, s binary, n long, own int").repartition("grp").sortWithinPartitions("grp", "s")
    nodes = suffix_nodes(dealt, least).groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, stage(nodes, "phrases")


def _cut(first: int | Column, length: Column | None = None) -> Column:
    return F.substring("s", first, F.lit(8 * DEPTH) if length is None else length)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 2000, covered: int = 100, budget: int = BUDGET) -> DataFrame:
    """The ``most`` best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A phrase has 2 to 5 words and occurs ``least`` times (a). Its score is floor(1000 * a * n / (l * r)) at the cut into two parts, occurring l and r
    times, that scores lowest (the first of several); n counts the language's words. A phrase inside a longer one that occurs at least ``covered`` percent
    as often is left out. Products are taken in 38 digits and divided whole, so scores are exact while n is below 10**17.

    A NULL text is empty, a NULL language is ``und``; ids play no part, repeated rows count again, other columns are ignored. A table without phrases of that
    frequency gives no rows.
    """
    words, phrases = phrase_counts(docs, text, lang, least, budget)
    size = F.expr("octet_length(s) div 8").cast("int")
    known = words.where(F.col("word").isNotNull())
    # the bytes of an id are those of the tasks' (little-endian) numbers
    packed = F.unhex(F.array_join(F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda i: F.substring(F.lpad(F.hex("id"), 16, "0"), 2 * i - 1, F.lit(2))), ""))
    words_by_bytes = known.select(packed.alias("w"), "lang", "word", "n")
    counts = phrases.union(words_by_bytes.select(F.col("w").alias("s"), "n"))
    cuts = phrases.withColumn("size", size).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "s", F.col("n").alias("a"), "k", _cut(1, 8 * F.col("k")).alias("head"), _cut(8 * F.col("k") + 1).alias("tail"))
    cuts = cuts.join(counts.select(F.col("s").alias("head"), F.col("n").alias("l")), "head").join(counts.select(F.col("s").alias("tail"), F.col("n").alias("r")), "tail")
    first = F.substring("s", 1, 8)
    totals = words.where(F.col("word").isNull()).select("lang", F.col("n").alias("total"))
    of_lang = phrases.select("s", first.alias("w")).join(words_by_bytes.select("w", "lang"), "w").join(totals, "lang").select("s", "lang", "total")
    scored = cuts.join(of_lang, "s").withColumn("score", F.expr(
        "(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(total AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    best = scored.groupBy("s", "lang").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("b")).select("s", "lang", "b.*")
    longer = phrases.where(F.octet_length("s") > 16).select(F.explode(F.array(
        F.substring("s", 1, F.octet_length("s") - 8), F.substring("s", 9, F.octet_length("s") - 8))).alias("s"), F.col("n").alias("of"))
    around = longer.groupBy("s").agg(F.max("of").alias("of"))
    best = best.join(around, "s", "left").where(F.col("of").isNull() | (100 * F.col("of") < covered * F.col("a"))).drop("of")
    spelled = best.select("s", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring("s", 8 * i + 1, F.lit(8)))).alias("at", "w"))
    spelled = spelled.join(words_by_bytes.select("w", "word"), "w").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("of"))
    spelled = spelled.select("s", F.array_join(F.transform("of", lambda w: w["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language's phrases are ranked in 64 parts first, so the window by language alone meets at most 64 * most
    part = F.pmod(F.xxhash64("s"), F.lit(64))
    leading = best.join(spelled, "s").withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return leading.withColumn("rank", rank).where(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
