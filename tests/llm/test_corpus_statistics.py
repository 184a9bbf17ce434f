"""Whitening, phrase collocations and line dedup against brute force and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import line_dedup, phrases, queries, whitening

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11: whitening

def brute_covariance(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)]
    return np.array(x), n, s, np.array(v)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(90, 6)) @ rng.normal(size=(6, 6)) + 5).tolist()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    got = whitening.whiten(rows).collect()
    x, n, s, v = brute_covariance(vectors)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    want = (x - np.array(s) / n) @ axes / np.sqrt(e)
    assert len(got) == 90 * 6 and {r.n for r in got} == {n}
    table = np.zeros((90, 6))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)
        assert r.deviation == sum((n * int(a) - t) ** 2 for a, t in zip(x[r.vec_id], s))
    signs = np.sign((table * want).sum(0))
    assert np.abs(table * signs - want).max() < 1e-8
    cov = np.cov(table.T, bias=True)
    assert max(r.identity_error for r in got) < 1e-9 and np.abs(cov - np.eye(6)).max() < 1e-9


def test_whitening_of_the_given_table_is_whole(spark):
    out = queries.whitened(spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").where(whitening.usable("embedding")).count()
    assert out.count() == 32 * n and out.agg(F.max("identity_error")).first()[0] < 1e-4


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    scales = 10.0 ** -np.linspace(0, 5, 40)
    v = q * scales @ q.T
    e, axes = whitening.one_sided_jacobi(whitening.pivoted_cholesky((v + v.T) / 2))
    assert np.abs(e / scales - 1).max() < 1e-8 and np.abs(axes.T @ axes - np.eye(40)).max() < 1e-12


def test_products_are_exact_beyond_doubles():
    y = np.array([[2**40 + 1, 3], [-(2**39) - 7, 5]], np.int64)
    assert whitening.exact_product(y).tolist() == [(2**40 + 1) ** 2 + (2**39 + 7) ** 2, 3 * (2**40 + 1) - 5 * (2**39 + 7), 34]


def test_whitening_awkward(spark):
    schema = "vec_id long, embedding array<double>, component string, i int, _v string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "x", 1, "v"), (1, [1.0, 2.0], "x", 1, "v"), (None, [3.0, 7.0], None, 1, "v"), (2, None, "x", 1, "v"), (3, [nan, 1.0], "x", 1, "v"),
            (4, [None, 1.0], "x", 1, "v"), (5, [inf, 1.0], "x", 1, "v"), (6, [], "x", 1, "v"), (7, [9.0], "x", 1, "v"), (8, [5.0, -1.0], "x", 1, "v")]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 2, 8: 2} and {r.n for r in got} == {4}
    for few in ([], rows[3:6], rows[:1], rows[:2]):
        empty = whitening.whiten(spark.createDataFrame(few, schema))
        assert empty.count() == 0 and empty.columns[:2] == ["vec_id", "component"]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}  # the other direction has no variance
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0], "x", 1, "v"), rows[0]], schema)).collect()


# 12: phrases

def brute_phrases(rows, least=100, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + d])) for d in range(1, 6) for i in range(len(w) - d + 1))
    often = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    covered = set()
    for (lang, p), c in often.items():
        for d in range(2, len(p)):
            covered |= {(lang, p[i:i + d]) for i in range(len(p) - d + 1) if c >= f[lang, p[i:i + d]]}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if (lang, p) not in covered:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, r) in enumerate(sorted(found)[:most])}


def phrase_corpus():
    r = random.Random(7)
    vocabulary = ["the", "of", "a", "Straße", "x", "漢字", "new", "York", "\x00", " ", "z"]
    ends = [".", ",", "\n", "!", "?", ";", ":", "\r", "\x0b", "\x0c"]
    rows = []
    for i in range(700):
        words = []
        for _ in range(r.randrange(60)):
            words += ["new", "York", "city", "of", "gold", "and", "dust"][:r.randrange(3, 8)] if r.random() < 0.1 else [r.choice(vocabulary)]
            if r.random() < 0.1:
                words[-1] += r.choice(ends) * r.randrange(1, 3)
        text = "".join(w + r.choice([" ", "\t", "  "]) for w in words)
        rows.append((i, text.upper() if r.random() < 0.2 else text, r.choice(["en", "de", "und", None, ""])))
    return rows + [(None, None, "en"), (1, "", None), (1, " . ,\n", "en"), (5, "the of " * 30_000, "en")]


@pytest.mark.parametrize("budget", [1 << 20, 50])
def test_phrases_equal_brute_force(spark, budget):
    rows = phrase_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit("x"), "s": F.lit(1), "word": F.lit(2)}).repartition(5)
    got = {tuple(r) for r in phrases.collocations(docs, budget=budget).collect()}
    assert got == brute_phrases([(lang, text) for _, text, lang in rows]) and len(got) > 20


def test_phrases_ranks_are_cut_per_language(spark):
    rows = phrase_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in phrases.collocations(docs, least=30, most=7).collect()}
    assert got == brute_phrases([(lang, text) for _, text, lang in rows], least=30, most=7)


def test_phrases_with_crowded_prefixes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CROWDED", 1 / 8)  # several words and pairs are crowded here
    rows = phrase_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert {tuple(r) for r in phrases.collocations(docs, budget=200).collect()} == brute_phrases([(lang, text) for _, text, lang in rows])


def test_words_that_share_an_id_are_noticed(spark):
    rows = [(1, "en", "the", 60), (1, "en", "the", 60), (2, "en", "of", 3), (2, "de", "von", 4), (3, "en", "rare", 9), (4, "en", None, 7)]
    got = phrases.merged(spark.createDataFrame(rows, "id long, lang string, word string, n long"), 100).collect()
    assert {(r.id, r.n, r.kinds) for r in got} == {(1, 120, 1), (2, 7, 2), (4, 7, 1)}
    assert (phrases.word_ids("en", [b"a", b"b"], 0) != phrases.word_ids("en", [b"a", b"b"], 1)).all()
    assert (phrases.word_ids("en", [b"a"], 0) != phrases.word_ids("de", [b"a"], 0)).all()


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 3 * 10**15 + 7, 9 * 10**16 + 1, 4 * 10**15 + 9, 3 * 10**15 + 11
    expr = ("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(total AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    got = spark.createDataFrame([(a, n, l, r)], "a long, total long, l long, r long").select(F.expr(expr)).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_phrases_suffixes_travel_once_a_task():
    rng = np.random.default_rng(8)
    kinds = rng.integers(1, 4, (30, phrases.DEPTH)).astype(np.uint64)
    kinds[:5, 3:] = 0
    kinds = np.unique(kinds, axis=0)
    drawn = [rng.integers(0, len(kinds), size) for size in (40, 0, 70, 1, 90, 200, 15)]
    parts = [(kinds[at], at * 3) for at in drawn]
    want = Counter(int(i) for at in drawn for i in at)
    [(m, other, n)] = phrases.summed_suffixes(iter(parts), 64)
    assert (m == kinds[sorted(want)]).all() and (other == 3 * np.array(sorted(want))).all() and n.tolist() == [want[i] for i in sorted(want)]
    # where too many differ they go in several lots, and nothing is lost
    lots = list(phrases.summed_suffixes(iter(parts), 50))
    again = Counter()
    for m, other, n in lots:
        assert len(m) == len(np.unique(m, axis=0))
        again.update(dict(zip((other // 3).tolist(), n.tolist())))
    assert len(lots) > 1 and again == want
    assert list(phrases.summed_suffixes(iter([(kinds[:0], np.empty(0))]), 50)) == []


def test_phrases_in_many_lots(spark, monkeypatch):
    rows = [(i, "the old mill by the river was the old mill by the sea." * (1 + i % 3), "en") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute_phrases([(lang, text) for _, text, lang in rows])
    for most in (7, 40, 10**6):
        monkeypatch.setattr(phrases, "SUFFIXES", most)
        assert {tuple(r) for r in phrases.collocations(docs).collect()} == want and len(want) > 5


def test_phrases_suffixes_are_summed_over_many_splits(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(phrases, "suffix_nodes", lambda rows, least, nodes=phrases.suffix_nodes: dealt.append(rows) or nodes(rows, least))
    cores = spark.sparkContext.defaultParallelism
    rows = [(i, "the old mill by the river was the old mill by the sea.", "en") for i in range(400)]
    want = brute_phrases([(lang, text) for _, text, lang in rows])
    for splits in (5 * cores, 8 * cores):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(splits)
        assert {tuple(r) for r in phrases.collocations(docs).collect()} == want and len(want) > 2
    assert [rows.count() <= 11 * cores for rows in dealt] == [True, True]  # at most eleven different suffixes
    assert [phrases.long_tasks(docs, n).rdd.getNumPartitions() for n in (0, 5 * cores * phrases.READ, 10**15)] == [cores, 5 * cores, 8 * cores]


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "once only", "en")], "doc_id long, text string, lang string")).count() == 0


# 13: line dedup

def brute_lines(texts, threshold=10):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blank).translate(FOLD)
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < threshold or not key(x)]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def line_corpus():
    r = random.Random(11)
    pool = [f"Common line {i}" for i in range(40)] + ["", "  ", "\t", " ", "é", "İ", "x"]
    rows = []
    for i in range(300):
        lines = [r.choice(pool) if r.random() < 0.5 else f"own {r.random()}" for _ in range(r.randrange(12))]
        rows.append((i, "\n".join(r.choice(["", " ", "\t\r", "\x0b"]) + (x.upper() if r.random() < 0.3 else x) + r.choice(["", "  ", "\r"]) for x in lines)))
    alone = "\n".join(["Common line 1"] * 3)
    return rows + [(7, None), (8, ""), (None, "\n\n"), (9, alone), (9, alone), (10, "Common line 2"), (11, "x\n" * 50_000)]


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 26), (7, 1)])
def test_line_dedup_equals_brute_force(spark, sizes):
    rows = line_corpus()
    docs = spark.createDataFrame([(i, *r, "kept", 3) for i, r in enumerate(rows)], "at long, doc_id long, text string, n long_string, hi int".replace("long_string", "string")).repartition(6)
    got = line_dedup.dedup_lines(docs, per_shard=sizes[0], group_bytes=sizes[1])
    assert got.columns == ["at", "doc_id", "text", "n", "hi", "_n_lines", "_n_dropped"]
    found = {r.at: (r._n_lines, r._n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()}
    want = brute_lines([t for _, t in rows])
    assert found == dict(enumerate(want)) and sum(d for _, d, _ in want) > 500


def test_line_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).count() == 0
    few = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in few.collect()) == [(1, "a\nb", 2, 0), (2, "", 1, 0)]
    with pytest.raises(ValueError, match="taken"):
        line_dedup.dedup_lines(docs.withColumn("_n_lines", F.lit(1)))


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, (50_000, 2)).astype(np.uint64)
    hashes[:100, 0] = 5  # one word agrees, the other does not
    index = line_dedup.PerfectHash.build(hashes)
    assert sorted(index.numbers(hashes)) == list(range(50_000))
    again = line_dedup.PerfectHash.from_bytes(index.to_bytes())
    assert (again.numbers(hashes) == index.numbers(hashes)).all() and len(index.to_bytes()) < 50_000
    prints, counts = np.empty(50_000, np.uint64), np.arange(50_000)
    prints[index.numbers(hashes)] = hashes[:, 1]
    shard = line_dedup.Shard(index.to_bytes(), prints.tobytes(), counts.tobytes())
    assert (shard.count(hashes) == index.numbers(hashes)).all()
    assert not shard.count(rng.integers(0, 2**63, (10_000, 2)).astype(np.uint64)).any()
    assert line_dedup.Shard(b"", b"", b"").count(hashes[:3]).tolist() == [0, 0, 0]


@pytest.mark.parametrize("name", ["op12_phrases", "op13_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*columns).collect())
