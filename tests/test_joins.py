import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from courtside.operators import joins
from courtside.operators.joins import (
    _cells, cover_levels, dyadic_cover, overlap_join, pattern_join, pattern_join_indexed, range_join, required_literal, word_join,
)


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(11)
    data = []
    for i in range(80):
        lo = rng.randrange(0, 500)
        data.append((rng.choice(["hot", "hot", "hot", "b"]), i, lo, rng.choice([lo - 1, lo, lo + 1, lo + 30, lo + 200, None])))
    return data


@pytest.mark.parametrize("width", [1, 16, 10_000])
def test_range_join(spark, spans, width):
    pts = [(k, p) for k in ("hot", "b", "c") for p in range(0, 700, 7)]
    left = spark.createDataFrame(pts, "k string, p long")
    right = spark.createDataFrame(spans, "k string, sid int, lo long, hi long")
    for longest in (None, 10):  # a wrong bound costs copies, no rows
        got = rows(range_join(left, right, ["k"], "p", "lo", "hi", "left", width, longest), "k", "p", "sid")
        check_range(got, pts, spans)


def check_range(got, pts, spans):
    want = []
    for k, p in pts:
        hits = [s for kk, s, lo, hi in spans if kk == k and hi is not None and lo <= p < hi]
        want += [(k, p, s) for s in hits] or [(k, p, None)]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("width", [1, 16, 10_000])
def test_overlap_join_gives_each_pair_once(spark, spans, width):
    a = spark.createDataFrame(spans, "k string, a int, alo long, ahi long")
    b = spark.createDataFrame(spans, "k string, b int, blo long, bhi long")
    got = rows(
        overlap_join(a, b, ["k"], ("alo", "ahi"), ("blo", "bhi"), F.col("a") != F.col("b"), width), "a", "b"
    )
    want = [
        (x[1], y[1]) for x in spans for y in spans
        if x[0] == y[0] and x[1] != y[1] and x[3] is not None and y[3] is not None
        and min(x[3], y[3]) > max(x[2], y[2])
    ]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_dyadic_cover_is_short_disjoint_and_whole(spark):
    rng = random.Random(4)
    data = [(a, a + n) for n in [0, 1, 2, 3, 4, 7, 8, 9, 100, 1023, 1024, 1025] for a in (0, 1, 5, -3, -8, 1024)]
    data += [(a := rng.randrange(-10**6, 10**6), a + rng.randrange(1, 10**6)) for _ in range(200)]
    got = spark.createDataFrame([*data, (None, 5), (5, 1)], "a long, b long").select("a", "b", dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        if r.a is None or r.b <= r.a:
            assert not r.c
            continue
        blocks = sorted((x.block * 2**x.level, (x.block + 1) * 2**x.level) for x in r.c)
        assert blocks[0][0] == r.a and blocks[-1][1] == r.b and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))
        assert len(blocks) <= 2 * max(0, (r.b - r.a).bit_length() - 1) + 2


def test_intervals_of_any_length_have_few_copies(spark):
    spans = spark.createDataFrame([(i, i * 7, i * 7 + 10**e) for i in range(50) for e in range(7)], "i int, lo long, hi long")
    most = spans.select(F.max(F.size(_cells("lo", "hi", 64)))).first()[0]
    assert most <= 2 * 14 + 4  # a million ids are 15,625 cells
    assert cover_levels(spans.where("hi - lo <= 10"), "lo", "hi", 64) == [0]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("width", [1, 64])
def test_range_join_of_long_and_short_intervals(spark, how, width):
    rng = random.Random(9)
    spans = [(rng.choice(["hot", "b", None]), i, lo := rng.randrange(-10**6, 10**6), lo + rng.choice([1, 3, 1000, 10**6])) for i in range(120)]
    pts = [(rng.choice(["hot", "b", "c", None]), rng.choice([None, rng.randrange(-10**6, 2 * 10**6)]), f"x{i % 50}") for i in range(300)]
    left, right = spark.createDataFrame(pts, "k string, p long, _block string"), spark.createDataFrame(spans, "k string, sid int, lo long, hi long")
    got = rows(range_join(left, right, ["k"], "p", "lo", "hi", how, width), "k", "p", "_block", "sid")
    want = []
    for k, p, x in pts:
        hits = [s for kk, s, lo, hi in spans if k is not None and kk == k and p is not None and lo <= p < hi]
        want += [(k, p, x, s) for s in hits] or ([(k, p, x, None)] if how == "left" else [])
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_overlaps_of_long_and_short_intervals(spark):
    rng = random.Random(10)
    spans = [(rng.choice(["hot", "b"]), i, lo := rng.randrange(0, 10**6), lo + rng.choice([1, 50, 10**6])) for i in range(150)]
    a, b = spark.createDataFrame(spans, "k string, a int, alo long, ahi long"), spark.createDataFrame(spans[50:], "k string, b int, blo long, bhi long")
    got = rows(overlap_join(a, b, ["k"], ("alo", "ahi"), ("blo", "bhi")), "a", "b")
    want = [(x[1], y[1]) for x in spans for y in spans[50:] if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2])]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert got == rows(overlap_join(a, b, ["k"], ("alo", "ahi"), ("blo", "bhi"), width=5000, longest=10_000), "a", "b")


def test_word_join_is_whole_word(spark):
    urls = spark.createDataFrame([(1, "/nba/heat-check"), (2, "/cheat/x"), (3, "/HEAT"), (4, "")], "id int, url string")
    words = spark.createDataFrame([("Heat",), ("nets",)], "w string")
    assert rows(word_join(urls, words, "url", "w", "id"), "id", "w") == [
        (1, "Heat"), (2, None), (3, "Heat"), (4, None)]


@pytest.mark.parametrize("limit", [1, 2, 100])
def test_pattern_join_slices_do_not_change_the_result(spark, limit):
    left = spark.createDataFrame([(1, "antho"), (2, "book"), (3, "zzz"), (3, "zzz")], "id int, name string")
    pats = spark.createDataFrame([("^an",), ("o",), ("k$",)], "p string")
    want = [(1, "^an"), (1, "o"), (2, "k$"), (2, "o"), (3, None), (3, None)]
    assert rows(pattern_join(left, pats, "name", "p", "left", limit), "id", "p") == want


def test_pattern_join_agrees_for_any_slice_size(spark):
    left = spark.createDataFrame([(1, "red car", None), (1, "red car", None), (2, "blue", "x"), (3, None, None)], "id int, text string, z string")
    patterns = spark.createDataFrame([("r.d",), ("car$",), ("green",)], "pattern string")
    whole = rows(pattern_join(left, patterns, "text", "pattern"), "id", "text", "z", "pattern")
    assert len(whole) == 6
    for n in (1, 2):
        assert rows(pattern_join(left, patterns, "text", "pattern", max_patterns=n), "id", "text", "z", "pattern") == whole


def test_word_join_finds_names_of_several_words(spark):
    left = spark.createDataFrame([(1, "Portland Trail Blazers"), (2, "blazers trail"), (3, "the trail"), (4, None)], "id int, text string")
    names = spark.createDataFrame([("trail blazers", "POR"), ("trail", "T")], "word string, code string")
    assert rows(word_join(left, names, "text", "word", "id"), "id", "code") == [(1, "POR"), (1, "T"), (2, "T"), (3, "T"), (4, None)]


@pytest.mark.parametrize("pattern, literal", [
    ("^red", "red"), ("l[ai]", None), ("a|bcd", None), ("colou?r", "colo"), ("(abc)?defg", "defg"), (r"\d+ points", " points"), ("(?i)abc", None), (r"a\.bcd", "bcd"),
    ("abc+d", "abc"), ("x{0,3}yzw", "yzw"), ("[^]]abc", "abc"), ("((ab)c)de", None), (r"\x41bcdef", None), ("ab.cd", None), ("", None), ("[a[b]]cde", None), ("abcd*", "abc"),
])
def test_required_literal(spark, pattern, literal):
    assert spark.createDataFrame([(pattern,)], "p string").select(required_literal(F.col("p"))).first()[0] == literal


def test_indexed_patterns_equal_the_plain_join(spark):
    texts = [(1, "red widget"), (1, "red widget"), (2, "a blue widget"), (3, None), (4, ""), (5, "xx red"), (6, "re"), (7, "widget red")]
    pats = [("r", "^red"), ("r", "^red"), ("w", "wid+get"), ("n", None), ("q", "zzz.*red"), ("b", "bl[ue]+ w"), ("e", "re|zz"), ("r2", "red$")]
    left, right = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(pats, "tag string, p string")
    for how in ("left", "inner"):
        assert rows(pattern_join_indexed(left, right, "t", "p", how), "i", "t", "tag", "p") == rows(pattern_join(left, right, "t", "p", how), "i", "t", "tag", "p")
    sure = right.where("tag not in ('e', 'b')")
    plan = pattern_join_indexed(left, sure, "t", "p", "inner")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pattern_join_indexed(left, right.limit(0), "t", "p").count() == len(texts)
    assert pattern_join_indexed(left.limit(0), right, "t", "p").count() == 0


def test_indexed_patterns_stage_no_text_per_gram(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(joins, "stage", lambda df, name: staged.setdefault(name, df))
    long = "\u00e9\U0001f600 " * 3000 + "left winger passes, "
    texts = [(i, long + w) for i, w in enumerate(("scorers shoot", "scorer", "passed", "scorers shoot", ""))] + [(9, None)]
    left = spark.createDataFrame(texts, "i int, t string")
    right = spark.createDataFrame([("a", "winger[^x]*scorers"), ("b", "score"), ("c", "\U0001f600 \u00e9"), ("d", "ssed$"), ("e", "wingers")], "tag string, p string")
    got = rows(pattern_join_indexed(left, right, "t", "p"), "i", "tag")
    assert got == rows(pattern_join(left, right, "t", "p"), "i", "tag")
    assert dict(staged["grams"].dtypes) == {"h": "bigint", "gram": "binary"}
    assert staged["grams"].count() == staged["grams"].distinct().count() <= 4 * 9
