"""Quality rules: a decision list learned from labelled statistics.

Statistics of a text are columns, made with DataFrame functions within the row. Rules are learned on at most
``labelled`` labelled documents by sequential covering: a conjunction of thresholds grows while it gains
information on two thirds of them, is pruned on the rest, joins the list if enough of what it covers there is
bad, and what it covers is taken away. The list becomes one ordered ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import words

SYMBOLS = "#*$%&|<>"
SHOUTED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
SPACES = "\x20\t\n\x0b\x0c\r"
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "shouted", "n_words")
#: (feature, True for "at least", threshold); a rule holds where all its conditions hold.
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


def _occurrences(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with statistics in columns whose names begin with ``_q_``.

    Repeated windows are found by sorting the row's own (hash, place) pairs, so there is no shuffle and a long
    text costs n log n. Each intermediate column is used more than once, which keeps Spark from inlining it; the results
    pass through a generator of one row, below which no later filter is pushed (it would repeat the whole work for each word).
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    out = docs.withColumn("_q_text", text).withColumn("_q_words", words(text))
    lines = F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_q_words")
    grams = F.transform("_q_words", lambda x, i: F.struct(
        F.xxhash64(x, F.get("_q_words", i + 1), F.get("_q_words", i + 2)).alias("h"), i.alias("i")))
    out = out.withColumns({
        "_q_n_words": n.cast("long"),
        "_q_word_chars": (F.length("_q_text") - _occurrences(F.col("_q_text"), SPACES)).cast("long"),
        "_q_n_symbols": _occurrences(F.col("_q_text"), SYMBOLS),
        "_q_n_shouted": _occurrences(F.col("_q_text"), SHOUTED),
        "_q_lines": lines,
        "_q_grams": F.sort_array(F.slice(grams, 1, F.greatest(n - 2, F.lit(0)))),
    }).drop("_q_text", "_q_words")
    h = lambda i: F.get("_q_grams", i)["h"]
    again = F.filter("_q_grams", lambda x, i: F.coalesce(x["h"] == h(i - 1), F.lit(False)) | F.coalesce(x["h"] == h(i + 1), F.lit(False)))
    out = out.withColumns({
        "_q_n_lines": F.size("_q_lines").cast("long"),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_places": F.sort_array(F.transform(again, lambda x: x["i"])),
    }).drop("_q_lines", "_q_grams")
    covered = F.transform("_q_places", lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get("_q_places", i - 1))))
    out = out.withColumn("_q_n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_q_places")
    statistics = [c for c in out.columns if c.startswith("_q_n_") or c == "_q_word_chars"]
    return out.select(*docs.columns, F.inline(F.array(F.struct(*statistics))))


def features() -> dict[str, Column]:
    n = F.greatest(F.col("_q_n_words"), F.lit(1))
    return {
        "mean_word": F.col("_q_word_chars") / n, "symbols": F.col("_q_n_symbols") / n,
        "dup_lines": F.col("_q_n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1)), "repeats": F.col("_q_n_repeat_words") / n,
        "shouted": F.col("_q_n_shouted") / n, "n_words": F.col("_q_n_words").cast("double")}


def base_failed() -> Column:
    return (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))


def _cuts(values: list[float], most: int = 24) -> list[float]:
    ordered = sorted(set(values))
    step = max(1, len(ordered) // most)
    return [(a + b) / 2 for a, b in zip(ordered[::step], ordered[1::step])]


def covering(rows: list[tuple], good: list[bool], precision: float = 0.9, most_rules: int = 12, most_conditions: int = 3) -> list[Rule]:
    """The decision list for rows of :data:`FEATURES`; sets of rows are bits of an integer."""
    of = lambda test: sum(1 << i for i, r in enumerate(rows) if test(r))
    conditions: dict[Condition, int] = {}
    for k, name in enumerate(FEATURES):
        for cut in _cuts([r[k] for r in rows]):
            conditions[name, True, cut] = high = of(lambda r, k=k, cut=cut: r[k] >= cut)
            conditions[name, False, cut] = ((1 << len(rows)) - 1) & ~high
    bad = sum(1 << i for i, g in enumerate(good) if not g)
    grow = sum(1 << i for i in range(len(rows)) if i % 3)
    left, rules = (1 << len(rows)) - 1, []

    def cover(rule: list[Condition]) -> int:
        out = left
        for c in rule:
            out &= conditions[c]
        return out

    def counts(mask: int) -> tuple[int, int]:
        return (mask & bad).bit_count(), (mask & ~bad).bit_count()

    while len(rules) < most_rules:
        rule: list[Condition] = []
        inside = left & grow
        while len(rule) < most_conditions:
            p, n = counts(inside)
            if not p or not n:
                break
            was = math.log2(p / (p + n))
            gain, best = 1e-9, None
            for c, mask in conditions.items():
                q, m = counts(inside & mask)
                if q and (value := q * (math.log2(q / (q + m)) - was)) > gain:
                    gain, best = value, c
            if best is None:
                break
            rule.append(best)
            inside &= conditions[best]
        if not rule:
            break

        def worth(size: int) -> float:
            p, n = counts(cover(rule[:size]) & ~grow)
            return (p - n) / (p + n) if p + n else -1.0

        rule = rule[:max(range(1, len(rule) + 1), key=worth)]
        p, n = counts(cover(rule))
        held_p, held_n = counts(cover(rule) & ~grow)
        if p < 3 or p < precision * (p + n) or held_p < precision * (held_p + held_n):
            break
        rules.append(tuple(rule))
        left &= ~cover(rule)
        if not counts(left)[0]:
            break
    return rules


def learn(docs: DataFrame, labels: DataFrame, labelled: int = 5000, text_column: str = "text", precision: float = 0.9) -> list[Rule]:
    """Rules that reject, from the ``labelled`` labels (doc_id, quality 0/1) with the smallest hashes.

    The bound makes both the broadcast ids and the collected rows small at every size. Labels without a document, and
    NULL ids or qualities, are ignored; without labels the list is empty. Of documents that share an id, one is read.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_q_good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    both = docs.select(F.col("doc_id").alias("_q_id"), F.col(text_column).alias("text")).join(
        F.broadcast(sample), F.col("_q_id") == F.col("doc_id"))
    facts = F.struct("_q_good", *(c.alias(k) for k, c in features().items()))
    # an id may stand for any number of rows: one of them is enough
    one = with_statistics(both).where(~base_failed()).groupBy("_q_id").agg(F.min(facts).alias("one"))
    rows = one.select("_q_id", "one.*").collect()
    rows = sorted(rows, key=lambda r: ((r["_q_id"] * 2654435761) % 2**32, tuple(r)))
    return covering([tuple(r)[2:] for r in rows], [bool(r["_q_good"]) for r in rows], precision)


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list rejects."""
    of, out = features(), None
    for rule in rules:
        holds = F.lit(True)
        for name, at_least, cut in rule:
            holds = holds & ((of[name] >= cut) if at_least else (of[name] < cut))
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule], text_column: str = "text") -> DataFrame:
    """``docs`` with its statistics, ``_q_base_failed`` and ``_q_kept``.

    NULL texts and texts without a word fail the base rules. NULL ids and repeated rows are judged like any other row.
    """
    return with_statistics(docs, text_column).withColumn("_q_base_failed", base_failed()).withColumn(
        "_q_kept", ~F.col("_q_base_failed") & verdict(rules))
