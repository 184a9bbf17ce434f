"""Queries of the text operators on the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import (
    byte_bpe_spark, chat_format, class_lm, html_extract, line_dedup, mixing, phrases, quality_rules, secret_scan, simhash, token_counts, topk, whitening,
)
from courtside.session import stage

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
UNIGRAM_PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.whole_components(F.col("embedding")).alias("v"))
    return topk.top_k(vectors.where(F.col("id") % 20 == 0), vectors, 20)


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["k"] != "model")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["k"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), UNIGRAM_PIECES)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    every = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat_format.format_chats(every)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.prepared(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    rows = stage(rows, "mix")
    return mixing.with_copies(rows, rows).select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).cast("long").alias("taken"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe_spark.encode_texts(docs, BPE_RANKS, public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, _read(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select(
        "doc_id", *(F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": exact_top_k, "op2_simhash": simhash_groups, "op3_secret_scan": secrets, "op4_token_counts": unigram_counts,
    "op5_chat_format": chats, "op6_mixing": mixed, "op7_byte_bpe": bpe_round_trip, "op8_quality_rules": quality,
    "op9_html_extract": page_texts, "op10_class_lm": class_scores, "op11_whitening": whitened, "op12_phrases": phrase_collocations,
    "op13_line_dedup": common_lines,
}

ORACLES: dict[str, str] = {
    "op1_exact_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 20""",
    "op5_chat_format": """
        WITH every AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(14 + length(role) + length(CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR regexp_matches(text, '\\\\[eth]')
                THEN replace(replace(replace(text, chr(92), chr(92) || 'e'), '</turn>', chr(92) || 't'), '### ', chr(92) || 'h')
                ELSE text END)) AS BIGINT) AS formatted_chars
        FROM every GROUP BY conv_id""",
    "op12_phrases": """
        WITH rows AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
        cut AS (SELECT doc, lang, unnest(string_split_regex(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM rows),
        pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM cut),
        totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
        grams AS (SELECT lang, unnest(list_transform(range(1, least(5, len(w) - i + 1) + 1), lambda d: w[i:i + d - 1])) AS g FROM starts),
        f AS (SELECT lang, g, len(g) AS d, CAST(count(*) AS HUGEINT) AS c FROM grams GROUP BY lang, g HAVING count(*) >= 100),
        cuts AS (SELECT lang, g, c AS a, unnest(range(1, d)) AS k FROM f WHERE d >= 2),
        scored AS (SELECT u.lang, u.g, u.a, u.k, x.c AS l, y.c AS r, t.n, (1000 * u.a * t.n) // (x.c * y.c) AS score FROM cuts u
            JOIN f x ON x.lang = u.lang AND x.g = u.g[1:u.k] JOIN f y ON y.lang = u.lang AND y.g = u.g[u.k + 1:len(u.g)] JOIN totals t ON t.lang = u.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        inner_parts AS (SELECT lang, c, unnest(list_concat(list_transform(range(1, d), lambda i: g[1:i]), list_concat(list_transform(range(2, d + 1), lambda i: g[i:d]),
            list_transform(range(2, d), lambda i: g[i:i + 1]), list_transform(range(2, d - 1), lambda i: g[i:i + 2])))) AS g FROM f WHERE d >= 3),
        around AS (SELECT lang, g, max(c) AS c FROM inner_parts GROUP BY lang, g),
        kept AS (SELECT s.* FROM lowest s LEFT JOIN around o ON o.lang = s.lang AND o.g = s.g WHERE o.c IS NULL OR 100 * o.c < 100 * s.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
            CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM kept QUALIFY rank <= 2000""",
    "op13_line_dedup": """
        WITH cut AS (SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM cut),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM (SELECT doc, doc_id, line, place, key IN (SELECT key FROM common) AS gone FROM keyed) GROUP BY doc, doc_id""",
}
