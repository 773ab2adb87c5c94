"""Corpus preparation queries: F1, F2, F4, F7-F9, A1-A3, T9, T10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.corpus import (cap_domain_share, contamination_filter, corpus_counts,
                                domain_pools, layer_grid, min_length_filter, sample_positions,
                                text_presence, truncate_array, uniqueness, with_default)
from ..sources.tables import read_table
from .registry import register

# Fixed values from the reference: sweep depth fractions, position sampling
# (4 extra positions, first candidate 50, sequences capped at 512 tokens).
DEPTH_FRACTIONS = (0.30, 0.40, 0.49, 0.57, 0.66, 0.75)
EXTRA_POSITIONS = 4
MIN_POSITION = 50
MAX_TOKENS = 512
LABEL_TOKENS = 16
DOMAIN_SHARE = 0.10

# SQL spellings of the shared patterns
SQL_WS = r"[\t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}]"
SQL_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SQL_WS}+|{SQL_WS}+\\z', '', 'g')"


@register("text_presence", """
SELECT lang, count(*) AS n_total,
       count_if(text IS NULL OR text = '')::BIGINT AS n_missing,
       count_if(text IS NOT NULL AND text <> '')::BIGINT AS n_usable
FROM documents GROUP BY lang""")
def q_text_presence(spark, sf_dir):
    """totals vs usable (non-null, non-empty) texts per language."""
    return text_presence(read_table(spark, sf_dir, "documents"), "text", ["lang"])


@register("min_length_filter", f"""
SELECT source, count(*) AS n_kept FROM documents
WHERE length({sql_strip('text')}) > 20 GROUP BY source""")
def q_min_length_filter(spark, sf_dir):
    """documents whose stripped text is longer than 20 characters."""
    d = min_length_filter(read_table(spark, sf_dir, "documents"), "text", 20)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_kept"))


@register("domain_default", """
SELECT coalesce(l.quality::VARCHAR, 'unknown') AS domain, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def q_domain_default(spark, sf_dir):
    """missing domain -> "unknown" (labels cover only some documents)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    return j.groupBy(with_default("quality").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@register("layer_grid", f"""
WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
g AS (SELECT DISTINCT user_id, n, round_even(f::DOUBLE * n, 0)::INTEGER AS layer
      FROM s, (VALUES {', '.join(f'({f!r})' for f in DEPTH_FRACTIONS)}) t(f))
SELECT user_id, n, layer FROM g WHERE layer >= 0 AND layer < n""")
def q_layer_grid(spark, sf_dir):
    """depth grid for every run (run size = events per user)."""
    s = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return layer_grid(s, "n", DEPTH_FRACTIONS)


@register("position_sample", f"""
WITH t AS (SELECT doc_id, least(len({SQL_TOKENS}), {MAX_TOKENS}) AS L FROM documents),
c AS (SELECT doc_id, L, least({MIN_POSITION}, L - 1) AS m FROM t),
s AS (SELECT doc_id, list_slice(generate_series(m, L - 2, greatest(1, (L - 1 - m) // {EXTRA_POSITIONS})), 1, {EXTRA_POSITIONS}) AS ps
      FROM c WHERE L - 1 - m > 0)
SELECT doc_id, unnest(ps)::INTEGER AS pos FROM s""")
def q_position_sample(spark, sf_dir):
    """F8: strided extra positions per document token sequence."""
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.least(F.size(tokens("text")), F.lit(MAX_TOKENS)).alias("L"))
    return d.select("doc_id", F.explode(sample_positions("L", EXTRA_POSITIONS, MIN_POSITION)).alias("pos"))


@register("truncate_tokens", f"""
WITH t AS (SELECT doc_id, {SQL_TOKENS} AS tok FROM documents)
SELECT doc_id, len(tok)::INTEGER AS n_tokens, len(list_slice(tok, 1, {MAX_TOKENS}))::INTEGER AS n_kept,
       list_slice(tok, 1, {MAX_TOKENS})[-1] AS last_kept,
       len(list_slice(tok, 1, {LABEL_TOKENS}))::INTEGER AS n_label
FROM t""")
def q_truncate_tokens(spark, sf_dir):
    """sequences cut to 512 tokens, labels to 16."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("tok"))
    kept = truncate_array("tok", MAX_TOKENS)
    return d.select("doc_id", F.size("tok").alias("n_tokens"), F.size(kept).alias("n_kept"),
                    F.try_element_at(kept, F.lit(-1)).alias("last_kept"),
                    F.size(truncate_array("tok", LABEL_TOKENS)).alias("n_label"))


@register("corpus_counts", """
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(DISTINCT text) AS n_distinct_texts,
       count(DISTINCT source) AS n_source, count(DISTINCT lang) AS n_lang FROM documents""")
def q_corpus_counts(spark, sf_dir):
    """A1: rows, distinct docs and texts, domain counts."""
    return corpus_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text", ["source", "lang"])


@register("domain_pools", """
SELECT source, count(*) AS pool_size, count(*) < 2 AS small_pool FROM documents GROUP BY source""")
def q_domain_pools(spark, sf_dir):
    """A2: negative-pool size per domain, small pools flagged."""
    return domain_pools(read_table(spark, sf_dir, "documents"), "source", 2)


@register("uniqueness", """
SELECT role, count(*) AS n, count(DISTINCT text) AS n_unique,
       round(count(DISTINCT text)::DOUBLE / count(*), 6) AS unique_ratio
FROM conversations GROUP BY role""")
def q_uniqueness(spark, sf_dir):
    """A3: distinct texts and their share per role."""
    return uniqueness(read_table(spark, sf_dir, "conversations"), "text", ["role"])


@register("contamination_filter", """
SELECT count(*) AS n_before,
       count_if(regexp_matches(text, '[0-9]+: KEEP'))::BIGINT AS n_removed,
       count_if(NOT regexp_matches(text, '[0-9]+: KEEP'))::BIGINT AS n_after FROM documents""")
def q_contamination_filter(spark, sf_dir):
    """Drop rows carrying a label marker; exact counts before / after."""
    d = read_table(spark, sf_dir, "documents")
    kept = contamination_filter(d, "text")
    before = d.agg(F.count(F.lit(1)).alias("n_before"))
    after = kept.agg(F.count(F.lit(1)).alias("n_after"))
    one = F.lit(1)
    return (before.withColumn("_k", one).join(after.withColumn("_k", one), "_k")
            .select("n_before", (F.col("n_before") - F.col("n_after")).alias("n_removed"), "n_after"))


@register("cap_domain_share", f"""
WITH o AS (SELECT count(*) AS n_other FROM documents WHERE lang IS DISTINCT FROM 'en'),
h AS (SELECT doc_id, lang,
             row_number() OVER (ORDER BY md5(concat_ws('|', '0', doc_id::VARCHAR)), doc_id) - 1 AS rk
      FROM documents WHERE lang = 'en'),
kept AS (SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'
         UNION ALL
         SELECT doc_id, lang FROM h, o WHERE rk < floor(n_other * {DOMAIN_SHARE / (1 - DOMAIN_SHARE)!r}))
SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS doc_id_sum FROM kept GROUP BY lang""")
def q_cap_domain_share(spark, sf_dir):
    """Cap the largest language at 10% of the corpus (md5 order)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    kept = cap_domain_share(d, "lang", "en", DOMAIN_SHARE, "doc_id", seed=0)
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("doc_id_sum"))
