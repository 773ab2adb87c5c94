"""Corpus preparation: F1, F2, F4, F7-F9, A1-A3, T9, T10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.random import hash_key
from ..functions.text import py_strip
from .indexing import buckets_for, dense_index, hex_bucket


def text_presence(df: DataFrame, text_col: str, group_cols=()) -> DataFrame:
    """totals vs rows with a usable (non-null, non-empty) text."""
    g = list(group_cols)
    missing = F.col(text_col).isNull() | (F.col(text_col) == "")
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("n_total"),
                              F.count_if(missing).alias("n_missing"),
                              F.count_if(~missing).alias("n_usable"))


def min_length_filter(df: DataFrame, text_col: str, min_exclusive: int = 20) -> DataFrame:
    """keep rows whose stripped text is longer than ``min_exclusive``."""
    return df.filter(F.length(py_strip(F.col(text_col))) > min_exclusive)


def with_default(col, default: str = "unknown") -> Column:
    """string coercion with a default for missing values."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(default))


def layer_grid(sizes: DataFrame, n_col: str, fractions, out_col: str = "layer") -> DataFrame:
    """per size n, sorted distinct round-half-even(f * n) within [0, n)."""
    fr = F.array(*[F.lit(float(f)) for f in fractions])
    return (sizes.withColumn("_f", F.explode(fr))
            .withColumn(out_col, F.bround(F.col("_f") * F.col(n_col), 0).cast("int"))
            .filter((F.col(out_col) >= 0) & (F.col(out_col) < F.col(n_col)))
            .drop("_f").dropDuplicates())


def sample_positions(seq_len, k: int = 4, min_pos: int = 50) -> Column:
    """F8: strided extra positions of a sequence of length L:
    m = min(min_pos, L-1), candidates [m, L-1), step = max(1, len // k),
    the first k of the stride. Empty when there are no candidates."""
    L = F.col(seq_len) if isinstance(seq_len, str) else seq_len
    m = F.least(F.lit(min_pos), L - 1)
    n_c = L - 1 - m
    step = F.greatest(F.lit(1), F.floor(n_c / F.lit(k)).cast("int"))
    seq = F.sequence(m, L - 2, step)
    return F.when(n_c > 0, F.slice(seq, 1, k)).otherwise(F.array().cast("array<int>"))


def truncate_array(arr, n: int) -> Column:
    """first n elements."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(a, 1, n)


def corpus_counts(df: DataFrame, doc_col: str, text_col: str, domain_cols) -> DataFrame:
    """A1: rows, distinct docs / texts, domain counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.countDistinct(doc_col).alias("n_docs"),
                  F.countDistinct(text_col).alias("n_distinct_texts"),
                  *[F.countDistinct(c).alias(f"n_{c}") for c in domain_cols])


def domain_pools(df: DataFrame, domain_col: str, min_rows: int = 2) -> DataFrame:
    """A2: pool size per domain and a flag for pools too small for a
    same-domain negative."""
    return (df.groupBy(domain_col).agg(F.count(F.lit(1)).alias("pool_size"))
            .withColumn("small_pool", F.col("pool_size") < min_rows))


def uniqueness(df: DataFrame, text_col: str, group_cols=()) -> DataFrame:
    """A3: distinct strings and their share."""
    g = list(group_cols)
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"),
                              F.countDistinct(text_col).alias("n_unique")).withColumn(
        "unique_ratio", F.col("n_unique") / F.col("n"))


def contamination_filter(df: DataFrame, text_col: str, pattern: str = r"[0-9]+: KEEP") -> DataFrame:
    """Rows without the label marker."""
    return df.filter(~F.coalesce(F.col(text_col).rlike(pattern), F.lit(False)))


def cap_domain_share(df: DataFrame, domain_col: str, domain: str, share: float, key_col: str,
                     seed: int = 0) -> DataFrame:
    """Keep at most floor(share / (1 - share) * n_other) rows of ``domain``
    (so it makes up at most ``share`` of the result), chosen by the md5 order of
    (seed, key). The rank comes from a distributed dense index, so a domain
    holding most rows is never gathered in one task."""
    is_hot = F.col(domain_col).eqNullSafe(domain)  # a missing domain is another domain
    n_other = df.filter(~is_hot).agg(F.count(F.lit(1)).alias("_no"))
    hot = df.filter(is_hot).withColumn("_h", hash_key(F.lit(seed), F.col(key_col)))
    ranked = dense_index(hot, ["_h", key_col], [], "_rank", hex_bucket("_h", buckets_for(hot.count())))
    cap = n_other.select(F.floor(F.col("_no") * F.lit(share / (1.0 - share))).alias("_cap"))
    kept = (ranked.withColumn("_one", F.lit(1))
            .join(F.broadcast(cap.withColumn("_one", F.lit(1))), "_one")
            .filter(F.col("_rank") < F.col("_cap")).select(*df.columns))
    return df.filter(~is_hot).unionByName(kept)
