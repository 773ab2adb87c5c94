"""P1-P4, F5, G2 from texts: encode source texts, form domain prototypes,
classify generated texts by the nearest prototype, and report.

Only the texts that a prototype uses are encoded on the source side, and only
texts of covered domains on the other; the encoder (X1) runs over Arrow batches
where the rows are. The report is one nested row; its lists are as long as the
number of domains, its sample ten rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson_bounds
from ..functions.text import py_strip
from ..functions.vectors import unit
from ..session import cut_lineage
from .common import join_group
from .encode import batch_encode
from .prototypes import accuracy, first_n_per_group, nearest_prototype
from .significance import perm_test_accuracy
from .vectors import vector_mean


def source_texts(rows: DataFrame, id_col: str, domain_col: str, text_col: str, min_chars: int = 20) -> DataFrame:
    """(id, domain, text) of the rows whose stripped text is longer than
    ``min_chars``; rows without domain or text are left out."""
    return (rows.filter(F.col(domain_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain"), py_strip(text_col).alias("text"))
            .filter(F.char_length("text") > min_chars))


def text_prototypes(source: DataFrame, per_domain: int = 200, min_texts: int = 3, fn_factory=None, eps: float = 1e-9) -> DataFrame:
    """(domain, n_texts, n_used, proto) of the domains with ``min_texts``
    texts: the mean of the first ``per_domain`` encoded texts by id,
    re-normalised. ``source`` is that of ``source_texts``."""
    counts = source.groupBy("domain").agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") >= min_texts)
    first = first_n_per_group(source, "domain", ["id", "text"], per_domain).join(counts, "domain", "left_semi")
    vec = batch_encode(first, "domain", "text", fn_factory)
    used = vec.groupBy("domain").agg(F.count(F.lit(1)).alias("n_used"))
    return (vector_mean(vec, "vec", ["domain"], "_m").join(used, "domain").join(counts, "domain")
            .select("domain", "n_texts", "n_used", unit("_m", eps).alias("proto")))


def classify_texts(texts: DataFrame, protos: DataFrame, fn_factory=None) -> DataFrame:
    """F5 + P3: (id, truth, pred, score, text) of the rows (id, domain, text)
    whose domain has a prototype; null texts are empty, and a text that the
    encoder maps to zero is as near to all domains: the first one is taken."""
    covered = texts.join(protos.select("domain"), "domain", "left_semi").withColumn("text", F.coalesce("text", F.lit("")))
    vec = batch_encode(covered, "id", "text", fn_factory)
    near = nearest_prototype(vec, "id", "vec", protos)
    return near.join(covered, "id").select("id", F.col("domain").alias("truth"), "pred", "score", "text")


def tracking_report(pred: DataFrame, source: DataFrame, protos: DataFrame, n_perm: int = 2000, seed: int = 0,
                    min_unique: int = 5, sample: int = 10) -> DataFrame:
    """P4 + G2, one nested row: n, accuracy, chance, p_value, wilson_ci_95
    (lo, hi), covered_domains and excluded_domains (sorted lists), n_unique
    (distinct generated texts, not predictions), n_total, domain_lock,
    per_domain_acc (map of domain to hits and n) and generations_sample (the
    first ``sample`` rows by id)."""
    test = perm_test_accuracy(pred.select("id", "pred", "truth"), accuracy(pred), n_perm, seed)
    covered = protos.select("domain")
    excluded = source.select("domain").distinct().join(covered, "domain", "left_anti")
    lists = [df.agg(F.array_sort(F.collect_list("domain")).alias(name)) for df, name in ((covered, "covered_domains"), (excluded, "excluded_domains"))]
    unique = pred.agg(F.countDistinct("text").alias("n_unique"), F.count(F.lit(1)).alias("n_total"))
    by_domain = (accuracy(pred, ["truth"]).agg(F.array_sort(F.collect_list(F.struct("truth", F.struct("hits", "n", "accuracy")))).alias("e"))
                 .select(F.map_from_entries("e").alias("per_domain_acc")))
    first = (pred.orderBy("id").limit(sample).agg(F.array_sort(F.collect_list(F.struct("id", "truth", "text"))).alias("generations_sample")))
    out = test
    for one in (*lists, unique, by_domain, first):
        out = join_group(out, one, ())
    lo, hi = wilson_bounds("hits", "n")
    k = F.size("covered_domains")
    lock = F.col("n_unique") < F.greatest(F.lit(min_unique), F.floor(k / 2))
    return out.select("n", "hits", "accuracy", (F.lit(1.0) / k).alias("chance"), "p_value", F.struct(lo.alias("lo"), hi.alias("hi")).alias("wilson_ci_95"),
                      "covered_domains", "excluded_domains", "n_unique", "n_total", lock.alias("domain_lock"), "per_domain_acc", "generations_sample")


def track_domains(source: DataFrame, texts: DataFrame, per_domain: int = 200, min_texts: int = 3, n_perm: int = 2000,
                  fn_factory=None) -> DataFrame:
    """The whole chain: ``source_texts`` rows and (id, domain, text) of the
    generated texts to ``tracking_report``."""
    source = cut_lineage(source, "source")
    protos = cut_lineage(text_prototypes(source, per_domain, min_texts, fn_factory), "prototypes")
    pred = cut_lineage(classify_texts(texts, protos, fn_factory), "classified")
    return tracking_report(pred, source, protos, n_perm)
