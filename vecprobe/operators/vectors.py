"""Corpus vector statistics.

The corpus mean is a one-row (per group) aggregate; it is attached to rows by
a join on the group key (a single broadcast row when ungrouped), never
collected to the driver."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, dot, l2_norm, scale_to, subtract
from .common import join_group


def vector_mean(df: DataFrame, vec_col: str = "vec", group_cols=(), name: str = "mean") -> DataFrame:
    """V2: element-wise mean per group as ``array<double>``.

    One partial + final aggregate (Summarizer keeps a d-wide buffer per task),
    so the shuffle is d doubles per task and group regardless of n."""
    g = list(group_cols)
    v = df.select(*g, array_to_vector(as_double(vec_col)).alias("_v"))
    agg = v.groupBy(*g).agg(Summarizer.mean(F.col("_v")).alias("_m")) if g else \
        v.agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return agg.select(*g, vector_to_array("_m").alias(name))


def vector_mean_long(mean_df: DataFrame, name: str = "mean", group_cols=()) -> DataFrame:
    """The mean as rows ``(group..., dim, mean)`` (dim 0-based)."""
    g = list(group_cols)
    return mean_df.select(*g, F.posexplode(name).alias("dim", "mean"))


def mean_center(df: DataFrame, mean_df: DataFrame, vec_col: str = "vec", group_cols=(),
                out_col: str = "centered", mean_col: str = "mean") -> DataFrame:
    """V3: v - corpus mean (mean attached per group)."""
    g = list(group_cols)
    j = join_group(df, mean_df.select(*g, F.col(mean_col).alias("_mean")), g)
    return j.withColumn(out_col, subtract(vec_col, "_mean")).drop("_mean")


def scale_vectors(df: DataFrame, vec_col: str = "vec", target=None, eps: float = 1e-9,
                  out_col: str = "scaled") -> DataFrame:
    """V4: v / (|v| + eps) * target; target defaults to sqrt(width) per row."""
    t = target if target is not None else F.sqrt(F.size(vec_col).cast("double"))
    return df.withColumn(out_col, scale_to(vec_col, t, eps))


def norm_stats(df: DataFrame, vec_col: str = "vec", group_cols=()) -> DataFrame:
    """A7 (+ V6): n, mean / population std / min / max of norms, norm of the
    corpus mean, and the anisotropy share mean(v . mean_hat) / (mean |v| + eps)."""
    g = list(group_cols)
    m = vector_mean(df, vec_col, g)
    j = join_group(df.select(*g, as_double(vec_col).alias("_v")), m, g)
    mnorm = l2_norm("mean")
    j = j.withColumn("_nrm", l2_norm("_v")).withColumn(
        "_proj", dot("_v", "mean") / (mnorm + F.lit(1e-9))).withColumn("_mn", mnorm)
    return j.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("_nrm").alias("norm_mean"), F.stddev_pop("_nrm").alias("norm_std"),
        F.min("_nrm").alias("norm_min"), F.max("_nrm").alias("norm_max"),
        F.first("_mn").alias("mean_activation_norm"),
        (F.avg("_proj") / (F.avg("_nrm") + F.lit(1e-9))).alias("anisotropy_share"))
