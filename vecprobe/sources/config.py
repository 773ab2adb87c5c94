"""J3 config fallback, J4 registry lookup, F11 required values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve_config(runs: DataFrame, run_cfg: DataFrame, parent_cfg: DataFrame, value_col: str,
                   default) -> DataFrame:
    """Runs (run, parent) + per-run and per-parent config -> value and the
    level it came from (run, then parent, then default)."""
    r = run_cfg.select("run", F.col(value_col).alias("_r"))
    p = parent_cfg.select("parent", F.col(value_col).alias("_p"))
    j = runs.join(r, "run", "left").join(p, "parent", "left")
    level = F.when(F.col("_r").isNotNull(), "run").when(F.col("_p").isNotNull(), "parent").otherwise("default")
    return j.select("run", "parent", F.coalesce("_r", "_p", F.lit(default)).alias(value_col), level.alias("level"))


# The reference's model-parameter registry (model id -> width,
# depth, injection scale).
MODEL_REGISTRY = [
    ("google/gemma-4-e2b", 1536, 35, 23, 39.19),
    ("google/gemma-4-e4b", 2560, 42, None, 50.5964),
]


def registry_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_REGISTRY, "model_id string, d_model int, n_layers int, "
                                 "default_layer int, injection_scale double")


def registry_lookup(df: DataFrame, key_col: str, registry: DataFrame) -> DataFrame:
    """Case-insensitive lookup (broadcast: the registry is a handful of
    rows); unknown keys come back with ``known = false`` for F11."""
    r = registry.withColumn("_key", F.lower("model_id"))
    j = df.withColumn("_key", F.lower(F.col(key_col))).join(F.broadcast(r), "_key", "left")
    return j.withColumn("known", F.col("model_id").isNotNull()).drop("_key")


def violations(df: DataFrame, checks: dict) -> DataFrame:
    """one row per named check with the number of violating rows."""
    aggs = [F.count_if(c).alias(name) for name, c in checks.items()]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in checks)
    return wide.selectExpr(f"stack({len(checks)}, {stack}) as (violation, n)")


def require(viol: DataFrame) -> None:
    """Fail fast when any check has violations (driver sees one small row per check)."""
    bad = viol.filter(F.col("n") > 0).collect()
    if bad:
        raise ValueError("required values missing: " + ", ".join(f"{r.violation}={r.n}" for r in bad))
