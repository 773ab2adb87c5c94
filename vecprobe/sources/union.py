"""Union of optional sources."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    local, HDFS and object stores alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def union_sources(spark: SparkSession, paths: dict, text_col: str, rename: dict | None = None,
                  default_domain: str = "unknown") -> DataFrame:
    """Read every existing path, skip those lacking ``text_col`` (warning),
    align by name (missing columns -> null) and tag rows with ``origin``;
    ``domain`` missing -> ``default_domain``."""
    out = None
    for name, path in paths.items():
        if not path_exists(spark, path):
            continue
        df = spark.read.parquet(path)
        if text_col not in df.columns:
            warnings.warn(f"{name}: no column {text_col!r}, excluded")
            continue
        for a, b in (rename or {}).items():
            if a in df.columns:
                df = df.withColumnRenamed(a, b)
        cols = [text_col] + (["domain"] if "domain" in df.columns else [])
        df = df.select(*cols).withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("domain", F.coalesce(F.col("domain").cast("string"), F.lit(default_domain)))
