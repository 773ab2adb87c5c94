"""S5-S11 sinks and sources: Parquet append / resume, JSON reports, JSON
config, CSV logs. Paths default to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def write_json_report(df: DataFrame, name: str, path: str | None = None) -> str:
    """One JSON object per row (one row per run)."""
    p = path or scratch_path(df.sparkSession, f"reports/{name}-{uuid.uuid4().hex}")
    df.coalesce(1).write.mode("overwrite").json(p)
    return p


def read_json_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Append rows (each batch is a new set of files; atomic per job)."""
    df.write.mode("append").parquet(path)


def resume_pending(source: DataFrame, done: DataFrame, key_cols) -> DataFrame:
    """Source rows whose key is not yet in the output (anti-join on
    a stable key, not on a row count)."""
    return source.join(done.select(*key_cols).distinct(), list(key_cols), "left_anti")


def parse_json_config(col: str, schema: T.StructType):
    """Typed config from a JSON string column."""
    return F.from_json(F.col(col), schema)


def write_csv_log(df: DataFrame, path: str) -> None:
    """Header + rows, appended batch by batch."""
    df.write.mode("append").option("header", True).csv(path)


def read_csv_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def sibling_path(path: str, suffix: str = "_multi") -> str:
    """``<dir>/<stem><suffix><ext>`` next to an output table."""
    import os
    root, ext = os.path.splitext(path.rstrip("/"))
    return f"{root}{suffix}{ext}"


def write_sibling(df: DataFrame, path: str, suffix: str = "_multi") -> str:
    """Write extra rows (e.g. multi-position rows) beside the main table;
    appended, so a resumed run keeps earlier rows (reference quirk Q3)."""
    p = sibling_path(path, suffix)
    df.write.mode("append").parquet(p)
    return p


def save_vector(df: DataFrame, path: str) -> None:
    """A vector (e.g. the corpus mean) as a one-row Parquet table."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_vector(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
