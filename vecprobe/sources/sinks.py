"""Restartable sinks: S5 / S6 batches, the S11 log, and S12 discovery by path.

A batch is a folder named by its id that a repeated write replaces, so a batch
that runs again after a crash leaves one copy, and readers find the id as the
``batch`` column. Ids sort as texts; ``batch_id`` pads numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File of the log's header; readers skip names that begin with an underscore.
HEADER = "_header.csv"


def batch_id(n: int) -> str:
    return f"{n:012d}"


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """Rows of one batch; writing a batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches with their ``batch`` (string); schema without it."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(path)


def append_log(df: DataFrame, path: str, batch: str) -> None:
    """One batch of a CSV log. The header is written once, beside the
    batches, which hold rows only; columns must be those of the first batch."""
    spark, path = df.sparkSession, path.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    head = hadoop.Path(f"{path}/{HEADER}")
    files = head.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    line = ",".join(df.columns) + "\n"
    if files.exists(head):
        f = files.open(head)
        known = bytes(f.readAllBytes()).decode()
        f.close()
        if known != line:
            raise ValueError(f"{path} holds the columns {known.strip()}")
    else:
        f = files.create(head, False)
        f.write(bytearray(line.encode()))
        f.close()
    df.write.mode("overwrite").option("header", False).csv(f"{path}/batch={batch}")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log's rows, typed, with their ``batch``; schema without it."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).option("header", False).csv(path)


def tail(df: DataFrame, order_cols, n: int = 10) -> DataFrame:
    """The last ``n`` rows by ``order_cols``, in that order. Each task keeps n
    rows; the table is not sorted."""
    last = df.orderBy(*[F.col(c).desc_nulls_last() for c in order_cols]).limit(n)
    return last.orderBy(*order_cols)


def write_checkpoints(df: DataFrame, path: str, ckpt_col: str) -> None:
    """One folder ``<path>/ckpt=<name>`` per value of ``ckpt_col``."""
    df.withColumnRenamed(ckpt_col, "ckpt").write.mode("overwrite").partitionBy("ckpt").parquet(path)


def discover_checkpoints(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """The rows of every checkpoint folder that ``glob`` matches, with
    ``ckpt``, the folder's own name, and ``tag``, its parent's name and its own,
    both read from the files' paths; no folder is listed on the driver twice and
    all checkpoints are read in one job. A glob without a match is an error."""
    rows = spark.read.schema(schema).parquet(glob)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    name = F.regexp_replace(F.url_decode(folder), "^ckpt=", "")
    return rows.select("*", name.alias("ckpt"), F.concat_ws("_", F.url_decode(parent), name).alias("tag"))
