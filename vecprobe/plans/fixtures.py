"""Derivations of the evaluation inputs from the driver tables (FIXTURES.md §2).

All of them are plain projections / explodes of the given tables, so their
size grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

N_LAYERS = 4


def signal_doc(vec_col: str = "embedding"):
    """Doc with signal: index of the largest of the first 4 components."""
    head = F.slice(F.col(vec_col), 1, 4)
    return (F.array_position(head, F.array_max(head)) - 1).cast("int")


#: SQL of ``turn_key``.
TURN_KEY_SQL = "(conv_id * (SELECT max(turn) + 1 FROM conversations) + turn)"


def turn_key(turns: DataFrame):
    """One integer per (conv_id, turn): turns are numbered in the base of the
    longest conversation, so no two turns share a key."""
    base = (turns.agg(F.max("turn")).first()[0] or 0) + 1
    return F.col("conv_id") * F.lit(base) + F.col("turn")


def signal_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc, vec): embeddings keyed by vec_id, doc = signal_doc."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), signal_doc().alias("doc"),
                    F.col("embedding").alias("vec"))


def label_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc, vec): doc = embeddings.label (signal-free: the fail side)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("doc"),
                    F.col("embedding").alias("vec"))


def layered_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, id, doc, vec): layer k = the k-th of N_LAYERS equal slices of the
    vector (rounded up, so every component is in a layer); one long table so
    every layer is evaluated in the same job."""
    e = read_table(spark, sf_dir, "embeddings")
    width = F.ceil(F.size("embedding") / N_LAYERS).cast("int")
    return (e.select(F.col("vec_id").alias("id"), signal_doc().alias("doc"), "embedding")
            .withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(N_LAYERS - 1))))
            .select("layer", "id", "doc",
                    F.slice("embedding", F.col("layer") * width + 1, width).alias("vec")))
