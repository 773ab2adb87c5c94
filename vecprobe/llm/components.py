"""Connected components of an edge table by alternating large and small stars.

Every step is a partial aggregation and an equi-join on edges; a vertex with
very many neighbours is one aggregate row and a join side that adaptive
execution splits, never a list. Labels never reach the driver; it reads one
row of counts per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for every vertex of ``edges`` (long columns ``a`` and
    ``b``, repeated and self edges allowed): the smallest vertex reachable.
    Vertices without an edge to another vertex, and null ends, have no row."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter("u is not null and v is not null and u <> v").distinct())
    e = cut_lineage(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.join(low, "u").filter("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small, "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
