"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_group(df: DataFrame, per_group: DataFrame, group_cols=()) -> DataFrame:
    """Attach a per-group summary (one row per group) to every row.

    With no group columns the summary is a single row: it is joined on a
    constant key and broadcast (size bound: one row). With groups, the join is
    an ordinary equi-join and AQE picks the strategy from runtime sizes."""
    g = list(group_cols)
    if g:
        return df.join(per_group, g)
    one = "_one"
    return (df.withColumn(one, F.lit(1))
            .join(F.broadcast(per_group.withColumn(one, F.lit(1))), one).drop(one))


def round_numeric(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float/double column (the oracle contract)."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
