"""Dense 0-based row index without a single-partition window.

Rows are cut into order-preserving buckets (a monotone function of the sort
key, e.g. the leading hex digits of an md5 key or a slice of the id range);
per-bucket counts give each bucket's offset (a table of groups x buckets),
and a window *inside* each bucket gives the local rank. Every step is a pure
function of the data, so re-running a lost task reproduces the same index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000


def hex_bucket(hex_col, n_buckets: int) -> Column:
    """Monotone bucket of an md5 hex key: leading 8 hex digits scaled to n."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    lead = F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint")
    return F.floor(lead * F.lit(n_buckets) / F.lit(16 ** 8))


def dense_index(df: DataFrame, order_cols, group_cols=(), name: str = "idx",
                bucket: Column | None = None) -> DataFrame:
    """Add ``name`` = 0-based rank inside the group by ``order_cols``.

    ``bucket`` must be non-decreasing in the order; None means one bucket per
    group (use for groups known to be small). ``order_cols`` must be a total
    order inside the group."""
    g = list(group_cols)
    if bucket is None:
        # one bucket per group: the rank is the index, no offsets needed
        w = Window.partitionBy(*g).orderBy(*order_cols) if g else Window.orderBy(*order_cols)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    d = df.withColumn("_bkt", bucket)
    cnt = d.groupBy(*g, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1) \
        if g else Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*g, "_bkt").orderBy(*order_cols)
    ranked = d.withColumn("_r", F.row_number().over(local) - 1)
    return (ranked.join(off, g + ["_bkt"])
            .withColumn(name, F.col("_off") + F.col("_r"))
            .drop("_bkt", "_off", "_r"))


def id_range_bucket(df: DataFrame, id_col: str, n_buckets: int) -> tuple[DataFrame, Column]:
    """Attach the global id range and return a monotone id bucket."""
    rng = df.agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi"))
    d = (df.withColumn("_one", F.lit(1))
         .join(F.broadcast(rng.withColumn("_one", F.lit(1))), "_one").drop("_one"))
    b = ((F.col(id_col) - F.col("_lo")).cast("double") * F.lit(n_buckets)
         / (F.col("_hi") - F.col("_lo") + F.lit(1)).cast("double")).cast("bigint")
    return d, b


def buckets_for(n_rows: int) -> int:
    """Buckets of about ROWS_PER_BUCKET rows; their number has no ceiling."""
    return n_rows // ROWS_PER_BUCKET + 1


def range_index(df: DataFrame, order_cols, group_cols, name: str, numeric_col,
                n_rows: int | None = None) -> DataFrame:
    """0-based rank by ``order_cols`` inside each group; ``numeric_col`` (a
    column monotone in the order, e.g. a timestamp in micros) cuts large
    inputs into global range buckets, so a group holding most rows is ranked
    by many tasks."""
    n = n_rows if n_rows is not None else df.count()
    nb = buckets_for(n)
    d = df.withColumn("_rk", numeric_col)
    d, b = id_range_bucket(d, "_rk", nb)
    return dense_index(d, order_cols, group_cols, name, b).drop("_rk", "_lo", "_hi")
