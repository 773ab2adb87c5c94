"""Seeded, engine-portable sampling (md5 draws)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import hash_int, hash_key, hash_long, hash_unit
from .common import join_group


def seeded_sample(df: DataFrame, key_col: str, n: int, seed: int) -> DataFrame:
    """K2: n rows without replacement: the n smallest md5(seed|key)
    (a bounded top-n: each task keeps n rows before the final merge)."""
    return df.orderBy(hash_key(F.lit(seed), F.col(key_col)), F.col(key_col)).limit(n)


def step_schedule(indexed: DataFrame, idx_col: str, n_steps_col: str, seed: int) -> DataFrame:
    """K3: one draw with replacement per step 1..n: row index
    md5(seed|step) mod n, resolved by an equi-join on the dense index.
    ``indexed`` carries ``idx`` (0..n-1) and the table size column."""
    steps = indexed.select((F.col(idx_col) + 1).alias("step"), F.col(n_steps_col).alias("_n"))
    draws = steps.select("step", F.pmod(hash_int(F.lit(seed), F.col("step")), F.col("_n")).alias("_draw"))
    return draws.join(indexed.drop(n_steps_col).withColumnRenamed(idx_col, "_draw"), "_draw").drop("_draw")


def token_dropout(tok_col: str, key_col: str, p: float, seed: int):
    """K7: keep each token when its draw u(seed, key, position) >= p; if none
    survive keep the first token."""
    kept = F.filter(F.col(tok_col), lambda x, i: hash_unit(F.lit(seed), F.col(key_col), i) >= F.lit(p))
    return F.when((F.size(kept) == 0) & (F.size(tok_col) > 0), F.slice(tok_col, 1, 1)).otherwise(kept)


def pick_variant(rows: DataFrame, key_cols, variants: DataFrame, order_col: str, text_col: str,
                 fallback_col: str, seed: int) -> DataFrame:
    """J1 + K6: for each row, one of the variants sharing its key (chosen by
    md5(seed|key) mod count, variants ranked by ``order_col``); rows without
    variants keep ``fallback_col``. No per-key list is collected: the pick
    is an equi-join on (key, rank)."""
    k = list(key_cols)
    w = Window.partitionBy(*k).orderBy(order_col)
    ranked = variants.select(*k, text_col, (F.row_number().over(w) - 1).alias("_rank"))
    cnt = variants.groupBy(*k).agg(F.count(F.lit(1)).alias("_nv"))
    pick = rows.join(cnt, k, "left").withColumn(
        "_rank", F.pmod(hash_int(F.lit(seed), *[F.col(c) for c in k]), F.col("_nv")))
    j = pick.join(ranked.withColumnRenamed(text_col, "_variant"), k + ["_rank"], "left")
    return j.withColumn("label", F.coalesce(F.col("_variant"), F.col(fallback_col))).drop(
        "_nv", "_rank", "_variant")


# The smallest primes above 2**40; each is coprime to any smaller pool size.
STRIDES = [1099511627791, 1099511627803, 1099511627831, 1099511627873,
           1099511627891, 1099511627917, 1099511627933, 1099511627953]


def _pool_images(a: DataFrame, pool_size, n_images, to_gidx, by_g: DataFrame, seed: int, tag: str) -> DataFrame:
    """(id, neg_id, _o): the first ``n_images`` images of a keyed bijection of
    the pool's index, t -> (start + t * stride) mod size with start and stride
    drawn by anchor. Images never repeat, so any quota up to the size fills."""
    d = (a.filter((n_images > 0) & (pool_size > 0))
         .withColumn("_t", F.explode(F.sequence(F.lit(0), F.least(n_images, pool_size).cast("int") - 1))))
    start = F.pmod(hash_long(F.lit(seed), F.col("id"), F.lit(tag)), pool_size)
    stride = F.element_at(F.array(*[F.lit(p) for p in STRIDES]),
                          F.pmod(hash_int(F.lit(seed), F.col("id"), F.lit(tag), F.lit("stride")), F.lit(8)).cast("int") + 1)
    j = F.pmod(start + F.col("_t") * F.pmod(stride, pool_size), pool_size)
    return (d.withColumn("_g", to_gidx(j)).join(by_g, "_g")
            .select("id", "neg_id", F.col("_t").alias("_o")))


def domain_negatives(rows: DataFrame, id_col: str, domain_col: str, k: int, seed: int,
                     domain_aware: bool = True) -> DataFrame:
    """K4 / K5: up to k negatives per anchor: never the anchor, never repeated.

    Domain-aware: min(k // 2, pool) from the anchor's domain, then up to the
    rest from other domains, then padded from everything left. Candidates per
    anchor are bounded (O(k)); pools are addressed through a dense
    (domain, index) numbering, so no anchor x pool pairs are formed."""
    from .significance import id_index
    r = rows.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("dom"))
    if not domain_aware:
        r = r.withColumn("dom", F.lit(""))
    sizes = r.groupBy("dom").agg(F.count(F.lit(1)).alias("n_d"))
    offs = sizes.withColumn("off", F.coalesce(F.sum("n_d").over(
        Window.orderBy("dom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("n_d").alias("N"))
    # per-domain numbering in id-range buckets: a domain holding most rows is
    # split over many window partitions instead of one task
    ix = id_index(r, ["dom"], "id", "didx", n_rows=r.count()).join(offs, "dom")
    a = join_group(ix, total, ()).withColumn("gidx", F.col("off") + F.col("didx"))
    a = a.select("id", "n_d", "off", "didx", "gidx", "N")
    by_g = a.select(F.col("gidx").alias("_g"), F.col("id").alias("neg_id"))
    half = k // 2 if domain_aware else 0
    parts = []
    n_same = F.lit(0)
    if half > 0:
        q_s = F.least(F.lit(half), F.col("n_d") - 1)
        parts.append(_pool_images(a, F.col("n_d") - 1, q_s,
                                  lambda j: F.col("off") + F.when(j >= F.col("didx"), j + 1).otherwise(j),
                                  by_g, seed, "s").drop("_o"))
        n_same = q_s
    q_o = F.least(F.lit(k) - n_same, F.col("N") - F.col("n_d"))
    if domain_aware:
        parts.append(_pool_images(a, F.col("N") - F.col("n_d"), q_o,
                                  lambda j: F.when(j < F.col("off"), j).otherwise(j + F.col("n_d")),
                                  by_g, seed, "o").drop("_o"))
    chosen = parts[0] if parts else a.select("id", F.col("id").alias("neg_id")).filter(F.lit(False))
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    have = chosen.groupBy("id").agg(F.count(F.lit(1)).alias("_nh"))
    b = a.join(have, "id", "left").withColumn("_nh", F.coalesce("_nh", F.lit(0)).cast("int"))
    need = F.least(F.lit(k) - F.col("_nh"), F.col("N") - 1 - F.col("_nh"))
    # at most k of the first 2k images are chosen already, so k fresh ones remain
    pad_c = _pool_images(b.filter(need > 0), F.col("N") - 1, F.lit(2 * k),
                         lambda j: F.when(j >= F.col("gidx"), j + 1).otherwise(j), by_g, seed, "p")
    pad_c = pad_c.join(chosen, ["id", "neg_id"], "left_anti")
    w = Window.partitionBy("id").orderBy("_o")
    pad = (pad_c.join(b.select("id", need.alias("_q")), "id").withColumn("_r", F.row_number().over(w))
           .filter(F.col("_r") <= F.col("_q")).select("id", "neg_id"))
    return chosen.unionByName(pad)
