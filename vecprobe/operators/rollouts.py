"""Rollout scoring and training-log analytics: W1-W5, W7, W8, A8-A11, G7.

All of them are window functions partitioned by run (and step group) or
grouped aggregates; none collects a run into a driver-side list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO_ADV = 1e-6   # |advantage| below this counts as zero (fixed value)
ADV_CLIP = 2.0    # advantages are clipped to +-2 (fixed value)


def argmax_rows(df: DataFrame, key_cols, score_col: str, tie_col: str) -> DataFrame:
    """One row per key with the largest ``score_col``; ties -> smallest
    ``tie_col``. A partial+final aggregate (max_by on a struct), so a hot key
    is reduced map-side instead of being sorted in one task."""
    k = list(key_cols)
    others = [c for c in df.columns if c not in k]
    best = df.groupBy(*k).agg(F.max_by(F.struct(*[F.col(c) for c in others]),
                                       F.struct(F.col(score_col), -F.col(tie_col))).alias("_b"))
    return best.select(*k, *[F.col(f"_b.{c}").alias(c) for c in others])


def group_advantage(df: DataFrame, group_cols, reward_col: str = "reward",
                    standardize: bool = False) -> DataFrame:
    """R - mean(r) in each group (optionally / population std, zero
    std -> 0), clipped to +-2, plus the group's zero-variance flag."""
    w = Window.partitionBy(*group_cols)
    adv = F.col(reward_col) - F.avg(reward_col).over(w)
    if standardize:
        sd = F.stddev_pop(reward_col).over(w)
        adv = F.when(sd > 0, adv / sd).otherwise(F.lit(0.0))
    out = df.withColumn("adv", adv)
    out = out.withColumn("adv_clip", F.greatest(F.lit(-ADV_CLIP), F.least(F.lit(ADV_CLIP), F.col("adv"))))
    return out.withColumn("zero_var", F.max(F.abs("adv") >= ZERO_ADV).over(w) == F.lit(False))


def step_summary(adv: DataFrame, group_cols, reward_col: str = "reward") -> DataFrame:
    """Per group: mean reward, non-zero advantages, their fraction (0 when the
    group is skipped) and the skip flag."""
    s = adv.groupBy(*group_cols).agg(
        F.avg(reward_col).alias("mean_reward"), F.count(F.lit(1)).alias("g"),
        F.count_if(F.abs("adv") > ZERO_ADV).alias("n_nonzero"),
        F.min("zero_var").alias("skipped"))
    return s.withColumn("frac_nonzero", F.when(F.col("skipped"), F.lit(0.0))
                        .otherwise(F.col("n_nonzero") / F.col("g")))


def _halo(df: DataFrame, part_cols, step_col: str, width: int, bucket_steps: int) -> DataFrame:
    """Rows tagged with their step bucket, plus copies of the last width-1
    rows of the previous bucket (``_own`` = false) so bounded look-back frames
    are exact inside each bucket. Needs bucket_steps >= width - 1."""
    if bucket_steps < width - 1:
        raise ValueError(f"bucket_steps ({bucket_steps}) must be >= width - 1 ({width - 1})")
    b = F.floor((F.col(step_col) - 1) / F.lit(bucket_steps)).cast("bigint")
    own = df.withColumn("_bkt", b).withColumn("_own", F.lit(True))
    pos_in = (F.col(step_col) - 1) - F.col("_bkt") * F.lit(bucket_steps)
    halo = (own.filter(pos_in >= F.lit(bucket_steps - (width - 1)))
            .withColumn("_bkt", F.col("_bkt") + 1).withColumn("_own", F.lit(False)))
    return own.unionByName(halo)


def rolling(df: DataFrame, part_cols, step_col: str, agg_fn, width: int, out_col: str,
            bucket_steps: int | None = None, post=None) -> DataFrame:
    """``agg_fn`` over the last ``width`` rows of each partition
    (rows ordered by a dense 1-based ``step_col``). With ``bucket_steps`` the
    partition is cut into step buckets with a halo, so one long run is spread
    over many tasks; results are identical."""
    if not bucket_steps:
        w = Window.partitionBy(*part_cols).orderBy(step_col).rowsBetween(-(width - 1), 0)
        v = agg_fn.over(w)
        return df.withColumn(out_col, post(v) if post else v)
    h = _halo(df, part_cols, step_col, width, bucket_steps)
    w = Window.partitionBy(*part_cols, "_bkt").orderBy(step_col).rowsBetween(-(width - 1), 0)
    v = agg_fn.over(w)
    return h.withColumn(out_col, post(v) if post else v).filter("_own").drop("_bkt", "_own")


def rolling_distinct(df: DataFrame, part_cols, order_cols, value_col: str, width: int) -> Column:
    """Distinct values among the last ``width`` rows (bounded window)."""
    w = Window.partitionBy(*part_cols).orderBy(*order_cols).rowsBetween(-(width - 1), 0)
    return F.size(F.collect_set(value_col).over(w))


def rolling_mean(part_cols, order_cols, value_col: str, width: int) -> Column:
    """Mean of the last ``width`` rows."""
    w = Window.partitionBy(*part_cols).orderBy(*order_cols).rowsBetween(-(width - 1), 0)
    return F.avg(value_col).over(w)


def running_sum(part_cols, order_cols, value) -> Column:
    """Cumulative sum from the start of the partition."""
    w = Window.partitionBy(*part_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(w)


def bucketed_running_sum(df: DataFrame, part_cols, step_col: str, value, out_col: str,
                         bucket_steps: int) -> DataFrame:
    """W7 for long runs: running sum inside step buckets plus the totals of
    the run's earlier buckets (a runs x buckets table)."""
    b = F.floor((F.col(step_col) - 1) / F.lit(bucket_steps)).cast("bigint")
    d = df.withColumn("_bkt", b).withColumn("_v", value)
    tot = d.groupBy(*part_cols, "_bkt").agg(F.sum("_v").alias("_t"))
    prev = Window.partitionBy(*part_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_t").over(prev), F.lit(0))).drop("_t")
    inb = Window.partitionBy(*part_cols, "_bkt").orderBy(step_col).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn("_in", F.sum("_v").over(inb)).join(off, list(part_cols) + ["_bkt"])
            .withColumn(out_col, F.col("_off") + F.col("_in")).drop("_bkt", "_v", "_in", "_off"))


def sustained(df: DataFrame, part_cols, order_col: str, flag: Column, k: int = 2) -> DataFrame:
    """Does ``flag`` hold at >= k consecutive checkpoints in a partition."""
    w = Window.partitionBy(*part_cols).orderBy(order_col)
    run = F.lit(True)
    for i in range(1, k):
        run = run & F.coalesce(F.lag(flag, i).over(w), F.lit(False))
    return (df.withColumn("_streak", flag & run).groupBy(*part_cols)
            .agg(F.max("_streak").alias("sustained")))


def ntile_of(pos, n, k: int) -> Column:
    """ntile(k) of the 1-based position ``pos`` among ``n`` rows, as arithmetic
    (tiles differ by at most one row; the first n mod k tiles are larger)."""
    q = F.floor(n / F.lit(k))
    rem = n - q * F.lit(k)
    big = rem * (q + 1)
    return F.when(pos <= big, F.floor((pos - 1) / (q + 1)) + 1) \
        .otherwise(rem + F.floor((pos - big - 1) / q) + 1).cast("int")


def quartile_means(df: DataFrame, part_cols, order_col: str, value_col: str) -> DataFrame:
    """Mean per ntile(4) bucket of the steps, plus the overall max.

    ``order_col`` must be a dense 1..n position (as rollout steps are), so the
    tile is arithmetic on a per-run count instead of a per-run sorted window."""
    stats = df.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("_n"), F.max(value_col).alias("max_reward"))
    q = df.join(stats, list(part_cols)).withColumn("quartile", ntile_of(F.col(order_col), F.col("_n"), 4))
    return q.groupBy(*part_cols, "quartile").agg(F.avg(value_col).alias("mean_reward"),
                                                 F.first("max_reward").alias("max_reward"))


def range_means(df: DataFrame, part_cols, order_col: str, value_col: str, ranges) -> DataFrame:
    """Mean and largest value of each named range of steps, ``ranges`` =
    (name, first, last), both ends included. A step finds its ranges, which may
    overlap, in a list that stands in the plan; a range without steps has no
    row. Values are summed to nine decimals, so that a mean does not depend on
    the order of the rows."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, lo, hi in ranges])
    inside = F.filter(table, lambda r: F.col(order_col).between(r["lo"], r["hi"]))
    rows = df.select(*part_cols, value_col, F.explode(F.transform(inside, lambda r: r["name"])).alias("steps"))
    return rows.groupBy(*part_cols, "steps").agg(F.count(F.lit(1)).alias("n_steps"),
                                                 (F.sum(F.col(value_col).cast("decimal(38,9)")).cast("double") / F.count(F.lit(1))).alias("mean_reward"),
                                                 F.max(value_col).alias("max_single_step"))


def loss_trend(df: DataFrame, part_cols, step_col: str, loss_col: str,
               max_slope: float = -0.002, min_r2: float = 0.10) -> DataFrame:
    """Least-squares slope and R^2 of loss on step; gate = slope < -0.002
    and R^2 >= 0.10 (the reference's pre-registered bar)."""
    return (df.groupBy(*part_cols).agg(F.regr_slope(loss_col, step_col).alias("slope"),
                                       F.regr_r2(loss_col, step_col).alias("r2"))
            .withColumn("gate", (F.col("slope") < max_slope) & (F.col("r2") >= min_r2)))


def infonce(df: DataFrame, group_cols, loss_col: str, is_pos: Column, temp: float = 1.0,
            beta: float = 1.0) -> DataFrame:
    """A10: beta * (loss_pos/T + logsumexp(-loss/T over positive and negatives)),
    a grouped stable log-sum-exp (max, then sum of exp(x - max))."""
    x = -F.col(loss_col) / F.lit(temp)
    g = df.withColumn("_x", x).withColumn("_pos", F.when(is_pos, F.col(loss_col)))
    m = g.groupBy(*group_cols).agg(F.max("_x").alias("_m"))
    j = g.join(m, list(group_cols))
    return j.groupBy(*group_cols).agg(
        (F.lit(beta) * (F.max("_pos") / F.lit(temp)
                        + F.max("_m") + F.log(F.sum(F.exp(F.col("_x") - F.col("_m")))))).alias("infonce"))


def rollout_loss(adv: DataFrame, group_cols, logp_col: str, completion_col: str) -> DataFrame:
    """Per group, -sum(adv_clip * mean token log-prob) over completions
    with a non-zero advantage, divided by their count; skipped groups -> 0.
    ``adv`` has one row per token: (group, completion, adv, adv_clip, logp)."""
    comp = adv.groupBy(*group_cols, completion_col).agg(
        F.avg(logp_col).alias("_mlp"), F.first("adv").alias("adv"), F.first("adv_clip").alias("adv_clip"))
    live = F.abs("adv") >= ZERO_ADV
    s = comp.groupBy(*group_cols).agg(
        F.sum(F.when(live, -F.col("adv_clip") * F.col("_mlp"))).alias("_tot"),
        F.count_if(F.abs("adv") > ZERO_ADV).alias("_nz"))
    return s.select(*group_cols, F.when(F.col("_nz") > 0, F.col("_tot") / F.col("_nz"))
                    .otherwise(F.lit(0.0)).alias("loss"))
