"""Rollout / training-log queries over ``events`` (FIXTURES §2): run =
user_id, rows ordered by (ts, event_id), four consecutive rows = one step's
group of completions, reward = value, completion text = event_type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.indexing import range_index
from ..operators.rollouts import (argmax_rows, bucketed_running_sum, group_advantage, infonce,
                                  loss_trend, quartile_means, range_means, rollout_loss, rolling, step_summary,
                                  sustained)
from ..sources.tables import read_table
from .registry import register

# Fixed values from the reference: group size, rolling-uniqueness width,
# rolling reward width, loss-trend bar, collapse bar.
GROUP = 4
UNIQUE_WINDOW = 5
REWARD_WINDOW = 10
CKPT_EVERY = 5          # fixture runs are short: a checkpoint every 5 steps
P_BAR = 0.05
MIN_UNIQUE = 5

_RO_SQL = f"""
ro0 AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
               value AS reward, event_type AS text FROM events),
ro AS (SELECT run, pos // {GROUP} + 1 AS step, pos % {GROUP} AS gi, reward, text FROM ro0),
adv AS (SELECT *, reward - avg(reward) OVER (PARTITION BY run, step) AS adv FROM ro),
advc AS (SELECT *, greatest(-2.0, least(2.0, adv)) AS adv_clip,
                bool_and(abs(adv) < 1e-6) OVER (PARTITION BY run, step) AS zero_var FROM adv),
steps AS (SELECT run, step, avg(reward) AS mean_reward, count(*) AS g,
                 count_if(abs(adv) > 1e-6) AS n_nonzero, bool_and(zero_var) AS skipped FROM advc GROUP BY run, step)"""


# runs longer than this many steps are windowed in step buckets (halo /
# prefix offsets), so one hot run is spread over many tasks
BUCKET_STEPS = 100_000


def _event_positions(spark, sf_dir):
    """events + 0-based position inside the run by (ts, event_id), ranked in
    timestamp-range buckets when the table is large."""
    e = read_table(spark, sf_dir, "events")
    return range_index(e, ["ts", "event_id"], ["user_id"], "pos", F.unix_micros(F.col("ts").cast("timestamp")))


def rollouts(spark, sf_dir):
    """(run, step, gi, reward, text): events as grouped rollouts."""
    e = _event_positions(spark, sf_dir)
    return (e.select(F.col("user_id").alias("run"), "pos",
                     F.col("value").alias("reward"), F.col("event_type").alias("text"))
            .select("run", (F.floor(F.col("pos") / GROUP) + 1).alias("step"),
                    (F.col("pos") % GROUP).cast("bigint").alias("gi"), "reward", "text"))


def step_log(spark, sf_dir):
    adv = group_advantage(rollouts(spark, sf_dir), ["run", "step"])
    return step_summary(adv, ["run", "step"])


@register("last_position_rows", """
SELECT source, doc_id, n_chars FROM (
  SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r
  FROM documents) WHERE r = 1""")
def q_last_position_rows(spark, sf_dir):
    """One row per group (source) at the arg-max length, first id on ties."""
    d = read_table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return argmax_rows(d, ["source"], "n_chars", "doc_id")


@register("group_advantage", f"""
WITH {_RO_SQL}
SELECT run, step, round(mean_reward, 6) AS mean_reward, g, n_nonzero::BIGINT AS n_nonzero, skipped,
       round(CASE WHEN skipped THEN 0.0 ELSE n_nonzero::DOUBLE / g END, 6) AS frac_nonzero FROM steps""")
def q_group_advantage(spark, sf_dir):
    """Group-relative advantages: mean, non-zero count/fraction, skip flag."""
    return step_log(spark, sf_dir)


@register("group_advantage_std", f"""
WITH {_RO_SQL},
sd AS (SELECT *, stddev_pop(reward) OVER (PARTITION BY run, step) AS s FROM ro)
SELECT run, step, gi,
       round(CASE WHEN s > 0 THEN (reward - avg(reward) OVER (PARTITION BY run, step)) / s ELSE 0.0 END, 6) AS adv,
       round(greatest(-2.0, least(2.0, CASE WHEN s > 0 THEN (reward - avg(reward) OVER (PARTITION BY run, step)) / s ELSE 0.0 END)), 6) AS adv_clip
FROM sd""")
def q_group_advantage_std(spark, sf_dir):
    """Standardized advantage (population std, zero std -> 0), clipped."""
    a = group_advantage(rollouts(spark, sf_dir), ["run", "step"], standardize=True)
    return a.select("run", "step", "gi", "adv", "adv_clip")


@register("rolling_unique", f"""
WITH {_RO_SQL}
SELECT run, step, count(DISTINCT text) OVER (PARTITION BY run ORDER BY step
                                             ROWS BETWEEN {UNIQUE_WINDOW - 1} PRECEDING AND CURRENT ROW) AS n_unique_5
FROM ro WHERE gi = 0""")
def q_rolling_unique(spark, sf_dir):
    """Distinct first-completion texts over the last 5 steps."""
    r = rollouts(spark, sf_dir).filter(F.col("gi") == 0)
    out = rolling(r, ["run"], "step", F.collect_set("text"), UNIQUE_WINDOW, "n_unique_5", BUCKET_STEPS, F.size)
    return out.select("run", "step", F.col("n_unique_5").cast("bigint").alias("n_unique_5"))


@register("rolling_reward", f"""
WITH {_RO_SQL},
rr AS (SELECT run, step, avg(mean_reward) OVER (PARTITION BY run ORDER BY step
                                            ROWS BETWEEN {REWARD_WINDOW - 1} PRECEDING AND CURRENT ROW) AS m FROM steps)
SELECT run, step, round(m, 6) AS mean_reward_last10 FROM rr WHERE step % {CKPT_EVERY} = 0""")
def q_rolling_reward(spark, sf_dir):
    """Mean of the last 10 logged step rewards at every checkpoint step."""
    s = step_log(spark, sf_dir)
    r = rolling(s, ["run"], "step", F.avg("mean_reward"), REWARD_WINDOW, "mean_reward_last10", BUCKET_STEPS)
    return r.filter(F.col("step") % CKPT_EVERY == 0).select("run", "step", "mean_reward_last10")


_LOG_SQL = """
lg AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
              value AS loss, event_type = 'error' AS skip FROM events)"""


def train_log(spark, sf_dir):
    """(run, step, loss, skip): events as a training log; 'error' = skipped step."""
    e = _event_positions(spark, sf_dir)
    return e.select(F.col("user_id").alias("run"), (F.col("pos") + 1).cast("bigint").alias("step"),
                    F.col("value").alias("loss"), (F.col("event_type") == "error").alias("skip"))


@register("cumulative_skips", f"""
WITH {_LOG_SQL},
c AS (SELECT *, sum(skip::INTEGER) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS skipped FROM lg)
SELECT run, step, round(loss, 6) AS loss, skipped::BIGINT AS skipped FROM c WHERE NOT skip""")
def q_cumulative_skips(spark, sf_dir):
    """Logged steps carry the running count of skipped steps."""
    lg = train_log(spark, sf_dir)
    c = bucketed_running_sum(lg, ["run"], "step", F.col("skip").cast("int"), "skipped", BUCKET_STEPS) \
        .withColumn("skipped", F.col("skipped").cast("bigint"))
    return c.filter(~F.col("skip")).select("run", F.col("step").cast("bigint").alias("step"), "loss", "skipped")


_CKPT_SQL = f"""
ck AS (SELECT user_id AS run, date_trunc('day', ts) AS ckpt, min(value) / 100.0 AS p,
              count(DISTINCT event_type) AS n_unique, count(*) AS n FROM events GROUP BY 1, 2),
ckf AS (SELECT *, p < {P_BAR} AS sig,
               coalesce(lag(p < {P_BAR}) OVER (PARTITION BY run ORDER BY ckpt), false) AS prev FROM ck),
sus AS (SELECT run, bool_or(sig AND prev) AS sustained FROM ckf GROUP BY run)"""


def checkpoint_evals(spark, sf_dir):
    """(run, ckpt, p, n_unique, n): one evaluation per (run, day) checkpoint."""
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("run"), F.date_trunc("day", "ts").alias("ckpt")).agg(
        (F.min("value") / 100.0).alias("p"), F.countDistinct("event_type").alias("n_unique"),
        F.count(F.lit(1)).alias("n"))


@register("sustained_gate", f"""
WITH {_CKPT_SQL}
SELECT run, sustained FROM sus""")
def q_sustained_gate(spark, sf_dir):
    """P < 0.05 at two consecutive checkpoints of a run."""
    ck = checkpoint_evals(spark, sf_dir)
    return sustained(ck, ["run"], "ckpt", F.col("p") < P_BAR, 2)


@register("reward_trajectory", f"""
WITH {_RO_SQL},
q AS (SELECT run, step, mean_reward, ntile(4) OVER (PARTITION BY run ORDER BY step) AS quartile FROM steps),
mx AS (SELECT run, max(mean_reward) AS max_reward FROM steps GROUP BY run)
SELECT q.run, quartile::INTEGER AS quartile, round(avg(mean_reward), 6) AS mean_reward, round(any_value(mx.max_reward), 6) AS max_reward
FROM q JOIN mx USING (run) GROUP BY q.run, quartile""")
def q_reward_trajectory(spark, sf_dir):
    """Quartile means of the step reward and the best single step."""
    return quartile_means(step_log(spark, sf_dir), ["run"], "step", "mean_reward")


# Fixed values from the reference: the step ranges of its reward trajectory.
STEP_RANGES = (("steps_1_100", 1, 100), ("steps_201_400", 201, 400), ("steps_401_600", 401, 600))


@register("reward_ranges", f"""
WITH {_RO_SQL},
rg AS (SELECT * FROM (VALUES {", ".join(map(str, STEP_RANGES))}) t(steps, lo, hi))
SELECT run, rg.steps AS steps, count(*) AS n_steps, round(sum(mean_reward::DECIMAL(38, 9))::DOUBLE / count(*), 6) AS mean_reward,
       round(max(mean_reward), 6) AS max_single_step
FROM steps s JOIN rg ON step BETWEEN lo AND hi GROUP BY run, rg.steps""")
def q_reward_ranges(spark, sf_dir):
    """Mean and best step reward of each run's fixed ranges of steps."""
    return range_means(step_log(spark, sf_dir), ["run"], "step", "mean_reward", STEP_RANGES)


@register("loss_trend_gate", f"""
WITH {_LOG_SQL}
SELECT run, round(regr_slope(loss, step), 6) AS slope, round(regr_r2(loss, step), 6) AS r2,
       regr_slope(loss, step) < -0.002 AND regr_r2(loss, step) >= 0.10 AS gate
FROM lg GROUP BY run""")
def q_loss_trend_gate(spark, sf_dir):
    """Loss-on-step regression slope and R^2 with the kill-gate bar."""
    return loss_trend(train_log(spark, sf_dir), ["run"], "step", "loss")


@register("infonce_loss", f"""
WITH {_RO_SQL},
x AS (SELECT run, step, gi, reward / 100.0 AS loss, -(reward / 100.0) AS x FROM ro),
m AS (SELECT run, step, max(x) AS m FROM x GROUP BY run, step)
SELECT run, step, round(max(CASE WHEN gi = 0 THEN loss END) + any_value(m.m) + ln(sum(exp(x - m.m))), 6) AS infonce
FROM x JOIN m USING (run, step) GROUP BY run, step""")
def q_infonce_loss(spark, sf_dir):
    """A10: contrastive loss with completion 0 as the positive (T = 1, beta = 1)."""
    r = rollouts(spark, sf_dir).withColumn("loss", F.col("reward") / 100.0)
    return infonce(r, ["run", "step"], "loss", F.col("gi") == 0, 1.0, 1.0)


@register("rollout_loss", f"""
WITH {_RO_SQL},
c AS (SELECT run, step, gi, adv, adv_clip, -ln(1 + reward) AS mlp FROM advc),
s AS (SELECT run, step, sum(CASE WHEN abs(adv) >= 1e-6 THEN -adv_clip * mlp END) AS tot,
             count_if(abs(adv) > 1e-6) AS nz FROM c GROUP BY run, step)
SELECT run, step, round(CASE WHEN nz > 0 THEN tot / nz ELSE 0.0 END, 6) AS loss FROM s""")
def q_rollout_loss(spark, sf_dir):
    """Policy loss per step group (token log-prob stand-in = -ln(1 + reward))."""
    a = group_advantage(rollouts(spark, sf_dir), ["run", "step"])
    a = a.withColumn("logp", -F.log1p("reward"))
    return rollout_loss(a, ["run", "step"], "logp", "gi")


@register("success_bar", f"""
WITH {_CKPT_SQL}, {_LOG_SQL},
last AS (SELECT run, arg_max(n_unique, ckpt) AS n_unique, arg_max(n, ckpt) AS n FROM ck GROUP BY run),
tr AS (SELECT run, regr_slope(loss, step) < -0.002 AND regr_r2(loss, step) >= 0.10 AS loss_gate FROM lg GROUP BY run)
SELECT s.run, s.sustained, l.n_unique >= {MIN_UNIQUE} AS not_collapsed,
       l.n_unique::DOUBLE / l.n >= 0.8 AS unique_ok, t.loss_gate,
       s.sustained AND l.n_unique >= {MIN_UNIQUE} AND l.n_unique::DOUBLE / l.n >= 0.8 AND t.loss_gate AS success
FROM sus s JOIN last l USING (run) JOIN tr t USING (run)""")
def q_success_bar(spark, sf_dir):
    """Four pre-registered bars per run -> success."""
    ck = checkpoint_evals(spark, sf_dir)
    sus = sustained(ck, ["run"], "ckpt", F.col("p") < P_BAR, 2)
    last = ck.groupBy("run").agg(F.max_by(F.struct("n_unique", "n"), "ckpt").alias("_l"))
    tr = loss_trend(train_log(spark, sf_dir), ["run"], "step", "loss").select("run", F.col("gate").alias("loss_gate"))
    j = sus.join(last, "run").join(tr, "run")
    nc = F.col("_l.n_unique") >= MIN_UNIQUE
    uo = F.col("_l.n_unique") / F.col("_l.n") >= 0.8
    return j.select("run", "sustained", nc.alias("not_collapsed"), uo.alias("unique_ok"), "loss_gate",
                    (F.col("sustained") & nc & uo & F.col("loss_gate")).alias("success"))
