"""Hand-checkable golden values (FIXTURES.md part 3)."""

import math

import pytest
from pyspark.sql import functions as F

from vecprobe.functions.stats import wilson_bounds
from vecprobe.functions.text import tag_extract
from vecprobe.functions.vectors import l2_norm, scale_to
from vecprobe.operators.corpus import layer_grid, sample_positions
from vecprobe.operators.rollouts import group_advantage, infonce, step_summary
from vecprobe.operators.tfidf import combined_reward


@pytest.mark.parametrize("k,n,lo,hi", [
    (1, 20, 0.008881219432873136, 0.23613589351256675),
    (0, 20, 0.0, 0.16113012549493322),
    (20, 20, 0.8388698745050667, 1.0),
    (34, 68, 0.3843786388809909, 0.6156213611190091),
    (0, 0, 0.0, 0.0),
])
def test_wilson(spark, k, n, lo, hi):
    df = spark.createDataFrame([(k, n)], "k long, n long")
    a, b = wilson_bounds("k", "n")
    r = df.select(a.alias("lo"), b.alias("hi")).first()
    assert r.lo == pytest.approx(lo, abs=1e-12) and r.hi == pytest.approx(hi, abs=1e-12)


def test_combined_reward(spark):
    df = spark.createDataFrame([(1.0, 0.17265198596498835)], "h double, s double")
    assert df.select(combined_reward("h", "s")).first()[0] == pytest.approx(0.8345303971929977, abs=1e-15)


def test_layer_grid(spark):
    df = spark.createDataFrame([(42,)], "n int")
    r = layer_grid(df, "n", (0.30, 0.40, 0.49, 0.57, 0.66, 0.75)).orderBy("layer").collect()
    assert [x.layer for x in r] == [13, 17, 21, 24, 28, 32]


@pytest.mark.parametrize("L,expected", [(10, []), (51, []), (52, [50]), (60, [50, 52, 54, 56]),
                                        (512, [50, 165, 280, 395])])
def test_position_sample(spark, L, expected):
    df = spark.createDataFrame([(L,)], "L int")
    assert df.select(sample_positions("L", 4, 50).alias("p")).first().p == expected


def test_infonce(spark):
    rows = [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 0, 2.0), (2, 1, 2.0), (2, 2, 2.0)]
    df = spark.createDataFrame(rows, "g int, i int, loss double")
    r = {x.g: x.infonce for x in infonce(df, ["g"], "loss", F.col("i") == 0).collect()}
    assert r[1] == pytest.approx(0.4076059644443804, abs=1e-12)
    assert r[2] == pytest.approx(math.log(3), abs=1e-12)


def test_scale_target(spark):
    for d, t in [(1536, 39.191835884530846), (2560, 50.59644256269407)]:
        df = spark.createDataFrame([([1.0] * d,)], "v array<double>")
        out = df.select(l2_norm(scale_to("v", F.sqrt(F.size("v").cast("double")))).alias("n")).first().n
        assert out == pytest.approx(t, rel=1e-8)


def test_tag_extract(spark):
    rows = [("a<explanation> x </explanation>b",), (" y ",), ("<explanation>z",),
            ("</explanation>w<explanation>q",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r.e for r in df.select(tag_extract("t").alias("e")).collect()] == ["x", "y", "z", ""]


def test_group_advantage(spark):
    rows = [(1, 1.0), (1, 0.0), (1, 0.0), (1, 0.0), (2, 0.5), (2, 0.5), (2, 0.5), (2, 0.5)]
    df = spark.createDataFrame(rows, "step int, reward double")
    a = group_advantage(df, ["step"])
    advs = sorted(r.adv for r in a.filter("step = 1").collect())
    assert advs == pytest.approx([-0.25, -0.25, -0.25, 0.75])
    s = {r.step: r for r in step_summary(a, ["step"]).collect()}
    assert s[1].n_nonzero == 4 and not s[1].skipped
    assert s[2].skipped and s[2].frac_nonzero == 0.0


def test_bucketed_windows_equal_plain(spark):
    """Halo buckets (rolling frames) and prefix offsets (running sums) give
    the same answers as one window per run."""
    from vecprobe.operators.rollouts import bucketed_running_sum, rolling
    rows = [(r, s, float((r * 7 + s * 3) % 5), f"t{(r + s) % 3}") for r in range(3) for s in range(1, 41)]
    df = spark.createDataFrame(rows, "run long, step long, v double, t string")
    for width, bucket in ((5, 7), (10, 9), (10, 13)):
        plain = rolling(df, ["run"], "step", F.avg("v"), width, "m").select("run", "step", "m")
        buck = rolling(df, ["run"], "step", F.avg("v"), width, "m", bucket_steps=bucket).select("run", "step", F.col("m").alias("m2"))
        assert plain.join(buck, ["run", "step"]).filter(F.abs(F.col("m") - F.col("m2")) > 1e-12).count() == 0
        assert buck.count() == len(rows)
    pu = rolling(df, ["run"], "step", F.collect_set("t"), 5, "u", None, F.size).select("run", "step", "u")
    bu = rolling(df, ["run"], "step", F.collect_set("t"), 5, "u", 6, F.size).select("run", "step", F.col("u").alias("u2"))
    assert pu.join(bu, ["run", "step"]).filter(F.col("u") != F.col("u2")).count() == 0
    from pyspark.sql import Window
    ref = df.withColumn("c", F.sum("v").over(Window.partitionBy("run").orderBy("step")))
    b = bucketed_running_sum(df, ["run"], "step", F.col("v"), "c2", 9)
    assert ref.join(b.select("run", "step", "c2"), ["run", "step"]).filter(F.col("c") != F.col("c2")).count() == 0


def test_ntile_arithmetic_matches_window(spark):
    from pyspark.sql import Window
    from vecprobe.operators.rollouts import ntile_of
    rows = [(n, p) for n in range(1, 23) for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n long, p long")
    w = df.withColumn("t", F.ntile(4).over(Window.partitionBy("n").orderBy("p")))
    bad = w.filter(ntile_of(F.col("p"), F.col("n"), 4) != F.col("t")).count()
    assert bad == 0
