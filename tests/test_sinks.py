"""Restartable sinks, discovery by path, column carry and step ranges."""

import pytest
from pyspark.sql import functions as F

from vecprobe.operators.extraction import extraction_tables
from vecprobe.operators.rollouts import range_means
from vecprobe.sources.sinks import (append_log, batch_id, discover_checkpoints, read_batches, read_log, tail, write_batch,
                                    write_checkpoints)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(30).withColumn("x", F.col("id") * 2)
    for n, lo in ((0, 0), (1, 10), (1, 10), (2, 20), (0, 0)):
        write_batch(df.filter(f"id >= {lo} and id < {lo + 10}"), path, batch_id(n))
    back = read_batches(spark, path, df.schema)
    assert back.count() == 30 and back.select("id").distinct().count() == 30
    assert {r.batch for r in back.select("batch").distinct().collect()} == {batch_id(n) for n in range(3)}


def test_log_has_one_header_and_a_bounded_tail(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(1, 26).select(F.col("id").alias("step"), (F.col("id") / 10).alias("mean_reward"))
    for n, lo in ((0, 1), (1, 11), (1, 11), (2, 21)):
        append_log(df.filter(f"step >= {lo} and step < {lo + 10}"), path, batch_id(n))
    rows = tail(read_log(spark, path, df.schema), ["step"], 10).collect()
    assert [r.step for r in rows] == list(range(16, 26)) and rows[-1].mean_reward == 2.5
    assert read_log(spark, path, df.schema).count() == 25
    assert (tmp_path / "log" / "_header.csv").read_text() == "step,mean_reward\n"
    with pytest.raises(ValueError):
        append_log(df.withColumnRenamed("step", "other"), path, batch_id(3))


def test_checkpoints_are_found_by_path(spark, tmp_path):
    for run in ("armA", "armB"):
        df = spark.createDataFrame([(f"step_{s:06d}", s * i) for s in (100, 200) for i in range(3)] + [("final", 0)], "step string, v int")
        write_checkpoints(df, str(tmp_path / run), "step")
    found = discover_checkpoints(spark, f"{tmp_path}/*/ckpt=step_*", df.drop("step").schema)
    assert {(r.tag, r.ckpt): r["count"] for r in found.groupBy("tag", "ckpt").count().collect()} == {
        (f"{run}_step_{s:06d}", f"step_{s:06d}"): 3 for run in ("armA", "armB") for s in (100, 200)}


def test_all_columns_are_carried_whatever_their_names(spark):
    long = [[float(i), -float(i)] for i in range(100)]
    rows = [(1, long, "a", "old", {"k": 1}), (2, long[:1], "b", "old", None), (3, None, "c", None, None), (4, long[:3], None, "x", {})]
    df = spark.createDataFrame(rows, "id long, seq array<array<double>>, `states` string, Activation_Vector string, sampled map<string,int>")
    primary, multi = extraction_tables(df, F.col("seq"), 7)
    keep = ["id", "seq", "states", "sampled"]
    assert primary.columns == [*keep, "activation_vector", "activation_layer"] and multi.columns == [*primary.columns, "position_idx"]
    got = {r.id: r for r in primary.collect()}
    assert set(got) == {1, 4} and got[1].activation_vector == [99.0, -99.0] and got[1].states == "a" and got[1].sampled == {"k": 1}
    extra = sorted((r.id, r.position_idx, r.activation_vector[0], r.states, r.activation_layer) for r in multi.collect())
    assert extra == [(1, p, float(p), "a", 7) for p in (50, 62, 74, 86)]
    again = extraction_tables(multi.withColumnRenamed("seq", "position"), F.col("position"), 8)[1]
    assert again.columns.count("position_idx") == 1 and again.filter("activation_layer <> 8").count() == 0


def test_ranges_may_overlap_and_be_empty(spark):
    df = spark.createDataFrame([(r, s, float(s)) for r in (1, 2) for s in range(1, 11 * r)], "run int, step int, v double")
    got = {(r.run, r.steps): (r.n_steps, r.mean_reward, r.max_single_step)
           for r in range_means(df, ["run"], "step", "v", [("a", 1, 4), ("b", 3, 12), ("c", 100, 200)]).collect()}
    assert got == {(1, "a"): (4, 2.5, 4.0), (1, "b"): (8, 6.5, 10.0), (2, "a"): (4, 2.5, 4.0), (2, "b"): (10, 7.5, 12.0)}
