"""J3 / J4 / F11 on tiny literal tables (FIXTURES: config and registry are
literal tables inside the tests)."""

import pytest
from pyspark.sql import functions as F

from vecprobe.sources.config import registry_frame, registry_lookup, require, resolve_config, violations


def test_registry_lookup_case_insensitive(spark):
    df = spark.createDataFrame([("google/gemma-4-E4B",), ("unknown/model",)], "model string")
    r = {x.model: x for x in registry_lookup(df, "model", registry_frame(spark)).collect()}
    assert r["google/gemma-4-E4B"].d_model == 2560 and r["google/gemma-4-E4B"].known
    assert not r["unknown/model"].known


def test_config_fallback_levels(spark):
    runs = spark.createDataFrame([(1, 10), (2, 10), (3, 30)], "run long, parent long")
    run_cfg = spark.createDataFrame([(1, 7)], "run long, k int")
    par_cfg = spark.createDataFrame([(10, 5)], "parent long, k int")
    r = {x.run: (x.k, x.level) for x in resolve_config(runs, run_cfg, par_cfg, "k", 0).collect()}
    assert r == {1: (7, "run"), 2: (5, "parent"), 3: (0, "default")}


def test_required_values_fail_fast(spark):
    df = spark.createDataFrame([(1, None), (2, 1536)], "id long, d_model int")
    v = violations(df, {"missing_d_model": F.col("d_model").isNull()})
    with pytest.raises(ValueError):
        require(v)
    require(violations(df.filter("id = 2"), {"missing_d_model": F.col("d_model").isNull()}))
