"""Each registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from vecprobe.sources.tables import TABLES

from conftest import SF_SMALL

FAST = ["vector_nn", "doc_top1_vectors", "vector_mean", "mean_center", "norm_stats", "text_presence",
        "min_length_filter", "layer_grid", "position_sample", "cap_domain_share", "ngram_counts",
        "tfidf_index", "tfidf_nn", "doc_top1_tfidf", "retrieval_reward", "group_advantage",
        "rolling_unique", "loss_trend_gate", "nearest_prototype", "domain_accuracy", "seeded_sample",
        "step_schedule", "token_dropout", "paraphrase_pick", "union_sources", "csv_log_roundtrip",
        "config_fallback", "batch_encode", "domain_negatives", "uniform_negatives",
        "text_prototypes", "excluded_domains", "domain_lock", "checkpoint_report", "reward_ranges", "restartable_batches",
        "log_tail", "discovered_checkpoints", "extraction_carry"]


def _norm(v):
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == exp


def test_every_query_has_docstring_and_registered_oracle_keys():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 70 and len(sql) >= 75


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1 and "p_value" in df.columns
