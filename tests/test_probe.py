"""The grouped probe against a dense fit."""

import hashlib
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from vecprobe.operators.probe import grouped_probe_cv, linear_probe_cv
from vecprobe.plans.report_evals import select_layer_flags


def _dense(ids, doc, x, cv=5, seed=0, steps=4000):
    """Newton-free reference: full gradient steps on one training fold at a time."""
    keep = [d for d in sorted(set(doc)) if doc.count(d) >= cv]
    rows = [(keep.index(d), hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i, v) for i, d, v in zip(ids, doc, x, strict=True) if d in keep]
    if len(rows) < 2 * cv or len(keep) < 2:
        return None
    fold, seen = {}, {}
    for c, _, i, _ in sorted(rows, key=lambda r: r[:3]):
        fold[i] = seen.get(c, 0) % cv
        seen[c] = seen.get(c, 0) + 1
    y, f, x = np.array([r[0] for r in rows]), np.array([fold[r[2]] for r in rows]), np.array([r[3] for r in rows])
    accs = []
    for k in range(cv):
        t = x[f != k]
        sd = t.std(0)
        z = np.c_[(x - t.mean(0)) / np.where(sd > 0, sd, 1), np.ones(len(x))]
        a, b, n = z[f != k], y[f != k], int((f != k).sum())
        w = np.zeros((z.shape[1], len(keep)))
        free = np.r_[np.ones(z.shape[1] - 1), 0][:, None]
        bound = a.T @ a / 2 + np.diag(free[:, 0])
        for _ in range(steps):
            e = np.exp(a @ w - (a @ w).max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            p[np.arange(n), b] -= 1
            w -= np.linalg.solve(bound, a.T @ p + free * w)
        accs.append(((z[f == k] @ w).argmax(1) == y[f == k]).mean())
    return float(np.mean(accs))


def test_groups_and_folds_equal_a_dense_fit(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for layer, noise in ((0, 0.6), (1, 1.5), (2, 4.0)):
        centre = rnd.normal(size=(4, 6))
        for i in range(120):
            d = i % 3 if i % 10 else 3
            rows.append((layer, i, f"d{d}", (centre[d] + noise * rnd.normal(size=6)).tolist() + [2.0]))
    rows += [(0, 900, "rare", [0.0] * 7), (3, 1, "d0", [1.0] * 7), (3, 2, "d1", [1.0] * 7)]
    rows += [(4, i, "only", [float(i)] * 7) for i in range(30)]
    df = spark.createDataFrame(rows, "layer int, id long, doc string, vec array<double>").repartition(5)
    got = {r.layer: r.probe_cv for r in grouped_probe_cv(df, "id", "doc", "vec", ["layer"]).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[3] is None and got[4] is None
    for layer in (0, 1, 2):
        own = [r for r in rows if r[0] == layer]
        assert math.isclose(got[layer], _dense([r[1] for r in own], [r[2] for r in own], [r[3] for r in own]), abs_tol=1e-12)
    assert math.isclose(linear_probe_cv(df.filter("layer = 1"), "id", "doc", "vec"), got[1])
    assert math.isnan(linear_probe_cv(df.filter("layer > 9"), "id", "doc", "vec"))


def test_select_layer_prefers_the_probe_among_candidates(spark):
    rows = [(0, 0.80, 0.2), (1, 0.75, 0.9), (2, 0.78, None), (3, 0.60, 1.0)]
    df = spark.createDataFrame(rows, "layer int, doc_top1 double, probe_cv double")
    pick = lambda d, c: [r.layer for r in select_layer_flags(d, c).filter("recommended").collect()]
    assert pick(df, "probe_cv") == [1] and pick(df, None) == [2]
    assert pick(df.withColumn("probe_cv", F.lit(None).cast("double")), "probe_cv") == [2]


def test_select_layer_runs_the_probe(spark, tmp_path):
    # two layers whose neighbours are all right; the one nearer to mid-depth is
    # not linear (each document sits on both sides of the origin)
    rnd, rows = np.random.default_rng(2), []
    for i in range(80):
        doc, side = i % 4, 1 if i // 4 % 2 else -1
        linear = np.eye(4)[doc]
        angle = math.pi * doc / 4 + 0.01 * rnd.normal()
        folded = side * np.array([math.cos(angle), math.sin(angle), 0, 0])
        vec = np.concatenate([linear + 0.01 * rnd.normal(size=4), rnd.normal(size=4), folded, rnd.normal(size=4)])
        rows.append((i, vec.tolist()))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in E.queries()["select_layer"](spark, str(tmp_path)).collect()]
    assert got == [(0, 1.0, True)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert con.sql(E.oracle_sql()["select_layer"]).fetchall() == got
