"""Whitening against dense algebra on small tables."""

import numpy as np
from pyspark.sql import functions as F

from vecprobe.llm.whitening import Fit, whiten, whitened_components


def _reference(x: np.ndarray):
    fit = np.unique(x, axis=0)
    s, n = fit.sum(0), len(fit)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return s, n, e[::-1], u[:, ::-1]


def test_equals_dense_algebra_with_copies_odd_rows_and_clashing_columns(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(300, 20)) * np.linspace(3, 0.5, 20)
    v = np.concatenate([v, np.repeat(v[:1], 150, 0)]).astype(np.float32)
    odd = [None, [], [None] + [1.0] * 19, [float("nan")] * 20, [float("-inf")] + [0.0] * 19, [1e30] + [0.0] * 19, [1.0]]
    rows = [(i, x, i, "c") for i, x in enumerate([*v.tolist(), *odd])] + [(None, v[0].tolist(), 1, "c"), (3, v[3].tolist(), 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, at long, x string").repartition(5)
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000
    s, n, e, u = _reference(x)
    got = whitened_components(df).toPandas()
    assert len(got) == 16 * (len(v) + 2) and set(got.n) == {n} and got.identity_error.nunique() == 1
    assert 0 <= got.identity_error[0] < 1e-9
    table = got[got.vec_id.notna() & (got.vec_id != 3)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    own = np.delete(np.arange(len(v)), 3)
    want = (x[own] - s / n) @ u[:, :16] / np.sqrt(e[:16])
    assert np.allclose(np.abs(np.sum(table * want, 0)), np.sum(want * want, 0)) and np.allclose(np.abs(table), np.abs(want))
    first = got.drop_duplicates("vec_id").set_index("vec_id").deviation
    assert all(first[i] == int(((n * x[i] - s) ** 2).sum()) for i in range(len(v)))
    assert np.allclose(got.groupby("component").explained.first(), e[:16] / e.sum())
    assert len(whiten(df.filter("vec_id is null")).collect()[0].y) == 0  # one vector: no variance
    assert whitened_components(df.filter("false")).count() == 0


def test_dependent_dimensions_give_fewer_components(spark):
    rnd = np.random.default_rng(1)
    v = np.floor(rnd.normal(size=(50, 2)) * 64) / 64
    df = spark.createDataFrame([(i, [*r, r[0], 7.0]) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    out = whitened_components(df)
    assert out.agg(F.max("component"), F.max("identity_error")).first()[0] == 2
    assert abs(out.filter("vec_id = 1").agg(F.sum("explained")).first()[0] - 1) < 1e-9


def test_exact_beyond_longs():
    f = Fit(1 << 30, [1 << 70, -5], 1 << 45)
    x = np.array([[1 << 40, 0]])
    assert not f.narrow and f.deviations(x) == [25] and f.deviations(x + 1) == [2 * (1 << 60) + 25 + 10 * (1 << 30)]
    assert f.deviations(x * 2) == [None]
