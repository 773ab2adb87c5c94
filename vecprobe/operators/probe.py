"""Cross-validated linear probe (multinomial logistic regression), all
groups and folds in one job a step.

Folds are stratified by a seeded md5 order inside each class; only classes with
at least ``cv`` rows take part. Each training fold is standardised on its own
statistics (the reference scales before splitting, which leaks fold statistics;
see README). The objective is that of C: the summed log-loss plus |w|^2 / (2 C),
intercepts free.

The rows are written once. A step reads them and sums, per (group, fold) model,
the loss and the gradient inside each task, then across tasks; only models
(classes x dimensions each) reach the driver. Steps are those of L-BFGS over the
fixed bound of the curvature (half the Gram matrix), whose plain step never
raises the loss and serves where a longer one would."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import hash_key
from ..functions.vectors import as_double
from ..session import cut_lineage
from .common import join_group
from .indexing import buckets_for, dense_index, hex_bucket

STEPS, MEMORY, TOLERANCE = 60, 8, 1e-5


def probe_rows(df: DataFrame, group_cols, id_col: str, doc_col: str, vec_col: str, cv: int, seed: int) -> DataFrame:
    """(group..., _class, _fold, _x) of the rows whose class has ``cv`` rows;
    classes are numbered by their order inside the group."""
    g = list(group_cols)
    n = df.groupBy(*g, doc_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= cv)
    classes = n.select(*g, F.col(doc_col).alias("_doc"), (F.dense_rank().over(Window.partitionBy(*g).orderBy(doc_col)) - 1).alias("_class"))
    d = df.select(*g, F.col(doc_col).alias("_doc"), F.col(id_col).alias("_id"), as_double(vec_col).alias("_x"),
                  hash_key(F.lit(seed), F.col(id_col)).alias("_key")).join(classes, [*g, "_doc"])
    d = cut_lineage(d, "probe")
    # classes are ranked in buckets of the key, so that no class is one task's
    ranked = dense_index(d, ["_key", "_id"], [*g, "_class"], "_rank", hex_bucket("_key", buckets_for(d.count())))
    return cut_lineage(ranked.select(*g, "_class", (F.col("_rank") % cv).cast("int").alias("_fold"), "_x"), "probe")


@dataclass
class Model:
    """One (group, fold) fit in standardised space; ``w`` holds weights and, in
    the last row, intercepts."""

    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray
    penalty: float
    w: np.ndarray
    loss: float = np.inf
    grad: np.ndarray | None = None
    done: bool = False
    plain: bool = False
    start: tuple | None = None
    past: list = field(default_factory=list)

    def raw(self) -> np.ndarray:
        """Weights and intercepts for rows that are not standardised."""
        w = self.w[:-1] / self.scale[:, None]
        return np.vstack([w, self.w[-1] - self.mean @ w])

    def _bounded(self, g: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.gram, g)

    def _direction(self) -> np.ndarray:
        q, used = self.grad.copy(), []
        for s, y in reversed(self.past):
            a = (s * q).sum() / (s * y).sum()
            used.append(a)
            q -= a * y
        q = self._bounded(q)
        for (s, y), a in zip(self.past, reversed(used), strict=True):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return -q

    def receive(self, loss: float, raw_grad: np.ndarray) -> None:
        """Take the loss and the gradient by raw weights at ``w``; go on, or back
        to the last point and from there by the plain step."""
        grad = np.vstack([(raw_grad[:-1] - np.outer(self.mean, raw_grad[-1])) / self.scale[:, None], raw_grad[-1]])
        grad[:-1] += self.penalty * self.w[:-1]
        loss += self.penalty * (self.w[:-1] ** 2).sum() / 2
        if self.start is not None and loss > self.start[1] + 1e-9 * abs(self.start[1]) and not self.plain:
            self.w, self.loss, self.grad = self.start
            self.past, self.plain = [], True
            self.w = self.w - self._bounded(self.grad)
            return
        if self.start is not None:
            s, y = self.w - self.start[0], grad - self.start[2]
            if (s * y).sum() > 1e-12:
                self.past = [*self.past, (s, y)][-MEMORY:]
        self.loss, self.grad, self.plain = loss, grad, False
        self.done = np.abs(grad).max(initial=0.0) <= TOLERANCE * self.gram[-1, -1]
        if not self.done:
            self.start = (self.w, loss, grad)
            self.w = self.w + self._direction()


def _moments(g, cv: int):
    def run(frames):
        total: dict = {}
        for p in frames:
            for key, rows in p.groupby([*g, "_fold"], sort=False):
                x = np.array(rows["_x"].tolist(), dtype=float)
                x = np.hstack([x, np.ones((len(x), 1))])
                total[key] = total.get(key, 0) + x.T @ x
        for key, m in total.items():
            yield pd.DataFrame([[*key, m.ravel().tolist()]], columns=[*g, "_fold", "values"])
    return run


def _gradients(g, models):
    """Per model of other folds than the row's: loss and gradient by raw weights."""
    def run(frames):
        own, total = models.value, {}
        for p in frames:
            for key, rows in p.groupby([*g, "_fold"], sort=False):
                x = np.array(rows["_x"].tolist(), dtype=float)
                x = np.hstack([x, np.ones((len(x), 1))])
                y = rows["_class"].to_numpy()
                for fold, w in own.get(key[:-1], {}).items():
                    if fold == key[-1]:
                        continue
                    z = x @ w
                    z -= z.max(1, keepdims=True)
                    e = np.exp(z)
                    s = e.sum(1)
                    loss = (np.log(s) - z[np.arange(len(y)), y]).sum()
                    r = e / s[:, None]
                    r[np.arange(len(y)), y] -= 1
                    got = np.r_[loss, (x.T @ r).ravel()]
                    total[(*key[:-1], fold)] = total.get((*key[:-1], fold), 0) + got
        for key, v in total.items():
            yield pd.DataFrame([[*key, v.tolist()]], columns=[*g, "_fold", "values"])
    return run


def _hits(g, models):
    def run(frames):
        own = models.value
        for p in frames:
            out = []
            for key, rows in p.groupby([*g, "_fold"], sort=False):
                w = own.get(key[:-1], {}).get(key[-1])
                if w is not None:
                    x = np.array(rows["_x"].tolist(), dtype=float)
                    z = x @ w[:-1] + w[-1]
                    out.append([*key, int((z.argmax(1) == rows["_class"].to_numpy()).sum()), len(rows)])
            if out:
                yield pd.DataFrame(out, columns=[*g, "_fold", "hits", "n"])
    return run


def _summed(rows: DataFrame, g, run, head: str) -> dict:
    """Arrays of the same key summed over all tasks: {key: array}."""
    keys = [*g, "_fold"]
    parts = rows.mapInPandas(run, f"{head}, values array<double>")
    cells = parts.select(*keys, F.posexplode("values").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for key, part in cells.groupby(keys, sort=False):
        out[key] = np.empty(len(part))
        out[key][part["at"].to_numpy()] = part["v"].to_numpy()
    return out


def grouped_probe_cv(df: DataFrame, id_col: str, doc_col: str, vec_col: str, group_cols=(), cv: int = 5,
                     seed: int = 0, C: float = 1.0, max_iter: int = STEPS) -> DataFrame:
    """(group..., probe_cv): mean accuracy over the folds; null where a group has
    fewer than 2 * cv rows of large enough classes, or one class only. Vectors
    of a group must have one length."""
    g = list(group_cols)
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    rows = probe_rows(df, g, id_col, doc_col, vec_col, cv, seed)
    head = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in g), "_fold int"])
    sizes = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), (F.max("_class") + 1).alias("k")).collect()
    usable = {tuple(r[c] for c in g): r.k for r in sizes if r.n is not None and r.n >= 2 * cv and r.k is not None and r.k > 1}
    moments = _summed(rows, g, _moments(g, cv), head) if usable else {}
    models: dict = {}
    for key, k in usable.items():
        folds = {f: m.reshape(int(len(m) ** 0.5), -1) for (*gk, f), m in moments.items() if tuple(gk) == key}
        whole = sum(folds.values())
        for fold, m in folds.items():
            t = whole - m
            n, d = t[-1, -1], len(t) - 1
            mean = t[-1, :-1] / n
            scale = np.sqrt(np.maximum(np.diag(t)[:-1] / n - mean ** 2, 0))
            scale[scale <= 1e-12 * np.maximum(np.abs(mean), 1)] = 1.0
            gram = np.zeros((d + 1, d + 1))
            gram[:-1, :-1] = (t[:-1, :-1] - n * np.outer(mean, mean)) / np.outer(scale, scale) / 2 + np.eye(d) / C
            gram[-1, -1] = n / 2
            models.setdefault(key, {})[fold] = Model(mean, scale, gram, 1 / C, np.zeros((d + 1, k)))
    for _ in range(max_iter):
        left = {key: {f: m.raw() for f, m in own.items() if not m.done} for key, own in models.items()}
        if not any(left.values()):
            break
        shared = sc.broadcast(left)
        for (*key, fold), v in _summed(rows, g, _gradients(g, shared), head).items():
            m = models[tuple(key)][fold]
            m.receive(v[0], v[1:].reshape(m.w.shape))
        shared.destroy()
    for own in models.values():
        for m in own.values():  # stopped on the way: the last point that was measured
            if not m.done and m.start is not None:
                m.w = m.start[0]
    shared = sc.broadcast({key: {f: m.raw() for f, m in own.items()} for key, own in models.items()})
    scored = (rows.mapInPandas(_hits(g, shared), f"{head}, hits long, n long").groupBy(*g, "_fold").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
              .groupBy(*g).agg(F.avg(F.col("hits") / F.col("n")).alias("probe_cv")))
    groups = df.select(*g).distinct() if g else spark.range(1).select()
    return join_group(groups, scored, g) if not g else groups.join(scored, g, "left")


def linear_probe_cv(df: DataFrame, id_col: str, doc_col: str, vec_col: str, cv: int = 5,
                    seed: int = 0, C: float = 1.0, max_iter: int = STEPS) -> float:
    """``grouped_probe_cv`` of one group as a float (NaN where it is null)."""
    acc = grouped_probe_cv(df, id_col, doc_col, vec_col, (), cv, seed, C, max_iter).first()[0]
    return float("nan") if acc is None else acc
