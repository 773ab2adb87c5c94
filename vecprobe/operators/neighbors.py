"""Nearest-neighbour tables over *distinct items* (J5 vectors, J6 TF-IDF).

Rows with an identical vector (or text) form one item with a multiplicity,
so collapsed outputs never expand into all pairs within a group of copies.
The result ``NN`` has three frames:

* ``rows``  (group..., id, item)               row -> item
* ``items`` (group..., item, mult, self_sim, zero)
* ``pairs`` (group..., item, nn_item, sim)     each item's best *other* items (ties kept)

A row's tied nearest neighbours are then: the other copies of its item when
``mult > 1`` and ``self_sim`` reaches the best score; the rows of the listed
``nn_item``s when their score is the best; or every other row of the group
when all scores are equal (zero vector / no shared term). Operators downstream
(doc_top1, permutation nulls) consume this form directly (SURVEY 7.3)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_double, l2_norm, unit, dot
from ..session import cut_lineage, read_folder, scratch_path
from .common import join_group
from .indexing import buckets_for, dense_index, hex_bucket

#: Tied candidates that a task holds before it drops those that a better one beat.
HELD_TIES = 1 << 20
#: Tasks of a search for each core, while there are block pairs enough.
TASKS_PER_CORE = 4


class NN(NamedTuple):
    rows: DataFrame
    items: DataFrame
    pairs: DataFrame
    group_cols: tuple


def dedupe_items(df: DataFrame, id_col: str, key_col: str, group_cols=()):
    """Map rows to distinct values of ``key_col``; item id = smallest row id."""
    g = list(group_cols)
    items = df.groupBy(*g, key_col).agg(F.min(id_col).alias("item"),
                                        F.count(F.lit(1)).alias("mult"))
    rows = df.select(*g, id_col, key_col).join(items.select(*g, key_col, "item"), g + [key_col]) \
        .select(*g, F.col(id_col).alias("id"), "item")
    return rows, items


def keep_best(pairs: DataFrame, group_cols, row_col: str = "item", score: str = "sim") -> DataFrame:
    """Keep every row's highest-scoring candidates (ties kept)."""
    w = Window.partitionBy(*group_cols, row_col)
    return (pairs.withColumn("_best", F.max(score).over(w))
            .filter(F.col(score) == F.col("_best")).drop("_best"))


def _group_key(group_cols):
    """A folder name for each group."""
    g = list(group_cols)
    return F.md5(F.to_json(F.struct(*g))) if g else F.lit("all")


def block_counts(items: DataFrame, group_cols, block_rows: int, n_blocks: int | None = None) -> DataFrame:
    """(group..., _nb): blocks of about ``block_rows`` rows for each group's own size."""
    count = F.lit(n_blocks) if n_blocks else F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows)))
    return items.groupBy(*group_cols).agg(F.greatest(F.lit(1), count).cast("int").alias("_nb"))


def write_blocks(rows: DataFrame, group_cols, counts: DataFrame, *payload) -> str:
    """Write (item, payload...) once to the shared folder, a folder for each
    group and hash block of the item. Searches read blocks from there, so that
    neither side is shuffled once per block of the other."""
    path = scratch_path(rows.sparkSession, f"blocks-{uuid.uuid4().hex}")
    d = join_group(rows, counts, group_cols).withColumn("_g", _group_key(group_cols))
    d = d.withColumn("_b", F.pmod(F.xxhash64("item"), F.col("_nb")).cast("int")).repartition("_g", "_b")
    d = d.groupBy("_g", "_b", "item").agg(*payload) if payload else d.drop("_nb", *group_cols)
    d.write.partitionBy("_g", "_b").parquet(path)
    return path


class _Best:
    """Each query row's best candidates of the blocks seen so far, ties kept."""

    def __init__(self, n: int, digits: int):
        self.best, self.digits = np.full(n, -np.inf), digits
        self.held: list = []
        self.n_held = 0

    def add(self, scores: np.ndarray, cand: pa.Array) -> None:
        """Rounding keeps the order, so only scores that come near the best are rounded."""
        top = scores.max(axis=1)
        near = np.flatnonzero((top >= self.best - 10.0 ** -self.digits) & np.isfinite(top))
        if not len(near):
            return
        top = np.round(top[near], self.digits)
        self.best[near] = np.maximum(self.best[near], top)
        part = scores if len(near) == len(scores) else scores[near]
        r, c = np.nonzero(part >= (self.best[near] - 10.0 ** -self.digits)[:, None])
        sim = np.round(part[r, c], self.digits)
        keep = sim == self.best[near][r]
        r, c, sim = near[r[keep]], c[keep], sim[keep]
        if len(r):
            self.held.append((r, cand.take(pa.array(c)), sim))
            self.n_held += len(r)
            if self.n_held > HELD_TIES:
                self._drop_beaten()

    def _drop_beaten(self) -> None:
        out = []
        for r, cand, sim in self.held:
            keep = sim == self.best[r]
            if keep.any():
                out.append((r[keep], cand.filter(pa.array(keep)), sim[keep]))
        self.held, self.n_held = out, sum(len(r) for r, _, _ in out)

    def result(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        self._drop_beaten()
        yield from self.held


def _search(spark, qpath: str, cpath: str, qcounts: DataFrame, ccounts: DataFrame, group_cols, id_type, exclude_self: bool,
            digits: int, load: Callable, score: Callable) -> DataFrame:
    """Best candidates (group..., item, nn_item, sim) of every query item. A
    task reads one block of queries, then, one at a time, the candidate blocks
    of its share; where there are fewer query blocks than cores can take, the
    candidate blocks are dealt to several shares. ``load(table)`` prepares a
    block's rows, ``score(q, c)`` gives their scores (or None: all below any)."""
    g = list(group_cols)
    counts = qcounts.withColumnRenamed("_nb", "_nq")
    counts = counts.join(ccounts.withColumnRenamed("_nb", "_nc"), g) if g else counts.crossJoin(ccounts.withColumnRenamed("_nb", "_nc"))
    counts = cut_lineage(counts.withColumn("_g", _group_key(g)), "blocks")
    total = counts.agg(F.sum("_nq")).first()[0] or 0
    wanted = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    shares = F.least(F.col("_nc"), F.lit(math.ceil(wanted / max(total, 1))))
    tasks = (counts.withColumn("_shares", shares.cast("int"))
             .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
             .withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
             .select(*g, "_g", "_q", "_share", "_shares", "_nc"))
    tasks = tasks.repartition(max(1, min(tasks.count(), 4 * wanted)))
    schema = T.StructType([*(qcounts.schema[c] for c in g), T.StructField("item", id_type),
                           T.StructField("nn_item", id_type), T.StructField("sim", T.DoubleType())])
    names = schema.names

    def run(batches):
        for b in batches:
            for k, t in enumerate(b.select(["_g", "_q", "_share", "_shares", "_nc"]).to_pylist()):
                q = read_folder(f"{qpath}/_g={t['_g']}/_b={t['_q']}")
                if q is None:
                    continue
                own, queries = load(q), q["item"].combine_chunks()
                rows, found = pd.Index(queries.to_pandas(integer_object_nulls=True)), _Best(len(q), digits)
                for j in range(t["_share"], t["_nc"], t["_shares"]):
                    c = read_folder(f"{cpath}/_g={t['_g']}/_b={j}")
                    scores = None if c is None else score(own, load(c))
                    if scores is None:
                        continue
                    cand = c["item"].combine_chunks()
                    if exclude_self:
                        at = rows.get_indexer_non_unique(cand.to_pandas(integer_object_nulls=True))[0]
                        of = np.flatnonzero(at >= 0) if rows.is_unique else None
                        if of is not None:
                            scores[at[of], of] = -np.inf
                        else:  # an item of several values
                            scores[queries.to_numpy(False)[:, None] == cand.to_numpy(False)[None, :]] = -np.inf
                    found.add(scores, cand)
                for r, cand, sim in found.result():
                    group = [b.column(i).take(pa.array(np.full(len(r), k))) for i in range(len(g))]
                    yield pa.RecordBatch.from_arrays([*group, queries.take(pa.array(r)), cand, pa.array(sim)], names=names)

    return keep_best(tasks.mapInArrow(run, schema), g)


def _load_dense(eps: float):
    def load(table: pa.Table):
        v = table["_v"].combine_chunks()
        flat = v.flatten()
        if v.null_count or flat.null_count or len(np.unique(np.diff(v.offsets.to_numpy()))) > 1:
            x = np.vstack(v.to_numpy(zero_copy_only=False)).astype(np.float64)
        else:
            x = flat.to_numpy().reshape(len(v), -1).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / (norm + eps), norm[:, 0] > 0
    return load


def _score_dense(skip_zero: bool):
    def score(q, c):
        s = q[0] @ c[0].T
        if skip_zero:
            s[~q[1]] = -np.inf
        return s
    return score


def blocked_best(queries: DataFrame, cands: DataFrame, group_cols, id_type, qcounts: DataFrame, ccounts: DataFrame,
                 exclude_self: bool, eps: float = 1e-9, digits: int = 9, skip_zero: bool = False) -> DataFrame:
    """Exact best-cosine candidates for every query row (ties kept), with
    ``skip_zero`` for those that are not zero.

    ``queries`` / ``cands``: (group..., item, _v), in ``qcounts`` / ``ccounts``
    blocks of a group (``block_counts``); the same frame for both is written
    once. Output: (group..., item, nn_item, sim)."""
    qpath = write_blocks(queries.select(*group_cols, "item", "_v"), group_cols, qcounts)
    cpath = qpath if cands is queries else write_blocks(cands.select(*group_cols, "item", "_v"), group_cols, ccounts)
    return _search(queries.sparkSession, qpath, cpath, qcounts, ccounts, group_cols, id_type, exclude_self, digits,
                   _load_dense(eps), _score_dense(skip_zero))


def vector_nn(df: DataFrame, id_col: str = "id", vec_col: str = "vec", group_cols=(),
              block_rows: int = 2048, n_blocks: int | None = None, eps: float = 1e-9,
              digits: int = 9) -> NN:
    """Exact cosine nearest items (self excluded) by blocked matmul.

    Similarities are rounded to ``digits`` before ties are decided, in both
    this engine and the oracle."""
    g = list(group_cols)
    base = df.select(*g, F.col(id_col), as_double(vec_col).alias("_v"))
    rows, items = dedupe_items(base, id_col, "_v", g)
    items = cut_lineage(items)
    u = unit("_v", eps)
    info = items.select(*g, "item", "mult", F.round(dot(u, u), digits).alias("self_sim"),
                        (l2_norm("_v") == 0).alias("zero"))
    counts = cut_lineage(block_counts(items, g, block_rows, n_blocks), "blocks")
    pairs = blocked_best(items, items, g, df.schema[id_col].dataType, counts, counts, True, eps, digits, True)
    return NN(cut_lineage(rows), cut_lineage(info), cut_lineage(pairs), tuple(g))


def row_pairs(nn: NN) -> DataFrame:
    """Row-level view ``(group..., id, nn_id, sim)`` of the tied neighbours,
    for inspection and small outputs. Expands copies, so it is quadratic in
    the size of a group of identical items; evaluation operators never call it."""
    g = list(nn.group_cols)
    best = nn.pairs.groupBy(*g, "item").agg(F.max("sim").alias("_bo"))
    it = nn.items.join(best, g + ["item"], "left")
    top = F.greatest(F.col("_bo"), F.when(F.col("mult") > 1, F.col("self_sim")))
    it = it.withColumn("_top", top)
    r = nn.rows
    other = (r.join(it.select(*g, "item", "_top"), g + ["item"])
             .join(nn.pairs, g + ["item"]).filter(F.col("sim") == F.col("_top"))
             .join(r.select(*g, F.col("item").alias("nn_item"), F.col("id").alias("nn_id")),
                   g + ["nn_item"]).select(*g, "id", "nn_id", "sim"))
    copies = (r.join(it.filter((F.col("mult") > 1) & (F.col("self_sim") == F.col("_top")))
                     .select(*g, "item", "self_sim"), g + ["item"])
              .join(r.select(*g, "item", F.col("id").alias("nn_id")), g + ["item"])
              .filter(F.col("id") != F.col("nn_id"))
              .select(*g, "id", "nn_id", F.col("self_sim").alias("sim")))
    return other.unionByName(copies)


def term_ids(terms: DataFrame, n_terms: int, group_cols=(), term_col: str = "term") -> DataFrame:
    """(group..., term, tid): exact dense ids of distinct terms, numbered in
    md5-prefix buckets."""
    h = terms.withColumn("_h", F.md5(F.col(term_col)))
    return dense_index(h, ["_h", term_col], group_cols, "tid", hex_bucket("_h", buckets_for(n_terms))).drop("_h")


class _Entries(NamedTuple):
    """Entries of a block's sparse rows by term: rows, weights, and where each
    distinct term's entries begin."""

    n: int
    row: np.ndarray
    w: np.ndarray
    terms: np.ndarray
    begin: np.ndarray


def _load_sparse(table: pa.Table) -> _Entries:
    e = table["e"].combine_chunks()
    row = np.repeat(np.arange(len(e)), np.diff(e.offsets.to_numpy()))
    flat = e.flatten()
    tid, w = flat.field("tid").to_numpy(zero_copy_only=False), flat.field("w").to_numpy(zero_copy_only=False)
    by = np.argsort(tid, kind="stable")
    terms, begin = np.unique(tid[by], return_index=True)
    return _Entries(len(e), row[by], w[by], terms, np.r_[begin, len(tid)])


def _spans(e: _Entries, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the terms at ``at``, and for each the place in ``at``."""
    size = e.begin[at + 1] - e.begin[at]
    first = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(e.begin[at] - first, size), np.repeat(np.arange(len(at)), size)


def sparse_block_scores(q: _Entries, c: _Entries, dense_factor: float = 600.0, cells: int = 1 << 22) -> np.ndarray | None:
    """Dot products of two blocks of sparse rows. Terms shared by many rows on
    both sides ("heavy": pairs per term above nq*nc/dense_factor) go through one
    dense BLAS product; the others' entries meet, some ``cells`` pairs at a time
    and terms of equally many query entries together, and are summed with
    bincount. None when nothing is shared."""
    _, tq, tc = np.intersect1d(q.terms, c.terms, assume_unique=True, return_indices=True)
    if not len(tq):
        return None
    dq, dc = (q.begin[tq + 1] - q.begin[tq]).astype(np.float64), (c.begin[tc + 1] - c.begin[tc]).astype(np.float64)
    heavy = dq * dc > (q.n * c.n) / dense_factor
    if heavy.any():
        sides = []
        for e, at in ((q, tq[heavy]), (c, tc[heavy])):
            of, place = _spans(e, at)
            dense = np.zeros((e.n, len(at)))
            dense[e.row[of], place] = e.w[of]
            sides.append(dense)
        S = sides[0] @ sides[1].T
    else:
        S = np.zeros((q.n, c.n))
    size, by = dq[~heavy].astype(np.int64), np.argsort(dq[~heavy], kind="stable")
    lq, lc, size = tq[~heavy][by], tc[~heavy][by], size[by]
    pairs = np.cumsum(size * dc[~heavy][by].astype(np.int64))
    at = 0
    while at < len(lq):
        done = int(pairs[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(pairs, done + cells, side="right")))
        cell, w, n = np.empty(int(pairs[to - 1]) - done, np.int64), np.empty(int(pairs[to - 1]) - done), 0
        ends = [*(np.flatnonzero(np.diff(size[at:to])) + at + 1), to]
        for lo, hi in zip([at, *ends[:-1]], ends, strict=True):
            # each entry of a candidate meets its term's entries of the queries
            mine = q.begin[lq[lo:hi], None] + np.arange(size[lo])
            of, term = _spans(c, lc[lo:hi])
            room = slice(n, n + len(of) * int(size[lo]))
            shape = (len(of), int(size[lo]))
            np.add(np.take(q.row[mine] * c.n, term, 0), c.row[of, None], out=cell[room].reshape(shape))
            np.multiply(np.take(q.w[mine], term, 0), c.w[of, None], out=w[room].reshape(shape))
            n = room.stop
        S += np.bincount(cell, weights=w, minlength=q.n * c.n).reshape(q.n, c.n)
        at = to
    return S


def _score_positive(digits: int):
    def score(q: _Entries, c: _Entries) -> np.ndarray | None:
        S = sparse_block_scores(q, c)
        if S is not None:
            S[S <= 0.5 * 10.0 ** -digits] = -np.inf
        return S
    return score


def blocked_best_sparse(q: DataFrame, c: DataFrame, group_cols, id_type, qcounts: DataFrame, ccounts: DataFrame,
                        exclude_self: bool, positive_only: bool = True, digits: int = 9) -> DataFrame:
    """Best candidates per query item for sparse, already-normalised vectors.

    ``q`` / ``c``: long entries (group..., item, tid, w), in ``qcounts`` /
    ``ccounts`` blocks of a group (``block_counts``); the same frame for both is
    written once. Output: (group..., item, nn_item, sim) with ties; scores <= 0
    dropped when ``positive_only`` (rows sharing no term are handled by the
    caller)."""
    entries = F.sort_array(F.collect_list(F.struct("tid", "w"))).alias("e")
    qpath = write_blocks(q.select(*group_cols, "item", "tid", "w"), group_cols, qcounts, entries)
    cpath = qpath if c is q else write_blocks(c.select(*group_cols, "item", "tid", "w"), group_cols, ccounts, entries)
    return _search(q.sparkSession, qpath, cpath, qcounts, ccounts, group_cols, id_type, exclude_self, digits,
                   _load_sparse, _score_positive(digits) if positive_only else sparse_block_scores)
