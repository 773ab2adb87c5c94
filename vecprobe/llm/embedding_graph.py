"""Embedding near-duplicates on a robust-pruned flat graph (operator 7).

1. Identical vectors become one item with a multiplicity.
2. Items go to the shards of their nearest ``overlap`` centroids (k-means on a
   bounded sample). A shard over ``MAX_GROUP`` items is cut into blocks and
   becomes one group for each pair of blocks, so that no task holds more and
   every pair of its items still meets.
3. Each group builds a graph: nearest candidates and a few random ones, kept by
   the robust pruning rule. The adjacency lists of an item from all its groups
   are united.
4. In each group, every item searches the united graph greedily from the
   group's medoids and its own node; the search goes on while it meets nodes
   within the range (with slack), so large neighbourhoods are covered whole.
   Only pairs with cosine >= ``threshold`` in double precision are kept.
5. An audit compares a bounded sample of items with all items by brute force.
   Below ``TARGET`` recall the overlap doubles and the graph is built again."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components

GROUP, MAX_GROUP = 1200, 4000
#: Sample and centroid limits of the k-means; more items make larger shards,
#: which are then cut into blocks.
MAX_CENTROIDS, SAMPLE = 8192, 1 << 16
OVERLAP, TARGET, AUDIT = 4, 0.98, 256
CANDIDATES, RANDOM, DEGREE, ALPHA = 40, 12, 24, 1.2
MEDOIDS, EXPANSIONS, AT_ONCE, SLACK = 16, 24, 4, 0.05


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 1) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Out-neighbours of every row of unit vectors ``x``: of its nearest and
    some random rows, nearest first, each unless a kept one is ALPHA times
    nearer to it than the row is."""
    n = len(x)
    rnd, out = np.random.default_rng(seed), []
    c = min(CANDIDATES, n - 1)
    for at in range(0, n, 256):
        p = np.arange(at, min(at + 256, n))
        sim = x[p] @ x.T
        sim[np.arange(len(p)), p] = -np.inf
        near = np.argpartition(-sim, c - 1, axis=1)[:, :c] if c else np.empty((len(p), 0), int)
        cand = np.concatenate([near, rnd.integers(n, size=(len(p), min(RANDOM, n)))], axis=1)
        s = np.take_along_axis(sim, cand, 1)
        by = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, by, 1), np.take_along_axis(s, by, 1)
        dist = np.sqrt(np.maximum(2 - 2 * s, 0))
        live = np.isfinite(s)
        live[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        kept = np.zeros_like(live)
        vec = x[cand]
        for j in range(cand.shape[1]):
            take = live[:, j] & (kept.sum(1) < DEGREE)
            kept[take, j] = True
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("pd,pcd->pc", vec[:, j], vec), 0))
            live[take] &= ~(ALPHA * between[take] <= dist[take]) | kept[take]
        out += [cand[i][kept[i]] for i in range(len(p))]
    return out


def range_search(x: np.ndarray, nbrs: list[np.ndarray], threshold: float, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, found row) with cosine >= threshold; see the module."""
    n = len(x)
    degree = max([1, *map(len, nbrs)])
    table = np.full((n, degree), -1)
    for i, a in enumerate(nbrs):
        table[i, :len(a)] = a
    k = min(MEDOIDS, n)
    medoids = np.unique((kmeans(x, k, 3) @ x.T).argmax(1))
    got_q, got_x = [], []
    for at in range(0, n, chunk):
        q = np.arange(at, min(at + chunk, n))
        sim = np.full((len(q), n), -np.inf)
        sim[:, medoids] = x[q] @ x[medoids].T
        sim[np.arange(len(q)), q] = 1.0
        todo = sim.copy()  # similarity of the nodes seen but not expanded
        active, done = np.arange(len(q)), 0
        e = min(AT_ONCE, n)
        while len(active):
            part = todo[active]
            pick = np.argpartition(-part, e - 1, axis=1)[:, :e]
            s = np.take_along_axis(part, pick, 1)
            limit = threshold - SLACK if done >= EXPANSIONS else -np.inf
            go = np.isfinite(s) & (s >= limit)
            more = go.any(1)
            r, c = np.nonzero(go)
            rows, nodes = active[r], pick[r, c]
            todo[rows, nodes] = -np.inf
            to = table[nodes]
            rows = np.repeat(rows, degree)
            to = to.ravel()
            ok = to >= 0
            rows, to = rows[ok], to[ok]
            ok = np.isneginf(sim[rows, to])
            flat = np.unique(rows[ok] * n + to[ok])
            rows, to = flat // n, flat % n
            value = np.einsum("ij,ij->i", x[q[rows]], x[to])
            sim[rows, to] = value
            todo[rows, to] = value
            active, done = active[more], done + e
        r, c = np.nonzero(sim >= threshold)
        got_q.append(q[r])
        got_x.append(c)
    return np.concatenate(got_q), np.concatenate(got_x)


def _vectors(p: pd.DataFrame) -> np.ndarray:
    return unit(np.array(p["embedding"].tolist()))


def _build(key, p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("id", kind="stable").reset_index(drop=True)
    ids = p["id"].to_numpy()
    return pd.DataFrame({"id": ids, "nbrs": [ids[a].tolist() for a in robust_prune(_vectors(p))]})


def _search(threshold: float):
    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable").reset_index(drop=True)
        ids = p["id"].to_numpy()
        nbrs = []
        for a in p["nbrs"]:
            a = np.asarray(a)
            at = np.minimum(np.searchsorted(ids, a), len(ids) - 1)
            nbrs.append(at[ids[at] == a])  # nodes of the united list that are here
        q, x = range_search(_vectors(p), nbrs, threshold)
        ok = q != x
        a, b = ids[q[ok]], ids[x[ok]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return run


class Items:
    """Distinct vectors of one width: id (smallest vec_id), embedding, copies."""

    def __init__(self, items: DataFrame, threshold: float):
        self.items, self.threshold = items, threshold
        self.kind = items.schema["embedding"].dataType.simpleString()
        self.spark, self.n = items.sparkSession, items.count()

    def _groups(self, overlap: int) -> DataFrame:
        """(group, id, embedding) with each item in its groups."""
        k = max(1, min(-(-self.n * overlap // GROUP), MAX_CENTROIDS))
        size = min(SAMPLE, max(32 * k, 1000))
        rows = (self.items.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(size)
                .sort("id").toPandas())
        x = unit(np.array(rows["embedding"].tolist()))
        k = min(k, len(x))
        centers = self.spark.sparkContext.broadcast(kmeans(x, k, 6))

        def assign(batches):
            for b in batches:
                v = unit(np.array(b.column("embedding").to_pylist()))
                sim = v @ centers.value.T
                m = min(overlap, sim.shape[1])
                near = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                row = np.repeat(np.arange(len(v)), m)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(row)), b.column("embedding").take(pa.array(row)), pa.array(near.ravel())],
                    names=["id", "embedding", "shard"])

        placed = cut_lineage(self.items.select("id", "embedding").repartition("id")
                             .mapInArrow(assign, f"id long, embedding {self.kind}, shard long"), "shards")
        blocks = placed.groupBy("shard").agg(F.when(F.count("*") <= MAX_GROUP, 1)
                                             .otherwise(F.ceil(F.count("*") / (MAX_GROUP // 2))).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("id"), F.col("blocks"))
        with_block = placed.join(blocks, "shard").withColumn("own", own)
        other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0)))
                          .otherwise(F.expr("filter(sequence(0, blocks - 1), j -> j <> own)")))
        return (with_block.withColumn("other", other)
                .select(F.struct("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("g"), "id", "embedding")
                .withColumn("group", F.to_json("g")).drop("g"))

    def pairs(self, overlap: int) -> DataFrame:
        groups = cut_lineage(self._groups(overlap), "groups")
        lists = groups.groupBy("group").applyInPandas(_build, "id long, nbrs array<long>")
        union = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))
        rows = groups.join(union, "id")
        found = rows.groupBy("group").applyInPandas(_search(self.threshold), "a long, b long")
        return cut_lineage(found.distinct(), "pairs")

    def recall(self, pairs: DataFrame) -> float:
        """Share of the links of a bounded sample of items that ``pairs`` has."""
        rows = self.items.select("id", "embedding").orderBy(F.xxhash64(F.lit("audit"), "id"), "id").limit(AUDIT).toPandas()
        ids, x = rows["id"].to_numpy(), unit(np.array(rows["embedding"].tolist()))
        threshold = self.threshold
        probe = self.spark.sparkContext.broadcast((ids, x))

        def compare(batches):
            ids, x = probe.value
            for b in batches:
                sim = unit(np.array(b.column("embedding").to_pylist())) @ x.T
                r, c = np.nonzero(sim >= threshold)
                own = b.column("id").to_numpy()[r]
                ok = own != ids[c]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, ids[c])[ok]), pa.array(np.maximum(own, ids[c])[ok])], names=["a", "b"])

        true = self.items.select("id", "embedding").mapInArrow(compare, "a long, b long").distinct()
        have = pairs.select("a", "b", F.lit(1).alias("have"))
        r = true.join(have, ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("have").alias("have")).first()
        return r.have / r.n if r.n else 1.0

    def links(self) -> tuple[DataFrame, float]:
        overlap = OVERLAP
        while True:
            pairs = self.pairs(overlap)
            recall = self.recall(pairs)
            if recall >= TARGET or overlap >= 64:
                return pairs, recall
            overlap *= 2


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row of ``vectors`` (vec_id long, embedding array of numbers):
    vec_id, n_links, component_id, kept, audit_recall.

    Two vectors link if their cosine is >= threshold. A vector that is null,
    empty or zero, or holds a null or non-finite component, links with nothing;
    vectors of different widths never link. Rows with equal vectors link with
    one another. A row with a null vec_id links with nothing and is kept, its
    component_id null; other columns are ignored; an empty table gives no rows.
    Floats stay floats on their way, other numbers are doubles; cosines are of
    doubles. audit_recall is the recall measured."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    fine = F.expr("size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) "
                  "and exists(embedding, v -> v <> 0)")
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    key = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"), F.size("embedding").alias("width")]
    good = rows.filter("ok").select("vec_id", "embedding", *key)
    items = cut_lineage(good.groupBy("k1", "k2", "width").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"),
                                                              F.any_value("embedding").alias("embedding")), "items")
    pairs, recall = None, 1.0
    for w in sorted(r.width for r in items.select("width").distinct().collect()):
        found, got = Items(items.filter(F.col("width") == w), threshold).links()
        pairs, recall = found if pairs is None else pairs.unionByName(found), min(recall, got)
    if pairs is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"), F.lit(recall).alias("audit_recall"))
    size = items.select("id", "copies")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (both.join(size.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("linked")))
    info = (items.join(linked, "id", "left").join(components(pairs, "a", "b"), "id", "left")
            .select("k1", "k2", "width", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id")))
    out = rows.select("vec_id", *[F.when(F.col("ok"), c).alias(n) for c, n in zip(key, ("k1", "k2", "width"), strict=True)])
    return (out.join(info, ["k1", "k2", "width"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall")))
