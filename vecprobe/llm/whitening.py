"""Embedding whitening with MLlib's BlockMatrix (operator 11).

Entries become whole numbers, so that sums and centring are exact. The fit list
(each distinct vector once) is indexed, centred and cut into distributed blocks
of rows; its transpose times itself is the scatter matrix. Only that matrix,
dimensions x dimensions, reaches the driver for the eigenvectors; a BlockMatrix
product with the whitening matrix then projects the rows. The covariance of the
projected fit list is measured by another product, not derived.

MLlib keeps the numbers of all blocks on the driver, so blocks grow from 1,024
rows to 8 MB with the table; it lays the row blocks of a product on about the
square root of the matrix's partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

COMPONENTS = 16
#: Whole numbers are floor(GRID * entry) + SHIFT.
GRID, SHIFT = 64, 1_000_000
#: Entries of at least this size have no exact whole number; such rows are left out.
LIMIT = float(1 << 50)
#: Eigenvalues not above this part of the largest are rounding noise.
NULL_SPACE = 1e-13
BLOCK_ROWS, BLOCK_BYTES, BLOCKS = 1024, 8 << 20, 4096
BLOCK_COLS = 1024


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """id, x array<long> of the rows whose vector is not null and has finite
    entries only."""
    v = F.col(col)
    ok = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * GRID) + F.lit(SHIFT))
    return vectors.filter(v.isNotNull() & ok).select(F.col(id_col).alias("id"), x.alias("x"))


def indexed(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with ``at``: 0-based numbers without gaps. A row's place
    in its file part is written with it and parts are numbered by their sizes,
    a table of one row per part: nothing is shuffled or sorted."""
    rows = cut_lineage(df.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    return (rows.withColumn("part", part).join(F.broadcast(parts), "part")
            .withColumn("at", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "first"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(batches):
    """Exact sums by dimension, as high and low halves, and the largest entry."""
    for b in batches:
        x = _matrix(b.column("x")) if b.num_rows else np.zeros((0, 0), np.int64)
        high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(x.shape[1])), pa.array(high), pa.array(low), pa.array(np.abs(x).max(0) if len(x) else high)],
            names=["dim", "high", "low", "most"])


class Fit:
    """Size ``n`` of the fit list, its sums ``s`` by dimension (exact), and
    whether n * x - s and its squares' sum fit a long."""

    def __init__(self, n: int, s: list[int], most: int):
        self.n, self.s = n, s
        far = n * most + max(map(abs, s), default=0)
        self.narrow = far < 1 << 62
        self.squares = len(s) * far * far < 1 << 62

    @classmethod
    def of(cls, fit: DataFrame) -> Fit:
        rows = (fit.select("x").mapInArrow(_sums, "dim long, high long, low long, most long").groupBy("dim")
                .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")], F.max("most").alias("most"))
                .orderBy("dim").collect())
        return cls(fit.count(), [(int(r.high) << 32) + int(r.low) for r in rows], max((r.most for r in rows), default=0))

    def offsets(self, x: np.ndarray, exact: bool) -> np.ndarray:
        """n * x - s, as longs or, where asked for, as Python's whole numbers."""
        if exact or not self.narrow:
            return x.astype(object) * self.n - np.array(self.s, object)
        return x * self.n - np.array(self.s, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x, False).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = self.offsets(x, not self.squares)
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(1)]


def centred_rows(rows: DataFrame, fit: Fit) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                y = fit.centred(_matrix(b.column("x")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("at"), lists], names=["index", "vector"])

    return rows.select("at", "x").mapInArrow(run, "index long, vector array<double>")


def block_matrix(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """Rows (index, vector array<double>) as blocks. Their height bounds both a
    block's bytes and, as far as that allows, the number of blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    cols = min(dims, BLOCK_COLS)
    high = max(1, BLOCK_BYTES // (8 * cols))
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(min(high, max(BLOCK_ROWS, -(-n // BLOCKS))), cols)


def product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a times b; the inner dimension is cut over ``splits`` tasks, whose
    partial products are summed where they arise before they are shuffled."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def scatter(a: BlockMatrix) -> np.ndarray:
    """The small matrix of a's transpose times a."""
    spark_parts = int(a._java_matrix_wrapper._sc.getConf().get("spark.sql.shuffle.partitions", "200"))
    return product(a.transpose(), a, min(a.numRowBlocks, spark_parts)).toLocalMatrix().toArray()


def whitening_matrix(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` columns, unit eigenvectors of ``v`` over the roots of their
    eigenvalues, by falling eigenvalue, and each one's share of the trace. Of an
    eigenvector's signs the one with a positive largest entry is taken."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    real = e > NULL_SPACE * max(e.max(initial=0.0), 0.0)
    e, u = e[real], u[:, real]
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(len(e))]) if len(e) else np.ones(0)
    return u * sign / np.sqrt(e), e / np.trace(v)


def _local(w: np.ndarray, sc, height: int) -> BlockMatrix:
    blocks = [((i, 0), DenseMatrix(len(p), p.shape[1], p.ravel(order="F"))) for i, p in enumerate(w[a:a + height] for a in range(0, len(w), height))]
    return BlockMatrix(sc.parallelize(blocks, 1), height, w.shape[1], *w.shape)


def _rows_of(m: BlockMatrix) -> DataFrame:
    rows = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.toDF("at", "vector").select("at", vector_to_array("vector").alias("y"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened vectors: ``id_col``, n, deviation and ``y`` (array<double>, one
    entry a component) of each row, with ``explained`` (array<double>, each
    component's share of the variance) and ``identity_error``.

    A row whose vector is null or holds a null or non-finite entry, or one of
    2**50 or more in size, is left out; so is one of another length than most
    (the smaller length of ties). Repeated rows and null or repeated ids keep a
    row each and equal vectors are whitened alike, but count once in the fit.
    Components without variance are left out: with fewer than two distinct
    vectors, or an empty table, there is none and ``y`` is empty. ``deviation``
    is null where it exceeds a long. Other columns are ignored."""
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = whole_numbers(vectors, id_col, col)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = sizes.d if sizes else 0
    rows = indexed(rows.filter(F.size("x") == d), "vectors")
    fit_rows = indexed(rows.select("x").distinct(), "fit-list")
    fit = Fit.of(fit_rows)
    w, explained, error = np.zeros((d, 0)), np.zeros(0), 0.0
    if fit.n > 1 and d:
        a = block_matrix(centred_rows(fit_rows, fit), fit.n, d)
        w, explained = whitening_matrix(scatter(a) / fit.n, components)
    out = [F.col("id").alias(id_col), F.lit(fit.n).cast("long").alias("n"), "deviation"]
    shares = F.array(*map(F.lit, explained.tolist())).cast("array<double>").alias("explained")

    def deviations(batches):
        for b in batches:
            x = _matrix(b.column("x")) if b.num_rows else None
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("at"), pa.array(fit.deviations(x) if x is not None else [], pa.int64())], names=["id", "at", "deviation"])

    kind = rows.schema["id"].dataType.simpleString()
    told = rows.select("id", "at", "x").mapInArrow(deviations, f"id {kind}, at long, deviation long")
    if not len(explained):
        return told.select(*out, F.array().cast("array<double>").alias("y"), shares, F.lit(error).alias("identity_error"))
    narrow = _local(w, sc, min(d, BLOCK_COLS))
    y = product(a, narrow)
    error = float(np.abs(scatter(y) / fit.n - np.eye(len(explained))).max())
    every = block_matrix(centred_rows(rows, fit), rows.count(), d)
    return told.join(_rows_of(product(every, narrow)), "at").select(*out, "y", shares, F.lit(error).alias("identity_error"))


def whitened_components(vectors: DataFrame) -> DataFrame:
    """``whiten`` with one row per vector and component (numbered from 1):
    vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whiten(vectors)
    return (rows.select("*", F.posexplode("y").alias("k", "whitened"))
            .select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened",
                    F.element_at("explained", F.col("k") + 1).alias("explained"), "identity_error"))
