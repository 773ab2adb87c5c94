"""Document fingerprints: invertible Bloom lookup sketches (operator 8).

A document is the multiset of its paragraphs (lines, cut further after a full
stop, exclamation or question mark before a space), each a 64-bit digest; the
k-th copy of a paragraph has a digest of its own. A digest adds itself to one
cell in each of three parts of the sketch: a count, a sum of digests and a sum
of checks. Peeling cells that hold one digest recovers what a sketch holds.

A text's sketch has a size that follows from the text alone: parts of a power
of two of cells, about half as many as paragraphs or more, doubled until the
sketch peels by itself. Two sketches of any sizes compare without their texts:
the larger folds to the smaller's size, the cells subtract, and peeling recovers
the paragraphs in which the versions differ. If it stops early, both sketches
are peeled, built again twice as large as the larger, and subtracted, until it
succeeds.

All rows of a slice are built and peeled together as arrays."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import free_name
from ..session import cut_lineage
from .textbuf import U, Slice, SpanHash, mix, slices

#: Cells of a part in the smallest sketch, and bytes of a cell.
LEAST, CELL = 4, 16
ROWS_PER_RANGE = 20_000
#: Code points of a text that place rows of one doc_id, or of none, in ranges.
START_CHARS = 48
_PART = [U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)]
_RAW = [("n", "<i4"), ("c", "<u4"), ("k", "<u8")]


def _check(d: np.ndarray) -> np.ndarray:
    return (mix(d ^ U(0x589965CC75374CC3)) >> U(32)).astype(np.uint32)


def digests(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of a slice (flat) and each row's first."""
    d = s.data
    if not len(d):
        return np.empty(0, U), np.zeros(len(s) + 1, np.int64)
    stop = d == 10
    stop[:-1] |= ((d[:-1] == 46) | (d[:-1] == 33) | (d[:-1] == 63)) & (d[1:] == 32)
    ends = np.union1d(np.flatnonzero(stop) + 1, s.offsets[1:][np.diff(s.offsets) > 0])
    starts = np.r_[0, ends[:-1]]
    h = SpanHash(d)(starts, ends)
    first = np.searchsorted(starts, s.offsets)
    row = np.repeat(np.arange(len(s)), np.diff(first))
    by = np.lexsort((h, row))
    same = np.r_[False, (h[by][1:] == h[by][:-1]) & (row[by][1:] == row[by][:-1])]
    at = np.arange(len(h))
    nth = np.empty(len(h), np.int64)
    nth[by] = at - np.maximum.accumulate(np.where(same, 0, at))
    return mix(h + nth.astype(U) * U(0x9E3779B97F4A7C15)), first


def _cat(parts: list, kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


class Sketches:
    """The sketches of many rows; row i has three parts of ``part[i]`` cells."""

    def __init__(self, part: np.ndarray):
        self.part = np.asarray(part, np.int64)
        self.base = np.r_[0, np.cumsum(3 * self.part)]
        size = int(self.base[-1])
        self.count = np.zeros(size, np.int64)
        self.key, self.check = np.zeros(size, U), np.zeros(size, np.uint32)

    def __len__(self) -> int:
        return len(self.part)

    def _places(self, d: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        part, base = self.part[row], self.base[row]
        return [base + k * part + (mix(d ^ _PART[k]).astype(np.int64) & (part - 1)) for k in range(3)]

    def add(self, d: np.ndarray, row: np.ndarray, sign=1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), d.shape)
        key, check = d * sign.astype(U), _check(d) * sign.astype(np.uint32)
        for p in self._places(d, row):
            np.add.at(self.count, p, sign)
            np.add.at(self.key, p, key)
            np.add.at(self.check, p, check)

    def total(self) -> np.ndarray:
        """How many digests each row holds."""
        return np.add.reduceat(self.count, self.base[:-1]) // 3 if len(self) else np.empty(0, np.int64)

    def take(self, rows: np.ndarray) -> Sketches:
        """A copy of some rows."""
        return self.folded(self.part[rows], rows)

    def folded(self, part: np.ndarray, rows: np.ndarray) -> Sketches:
        """A copy of some rows in parts of ``part`` cells, not more than they have."""
        out = Sketches(part)
        size = 3 * self.part[rows]
        own = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        old, new = self.part[rows][own], out.part[own]
        to = out.base[own] + at // old * new + (at % old & (new - 1))
        cell = self.base[rows][own] + at
        np.add.at(out.count, to, self.count[cell])
        np.add.at(out.key, to, self.key[cell])
        np.add.at(out.check, to, self.check[cell])
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.part)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (digest, row, sign) and, by row, whether all was recovered.
        Empties the sketches as far as it comes."""
        got_d, got_row, got_sign = [], [], []
        row_of = np.repeat(np.arange(len(self)), 3 * self.part)
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[pure]
            d = self.key[pure] * sign.astype(U)
            ok = _check(d) * sign.astype(np.uint32) == self.check[pure]
            pure, sign, d = pure[ok], sign[ok], d[ok]
            row = row_of[pure]
            ok = np.zeros(len(d), bool)  # a digest must belong in the cell that shows it
            for p in self._places(d, row):
                ok |= p == pure
            d, row, sign = d[ok], row[ok], sign[ok]
            if not len(d):
                break
            by = np.lexsort((d, row))
            one = by[np.r_[True, (d[by][1:] != d[by][:-1]) | (row[by][1:] != row[by][:-1])]]
            d, row, sign = d[one], row[one], sign[one]
            self.add(d, row, -sign)
            got_d.append(d)
            got_row.append(row)
            got_sign.append(sign)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        whole = ~np.logical_or.reduceat(left, self.base[:-1]) if len(self) else np.empty(0, bool)
        return _cat(got_d, U), _cat(got_row, np.int64), _cat(got_sign, np.int64), whole

    def texts(self) -> list[str]:
        """Base64 of each row's cells: count (4 bytes), check (4), key (8)."""
        raw = np.zeros(len(self.count), _RAW)
        raw["n"], raw["c"], raw["k"] = self.count, self.check, self.key
        b, at = raw.tobytes(), (CELL * self.base).tolist()
        return [base64.b64encode(b[i:j]).decode() for i, j in zip(at[:-1], at[1:], strict=True)]


def read(texts: list[str]) -> Sketches:
    """The sketches that ``Sketches.texts`` wrote."""
    raw = [base64.b64decode(t) for t in texts]
    out = Sketches(np.array([len(r) // (3 * CELL) for r in raw], np.int64))
    cells = np.frombuffer(b"".join(raw), _RAW)
    out.count, out.check, out.key = cells["n"].astype(np.int64), cells["c"].copy(), cells["k"].copy()
    return out


def _rows(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sketch(d: np.ndarray, first: np.ndarray) -> Sketches:
    """Each row's sketch, in the least size from which it peels by itself;
    d, first: as of ``digests``."""
    row, n = _rows(first), np.diff(first)
    part = LEAST << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / (2 * LEAST))), 0).astype(np.int64)
    left = np.arange(len(n))
    while len(left):
        mine = np.isin(row, left)
        trial = Sketches(part[left])
        trial.add(d[mine], np.searchsorted(left, row[mine]))
        left = left[~trial.peel()[3]]
        part[left] *= 2
    out = Sketches(part)
    out.add(d, row)
    return out


def differences(a: Sketches, b: Sketches) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row, the digests that only ``a`` and only ``b`` hold, from the
    sketches alone."""
    out: list = [None] * len(a)
    left, part = np.arange(len(a)), np.minimum(a.part, b.part)
    x, y = a.folded(part, left), b.folded(part, left)
    part = np.maximum(a.part, b.part)
    while True:
        d, row, sign, whole = x.minus(y).peel()
        by = np.argsort(row, kind="stable")
        edge = np.searchsorted(row[by], np.arange(len(left) + 1))
        for k in np.flatnonzero(whole).tolist():
            own = by[edge[k]:edge[k + 1]]
            out[left[k]] = (d[own][sign[own] > 0], d[own][sign[own] < 0])
        left = left[~whole]
        if not len(left):
            return out
        part[left] *= 2
        x, y = _grown(a, left, part[left]), _grown(b, left, part[left])


def _grown(s: Sketches, rows: np.ndarray, part: np.ndarray) -> Sketches:
    """Some rows' sketches built again in parts of ``part`` cells, out of what
    peeling recovers from them."""
    d, row, sign, whole = s.take(rows).peel()
    if not whole.all():
        raise ValueError("a sketch does not peel: not one that sketch() built")
    out = Sketches(part)
    out.add(d, row, sign)
    return out


def likeness(a: Sketches, b: Sketches) -> np.ndarray:
    """Shared paragraphs over all paragraphs of both, by row; 1 if both are empty."""
    return _likeness(differences(a, b), a, b)


def _likeness(found: list, a: Sketches, b: Sketches) -> np.ndarray:
    diff = np.array([len(x) + len(y) for x, y in found], float)
    total = a.total() + b.total()
    return np.where(total > 0, 1 - diff / np.maximum((total + diff) / 2, 1), 1.0)


def compare_fingerprints(versions: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``only_a``, ``only_b`` (sorted arrays of paragraph digests, as signed
    longs) and ``likeness`` to rows that hold two fingerprints, recovered from
    the two strings; nulls where either is null. The rows' other columns stay,
    those of these three names are replaced; no shuffle. A string that is no
    fingerprint is an error."""
    kind = pa.struct([("only_a", pa.list_(pa.int64())), ("only_b", pa.list_(pa.int64())), ("likeness", pa.float64())])

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        some = np.flatnonzero(left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False))
        x, y = (read(c.take(pa.array(some, pa.int64())).to_pylist()) for c in (left, right))
        found = differences(x, y)
        rows: list = [None] * len(left)
        for i, (p, q), v in zip(some.tolist(), found, _likeness(found, x, y).tolist(), strict=True):
            rows[i] = {"only_a": np.sort(p.view(np.int64)), "only_b": np.sort(q.view(np.int64)), "likeness": v}
        return pa.array(rows, kind)

    found = F.arrow_udf(run, "only_a array<long>, only_b array<long>, likeness double")(F.col(a), F.col(b))
    names = [c for c in versions.columns if c not in ("only_a", "only_b", "likeness")]
    both = versions.select(*names, found.alias(free_name(versions.columns, "found")))
    got = F.col(both.columns[-1])
    return both.select(*names, *[got[c].alias(c) for c in ("only_a", "only_b", "likeness")])


def _fingerprint(batches):
    held = None  # (bucket, doc_id, text) waiting for the next document
    for b in batches:
        for s in slices(b.column("text")):
            part = b.slice(s.start, len(s))
            rows = ([held] if held else []) + list(zip(part.column("bucket").to_pylist(), part.column("role").to_pylist(),
                                                       part.column("doc_id").to_pylist(), [s.text(i) for i in range(len(s))], strict=True))
            pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if x[0] == y[0] and x[1] == 0]
            held = rows[-1]
            if pairs:
                yield _described(pairs)


def _described(pairs: list[tuple]) -> pa.RecordBatch:
    text, after = [x[3] for x, _ in pairs], [y[3] for _, y in pairs]
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(text, after, strict=True)]
    as_slice = lambda t: next(slices(pa.array(t, pa.large_string()), 1 << 62))
    own, new, nxt = (sketch(*digests(as_slice(t))) for t in (text, edited, after))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(t) for t in text], pa.int64()),
         pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited]),
         pa.array(own.texts()), pa.array(new.texts()),
         pa.array(likeness(own, new)), pa.array(likeness(own, nxt))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _order(doc_id, start) -> tuple:
    """Descending ids, none last, then texts."""
    return (doc_id is None, -(doc_id or 0), start)


def _cuts(keys: DataFrame, parts: int) -> list[tuple]:
    """The first (doc_id, start) of each of about ``parts`` ranges, in order."""
    dealt = keys.repartitionByRange(parts, F.desc_nulls_last("doc_id"), "start").withColumn("part", F.spark_partition_id())
    first = dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(0))).alias("down"), "start", "doc_id")).alias("f"))
    return sorted(((r.f.doc_id, r.f.start) for r in first.collect()), key=lambda c: _order(*c))


def _range_of(cuts: list[tuple]):
    """Twice the number of the range of (doc_id, start), and 1 for a range's first."""
    edges = [_order(*c) for c in cuts]

    def run(doc_id: pa.Array, start: pa.Array) -> pa.Array:
        out = []
        for key in map(_order, doc_id.to_pylist(), start.to_pylist()):
            i = bisect_right(edges, key) - 1
            out.append(2 * i + (edges[i] == key))
        return pa.array(out, pa.int64())

    return F.arrow_udf(run, "long")


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last
    floor(n_chars / 2) code points replaced by the first as many of the next
    document in descending doc_id (after the last: the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; the likeness columns follow from the fingerprints
    alone (``likeness``, ``compare_fingerprints``). A null text is empty. Rows
    that repeat a doc_id follow one another in the order of their texts; null
    ids come last; one document is its own next; equal rows are alike in all
    columns but the last one's; a long text has a longer fingerprint and is one
    task's record; columns other than doc_id and text are ignored; an empty
    table gives no rows.

    Documents are dealt to ranges of (doc_id, first code points of the text);
    each range also gets the first document of the next one, so that only the
    texts at the borders are read twice and texts are shuffled once. The ranges'
    firsts (one per ROWS_PER_RANGE rows) are what the driver holds. Rows of one
    id, or of none, share a task only where their texts begin alike."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    start = F.substring("text", 1, START_CHARS)
    keys = cut_lineage(rows.select("doc_id", start.alias("start")), "fingerprint-keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // ROWS_PER_RANGE))
    cuts = _cuts(keys, parts)
    placed = rows.withColumn("at", _range_of(cuts)("doc_id", start))
    n = max(len(cuts), 1)
    border = (placed.filter("at % 2 = 1").groupBy("at", "doc_id").agg(F.min("text").alias("text"))
              .select("doc_id", "text", F.pmod(F.shiftright("at", 1) - 1, F.lit(n)).alias("bucket"), F.lit(1).alias("role")))
    every = placed.select("doc_id", "text", F.shiftright("at", 1).alias("bucket"), F.lit(0).alias("role")).unionByName(border)
    return (every.repartition(parts, "bucket")
            .sortWithinPartitions("bucket", "role", F.desc_nulls_last("doc_id"), "text")
            .mapInArrow(_fingerprint, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                      "edited_fingerprint string, near_edited double, near_next double"))
