"""Quality classifier by Bradley-Terry pairwise ranking (operator 4).

Each whole text is described by a few measures of its characters, words and
lines. A preferred and a rejected document form a pair; the weights minimise
the logistic loss on the pair's feature difference. Measures are standardised
over all documents; every labelled row is in a pair. The cut between the
classes is a quantile of the scores of all labelled rows, and scores are mapped
so that it lies at ``CUT``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import buckets_for, dense_index, hex_bucket
from ..session import cut_lineage
from .bpe import LETTER, NUMBER, char_classes, code_points
from .columns import set_aside
from .textbuf import Slice, SpanHash, text_batches, trim, words

#: Pairs at least, while the classes have as many.
PAIRS, STEPS, RIDGE = 60_000, 60, 1e-3
#: Texts are measured in slices of so many bytes.
MEASURED_BYTES = 1 << 18
CUT = 0.3
MEASURES = ["letters", "upper", "digits", "spaces", "marks", "symbols", "bangs", "bars", "word_len", "log_words",
            "distinct", "repeats", "top_word", "odd_words", "line_len", "stops", "distinct_bends", "case_bends"]


def measures(s: Slice) -> np.ndarray:
    """One row of MEASURES for each text of a slice; an empty text is all 0."""
    n, out = len(s), np.zeros((len(s), len(MEASURES)))
    cp, pos = code_points(s.data)
    at = np.searchsorted(pos, s.offsets)
    row = np.repeat(np.arange(n), np.diff(at))
    cls = char_classes()[cp]
    chars = np.maximum(np.diff(at), 1)
    share = lambda sel: np.bincount(row[sel], minlength=n) / chars
    letter = cls == LETTER
    upper = letter & (((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE)))
    out[:, 0], out[:, 2], out[:, 3] = share(letter), share(cls == NUMBER), share(cp == 32)
    letters = np.maximum(np.bincount(row[letter], minlength=n), 1)
    out[:, 1] = np.bincount(row[upper], minlength=n) / letters
    out[:, 4] = share(np.isin(cp, [33, 34, 39, 44, 46, 58, 59, 63]))
    out[:, 5] = share(np.isin(cp, [35, 36, 37, 38, 42, 64, 94, 95, 126]))
    out[:, 6], out[:, 7], breaks = share(cp == 33), share(cp == 124), np.bincount(row[cp == 10], minlength=n)
    st, en, first = words(s)
    w = np.diff(first)
    own = np.repeat(np.arange(n), w)
    some = np.maximum(w, 1)
    h = SpanHash(s.data, lower=True)(st, en) if len(st) else np.empty(0, np.uint64)
    out[:, 8] = np.bincount(own, weights=np.minimum(en - st, 64), minlength=n) / some / 10
    out[:, 9] = np.log1p(w)
    by = np.lexsort((h, own))
    new = np.ones(len(h), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (own[by][1:] != own[by][:-1])
    head = np.flatnonzero(new)
    out[:, 10] = np.bincount(own[by][head], minlength=n) / some
    if len(h):
        run = np.diff(np.r_[head, len(h)])
        top = np.zeros(n)
        np.maximum.at(top, own[by][head], run)
        out[:, 12] = top / some
        same = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1]))
        out[:, 11] = np.bincount(own[same], minlength=n) / some
        last = s.data[en - 1]
        out[:, 13] = np.bincount(own[np.isin(last, [33, 35, 36, 37, 38, 42, 124])], minlength=n) / some
        out[:, 15] = np.bincount(own[last == 46], minlength=n) / some
    out[:, 14] = np.log1p(np.diff(at) / (breaks + 1)) / 5
    out[:, 16] = np.maximum(out[:, 10] - 0.5, 0)
    out[:, 17] = np.minimum(out[:, 1], 0.2)
    out[np.diff(at) == 0] = 0
    return out


def with_measures(docs: DataFrame, name: str = "x") -> DataFrame:
    """``docs`` with ``name``: array of the MEASURES of ``text``."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches):
        for b, s in text_batches(batches, MEASURED_BYTES):
            x = measures(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * len(MEASURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.slice(s.start, len(s)).columns, lists], names=schema.names)
        trim()

    return docs.mapInArrow(run, schema)


def measure_table(docs: DataFrame) -> DataFrame:
    """doc_id and ``x`` of every row."""
    return with_measures(docs.select("doc_id", "text")).drop("text")


def fit_pairs(good: np.ndarray, bad: np.ndarray, seed: int = 11) -> np.ndarray:
    """Bradley-Terry weights: mean log(1 + exp(-w (good - bad))) over random
    pairs plus a ridge, by Newton steps."""
    if not len(good) or not len(bad):
        return np.zeros(len(MEASURES))
    rnd = np.random.default_rng(seed)
    d = good[rnd.integers(len(good), size=PAIRS)] - bad[rnd.integers(len(bad), size=PAIRS)]
    return newton(lambda w: (*pair_sums(d, w), len(d)), d.shape[1])


def pair_sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature, summed over pairs of feature difference ``d``."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
    return -(d * p[:, None]).sum(0), (d * (p * (1 - p))[:, None]).T @ d


def newton(sums, width: int) -> np.ndarray:
    """Newton steps; ``sums(w)`` gives gradient, curvature and number of pairs."""
    w = np.zeros(width)
    for _ in range(STEPS):
        g, hess, n = sums(w)
        step = np.linalg.solve(hess / n + RIDGE * np.eye(width), g / n + RIDGE * w)
        w -= step * min(1.0, 5 / max(np.linalg.norm(step), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_pairs(rows: DataFrame, count: dict) -> DataFrame:
    """``d``: differences of ``x``, good less bad. Each row of the larger class is
    paired with rows of the smaller one by their ranks in the order of a hash,
    as often as it takes for PAIRS pairs; so every labelled row is in a pair."""
    many = int(count[1] >= count[0])
    n_many, n_few = count[many], count[1 - many]
    times = min(n_few, -(-PAIRS // n_many))
    h = rows.withColumn("_h", F.md5(F.col("doc_id").cast("string")))
    ranked = dense_index(h, ["_h", "doc_id", "x"], ["quality"], "_rank", hex_bucket("_h", buckets_for(n_many + n_few)))
    a = ranked.filter(F.col("quality") == many).select(
        F.col("x").alias("_a"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda k: F.pmod(F.col("_rank") + k, F.lit(n_few)))).alias("_rank"))
    b = ranked.filter(F.col("quality") == 1 - many).select("_rank", F.col("x").alias("_b"))
    good, bad = ("_a", "_b") if many else ("_b", "_a")
    return a.join(b, "_rank").select(F.zip_with(good, bad, lambda x, y: x - y).alias("d"))


def fit_table(pairs: DataFrame, std: np.ndarray) -> np.ndarray:
    """Weights of standardised differences; a step is one job over all pairs."""
    width = len(std)

    def sums(w):
        def run(batches):
            g, h, n = np.zeros(width), np.zeros((width, width)), 0
            for b in batches:
                d = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) / std
                own = pair_sums(d, w)
                g, h, n = g + own[0], h + own[1], n + len(d)
            yield pa.RecordBatch.from_pydict({"s": [[*g, *h.ravel(), float(n)]]}, pa.schema([("s", pa.list_(pa.float64()))]))

        total = np.sum([r.s for r in pairs.mapInArrow(run, "s array<double>").collect()], axis=0)
        return total[:width], total[width:-1].reshape(width, width), total[-1]

    return newton(sums, width)


def best_cut(scored: DataFrame) -> float:
    """The cut of (s, quality) that rejects most: right rejections less wrong
    ones, summed over all rows in the order of s."""
    per = cut_lineage(scored.groupBy("s").agg(F.sum(F.lit(1) - 2 * F.col("quality")).alias("gain")), "scores")
    lo, hi, n = per.agg(F.min("s"), F.max("s"), F.count("s")).first()
    nb = buckets_for(n)
    bucket = F.floor((F.col("s") - F.lit(lo)) * F.lit(nb) / F.lit((hi - lo) * (1 + 1e-9) or 1.0))
    d = per.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = d.groupBy("_b").agg(F.sum("gain").alias("_g")).select("_b", F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_off"))
    run = Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = d.withColumn("_own", F.sum("gain").over(run)).join(off, "_b").withColumn("total", F.col("_off") + F.col("_own"))
    top = ranked.agg(F.max(F.struct("total", -F.col("s"))).alias("t")).select("t.*").first()
    at = -top[1]
    after = per.filter(F.col("s") > F.lit(at)).agg(F.min("s")).first()[0]
    return lo - 1.0 if top[0] <= 0 or after is None else (at + after) / 2


class Ranker:
    def __init__(self, mean, std, w, cut: float, slope: float):
        self.mean, self.std, self.w, self.cut, self.slope = mean, std, w, cut, slope

    @classmethod
    def train(cls, table: DataFrame, labels: DataFrame, learn: Column) -> Ranker:
        """From a measure table and labels (doc_id, quality) of rows where ``learn`` holds."""
        cols = [F.col("x")[i] for i in range(len(MEASURES))]
        stat = table.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
        stat = np.array([0.0 if v is None else v for v in stat])
        mean, std = stat[:len(MEASURES)], stat[len(MEASURES):]
        std = np.where(std > 1e-9, std, 1.0)
        known = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").filter(learn).distinct()
        rows = cut_lineage(table.join(known, "doc_id").select("doc_id", "quality", "x"), "labelled")
        count = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
        if not count:
            return cls(mean, std, np.zeros(len(MEASURES)), 0.0, 1.0)
        w = fit_table(cut_lineage(labelled_pairs(rows, count), "pairs"), std) if len(count) == 2 else np.zeros(len(MEASURES))
        # all labelled rows decide the cut
        cut = best_cut(rows.select(cls(mean, std, w, 0.0, 1.0).linear(F.col("x")).alias("s"), "quality"))
        return cls(mean, std, w, float(cut), 1.0)

    def linear(self, x: Column) -> Column:
        """Weighted sum of the standardised measures."""
        total = F.lit(0.0)
        for i, (m, sd, w) in enumerate(zip(self.mean, self.std, self.w, strict=True)):
            total = total + (x[i] - F.lit(float(m))) * F.lit(float(w / sd))
        return total

    def score(self, x: Column) -> Column:
        """Score in 0 to 1; CUT at the threshold quantile."""
        total = F.lit(float(np.log(CUT / (1 - CUT)) - self.slope * self.cut))
        for i, (m, sd, w) in enumerate(zip(self.mean, self.std, self.w, strict=True)):
            total = total + (x[i] - F.lit(float(m))) * F.lit(float(self.slope * w / sd))
        total = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """The rows of ``docs`` that score at least CUT, with all their columns,
    whatever their names. Texts are measured twice (to fit, to filter) instead
    of being shuffled. Nulls, empty and repeated rows: as ``score_documents``;
    a score that ties with CUT stays."""
    docs, back = set_aside(docs, "_measures")
    ranker = Ranker.train(cut_lineage(measure_table(docs), "measures"), labels, learn)
    rows = with_measures(docs, "_measures")
    return back(rows.filter(ranker.score(F.col("_measures")) >= CUT).drop("_measures"))


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, score, predicted (1 if score >= CUT) of every row of ``docs``.

    A null or empty text is scored by measures of 0. Without labels of both
    classes every score is CUT. Repeated rows score alike, null ids stay, other
    columns are ignored; labels that are null or neither 0 nor 1 are not used;
    a text of any length is measured whole, in one task; equal measures give
    equal scores, and one equal to CUT counts as 1; an empty table gives no rows."""
    table = cut_lineage(measure_table(docs), "measures")
    ranker = Ranker.train(table, labels, learn)
    out = table.select("doc_id", ranker.score(F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
