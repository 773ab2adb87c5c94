"""Language identification (operator 1): sparse multinomial logistic regression
on TF-IDF character n-grams, trained by follow-the-regularised-leader with
elastic-net penalties, then temperature calibration.

N-grams of 1 to 3 code points (letters lower-cased, all else a space) are
hashed to ``DIMS`` features. Document frequencies cover every training row; the
weights are fitted on at most about ``PER_LANGUAGE`` rows of each language,
drawn by a hash of their id. The model is one table of ``DIMS`` x languages;
prediction adds its rows over a whole text, so nothing is cut."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import LETTER, char_classes, code_points
from .textbuf import Slice, U, mix, text_batches, trim

DIMS = 1 << 16
#: Expected rows per language that the weights are fitted on.
PER_LANGUAGE = 1500
#: So many language counts are broadcast at most.
LANGUAGES = 100_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-3, 1e-3
#: Scale of relative term frequencies, so that usual feature values are near 1.
SCALE = 100.0
UNKNOWN = "und"


@functools.cache
def _folded() -> np.ndarray:
    """Code point -> lower-case letter, or a space for what is no letter."""
    t = np.full(0x110000, 32, np.int32)
    for i in np.flatnonzero(char_classes() == LETTER).tolist():
        low = chr(i).lower()
        t[i] = ord(low) if len(low) == 1 else i
    return t


#: Texts are cut into n-grams in slices of so many bytes.
GRAM_BYTES = 1 << 18


def grams(s: Slice) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features of a slice's n-grams, for each n: (features, each row's first),
    and whether each row has a letter."""
    cp, pos = code_points(s.data)
    first = np.searchsorted(pos, s.offsets)
    row = np.repeat(np.arange(len(s), dtype=np.int32), np.diff(first))
    letter = np.bincount(row[char_classes()[cp] == LETTER], minlength=len(s)) > 0
    c = _folded()[cp].astype(U)
    out = []
    key = np.zeros(len(c), U)
    for n in range(3):
        m = len(c) - n
        if m <= 0:
            break
        key = key[:m] * U(0x1FFFFF) + c[n:] + U(1)
        ok = (row[:m] == row[n:]) & ((c[:m] != U(32)) | (c[n:] != U(32)))
        out.append(((mix(key[ok] + U(n)) >> U(48)).astype(np.int32), np.searchsorted(row[:m][ok], np.arange(len(s) + 1))))
    return out, letter


def row_grams(s: Slice):
    """The features of each row of a slice, all n together."""
    parts, _ = grams(s)
    for i in range(len(s)):
        yield np.concatenate([f[first[i]:first[i + 1]] for f, first in parts]) if parts else np.empty(0, np.int32)


def _document_counts(batches):
    df, n = np.zeros(DIMS, np.int64), 0
    seen = np.zeros(DIMS, bool)
    for _, s in text_batches(batches, GRAM_BYTES):
        for f in row_grams(s):
            seen[f] = True
            df += seen
            seen[:] = False
        n += len(s)
    trim()
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[df[some], n])], names=["feature", "n"])


def _sparse_rows(batches):
    for b, s in text_batches(batches, GRAM_BYTES):
        idx, val = [], []
        for f in row_grams(s):
            u, n = np.unique(f, return_counts=True)
            idx.append(u.astype(np.int32).tobytes())
            val.append((n * (SCALE / max(len(f), 1))).astype(np.float32).tobytes())
        part = b.slice(s.start, len(s))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("lang"), part.column("tune"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
            names=["doc_id", "lang", "tune", "idx", "val"])
    trim()


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of accumulated gradients ``z`` and squares ``n``."""
    w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights DIMS x classes by FTRL over (features, values, class) rows."""
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))
    rnd = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rnd.permutation(len(rows)).tolist():
            f, v, y = rows[i]
            zi, ni = z[f], n[f]
            w = weights_of(zi, ni)
            p = _softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[f] = ni + g * g
    return weights_of(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, g = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """``table``: idf-weighted weights by feature and language, over the temperature."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    @classmethod
    def train(cls, docs: DataFrame, learn: Column, tune: Column) -> Model:
        """Learns from the rows where ``learn`` holds and lang is not null; those
        where ``tune`` holds set the temperature."""
        spark = docs.sparkSession
        rows = docs.select("doc_id", "text", "lang", tune.alias("tune"), learn.alias("learn")).filter("learn and lang is not null")
        per = rows.groupBy("lang").agg(F.count("*").alias("of_lang"))
        # Arrow tables: rows that are collected as objects take many times their size in both of the driver's processes
        df = (rows.select("text").mapInArrow(_document_counts, "feature long, n long")
              .groupBy("feature").agg(F.sum("n").alias("n")).toArrow())
        feature, n = (df.column(c).to_numpy() for c in ("feature", "n"))
        share = F.lit(float(PER_LANGUAGE)) / F.col("of_lang")
        draw = F.pmod(F.xxhash64(F.lit("language-id"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
        per = cut_lineage(per, "languages")
        if per.count() <= LANGUAGES:  # else the texts are joined by language
            per = F.broadcast(per)
        sample = cut_lineage(rows.drop("learn").join(per, "lang").filter(draw < share).drop("of_lang"), "sample")
        sample = sample.mapInArrow(_sparse_rows, "doc_id long, lang string, tune boolean, idx binary, val binary").toArrow()
        if not len(sample):
            return cls([], np.zeros((DIMS, 0), np.float32))
        total = int(n[feature == -1].sum())
        count = np.zeros(DIMS)
        count[feature[feature >= 0]] = n[feature >= 0]
        langs, table = _fitted(sample, np.log((1 + total) / (1 + count)) + 1)
        del sample
        trim()
        return cls(langs, table)


def _fitted(sample: pa.Table, idf: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and calibrated table of the sampled rows (see ``_sparse_rows``)."""
    lang, tune, idx, val = (sample.column(c) for c in ("lang", "tune", "idx", "val"))
    langs = sorted(pc.unique(lang).to_pylist())
    data = []
    for i in pc.sort_indices(sample.select(["doc_id", "lang"]), [("doc_id", "ascending"), ("lang", "ascending")]).to_pylist():
        f, v = np.frombuffer(idx[i].as_buffer(), np.int32), np.frombuffer(val[i].as_buffer(), np.float32)
        data.append((f, v * idf[f], langs.index(lang[i].as_py()), bool(tune[i].as_py())))
    w = fit([d[:3] for d in data if not d[3]] or [d[:3] for d in data], len(langs))
    held = [d for d in data if d[3]]
    t = temperature(np.array([v @ w[f] for f, v, _, _ in held]).reshape(len(held), len(langs)), np.array([d[2] for d in held], int))
    return langs, (w * idf[:, None] * (SCALE / t)).astype(np.float32)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to every row of ``docs`` (replacing columns of
    these names)."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table))
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*rest)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        langs, table = shared.value
        for b, s in text_batches(batches, GRAM_BYTES):
            parts, letter = grams(s)
            total, size = np.zeros((len(s), len(langs))), np.zeros(len(s), np.int64)
            for f, first in parts:
                some = np.flatnonzero(np.diff(first))
                size += np.diff(first)
                for k in range(len(langs) if len(some) else 0):
                    total[some, k] += np.add.reduceat(table[f, k], first[:-1][some], dtype=np.float64)
            if langs:
                p = _softmax(total / np.maximum(size, 1)[:, None])
                score, pred = p.max(1), [langs[k] for k in p.argmax(1)]
            else:
                score, pred = np.zeros(len(s)), [UNKNOWN] * len(s)
            score = np.where(letter, score, 0.0)
            pred = [x if ok else UNKNOWN for x, ok in zip(pred, letter.tolist(), strict=True)]
            part = b.slice(s.start, len(s))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], names=schema.names)
        trim()

    return docs.mapInArrow(run, schema)


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id long,
    text, lang; other columns are ignored).

    Learns from rows whose crc32 of the id mod 4 is not 2 (3: temperature). A
    row with a null id is held out. A null text or one without a letter is
    ``und`` with score 0, as is every text when there is nothing to learn from.
    Repeated rows are predicted alike; an empty table gives no rows."""
    held = F.coalesce(remainder(4) == 2, F.lit(True))
    model = Model.train(docs, ~held, remainder(4) == 3)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
