"""Invertible sketches: recovered differences and the edited versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecprobe.llm.fingerprints import START_CHARS, _cuts, compare_fingerprints, differences, digests, fingerprint_versions, likeness, read, sketch
from vecprobe.llm.textbuf import slices

from .texts import awkward


def _of(texts):
    return digests(next(slices(pa.array(texts, pa.large_string()), 1 << 60)))


def _sketch(texts):
    return sketch(*_of(texts))


def _paragraphs(text):
    """Brute force: the text's paragraphs with how often each occurs."""
    return Counter(re.findall(r"(?:[^\n.!?]|[.!?](?! ))*(?:\n|[.!?](?= )|$)", text)[:-1])


def test_differences_are_recovered_whatever_their_number():
    rnd = random.Random(3)
    a, b = [], []
    for n in (0, 1, 3, 8, 40, 400, 3000):
        x = [f"line {rnd.randrange(10 ** 6)}\n" for _ in range(n)] * 2
        y = [l for l in x if rnd.random() < 0.6] + [f"new {i}\n" for i in range(n // 2)]
        a += ["".join(x), "".join(x)]
        b += ["".join(y), "".join(x)]
    da, db = _of(a), _of(b)
    for i, (only_a, only_b) in enumerate(differences(sketch(*da), sketch(*db))):
        x, y = (Counter(d[f[i]:f[i + 1]].tolist()) for d, f in (da, db))
        assert (Counter(only_a.tolist()), Counter(only_b.tolist())) == (x - y, y - x)


def test_likeness_and_equal_fingerprints():
    same = _sketch(["a\nb\na", "x. y. z", ""])
    assert likeness(same, same).tolist() == [1, 1, 1]
    assert likeness(_sketch(["a. b. c. d"]), _sketch(["a. b. x. y"]))[0] == pytest.approx(1 / 3)
    assert likeness(_sketch(["", "a"]), _sketch(["b", ""])).tolist() == [0, 0]
    t = _sketch(["p\nq", "p\nq", "q\np"]).texts()
    assert t[0] == t[1] and len(set(map(len, t))) == 1


def test_versions_follow_descending_ids(spark):
    texts = awkward()
    rows = [(3 * i, t, 9, "x") for i, t in enumerate(texts)] + [(None, "no id. at all", 1, None), (6, "tie", 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, bucket string").repartition(4)
    order = sorted([(i, t or "") for i, t, *_ in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    exp = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        h = len(t) // 2
        exp.append((i, len(t), hashlib.sha256((t[:len(t) - h] + nxt[:h]).encode()).hexdigest()))
    got = fingerprint_versions(df).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(exp, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint_versions(df.filter("false")).count() == 0
    one = fingerprint_versions(spark.createDataFrame([(1, "a. b.")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.n_chars == 5
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])


def test_sizes_follow_the_text_and_sketches_of_any_sizes_compare():
    rnd = random.Random(8)
    lines = [f"l{rnd.randrange(10 ** 9)}\n" for _ in range(6000)]
    a = ["".join(lines[:n]) for n in (0, 1, 5, 30, 900, 6000, 6000, 20)]
    b = ["".join(lines[k:n]) for k, n in ((0, 6000), (0, 900), (5, 10), (29, 31), (0, 901), (0, 1), (3000, 6000), (0, 0))]
    x, y = _sketch(a), _sketch(b)
    assert x.part.tolist() == [_sketch([t]).part[0] for t in a]  # not by its neighbours
    assert (x.part[5] > 100 * x.part[1]) and (x.take(np.arange(len(a))).peel()[3]).all()
    again = read(x.texts())
    assert again.texts() == x.texts() and again.total().tolist() == [t.count("\n") for t in a]
    for p, q in ((x, y), (y, x), (again, read(y.texts()))):
        for (only_p, only_q), s, t in zip(differences(p, q), *((a, b) if p is not y else (b, a)), strict=True):
            one, two = Counter(s.splitlines()), Counter(t.splitlines())
            assert (len(only_p), len(only_q)) == ((one - two).total(), (two - one).total())
    small = x.folded(np.minimum(x.part, 8), np.arange(len(a)))
    assert small.total().tolist() == x.total().tolist()


def test_likeness_follows_from_the_returned_strings(spark):
    texts = [t or "" for t in awkward()] + ["One. Two! Three? Four.\nfive " * k for k in (1, 7, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = fingerprint_versions(df).withColumn("found", F.lit("own"))
    rows = {r.doc_id: r for r in compare_fingerprints(got, "fingerprint", "edited_fingerprint").collect()}
    order = sorted(rows, reverse=True)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        r, t, u = rows[i], texts[i], texts[nxt]
        edited = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        assert r.found == "own" and r.near_edited == r.likeness
        assert r.near_next == likeness(read([r.fingerprint]), read([rows[nxt].fingerprint]))[0]
        one, two = _paragraphs(t), _paragraphs(edited)
        assert (len(r.only_a), len(r.only_b)) == ((one - two).total(), (two - one).total())
        whole = (one | two).total()
        assert r.likeness == pytest.approx((one & two).total() / whole if whole else 1)


def test_comparing_keeps_nulls_columns_and_empty_tables(spark):
    t = _sketch(["a. b", "a. c", ""]).texts()
    df = spark.createDataFrame([(1, t[0], t[1], 5.0), (2, None, t[0], 6.0), (3, t[2], t[2], None)], "only_a long, a string, b string, likeness double")
    got = compare_fingerprints(df.withColumn("found", F.col("only_a")), "a", "b").sort("found").collect()
    assert [(r.found, r.likeness) for r in got] == [(1, pytest.approx(1 / 3)), (2, None), (3, 1.0)]
    assert len(got[0].only_a) == len(got[0].only_b) == 1 and got[1].only_a is None
    assert compare_fingerprints(df.filter("false"), "a", "b").count() == 0


def test_rows_without_id_and_of_one_id_spread_over_ranges(spark):
    rows = [(None, f"{i:05d} text. of none") for i in range(300)] + [(7, f"{i:05d} text. of seven") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    cuts = _cuts(df.select("doc_id", F.substring("text", 1, START_CHARS).alias("start")), 8)
    assert len(cuts) >= 6 and len({c[0] for c in cuts}) == 2
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    exp = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        h = len(t) // 2
        exp.append((i, len(t), hashlib.sha256((t[:len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert sorted((tuple(r)[:3] for r in fingerprint_versions(df).collect()), key=repr) == sorted(exp, key=repr)
