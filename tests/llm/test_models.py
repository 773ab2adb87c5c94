"""Language identification, quality ranking and the embedding graph on small tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from vecprobe.llm.embedding_graph import near_duplicates, unit
from vecprobe.llm.language_id import identify_languages, remainder, temperature
from vecprobe.llm.quality_ranker import CUT, fit_pairs, keep_good, score_documents

WORDS = {"en": "the of and thing other with", "de": "der und nicht schön über straße", "ru": "это был человек время слово"}


def _texts(seed, n):
    rnd = random.Random(seed)
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        yield i, " ".join(rnd.choices(WORDS[lang].split(), k=rnd.randrange(2, 60))), lang


def test_language_id_held_out_accuracy_and_odd_texts(spark):
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 ...", "ru"), (None, "the other thing", "en"), (1004, "und " * 60_000, None), (3, "the tie", "en")]
    df = spark.createDataFrame([(i, t, lang, 1.0, "x") for i, t, lang in [*_texts(1, 240), *odd]],
                               "doc_id long, text string, lang string, score double, held_out string").repartition(3)
    rows = identify_languages(df).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    lang = {i: x for i, _, x in _texts(1, 240)}
    held = [r for r in rows if r.held_out and r.doc_id in lang and r.doc_id != 3]
    assert len(held) > 30 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in rows}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1004].lang_pred == "de"
    empty = df.filter("false")
    assert identify_languages(empty).count() == 0
    assert {r.lang_pred for r in identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_temperature_undoes_overconfidence():
    rnd = np.random.default_rng(1)
    z = rnd.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rnd.choice(3, p=q) for q in p])
    assert 4 < temperature(z * 5, y) < 6 and temperature(z[:0], y[:0]) == 1.0


def test_bradley_terry_ranks_by_the_telling_measure():
    rnd = np.random.default_rng(2)
    good, bad = rnd.normal(size=(300, 18)), rnd.normal(size=(300, 18))
    good[:, 3] += 3
    w = fit_pairs(good, bad)
    assert w.argmax() == 3 and not fit_pairs(good, bad[:0]).any()


def test_quality_scores(spark):
    rnd = random.Random(3)
    def junk():
        return " ".join([rnd.choice(["AAA!!", "buy$$$", "x|"])] * rnd.randrange(20, 60))
    rows = [(i, t if i % 4 else junk()) for i, t, _ in _texts(5, 400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "w " * 50_000), (None, "no id")], "doc_id long, text string").withColumn("score", F.lit("c")).withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400)] + [(5, None, 1), (None, 1, 0), (900, 7, 0)], "doc_id long, quality int, toxic int")
    learn = ~F.coalesce(remainder(5) == 0, F.lit(True))
    out = score_documents(docs, labels, learn).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= CUT) for r in out)
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in out if r.doc_id is not None and r.doc_id < 400]) > 0.97
    kept = keep_good(docs, labels, learn)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert score_documents(docs.filter("false"), labels, learn).count() == 0
    assert {r.predicted for r in score_documents(docs, labels.filter("false"), learn).collect()} == {1}


def test_embedding_graph_equals_brute_force(spark):
    rnd = np.random.default_rng(4)
    x = []
    for _ in range(60):
        c = rnd.normal(size=16)
        x += [(c + 0.04 * rnd.normal(size=16)).tolist() for _ in range(rnd.integers(1, 9))]
    x += [x[0], x[0], [2 * v for v in x[1]]]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0]]
    rows = [(i, v, 1, "c") for i, v in enumerate([*x, *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, copies string").repartition(3)
    u = unit(np.array(x, dtype=np.float32))
    link = u @ u.T >= 0.95
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.where(link, comp[None, :], len(x)).min(1)
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum() - 1, comp[i], comp[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(len(x), len(rows)))
    assert near_duplicates(df.filter("false")).count() == 0


def test_embedding_graph_keeps_doubles_and_rows_without_id(spark):
    big, small = [[1e200, 0.0, 2e199], [1e-60, 0.0, 2e-61]], [0.0, 1e-300, 0.0]
    rows = [(4, big[0]), (2, big[1]), (9, small), (None, big[0]), (None, None), (5, [0.0, 1e300, 0.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(4, 1, 2, False), (2, 1, 2, True), (9, 1, 5, False), (5, 1, 5, True), (None, 0, None, True), (None, 0, None, True)], key=repr)
    alone = near_duplicates(spark.createDataFrame([(None, big[0]), (3, None)], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in alone} == {(None, 0, None, True), (3, 0, 3, True)}


def test_ranker_learns_from_every_labelled_row(spark):
    """Before, pairs and cut came from a draw of rows."""
    from vecprobe.llm.quality_ranker import best_cut, labelled_pairs
    rnd = np.random.default_rng(8)
    y = rnd.random(700) < 0.8
    rows = spark.createDataFrame([(i, int(q), [float(i)] if q else [-10000.0 * i - 10000]) for i, q in enumerate(y)], "doc_id long, quality int, x array<double>")
    count = {1: int(y.sum()), 0: int((~y).sum())}
    d = [int(r.d[0]) for r in labelled_pairs(rows, count).collect()]
    assert {v % 10000 for v in d} == set(np.flatnonzero(y)) and {v // 10000 - 1 for v in d} == set(np.flatnonzero(~y))
    assert len(d) == len(set(d)) >= 60_000
    s = np.round(rnd.normal(size=700) + y, 1)
    cut = best_cut(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, quality int"))
    gain = lambda c: ((s < c) & ~y).sum() - ((s < c) & y).sum()
    assert gain(cut) == max(gain(c) for c in [s.min() - 1, *(np.unique(s) + 0.05)])
