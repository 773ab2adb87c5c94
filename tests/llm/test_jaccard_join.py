"""N-gram Jaccard join against its definition by all pairs."""

import random

import pytest

from vecprobe.llm.jaccard_join import (brute_force, drop_near_duplicates, jaccard_groups, least_shared, prefix_length, prefix_sql,
                                       shared_sql)


def _run(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(df).collect()}


def test_matches_all_pairs_with_copies_near_copies_and_shared_passages(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = {0: None, 1: "", 2: " \t\n", 3: "One two", 4: "one  TWO", 5: "a b c d", 6: "a b c d e", 7: "É b c d e f"}
    passage = rnd.choices(vocab, k=60)
    for g in range(12):
        base = rnd.choices(vocab, k=rnd.choice([6, 12, 40, 150]))
        for _ in range(rnd.choice([1, 2, 5, 15])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts[len(texts)] = " ".join(t)
        texts[len(texts)] = " ".join(passage + rnd.choices(vocab, k=rnd.choice([5, 12, 20, 90])))
    texts[len(texts)] = "long " * 30_000 + " ".join(rnd.choices(vocab, k=20_000))
    assert _run(spark, texts) == brute_force(texts)


def test_edges_of_the_threshold(spark):
    # 4 words against 5: one shingle each, different; equal sequences link
    w = [f"x{i}" for i in range(40)]
    texts = {1: " ".join(w[:14]), 2: " ".join(w[:13]), 3: " ".join(w[1:13]), 4: "x0 x1 x2 x3", 5: "X0\tx1\nx2 x3"}
    assert _run(spark, texts) == brute_force(texts)


@pytest.mark.parametrize("rows", [[], [(None, "a b c"), (7, None)]])
def test_empty_tables_null_ids_and_clashing_names(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows],
                               "doc_id long, text string, component_id int, n int, key string")
    assert [tuple(r) for r in jaccard_groups(df).collect()] == [(i, 0, i) for i, _ in rows if i is not None]
    assert drop_near_duplicates(df).columns == df.columns


def _kept(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n int, key string").repartition(3)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


@pytest.mark.parametrize("far", [0, 2**63 - 100, None])
def test_drop_keeps_null_ids_and_one_row_of_each_group(spark, far):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda t: t + " more"
    rows = [(None, c), (None, c), (None, near(c)), (None, near(a)), (None, None), (None, "lone words"),
            (5, a), (5, a), (5, b), (9, near(a)), (10, near(b)), (3, d), (3, d), (8, d), (11, near(d)), (12, None), (13, ""), (13, "")]
    expect = [(5, a), (5, b), (3, d), (12, None), (13, ""), (None, None), (None, "lone words")]
    if far is None:  # ids at both ends of the range leave no room
        more = [(-2**63, "far words"), (2**63 - 1, "further words")]
    else:
        more = [(far + 90, "far words")]
    kept = _kept(spark, rows + more)
    assert [x for x in kept if x[1] not in (c, near(c))] == sorted(expect + more, key=str)
    assert sum(x[1] in (c, near(c)) for x in kept) == 1


def test_drop_of_repeated_rows_alone(spark):
    t = " ".join(f"w{i}" for i in range(30))
    assert _kept(spark, [(1, t), (1, t), (2, t), (3, "x y"), (3, "x y")]) == [(1, t), (3, "x y")]
    assert _kept(spark, []) == []


def test_ids_with_several_texts_unite_the_groups_of_all(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (9, a + " more"), (3, b + " more"), (4, c), (4, c), (5, None), (5, c + " more"), (8, None)]
    out = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, out.collect())) == [(3, 57, 3), (4, 56, 4), (4, 56, 4), (5, 0, 4), (5, 57, 4), (7, 56, 3), (7, 56, 3),
                                                 (8, 0, 8), (9, 57, 3)]


def test_bounds_on_shared_prefix_shingles(spark):
    """The SQL bounds against their definition, and against random sets under
    random orders: similar sets share at least so many of their prefixes."""
    sizes = [(n, m) for n in (*range(1, 30), 97, 400, 12_345) for m in range(-(-4 * n // 5), min(n + 3, 5 * n // 4) + 1)]
    got = (spark.createDataFrame(sizes, "n long, m long")
           .selectExpr("n", "m", f"{prefix_sql('n', 80)} AS p", f"{shared_sql('n', 'm', 80)} AS s").collect())
    for r in got:
        least = -(-80 * (r.n + r.m) // 180)
        assert r.p == prefix_length(r.n, 80)
        assert r.s == min(prefix_length(r.n, 80) - (r.n - least), prefix_length(r.m, 80) - (r.m - least))
        assert r.s >= min(least_shared(r.n), least_shared(r.m)) >= 1
    rnd, bound = random.Random(3), {(r.n, r.m): r.s for r in got}
    for n, m in rnd.sample([x for x in bound if x[0] < 500], 60):
        both = -(-80 * (n + m) // 180)
        if both > min(n, m):
            continue
        order = rnd.sample(range(n + m - both), n + m - both)
        x, y = order[:n], order[:both] + order[n:]
        common = set(sorted(x)[:prefix_length(n, 80)]) & set(sorted(y)[:prefix_length(m, 80)])
        assert len(common) >= bound[n, m]
