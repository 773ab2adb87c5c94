"""Negatives: never the anchor, never repeated, at most k, same-domain quota."""

from pyspark.sql import functions as F

from vecprobe.operators.sampling import domain_negatives


def test_domain_negatives_properties(spark):
    rows = [(i, "a" if i < 3 else ("b" if i < 40 else "c")) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, dom string")
    k = 8
    neg = domain_negatives(df, "id", "dom", k, seed=5).collect()
    dom = dict(rows)
    by = {}
    for r in neg:
        assert r.id != r.neg_id
        by.setdefault(r.id, []).append(r.neg_id)
    for a, ns in by.items():
        assert len(ns) == len(set(ns)) <= k
        assert len(ns) == k
        same = sum(1 for x in ns if dom[x] == dom[a])
        pool = sum(1 for x in dom.values() if x == dom[a]) - 1
        assert same >= min(k // 2, pool)


def test_uniform_negatives(spark):
    df = spark.createDataFrame([(i, "x") for i in range(6)], "id long, dom string")
    neg = domain_negatives(df, "id", "dom", 8, seed=1, domain_aware=False)
    c = neg.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("neg_id").alias("d")).collect()
    assert all(x.n == 5 and x.d == 5 for x in c)
