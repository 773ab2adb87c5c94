"""Cases that earlier limits and switches got wrong: null keys, wide vectors,
long conversations, small pools, large groups."""

from pyspark.sql import functions as F

from vecprobe.operators.corpus import cap_domain_share
from vecprobe.operators.indexing import buckets_for
from vecprobe.operators.neighbors import term_ids
from vecprobe.operators.sampling import domain_negatives
from vecprobe.operators.significance import permutation_ranks
from vecprobe.plans.fixtures import N_LAYERS, layered_activations, turn_key


def test_cap_domain_share_keeps_rows_without_domain(spark):
    df = spark.createDataFrame([(i, ["en", "fr", None][i % 3]) for i in range(300)], "id long, lang string")
    kept = {r.lang: r["count"] for r in cap_domain_share(df, "lang", "en", 0.1, "id").groupBy("lang").count().collect()}
    assert kept == {None: 100, "fr": 100, "en": 22}


def test_layers_cover_every_component(spark, tmp_path):
    spark.createDataFrame([(1, [float(i) for i in range(90)])], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    rows = layered_activations(spark, str(tmp_path)).orderBy("layer").collect()
    assert len(rows) == N_LAYERS and [x for r in rows for x in r.vec] == list(range(90))


def test_turn_keys_do_not_collide_in_long_conversations(spark):
    t = spark.createDataFrame([(c, k) for c in range(3) for k in range(250)], "conv_id long, turn long")
    assert t.select(turn_key(t).alias("k")).distinct().count() == 750


def test_negatives_always_fill(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else f"d{i}") for i in range(12)], "id long, dom string")
    got = domain_negatives(df, "id", "dom", 8, 1).groupBy("id").agg(
        F.count("*").alias("n"), F.countDistinct("neg_id").alias("d"), F.max(F.col("id") == F.col("neg_id")).alias("self"))
    assert {(r.n, r.d, r.self) for r in got.collect()} == {(8, 8, False)}


def test_shuffles_are_bijections_and_differ(spark):
    keys = spark.createDataFrame([(g, 10 * i) for g, n in ((0, 1), (1, 37), (2, 64)) for i in range(n)], "g int, id long")
    r = permutation_ranks(keys, 20, 3, ["g"])
    per = r.groupBy("g", "perm").agg(F.countDistinct("src_idx").alias("d"), F.max("src_idx").alias("m"), F.count("*").alias("n"))
    assert all(x.d == x.n == x.m + 1 for x in per.collect())
    lists = r.filter("g = 1").groupBy("perm").agg(F.sort_array(F.collect_list(F.struct("id", "src_idx"))).alias("l")).collect()
    assert len({str(x.l) for x in lists}) == 20


def test_term_ids_are_dense_and_buckets_unbounded(spark):
    t = spark.createDataFrame([(f"t{i}",) for i in range(500)], "term string")
    assert sorted(r.tid for r in term_ids(t, 10 ** 7).collect()) == list(range(500))
    assert buckets_for(10 ** 12) > 10 ** 6 and buckets_for(0) == 1
