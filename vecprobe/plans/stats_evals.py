"""Vector statistics: V2 mean, V3 centering, V4 scaling, A7/V6 norm stats and
anisotropy, F6 zero fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import l2_norm, zero_fill
from ..operators.vectors import mean_center, norm_stats, scale_vectors, vector_mean, vector_mean_long
from ..sources.tables import read_table
from .fixtures import layered_activations, signal_activations
from .registry import register

_MEAN_SQL = """
ex AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
md AS (SELECT dim, avg(x) AS mx FROM ex GROUP BY dim),
m AS (SELECT list(mx ORDER BY dim) AS mean FROM md)"""


@register("vector_mean", f"""
WITH {_MEAN_SQL}
SELECT dim::INTEGER AS dim, round(mx, 6) AS mean FROM md""")
def q_vector_mean(spark, sf_dir):
    """V2: element-wise corpus mean (one row per dimension)."""
    act = signal_activations(spark, sf_dir)
    return vector_mean_long(vector_mean(act, "vec"))


@register("mean_center", f"""
WITH {_MEAN_SQL},
c AS (SELECT vec_id AS id,
             list_transform(range(len(embedding)), lambda i: embedding[i + 1]::DOUBLE - mean[i + 1]) AS cv
      FROM embeddings, m)
SELECT id, round(sqrt(list_sum(list_transform(cv, lambda x: x * x))), 6) AS c_norm,
       round(cv[1], 6) AS c_first, round(cv[len(cv)], 6) AS c_last FROM c""")
def q_mean_center(spark, sf_dir):
    """V3: vectors minus the corpus mean (norm and end components per row)."""
    act = signal_activations(spark, sf_dir)
    c = mean_center(act, vector_mean(act, "vec"), "vec")
    return c.select("id", l2_norm("centered").alias("c_norm"),
                    F.element_at("centered", 1).alias("c_first"),
                    F.element_at("centered", -1).alias("c_last"))


@register("scale_vectors", """
WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e,
                  sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm FROM embeddings),
s AS (SELECT id, list_transform(e, lambda x: x / (nrm + 1e-9) * sqrt(len(e))) AS sv FROM n)
SELECT id, round(sqrt(list_sum(list_transform(sv, lambda x: x * x))), 6) AS s_norm,
       round(sv[1], 6) AS s_first FROM s""")
def q_scale_vectors(spark, sf_dir):
    """V4: scale every vector to norm sqrt(d) (injection scale)."""
    act = signal_activations(spark, sf_dir)
    s = scale_vectors(act, "vec")
    return s.select("id", l2_norm("scaled").alias("s_norm"), F.element_at("scaled", 1).alias("s_first"))


_LAYERED_SQL = """
lv AS (SELECT k::INTEGER AS layer, vec_id AS id,
              list_slice(embedding::DOUBLE[], ((len(embedding) + 3) // 4) * k + 1, ((len(embedding) + 3) // 4) * k + ((len(embedding) + 3) // 4)) AS v
       FROM embeddings, range(4) t(k)),
ex AS (SELECT layer, unnest(range(len(v))) AS dim, unnest(v) AS x FROM lv),
m AS (SELECT layer, list(mx ORDER BY dim) AS mean
      FROM (SELECT layer, dim, avg(x) AS mx FROM ex GROUP BY layer, dim) GROUP BY layer),
j AS (SELECT lv.layer, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm,
             sqrt(list_sum(list_transform(mean, lambda x: x * x))) AS mn,
             list_dot_product(v, mean) AS d
      FROM lv JOIN m USING (layer))"""


@register("norm_stats", f"""
WITH {_LAYERED_SQL}
SELECT layer, count(*) AS n_rows, round(avg(nrm), 6) AS norm_mean, round(stddev_pop(nrm), 6) AS norm_std,
       round(min(nrm), 6) AS norm_min, round(max(nrm), 6) AS norm_max,
       round(any_value(mn), 6) AS mean_activation_norm,
       round(avg(d / (mn + 1e-9)) / (avg(nrm) + 1e-9), 6) AS anisotropy_share
FROM j GROUP BY layer""")
def q_norm_stats(spark, sf_dir):
    """A7 + V6 for every layer in one job: norm mean / population std / min /
    max, corpus-mean norm, anisotropy share."""
    return norm_stats(layered_activations(spark, sf_dir), "vec", ["layer"])


@register("anisotropy_share", """
WITH n AS (SELECT embedding::DOUBLE[] AS v FROM embeddings),
ex AS (SELECT unnest(range(len(v))) AS dim, unnest(v) AS x FROM n),
m AS (SELECT list(mx ORDER BY dim) AS mean FROM (SELECT dim, avg(x) AS mx FROM ex GROUP BY dim)),
j AS (SELECT sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm,
             sqrt(list_sum(list_transform(mean, lambda x: x * x))) AS mn, list_dot_product(v, mean) AS d
      FROM n, m)
SELECT round(any_value(mn), 6) AS mean_activation_norm,
       round(avg(d / (mn + 1e-9)) / (avg(nrm) + 1e-9), 6) AS anisotropy_share FROM j""")
def q_anisotropy_share(spark, sf_dir):
    """V6: share of vector length along the corpus-mean direction."""
    s = norm_stats(signal_activations(spark, sf_dir), "vec")
    return s.select("mean_activation_norm", "anisotropy_share")


@register("zero_fill_vectors", """
SELECT d.doc_id, e.vec_id IS NOT NULL AS has_vec,
       len(coalesce(e.embedding::DOUBLE[], list_transform(range((SELECT max(len(embedding)) FROM embeddings)), lambda i: 0.0::DOUBLE)))::INTEGER AS width,
       round(sqrt(list_sum(list_transform(coalesce(e.embedding::DOUBLE[], list_transform(range((SELECT max(len(embedding)) FROM embeddings)), lambda i: 0.0::DOUBLE)), lambda x: x * x))), 6) AS norm
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def q_zero_fill_vectors(spark, sf_dir):
    """documents without a vector get a zero vector of the table width."""
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    j = d.join(e, "doc_id", "left").withColumn("filled", zero_fill("embedding", width))
    return j.select("doc_id", F.col("embedding").isNotNull().alias("has_vec"),
                    F.size("filled").alias("width"), l2_norm("filled").alias("norm"))
