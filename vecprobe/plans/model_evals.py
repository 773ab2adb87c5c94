"""R6 linear probe and X1 batch encoding (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import l2_norm
from ..operators.encode import batch_encode
from ..operators.probe import linear_probe_cv
from ..sources.tables import read_table
from .fixtures import signal_activations
from .registry import register


@register("linear_probe_cv")
def q_linear_probe_cv(spark, sf_dir):
    """5-fold probe accuracy of the signal doc from the vectors."""
    act = signal_activations(spark, sf_dir)
    acc = linear_probe_cv(act, "id", "doc", "vec", cv=5, seed=0)
    n = act.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc").alias("n_classes"))
    return n.select(F.lit(acc).alias("probe_cv"), "n_rows", "n_classes")


@register("batch_encode", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS tok FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(tok), 1, 8))::UBIGINT % 64)::INTEGER AS dim, count(*) AS c FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n_dims, sqrt(sum(c * c)) AS nrm, max(c) AS cmax FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_dims, 0) AS n_dims, round(coalesce(n.cmax / n.nrm, 0.0), 6) AS v_max
FROM documents d LEFT JOIN n USING (doc_id)""")
def q_batch_encode(spark, sf_dir):
    """Every document through the default hashing encoder."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    v = batch_encode(d, "doc_id", "text")
    return v.select("doc_id", F.size(F.filter("vec", lambda x: x != 0)).cast("bigint").alias("n_dims"),
                    F.array_max("vec").alias("v_max"))
