"""Vector retrieval evaluations: J5 vector_nn, R1 doc_top1, R2/R3 nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.neighbors import row_pairs, vector_nn
from ..operators.retrieval import doc_top1, doc_top1_rows
from ..operators.significance import perm_test_labels, perm_test_rows
from . import sql_fragments as Q
from .fixtures import signal_activations
from .registry import register
from ..session import cut_lineage

N_PERM_LABELS = 2000   # label shuffles, layer sweep default
N_PERM_ROWS = 5000     # row shuffles, checkpoint evaluation default


def _signal_nn(spark, sf_dir):
    act = signal_activations(spark, sf_dir)
    return act, vector_nn(act, "id", "vec")


@register("vector_nn", f"""
WITH {Q.ACT_UNIT}, {Q.ACT_NN}
SELECT id, nn_id, round(sim, 6) AS sim FROM act_nn""")
def q_vector_nn(spark, sf_dir):
    """Every row's most cosine-similar other row (ties kept)."""
    _, nn = _signal_nn(spark, sf_dir)
    return row_pairs(nn)


@register("doc_top1_vectors", f"""
WITH {Q.ACT_UNIT}, {Q.ACT_NN}, {Q.ACT_ROWS}
SELECT round(doc_top1, 6) AS doc_top1, hits, n, n_docs, round(chance, 6) AS chance FROM act_obs""")
def q_doc_top1_vectors(spark, sf_dir):
    """R1 on vectors: share of rows whose nearest other row is from the same doc."""
    act, nn = _signal_nn(spark, sf_dir)
    return doc_top1(doc_top1_rows(nn, act.select("id", "doc")))


def _perm_labels_sql(n_perm: int, seed: int) -> str:
    return f"""
WITH {Q.ACT_UNIT}, {Q.ACT_NN}, {Q.ACT_ROWS},
lab AS (SELECT id, doc, row_number() OVER (ORDER BY id) - 1 AS idx FROM act),
pr AS ({Q.perm_ranks(n_perm, seed, 'act')}),
pl AS (SELECT pr.perm, pr.id, lab.doc AS plab FROM pr JOIN lab ON pr.src_idx = lab.idx),
pb AS (SELECT nn.id, pl.perm, min(pl.plab) AS bl
       FROM act_nn nn JOIN pl ON pl.id = nn.nn_id GROUP BY nn.id, pl.perm),
ph AS (SELECT pl.perm, sum(coalesce(pb.bl = pl.plab, false)::INTEGER)::BIGINT AS hits
       FROM pl LEFT JOIN pb ON pb.id = pl.id AND pb.perm = pl.perm GROUP BY pl.perm)
SELECT round(o.doc_top1, 6) AS doc_top1, o.hits, o.n, o.n_docs, round(o.chance, 6) AS chance,
       round((count_if(ph.hits >= o.hits)::BIGINT + 1)::DOUBLE / ({n_perm} + 1), 6) AS p_value,
       round((o.doc_top1 - avg(ph.hits::DOUBLE / o.n)) / (stddev_pop(ph.hits::DOUBLE / o.n) + 1e-12), 6) AS z
FROM act_obs o, ph GROUP BY o.doc_top1, o.hits, o.n, o.n_docs, o.chance"""


@register("perm_test_labels", _perm_labels_sql(N_PERM_LABELS, 0))
def q_perm_test_labels(spark, sf_dir):
    """R2: doc_top1 with a 2,000-shuffle label-permutation null (p, z)."""
    act, nn = _signal_nn(spark, sf_dir)
    rows = cut_lineage(doc_top1_rows(nn, act.select("id", "doc")))
    obs = doc_top1(rows)
    return perm_test_labels(nn, rows, obs, N_PERM_LABELS, seed=0)


def _perm_rows_sql(n_perm: int, seed: int) -> str:
    return f"""
WITH {Q.ACT_UNIT}, {Q.ACT_NN}, {Q.ACT_ROWS},
rw AS (SELECT id, doc, best_doc, doc_rows, row_number() OVER (ORDER BY id) - 1 AS idx FROM act_rows),
pr AS ({Q.perm_ranks(n_perm, seed, 'act')}),
ph AS (SELECT pr.perm,
              sum(coalesce(src.best_doc = me.doc AND me.doc_rows > 1, false)::INTEGER) AS hits
       FROM pr JOIN rw src ON pr.src_idx = src.idx JOIN rw me ON me.id = pr.id GROUP BY pr.perm)
SELECT round(o.doc_top1, 6) AS doc_top1, o.hits, o.n, o.n_docs, round(o.chance, 6) AS chance,
       round((count_if(ph.hits >= o.hits)::BIGINT + 1)::DOUBLE / ({n_perm} + 1), 6) AS p_value,
       round((o.doc_top1 - avg(ph.hits::DOUBLE / o.n)) / (stddev_pop(ph.hits::DOUBLE / o.n) + 1e-12), 6) AS z
FROM act_obs o, ph GROUP BY o.doc_top1, o.hits, o.n, o.n_docs, o.chance"""


@register("perm_test_rows", _perm_rows_sql(N_PERM_ROWS, 0))
def q_perm_test_rows(spark, sf_dir):
    """doc_top1 with a 5,000-shuffle row-permutation null."""
    act, nn = _signal_nn(spark, sf_dir)
    rows = cut_lineage(doc_top1_rows(nn, act.select("id", "doc")))
    return perm_test_rows(rows, doc_top1(rows), N_PERM_ROWS, seed=0)
