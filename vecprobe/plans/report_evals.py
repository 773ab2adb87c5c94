"""Prototype classification, guards, verdicts and the layer sweep:
P1, P3, J8, A4-A6, R4, M1, G1, G3, G5, G6, K8, R5, R6 (P2, P4, G2, S9: tracking_evals)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import wilson_bounds
from ..functions.text import py_strip, tag_extract
from ..functions.vectors import l2_norm
from ..operators.common import join_group
from ..operators.neighbors import vector_nn
from ..operators.probe import grouped_probe_cv
from ..operators.prototypes import accuracy, domain_prototypes, nearest_prototype
from ..operators.retrieval import doc_top1, doc_top1_rows
from ..operators.significance import perm_test_accuracy, perm_test_labels
from ..session import cut_lineage
from ..sources.tables import read_table
from .fixtures import N_LAYERS, TURN_KEY_SQL, layered_activations
from .registry import register
from .sql_fragments import perm_ranks
from .text_evals import _REWARD_SQL, _rewards, generated_texts

# Fixed values from the reference: prototype size / minimum, accuracy
# shuffles, collapse and lock bars, preview widths, layer-selection rule.
PER_DOMAIN = 200
MIN_PROTO = 3
N_PERM_ACC = 2000
MIN_UNIQUE = 5
LOCK_PREFIX = 30
VERDICT_PREFIX = 60
HARD_BAR = 0.1
BAND = 0.10
MID_DEPTH = 0.49
LAYER_GATE = 0.40
N_PERM_LAYERS = 2000

_PROTO_SQL = f"""
e AS (SELECT vec_id AS id, label AS domain, embedding::DOUBLE[] AS v,
             sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm FROM embeddings),
u AS (SELECT id, domain, list_transform(v, lambda x: x / (nrm + 1e-9)) AS u FROM e),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS rn FROM u) WHERE rn <= {PER_DOMAIN}),
pd AS (SELECT domain, unnest(range(len(u))) AS dim, unnest(u) AS x FROM capped),
pm AS (SELECT domain, list(mx ORDER BY dim) AS m FROM (SELECT domain, dim, avg(x) AS mx FROM pd GROUP BY domain, dim) GROUP BY domain),
pc AS (SELECT domain, count(*) AS n_used FROM capped GROUP BY domain),
pn AS (SELECT pm.domain, pc.n_used, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS mn FROM pm JOIN pc USING (domain) WHERE pc.n_used >= {MIN_PROTO}),
protos AS (SELECT domain, n_used, list_transform(m, lambda x: x / (mn + 1e-9)) AS p FROM pn),
protos2 AS (SELECT domain, n_used, p, list_transform(p, lambda x: x / (sqrt(list_sum(list_transform(p, lambda y: y * y))) + 1e-9)) AS pp FROM protos),
sc AS (SELECT u.id, u.domain AS truth, protos2.domain AS cand, round(list_dot_product(u.u, protos2.pp), 9) AS s FROM u, protos2
       WHERE u.domain IN (SELECT domain FROM protos)),
scm AS (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM sc),
pred AS (SELECT id, min(cand) AS pred, any_value(truth) AS truth, max(s) AS score FROM scm WHERE s = m GROUP BY id),
ncov AS (SELECT count(*) AS n_covered FROM protos),
obs AS (SELECT sum((pred = truth)::INTEGER)::BIGINT AS hits, count(*) AS n,
               sum((pred = truth)::INTEGER)::DOUBLE / count(*) AS accuracy FROM pred)"""


def _protos(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    p = domain_prototypes(e, "label", "embedding", ["vec_id"], PER_DOMAIN, MIN_PROTO)
    return e, cut_lineage(p)


def _predictions(spark, sf_dir):
    """only rows whose domain has a prototype are classified."""
    e, p = _protos(spark, sf_dir)
    e = e.join(p.select(F.col("domain").alias("label")), "label", "left_semi")
    pr = nearest_prototype(e, "vec_id", "embedding", p)
    pred = (pr.join(e.select("vec_id", F.col("label").alias("truth")), "vec_id")
            .select(F.col("vec_id").alias("id"), "pred", "truth", "score"))
    return e, p, cut_lineage(pred)


@register("domain_prototypes", f"""
WITH {_PROTO_SQL}
SELECT domain, n_used, round(p[1], 6) AS p_first, round(sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS p_norm
FROM protos""")
def q_domain_prototypes(spark, sf_dir):
    """Re-normalised mean of the first 200 unit vectors of each label."""
    _, p = _protos(spark, sf_dir)
    return p.select("domain", "n_used", F.element_at("proto", 1).alias("p_first"), l2_norm("proto").alias("p_norm"))


@register("nearest_prototype", f"""
WITH {_PROTO_SQL}
SELECT id, pred, round(score, 6) AS score FROM pred""")
def q_nearest_prototype(spark, sf_dir):
    """Nearest prototype of every vector of a covered label (first label on ties)."""
    _, _, pred = _predictions(spark, sf_dir)
    return pred.select("id", "pred", "score")


@register("domain_accuracy", f"""
WITH {_PROTO_SQL}
SELECT hits, n, round(accuracy, 6) AS accuracy, round(1.0 / n_covered, 6) AS chance FROM obs, ncov""")
def q_domain_accuracy(spark, sf_dir):
    """A4: accuracy of nearest-prototype predictions and chance 1/k."""
    _, p, pred = _predictions(spark, sf_dir)
    k = p.agg(F.count(F.lit(1)).alias("n_covered"))
    return join_group(accuracy(pred), k, ()).select(
        "hits", "n", "accuracy", (F.lit(1.0) / F.col("n_covered")).alias("chance"))


@register("per_domain_accuracy", f"""
WITH {_PROTO_SQL}
SELECT truth AS domain, sum((pred = truth)::INTEGER)::BIGINT AS hits, count(*) AS n,
       round(avg((pred = truth)::INTEGER), 6) AS accuracy FROM pred GROUP BY truth""")
def q_per_domain_accuracy(spark, sf_dir):
    """A5: accuracy per true domain."""
    _, _, pred = _predictions(spark, sf_dir)
    return accuracy(pred.withColumnRenamed("truth", "domain").withColumn("truth", F.col("domain")), ["domain"])


@register("wilson_interval", f"""
WITH {_PROTO_SQL},
pdom AS (SELECT truth AS domain, sum((pred = truth)::INTEGER)::BIGINT AS hits, count(*) AS n FROM pred GROUP BY truth),
w AS (SELECT domain, hits, n, hits::DOUBLE / n AS p, 1 + 1.96 * 1.96 / n AS d FROM pdom)
SELECT domain, hits, n,
       round(greatest(0.0, (p + 1.96 * 1.96 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / d), 6) AS ci_lo,
       round(least(1.0, (p + 1.96 * 1.96 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / d), 6) AS ci_hi
FROM w""")
def q_wilson_interval(spark, sf_dir):
    """M1: 95% Wilson interval of each domain's accuracy."""
    _, _, pred = _predictions(spark, sf_dir)
    a = accuracy(pred.withColumn("domain", F.col("truth")), ["domain"])
    lo, hi = wilson_bounds("hits", "n")
    return a.select("domain", "hits", "n", lo.alias("ci_lo"), hi.alias("ci_hi"))


_ACC_PERM_SQL = f"""
rw AS (SELECT id, pred, truth, row_number() OVER (ORDER BY id) - 1 AS idx FROM pred),
pr AS ({perm_ranks(N_PERM_ACC, 0, 'pred')}),
ph AS (SELECT pr.perm, sum((src.pred = me.truth)::INTEGER) AS hits
       FROM pr JOIN rw src ON pr.src_idx = src.idx JOIN rw me ON me.id = pr.id GROUP BY pr.perm),
pt AS (SELECT o.hits, o.n, o.accuracy,
              (count_if(ph.hits >= o.hits) + 1)::DOUBLE / ({N_PERM_ACC} + 1) AS p_value,
              (o.accuracy - avg(ph.hits::DOUBLE / o.n)) / (stddev_pop(ph.hits::DOUBLE / o.n) + 1e-12) AS z
       FROM obs o, ph GROUP BY o.hits, o.n, o.accuracy)"""


@register("perm_test_accuracy", f"""
WITH {_PROTO_SQL}, {_ACC_PERM_SQL}
SELECT hits, n, round(accuracy, 6) AS accuracy, round(p_value, 6) AS p_value, round(z, 6) AS z FROM pt""")
def q_perm_test_accuracy(spark, sf_dir):
    """Accuracy against 2,000 shuffles of the predictions."""
    _, _, pred = _predictions(spark, sf_dir)
    return perm_test_accuracy(pred, accuracy(pred), N_PERM_ACC, seed=0)


@register("collapse_guard", f"""
WITH g AS (SELECT conv_id, text FROM conversations),
s AS (SELECT conv_id, count(*) AS n, count(DISTINCT text) AS n_unique,
             count(DISTINCT substr(text, 1, {LOCK_PREFIX})) = 1 AS domain_lock FROM g GROUP BY conv_id)
SELECT conv_id, n, n_unique, n_unique < {MIN_UNIQUE} AS mode_collapsed, domain_lock,
       NOT (n_unique < {MIN_UNIQUE}) AND NOT domain_lock AS guard_pass FROM s""")
def q_collapse_guard(spark, sf_dir):
    """G1 + G3: mode collapse (< 5 distinct outputs) and lock (one 30-char
    prefix) per conversation."""
    c = read_table(spark, sf_dir, "conversations")
    s = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_unique"),
                                 (F.countDistinct(F.substring("text", 1, LOCK_PREFIX)) == 1).alias("domain_lock"))
    mc = F.col("n_unique") < MIN_UNIQUE
    return s.select("conv_id", "n", "n_unique", mc.alias("mode_collapsed"), "domain_lock",
                    (~mc & ~F.col("domain_lock")).alias("guard_pass"))


def _verdict_rows(spark, sf_dir):
    r = _rewards(spark, sf_dir)
    g = generated_texts(spark, sf_dir).select(F.col("id").alias("qid"), tag_extract("text").alias("gen"))
    return r.join(g, "qid")


_VERDICT_SQL = _REWARD_SQL + f""",
gt AS (SELECT {TURN_KEY_SQL} AS qid, text FROM conversations),
v AS (SELECT rr.*, substr(gt.text, 1, {VERDICT_PREFIX}) AS pre FROM rr JOIN gt USING (qid))"""


@register("eval_summary", _VERDICT_SQL + f"""
SELECT count(*) AS n_eval, round(avg(hard), 6) AS mean_hard, round(avg(soft), 6) AS mean_soft,
       count(DISTINCT pre) AS n_unique,
       CASE WHEN avg(hard) > {HARD_BAR} AND count(DISTINCT pre) >= {MIN_UNIQUE} THEN 'PASS' ELSE 'COLLAPSE' END AS verdict
FROM v""")
def q_eval_summary(spark, sf_dir):
    """A6 + G5 over every generated turn: mean hard / soft, distinct 60-char
    previews, PASS / COLLAPSE."""
    v = _verdict_rows(spark, sf_dir)
    return _summarize(v.groupBy())


def _summarize(grouped):
    s = grouped.agg(F.count(F.lit(1)).alias("n_eval"), F.avg("hard").alias("mean_hard"),
                    F.avg("soft").alias("mean_soft"),
                    F.countDistinct(F.substring(py_strip("gen"), 1, VERDICT_PREFIX)).alias("n_unique"))
    ok = (F.col("mean_hard") > HARD_BAR) & (F.col("n_unique") >= MIN_UNIQUE)
    return s.withColumn("verdict", F.when(ok, "PASS").otherwise("COLLAPSE"))


@register("rollout_verdict", _VERDICT_SQL + f"""
SELECT true_doc AS conv_id, count(*) AS n_eval, round(avg(hard), 6) AS mean_hard, round(avg(soft), 6) AS mean_soft,
       count(DISTINCT pre) AS n_unique,
       CASE WHEN avg(hard) > {HARD_BAR} AND count(DISTINCT pre) >= {MIN_UNIQUE} THEN 'PASS' ELSE 'COLLAPSE' END AS verdict
FROM v GROUP BY true_doc""")
def q_rollout_verdict(spark, sf_dir):
    """G5 per conversation (one run per conversation)."""
    v = _verdict_rows(spark, sf_dir).withColumnRenamed("true_doc", "conv_id")
    return _summarize(v.groupBy("conv_id"))


# ---- layer sweep ---------------------------------------------------------

_LAYER_SQL = f"""
lv AS (SELECT k::INTEGER AS layer, vec_id AS id,
              (list_position(list_slice(embedding, 1, 4), list_max(list_slice(embedding, 1, 4))) - 1)::INTEGER AS doc,
              list_slice(embedding::DOUBLE[], ((len(embedding) + 3) // 4) * k + 1, ((len(embedding) + 3) // 4) * k + ((len(embedding) + 3) // 4)) AS v FROM embeddings, range({N_LAYERS}) t(k)),
lu AS (SELECT layer, id, doc, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-9)) AS u FROM lv),
ls AS (SELECT a.layer, a.id, b.id AS nn_id, round(list_dot_product(a.u, b.u), 9) AS sim
       FROM lu a JOIN lu b ON a.layer = b.layer AND a.id <> b.id),
lb AS (SELECT layer, id, max(sim) AS m FROM ls GROUP BY layer, id),
lnn AS (SELECT ls.layer, ls.id, ls.nn_id FROM ls JOIN lb USING (layer, id) WHERE ls.sim = lb.m),
lbd AS (SELECT lnn.layer, lnn.id, min(b.doc) AS best_doc FROM lnn JOIN lv b ON b.layer = lnn.layer AND b.id = lnn.nn_id GROUP BY ALL),
lcnt AS (SELECT layer, doc, count(*) AS doc_rows FROM lv GROUP BY layer, doc),
lrows AS (SELECT a.layer, a.id, a.doc, coalesce(bd.best_doc = a.doc AND c.doc_rows > 1, false) AS hit
          FROM lv a LEFT JOIN lbd bd ON bd.layer = a.layer AND bd.id = a.id JOIN lcnt c ON c.layer = a.layer AND c.doc = a.doc),
lobs AS (SELECT layer, sum(hit::INTEGER)::DOUBLE / count(*) AS doc_top1, sum(hit::INTEGER)::BIGINT AS hits, count(*) AS n,
                count(DISTINCT doc) AS n_docs FROM lrows GROUP BY layer),
llab AS (SELECT layer, id, doc, row_number() OVER (PARTITION BY layer ORDER BY id) - 1 AS idx FROM lv),
lpr AS ({perm_ranks(N_PERM_LAYERS, 0, 'lv', 'layer')}),
lpl AS (SELECT lpr.layer, lpr.perm, lpr.id, llab.doc AS plab FROM lpr JOIN llab ON llab.layer = lpr.layer AND llab.idx = lpr.src_idx),
lpb AS (SELECT nn.layer, nn.id, pl.perm, min(pl.plab) AS bl FROM lnn nn JOIN lpl pl ON pl.layer = nn.layer AND pl.id = nn.nn_id GROUP BY ALL),
lph AS (SELECT pl.layer, pl.perm, sum(coalesce(pb.bl = pl.plab, false)::INTEGER) AS hits
        FROM lpl pl LEFT JOIN lpb pb ON pb.layer = pl.layer AND pb.id = pl.id AND pb.perm = pl.perm GROUP BY ALL),
lsum AS (SELECT o.layer, o.doc_top1, o.n_docs, 1.0 / o.n_docs AS chance,
                (count_if(ph.hits >= o.hits) + 1)::DOUBLE / ({N_PERM_LAYERS} + 1) AS p_value,
                (o.doc_top1 - avg(ph.hits::DOUBLE / o.n)) / (stddev_pop(ph.hits::DOUBLE / o.n) + 1e-12) AS z
         FROM lobs o JOIN lph ph USING (layer) GROUP BY o.layer, o.doc_top1, o.n_docs, o.hits, o.n),
top AS (SELECT max(doc_top1) AS top FROM lsum),
cand AS (SELECT lsum.*, row_number() OVER (ORDER BY 0.0 DESC, abs(layer::DOUBLE / {N_LAYERS} - {MID_DEPTH}) ASC, layer ASC) AS r
         FROM lsum, top WHERE doc_top1 >= top - {BAND}),
sweep AS (SELECT lsum.*, coalesce(cand.r = 1, false) AS recommended, top.top >= {LAYER_GATE} AS gate_pass
          FROM lsum LEFT JOIN cand USING (layer), top)"""


def _sweep(spark, sf_dir, probe: bool = False):
    lv = layered_activations(spark, sf_dir)
    nn = vector_nn(lv, "id", "vec", ["layer"])
    rows = cut_lineage(doc_top1_rows(nn, lv.select("layer", "id", "doc")))
    obs = doc_top1(rows, ["layer"])
    s = perm_test_labels(nn, rows, obs, N_PERM_LAYERS, seed=0)
    if not probe:
        return select_layer_flags(s)
    s = s.join(grouped_probe_cv(lv, "id", "doc", "vec", ["layer"]), "layer")
    return select_layer_flags(cut_lineage(s), "probe_cv")


def select_layer_flags(per_layer, probe_col: str | None = None):
    """K8: candidates within 0.10 of the best doc_top1; then probe score desc
    (missing -> 0), then depth nearest 0.49, then lower layer. Adds
    ``recommended`` and the gate ``top >= 0.40``."""
    w_all = Window.partitionBy(F.lit(1))
    top = F.max("doc_top1").over(w_all)
    probe = F.coalesce(F.col(probe_col), F.lit(0.0)) if probe_col else F.lit(0.0)
    d = per_layer.withColumn("_top", top).withColumn(
        "_cand", F.col("doc_top1") >= F.col("_top") - F.lit(BAND))
    dist = F.abs(F.col("layer") / F.lit(float(N_LAYERS)) - F.lit(MID_DEPTH))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_cand"), probe.desc(), dist.asc(), F.col("layer").asc())
    return (d.withColumn("recommended", F.row_number().over(order) == 1)
            .withColumn("gate_pass", F.col("_top") >= F.lit(LAYER_GATE)).drop("_top", "_cand"))


@register("layer_sweep", f"""
WITH {_LAYER_SQL}
SELECT layer, round(doc_top1, 6) AS doc_top1, n_docs, round(chance, 6) AS chance, round(p_value, 6) AS p_value,
       round(z, 6) AS z, recommended, gate_pass FROM sweep""")
def q_layer_sweep(spark, sf_dir):
    """Every layer's doc_top1 with its label-permutation null in one job,
    plus the recommended layer and the 0.40 gate (no probe)."""
    s = _sweep(spark, sf_dir)
    return s.select("layer", "doc_top1", "n_docs", "chance", "p_value", "z", "recommended", "gate_pass")


@register("layer_sweep_probe")
def q_layer_sweep_probe(spark, sf_dir):
    """R5 with R6: the sweep with every layer's cross-validated probe, the layer
    that K8 recommends by it, and G6's reason for the choice."""
    s = _sweep(spark, sf_dir, probe=True)
    return s.select("layer", "doc_top1", "n_docs", "chance", "p_value", "z", "probe_cv", "recommended", "gate_pass",
                    F.when(F.col("recommended"), layer_reason(N_LAYERS)).alias("reason"))


def layer_reason(n_layers: int):
    """K8's sentence: how near to the top, the probe, the depth."""
    probe = F.coalesce(F.format_string("%.3f", "probe_cv"), F.lit("N/A"))
    return F.format_string("doc_top1=%.3f (within " + f"{BAND:.2f}" + " of top %.3f); probe_cv=%s; depth=%d/%d=%.2f", F.col("doc_top1"),
                           F.max("doc_top1").over(Window.partitionBy(F.lit(1))), probe, F.col("layer"), F.lit(n_layers), F.col("layer") / F.lit(n_layers))


#: R6 in SQL: ``probe`` (layer, probe_cv), each training fold standardised on its own statistics, fitted by accelerated
#: gradient steps under a row-sum bound of the curvature.
PROBE_FOLDS, PROBE_SQL_STEPS = 5, 100
_PROBE_SQL = f"""
pcl AS (SELECT layer, doc, dense_rank() OVER (PARTITION BY layer ORDER BY doc) - 1 AS cls
        FROM (SELECT layer, doc FROM lv WHERE doc IS NOT NULL GROUP BY layer, doc HAVING count(*) >= {PROBE_FOLDS})),
prw AS MATERIALIZED (SELECT layer, cls, v, row_number() OVER () AS rid,
                            (row_number() OVER (PARTITION BY layer, cls ORDER BY md5('0|' || id), id) - 1) % {PROBE_FOLDS} AS fold
                     FROM lv JOIN pcl USING (layer, doc)),
pok AS (SELECT layer FROM prw GROUP BY layer HAVING count(*) >= {2 * PROBE_FOLDS} AND count(DISTINCT cls) > 1),
pmo AS (SELECT layer, held, dim, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS sd
        FROM (SELECT layer, held, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM prw SEMI JOIN pok USING (layer), range({PROBE_FOLDS}) t(held) WHERE fold <> held)
        GROUP BY layer, held, dim),
pst AS (SELECT layer, held, list(m ORDER BY dim) AS m, list(CASE WHEN sd <= 1e-12 * greatest(abs(m), 1) THEN 1.0 ELSE sd END ORDER BY dim) AS sd FROM pmo GROUP BY layer, held),
pz AS MATERIALIZED (SELECT layer, held, rid, cls, fold = held AS test, list_append(list_transform(range(1, len(v) + 1), lambda i: (v[i] - m[i]) / sd[i]), 1.0::DOUBLE) AS z
                    FROM prw JOIN pst USING (layer)),
pgr AS (SELECT layer, held, i, j, sum(zi * z[j]) AS g
        FROM (SELECT layer, held, z, unnest(range(1, len(z) + 1)) AS i, unnest(z) AS zi FROM pz WHERE NOT test), range(1, (SELECT max(len(z)) + 1 FROM pz)) t(j) GROUP BY ALL),
pbd AS MATERIALIZED (SELECT layer, held, max(r) / 2 + 1 AS bound FROM (SELECT layer, held, i, sum(abs(g)) AS r FROM pgr GROUP BY ALL) GROUP BY ALL),
pw AS (
  SELECT 0 AS step, layer, held, cls, list_transform(range(len(m) + 1), lambda i: 0.0::DOUBLE) AS w, list_transform(range(len(m) + 1), lambda i: 0.0::DOUBLE) AS y
  FROM pst JOIN (SELECT DISTINCT layer, cls FROM prw) USING (layer)
  UNION ALL
  SELECT step + 1, layer, held, cls, nw, list_transform(range(1, len(nw) + 1), lambda i: nw[i] + step / (step + 3.0) * (nw[i] - w[i]))
  FROM (SELECT step, layer, held, cls, any_value(w) AS w, list(y[dim] - (g + CASE WHEN dim < len(y) THEN y[dim] ELSE 0 END) / bound ORDER BY dim) AS nw
        FROM (SELECT step, layer, held, cls, dim, any_value(w) AS w, any_value(y) AS y, sum((e / tot - (cls = truth)::INTEGER) * x) AS g
              FROM (SELECT *, unnest(range(1, len(z) + 1)) AS dim, unnest(z) AS x
                    FROM (SELECT *, sum(e) OVER (PARTITION BY layer, held, rid) AS tot
                          FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY layer, held, rid)) AS e
                                FROM (SELECT step, layer, held, pw.cls, rid, pz.cls AS truth, w, y, z, list_dot_product(z, y) AS s
                                      FROM pw JOIN pz USING (layer, held) WHERE NOT test AND step < {PROBE_SQL_STEPS}))))
              GROUP BY ALL) JOIN pbd USING (layer, held) GROUP BY step, layer, held, cls)),
psc AS (SELECT layer, held, rid, pz.cls AS truth, pw.cls AS cls, list_dot_product(z, w) AS s FROM pw JOIN pz USING (layer, held) WHERE test AND step = {PROBE_SQL_STEPS}),
phit AS (SELECT layer, held, rid, arg_min(cls = truth, struct_pack(a := -s, b := cls)) AS hit FROM psc GROUP BY ALL),
probe AS (SELECT layer, avg(acc) AS probe_cv FROM (SELECT layer, held, avg(hit::INTEGER) AS acc FROM phit GROUP BY ALL) GROUP BY layer)"""


@register("select_layer", f"""
WITH RECURSIVE {_LAYER_SQL}, {_PROBE_SQL}
SELECT layer, round(doc_top1, 6) AS doc_top1, top >= {LAYER_GATE} AS gate_pass
FROM lsum LEFT JOIN probe USING (layer), top WHERE doc_top1 >= top - {BAND}
ORDER BY coalesce(probe_cv, 0.0) DESC, abs(layer::DOUBLE / {N_LAYERS} - {MID_DEPTH}) ASC, layer ASC LIMIT 1""")
def q_select_layer(spark, sf_dir):
    """K8: the recommended layer of the sweep, by the probe among the layers
    near the best."""
    return _sweep(spark, sf_dir, probe=True).filter("recommended").select("layer", "doc_top1", "gate_pass")
