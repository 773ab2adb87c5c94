"""Sampling queries: K2-K7, J1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.common import join_group
from ..operators.corpus import truncate_array
from ..operators.sampling import (STRIDES, domain_negatives, pick_variant, seeded_sample, step_schedule,
                                  token_dropout)
from ..operators.significance import id_index
from ..sources.tables import read_table
from .fixtures import TURN_KEY_SQL, turn_key
from .registry import register

# Fixed values from the reference: eval sample size and seed, step seed
# (seed 17 + 42), label cap; dropout rate and negatives are run parameters.
SAMPLE_N = 20
SAMPLE_SEED = 42
STEP_SEED = 59
LABEL_TOKENS = 16
DROPOUT = 0.3
N_NEGS = 8


@register("seeded_sample", f"""
SELECT doc_id, source FROM documents
ORDER BY md5(concat_ws('|', '{SAMPLE_SEED}', doc_id::VARCHAR)), doc_id LIMIT {SAMPLE_N}""")
def q_seeded_sample(spark, sf_dir):
    """K2: 20 documents without replacement, seed 42."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return seeded_sample(d, "doc_id", SAMPLE_N, SAMPLE_SEED)


@register("step_schedule", f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT idx + 1 AS step, (('0x' || substr(md5(concat_ws('|', '{STEP_SEED}', (idx + 1)::VARCHAR)), 1, 8))::UBIGINT % n)::BIGINT AS draw FROM d, n)
SELECT s.step, d.doc_id FROM s JOIN d ON d.idx = s.draw""")
def q_step_schedule(spark, sf_dir):
    """K3: one seeded draw with replacement per training step (n steps)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    ix = id_index(d, (), "doc_id", "idx")
    ix = join_group(ix, d.agg(F.count(F.lit(1)).alias("n")), ())
    return step_schedule(ix, "idx", "n", STEP_SEED).select("step", "doc_id")


@register("token_dropout", f"""
WITH t AS (SELECT {TURN_KEY_SQL} AS id,
                  list_slice(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), 1, {LABEL_TOKENS}) AS tok
           FROM conversations),
k AS (SELECT id, tok, list_filter(tok, lambda x, i: (('0x' || substr(md5(concat_ws('|', '{STEP_SEED}', id::VARCHAR, (i - 1)::VARCHAR)), 1, 8))::UBIGINT / 4294967296.0) >= {DROPOUT}) AS kept FROM t)
SELECT id, len(CASE WHEN len(kept) = 0 AND len(tok) > 0 THEN list_slice(tok, 1, 1) ELSE kept END)::INTEGER AS n_kept,
       array_to_string(CASE WHEN len(kept) = 0 AND len(tok) > 0 THEN list_slice(tok, 1, 1) ELSE kept END, ' ') AS kept
FROM k""")
def q_token_dropout(spark, sf_dir):
    """K7: label tokens (first 16) with seeded 30% dropout, first kept if all drop."""
    c = read_table(spark, sf_dir, "conversations")
    t = c.select(turn_key(c).alias("id"),
                 truncate_array(tokens("text"), LABEL_TOKENS).alias("tok"))
    k = t.select("id", token_dropout("tok", "id", DROPOUT, STEP_SEED).alias("kept"))
    return k.select("id", F.size("kept").alias("n_kept"), F.array_join("kept", " ").alias("kept"))


@register("paraphrase_pick", f"""
WITH v AS (SELECT conv_id AS doc_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rk FROM conversations),
c AS (SELECT doc_id, count(*) AS nv FROM v GROUP BY doc_id),
p AS (SELECT d.doc_id, d.lang,
             (('0x' || substr(md5(concat_ws('|', '{STEP_SEED}', d.doc_id::VARCHAR)), 1, 8))::UBIGINT % c.nv)::BIGINT AS rk
      FROM documents d LEFT JOIN c USING (doc_id))
SELECT p.doc_id, coalesce(v.text, p.lang) AS label FROM p LEFT JOIN v ON v.doc_id = p.doc_id AND v.rk = p.rk""")
def q_paraphrase_pick(spark, sf_dir):
    """J1 + K6: each document's label is a seeded pick among its
    conversation's turns; documents without one keep their own label."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    v = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return pick_variant(d, ["doc_id"], v, "turn", "text", "lang", STEP_SEED).select("doc_id", "label")


def _negatives_sql(k: int, seed: int, domain_aware: bool) -> str:
    """The negatives sampler in SQL: same draws and pad step."""
    dom = "source" if domain_aware else "''"
    half = k // 2 if domain_aware else 0

    def pool(src, ps, q, to_g, tag):
        start = f"(('0x' || substr(md5(concat_ws('|', '{seed}', id::VARCHAR, '{tag}')), 1, 15))::UBIGINT % ({ps})::UBIGINT)::BIGINT"
        pick = f"(('0x' || substr(md5(concat_ws('|', '{seed}', id::VARCHAR, '{tag}', 'stride')), 1, 8))::UBIGINT % 8)::BIGINT + 1"
        return f"""
  SELECT x.id, byg.neg_id, x.t AS o
  FROM (SELECT *, {to_g.format(j='j')} AS g FROM (
          SELECT *, ({start} + t * (({STRIDES}[{pick}])::BIGINT % ({ps}))) % ({ps}) AS j FROM (
            SELECT *, unnest(generate_series(0, least({q}, {ps}) - 1)) AS t FROM {src} WHERE {q} > 0 AND {ps} > 0))) x
  JOIN byg ON byg.g = x.g"""

    def take(cands, quota_src):
        return f"""
  SELECT id, neg_id FROM (
    SELECT c.id, c.neg_id, row_number() OVER (PARTITION BY c.id ORDER BY c.o) AS rn, qq.q
    FROM ({cands}) c JOIN {quota_src} qq USING (id)) WHERE rn <= q"""

    parts = []
    ctes = [f"""r AS (SELECT doc_id AS id, {dom}::VARCHAR AS dom FROM documents),
sz AS (SELECT dom, count(*) AS n_d FROM r GROUP BY dom),
offs AS (SELECT dom, n_d, coalesce(sum(n_d) OVER (ORDER BY dom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sz),
tot AS (SELECT sum(n_d)::BIGINT AS N FROM sz),
a AS (SELECT r.id, o.n_d, o.off, row_number() OVER (PARTITION BY r.dom ORDER BY r.id) - 1 AS didx, tot.N
      FROM r JOIN offs o USING (dom), tot),
a2 AS (SELECT *, off + didx AS gidx FROM a),
byg AS (SELECT gidx AS g, id AS neg_id FROM a2)"""]
    if half > 0:
        ctes.append(f"sq AS (SELECT id, least({half}, n_d - 1) AS q FROM a2)")
        ctes.append("same AS (" + take(pool("a2", "n_d - 1", f"least({half}, n_d - 1)",
                                               "off + CASE WHEN {j} >= didx THEN {j} + 1 ELSE {j} END", "s"), "sq") + ")")
        parts.append("SELECT * FROM same")
    n_same = f"least({half}, n_d - 1)" if half > 0 else "0"
    if domain_aware:
        ctes.append(f"oq AS (SELECT id, least({k} - {n_same}, N - n_d) AS q FROM a2)")
        ctes.append("other AS (" + take(pool("a2", "N - n_d", f"least({k} - {n_same}, N - n_d)",
                                                "CASE WHEN {j} < off THEN {j} ELSE {j} + n_d END", "o"), "oq") + ")")
        parts.append("SELECT * FROM other")
    chosen = " UNION ALL ".join(parts) if parts else "SELECT id, id AS neg_id FROM a2 WHERE false"
    ctes.append(f"chosen AS ({chosen})")
    ctes.append("""b AS (SELECT a2.*, coalesce(h.nh, 0) AS nh FROM a2 LEFT JOIN
                 (SELECT id, count(*) AS nh FROM chosen GROUP BY id) h USING (id))""")
    ctes.append(f"pq AS (SELECT id, least({k} - nh, N - 1 - nh) AS q FROM b)")
    pad_c = pool(f"(SELECT * FROM b WHERE least({k} - nh, N - 1 - nh) > 0)", "N - 1", str(2 * k),
                 "CASE WHEN {j} >= gidx THEN {j} + 1 ELSE {j} END", "p")
    ctes.append(f"padc AS (SELECT * FROM ({pad_c}) p WHERE NOT EXISTS "
                f"(SELECT 1 FROM chosen c WHERE c.id = p.id AND c.neg_id = p.neg_id))")
    ctes.append("pad AS (" + take("SELECT * FROM padc", "pq") + ")")
    return "WITH " + ",\n".join(ctes) + "\nSELECT id, neg_id FROM chosen UNION ALL SELECT id, neg_id FROM pad"


@register("domain_negatives", _negatives_sql(N_NEGS, STEP_SEED, True))
def q_domain_negatives(spark, sf_dir):
    """K4: 8 negatives per document: 4 from its source, 4 from other sources."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return domain_negatives(d, "doc_id", "source", N_NEGS, STEP_SEED, True)


@register("uniform_negatives", _negatives_sql(N_NEGS, STEP_SEED, False))
def q_uniform_negatives(spark, sf_dir):
    """K5: 8 negatives per document from the whole table."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return domain_negatives(d, "doc_id", "source", N_NEGS, STEP_SEED, False)
