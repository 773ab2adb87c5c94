"""Domain tracking from texts: P1, P2, P4, J10, F5, G2, S9.

Fixture: a document's domain is its language and source; source texts are the
whole documents, a generated text is a document's last line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.vectors import l2_norm
from ..operators.prototypes import excluded_domains
from ..operators.tracking import source_texts, text_prototypes, track_domains
from ..session import cut_lineage
from ..sources.io import read_json_report, write_json_report
from ..sources.tables import read_table
from .corpus_evals import sql_strip
from .registry import register
from .report_evals import MIN_PROTO, MIN_UNIQUE, N_PERM_ACC, PER_DOMAIN
from .sql_fragments import perm_ranks

# Fixed value from the reference: source texts are longer than this.
MIN_CHARS = 20
SAMPLE = 10
DOMAIN_SQL = "lang || '/' || source"


def _encoded_sql(name: str, src: str) -> str:
    """Unit vectors of the texts of ``src`` (k, text) by the hashing encoder."""
    return f"""
{name}_t AS (SELECT k, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tok FROM {src}),
{name}_b AS (SELECT k, (('0x' || substr(md5(tok), 1, 8))::UBIGINT % 64)::INTEGER AS dim, count(*)::DOUBLE AS c FROM {name}_t GROUP BY ALL),
{name} AS (SELECT k, dim, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS w FROM {name}_b)"""


_CHAIN_SQL = f"""
src AS (SELECT * FROM (SELECT doc_id, {DOMAIN_SQL} AS domain, {sql_strip('text')} AS text FROM documents WHERE text IS NOT NULL)
        WHERE length(text) > {MIN_CHARS} AND domain IS NOT NULL),
cnt AS (SELECT domain, count(*) AS n_texts FROM src GROUP BY domain HAVING count(*) >= {MIN_PROTO}),
capped AS (SELECT doc_id AS k, domain, text FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY doc_id, text) AS rn FROM src)
           WHERE rn <= {PER_DOMAIN} AND domain IN (SELECT domain FROM cnt)),
used AS (SELECT domain, count(*) AS n_used FROM capped GROUP BY domain),
{_encoded_sql('se', 'capped')},
pm AS (SELECT domain, dim, sum(w) / any_value(n_used) AS m FROM se JOIN capped USING (k) JOIN used USING (domain) GROUP BY domain, dim),
protos AS (SELECT domain, dim, m / (sqrt(sum(m * m) OVER (PARTITION BY domain)) + 1e-9) AS p FROM pm),
protos2 AS (SELECT domain, dim, p / (sqrt(sum(p * p) OVER (PARTITION BY domain)) + 1e-9) AS p FROM protos),
gen AS (SELECT doc_id AS k, {DOMAIN_SQL} AS domain, {sql_strip("string_split(" + sql_strip("coalesce(text, '')") + ", chr(10))[-1]")} AS text
        FROM documents WHERE {DOMAIN_SQL} IN (SELECT domain FROM cnt)),
{_encoded_sql('ge', 'gen')},
dots AS (SELECT ge.k, p.domain AS cand, sum(ge.w / (1 + 1e-9) * p.p) AS s FROM ge JOIN protos2 p USING (dim) GROUP BY ge.k, p.domain),
sc AS (SELECT gen.k AS id, gen.domain AS truth, gen.text, cnt.domain AS cand, round(coalesce(dots.s, 0), 9) AS s
       FROM gen, cnt LEFT JOIN dots ON dots.k = gen.k AND dots.cand = cnt.domain),
scm AS (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM sc),
pred AS (SELECT id, min(cand) AS pred, any_value(truth) AS truth, any_value(text) AS text FROM scm WHERE s = m GROUP BY id),
obs AS (SELECT sum((pred = truth)::INTEGER)::BIGINT AS hits, count(*) AS n, sum((pred = truth)::INTEGER)::DOUBLE / count(*) AS accuracy FROM pred)"""

_REPORT_SQL = f"""
WITH {_CHAIN_SQL},
rw AS (SELECT id, pred, truth, row_number() OVER (ORDER BY id) - 1 AS idx FROM pred),
pr AS ({perm_ranks(N_PERM_ACC, 0, 'pred')}),
ph AS (SELECT pr.perm, sum((src.pred = me.truth)::INTEGER) AS hits
       FROM pr JOIN rw src ON pr.src_idx = src.idx JOIN rw me ON me.id = pr.id GROUP BY pr.perm),
pt AS (SELECT o.hits, o.n, o.accuracy, (count_if(ph.hits >= o.hits) + 1)::DOUBLE / ({N_PERM_ACC} + 1) AS p_value FROM obs o, ph GROUP BY ALL),
w AS (SELECT pt.*, hits::DOUBLE / n AS p, 1 + 1.96 * 1.96 / n AS d, (SELECT count(*) FROM cnt) AS k FROM pt),
per AS (SELECT string_agg(truth || '=' || hits || '/' || n, ',' ORDER BY truth) AS per_domain_acc
        FROM (SELECT truth, sum((pred = truth)::INTEGER)::BIGINT AS hits, count(*) AS n FROM pred GROUP BY truth)),
smp AS (SELECT string_agg(truth || ': ' || text, chr(10) ORDER BY id) AS generations_sample FROM (SELECT * FROM pred ORDER BY id LIMIT {SAMPLE})),
rep AS (
  SELECT n, accuracy, 1.0 / k AS chance, p_value,
         greatest(0.0, (p + 1.96 * 1.96 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / d) AS ci_lo,
         least(1.0, (p + 1.96 * 1.96 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / d) AS ci_hi,
         k AS n_covered, (SELECT string_agg(domain, ',' ORDER BY domain) FROM cnt) AS covered_domains,
         (SELECT coalesce(string_agg(domain, ',' ORDER BY domain), '') FROM (SELECT DISTINCT domain FROM src) WHERE domain NOT IN (SELECT domain FROM cnt)) AS excluded_domains,
         (SELECT count(DISTINCT text) FROM pred) AS n_unique, (SELECT count(DISTINCT text) FROM pred) < greatest({MIN_UNIQUE}, k // 2) AS domain_lock,
         per_domain_acc, generations_sample
  FROM w, per, smp)"""


def _texts(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").withColumn("domain", F.concat("lang", F.lit("/"), "source"))
    last = py_strip(F.element_at(F.split(py_strip(F.coalesce("text", F.lit(""))), "\n"), -1))
    return source_texts(d, "doc_id", "domain", "text", MIN_CHARS), d.select(F.col("doc_id").alias("id"), "domain", last.alias("text"))


def _report(spark, sf_dir):
    source, texts = _texts(spark, sf_dir)
    return track_domains(source, texts, PER_DOMAIN, MIN_PROTO, N_PERM_ACC)


def _flat(report):
    acc = F.transform(F.array_sort(F.map_entries("per_domain_acc")),
                      lambda e: F.concat(e["key"], F.lit("="), e["value"]["hits"].cast("string"), F.lit("/"), e["value"]["n"].cast("string")))
    sample = F.transform("generations_sample", lambda g: F.concat(g["truth"], F.lit(": "), g["text"]))
    return report.select(
        "n", "accuracy", "chance", "p_value", F.col("wilson_ci_95.lo").alias("ci_lo"), F.col("wilson_ci_95.hi").alias("ci_hi"),
        F.size("covered_domains").cast("bigint").alias("n_covered"), F.array_join("covered_domains", ",").alias("covered_domains"),
        F.array_join("excluded_domains", ",").alias("excluded_domains"), "n_unique", "domain_lock",
        F.array_join(acc, ",").alias("per_domain_acc"), F.array_join(sample, "\n").alias("generations_sample"))


_FLAT_SQL = """
SELECT n, round(accuracy, 6) AS accuracy, round(chance, 6) AS chance, round(p_value, 6) AS p_value, round(ci_lo, 6) AS ci_lo,
       round(ci_hi, 6) AS ci_hi, n_covered, covered_domains, excluded_domains, n_unique, domain_lock, per_domain_acc, generations_sample FROM rep"""


@register("text_prototypes", f"""
WITH {_CHAIN_SQL},
norm AS (SELECT domain, sqrt(sum(p * p)) AS p_norm, max(p) AS p_max FROM protos GROUP BY domain)
SELECT domain, n_texts, n_used, round(p_norm, 6) AS p_norm, round(p_max, 6) AS p_max FROM cnt JOIN used USING (domain) JOIN norm USING (domain)""")
def q_text_prototypes(spark, sf_dir):
    """Prototypes of the domains' source texts."""
    p = text_prototypes(_texts(spark, sf_dir)[0], PER_DOMAIN, MIN_PROTO)
    return p.select("domain", "n_texts", "n_used", l2_norm("proto").alias("p_norm"), F.array_max("proto").alias("p_max"))


@register("excluded_domains", f"""
WITH {_CHAIN_SQL}
SELECT DISTINCT domain FROM src WHERE domain NOT IN (SELECT domain FROM cnt)""")
def q_excluded_domains(spark, sf_dir):
    """Domains of source texts with too few of them for a prototype."""
    source = cut_lineage(_texts(spark, sf_dir)[0])
    return excluded_domains(source, "domain", text_prototypes(source, PER_DOMAIN, MIN_PROTO))


@register("domain_tracking_report", _REPORT_SQL + _FLAT_SQL)
def q_domain_tracking_report(spark, sf_dir):
    """The report of the whole chain, its lists and map written as texts."""
    return _flat(_report(spark, sf_dir))


@register("domain_lock", _REPORT_SQL + """
SELECT n_unique, n_covered, domain_lock FROM rep""")
def q_domain_lock(spark, sf_dir):
    """Distinct generated texts below max(5, covered // 2)."""
    return _flat(_report(spark, sf_dir)).select("n_unique", "n_covered", "domain_lock")


@register("report_json", _REPORT_SQL + _FLAT_SQL)
def q_report_json(spark, sf_dir):
    """The nested report (lists, a map, a sample) written as JSON and read
    back with its schema."""
    rep = _report(spark, sf_dir)
    return _flat(read_json_report(spark, write_json_report(rep, "domain_tracking_report"), rep.schema))
