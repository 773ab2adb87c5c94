"""Sources, sinks and config: S1, S3-S6, S10-S12, J3, F11."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..operators.common import join_group
from ..operators.extraction import extraction_tables
from ..session import scratch_path
from ..sources.io import (append_parquet, parse_json_config, read_csv_log, resume_pending,
                          write_csv_log)
from ..sources.sinks import append_log, batch_id, discover_checkpoints, read_batches, read_log, tail, write_batch, write_checkpoints
from ..sources.tables import TABLES, read_table
from ..sources.union import union_sources
from .registry import register
from .rollout_evals import _RO_SQL, step_log

CONFIG_SCHEMA = T.StructType([T.StructField("k", T.IntegerType())])


@register("scan_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def q_scan_profile(spark, sf_dir):
    """Whole-table scans of every driver table (row counts)."""
    out = None
    for t in TABLES:
        c = read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")) \
            .select(F.lit(t).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


@register("head_n", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 10")
def q_head_n(spark, sf_dir):
    """S3: first 10 rows by a stable key (file order is not defined)."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(10)


@register("union_sources", """
SELECT origin, domain, count(*) AS n FROM (
  SELECT 'documents' AS origin, source AS domain FROM documents
  UNION ALL SELECT 'benchmark' AS origin, 'unknown' AS domain FROM benchmark
  UNION ALL SELECT 'conversations' AS origin, 'unknown' AS domain FROM conversations)
GROUP BY origin, domain""")
def q_union_sources(spark, sf_dir):
    """Texts from every source that exists and has a text column;
    a missing path is skipped and pages (html only) are excluded."""
    paths = {n: f"{sf_dir}/{n}.parquet" for n in ("documents", "benchmark", "conversations", "pages")}
    paths["missing"] = f"{sf_dir}/no_such_table.parquet"
    u = union_sources(spark, paths, "text", {"source": "domain"})
    return u.groupBy("origin", "domain").agg(F.count(F.lit(1)).alias("n"))


def _two_batches(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    path = scratch_path(spark, f"append/{uuid.uuid4().hex}")
    append_parquet(d.filter(F.col("lang") == "en"), path)
    append_parquet(d.filter(~F.col("lang").eqNullSafe("en")), path)
    return d, spark.read.parquet(path)


@register("incremental_append", """
SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang""")
def q_incremental_append(spark, sf_dir):
    """Two appended batches read back as one table (each row once)."""
    _, out = _two_batches(spark, sf_dir)
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("resume_pending", """
SELECT lang, count(*) AS n FROM documents WHERE lang IS DISTINCT FROM 'en' GROUP BY lang""")
def q_resume_pending(spark, sf_dir):
    """After a first batch (English) was written, only rows whose key
    is not in the output remain to be processed."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    path = scratch_path(spark, f"resume/{uuid.uuid4().hex}")
    append_parquet(d.filter(F.col("lang") == "en"), path)
    pending = resume_pending(d, spark.read.parquet(path), ["doc_id"])
    return pending.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("json_config", """
SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::INTEGER)::BIGINT AS k_sum,
       count_if(json_extract_string(props, '$.k') IS NULL)::BIGINT AS k_missing
FROM events GROUP BY event_type""")
def q_json_config(spark, sf_dir):
    """Typed JSON config parsed from a string column."""
    e = read_table(spark, sf_dir, "events").select("event_type", parse_json_config("props", CONFIG_SCHEMA).alias("cfg"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cfg.k").alias("k_sum"),
                                       F.count_if(F.col("cfg.k").isNull()).alias("k_missing"))


@register("csv_log_roundtrip", f"""
WITH {_RO_SQL}
SELECT run, step, round(mean_reward, 6) AS mean_reward,
       round(CASE WHEN skipped THEN 0.0 ELSE n_nonzero::DOUBLE / g END, 6) AS frac_nonzero FROM steps""")
def q_csv_log_roundtrip(spark, sf_dir):
    """The rollout log written as CSV with a header and read back typed."""
    log = step_log(spark, sf_dir).select("run", "step", "mean_reward", "frac_nonzero")
    path = scratch_path(spark, f"csvlog/{uuid.uuid4().hex}")
    write_csv_log(log, path)
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("step", T.LongType()),
                           T.StructField("mean_reward", T.DoubleType()),
                           T.StructField("frac_nonzero", T.DoubleType())])
    return read_csv_log(spark, path, schema)


@register("per_checkpoint_eval", """
SELECT event_type AS ckpt, count(*) AS n, count(DISTINCT user_id) AS n_runs,
       round(avg(value), 6) AS mean_reward, count(DISTINCT props) AS n_unique FROM events GROUP BY event_type""")
def q_per_checkpoint_eval(spark, sf_dir):
    """Every checkpoint evaluated in one grouped job (ckpt = event_type)."""
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("ckpt")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_runs"),
        F.avg("value").alias("mean_reward"), F.countDistinct("props").alias("n_unique"))


@register("config_fallback", """
WITH run AS (SELECT user_id AS run, arg_min(json_extract_string(props, '$.k')::INTEGER, (ts, event_id)) AS k
             FROM events WHERE event_type = 'signup' GROUP BY user_id),
par AS (SELECT user_id // 10 AS parent, arg_min(json_extract_string(props, '$.k')::INTEGER, (ts, event_id)) AS k
        FROM events WHERE event_type = 'purchase' GROUP BY user_id // 10),
runs AS (SELECT DISTINCT user_id AS run FROM events)
SELECT runs.run, coalesce(run.k, par.k, 0) AS k,
       CASE WHEN run.k IS NOT NULL THEN 'run' WHEN par.k IS NOT NULL THEN 'parent' ELSE 'default' END AS level
FROM runs LEFT JOIN run USING (run) LEFT JOIN par ON par.parent = runs.run // 10""")
def q_config_fallback(spark, sf_dir):
    """A run's config from its own record, else its parent's, else the default."""
    from ..sources.config import resolve_config
    e = read_table(spark, sf_dir, "events").withColumn("cfg", parse_json_config("props", CONFIG_SCHEMA))
    first = lambda df, key: df.groupBy(key).agg(
        F.min_by("cfg.k", F.struct("ts", "event_id")).alias("k"))
    run_cfg = first(e.filter(F.col("event_type") == "signup").withColumn("run", F.col("user_id")), "run")
    par_cfg = first(e.filter(F.col("event_type") == "purchase")
                    .withColumn("parent", F.floor(F.col("user_id") / 10)), "parent")
    runs = e.select(F.col("user_id").alias("run")).distinct().withColumn("parent", F.floor(F.col("run") / 10))
    return resolve_config(runs, run_cfg, par_cfg, "k", 0).select("run", "k", "level")


@register("required_values", """
SELECT 'missing_label' AS violation, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL
UNION ALL SELECT 'empty_text' AS violation, count(*) AS n FROM documents WHERE text IS NULL OR text = ''""")
def q_required_values(spark, sf_dir):
    """violations table of required values (a fail-fast helper raises on it)."""
    from ..sources.config import violations
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("_has"))
    j = d.join(lab, "doc_id", "left")
    return violations(j, {"missing_label": F.col("_has").isNull(),
                          "empty_text": F.col("text").isNull() | (F.col("text") == "")})


@register("vector_file_roundtrip", """
WITH ex AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT dim::INTEGER AS dim, round(avg(x), 6) AS mean FROM ex GROUP BY dim""")
def q_vector_file_roundtrip(spark, sf_dir):
    """The corpus mean saved as a one-row table and loaded back."""
    from ..operators.vectors import vector_mean, vector_mean_long
    from ..sources.io import load_vector, save_vector
    e = read_table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec"))
    path = scratch_path(spark, f"vectors/mean-{uuid.uuid4().hex}")
    save_vector(vector_mean(e, "vec"), path)
    return vector_mean_long(load_vector(spark, path))


@register("multi_position_table", """
WITH t AS (SELECT doc_id, least(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')), 512) AS L FROM documents),
c AS (SELECT doc_id, L, least(50, L - 1) AS m FROM t),
s AS (SELECT doc_id, list_slice(generate_series(m, L - 2, greatest(1, (L - 1 - m) // 4)), 1, 4) AS ps FROM c WHERE L - 1 - m > 0),
p AS (SELECT doc_id, unnest(ps) AS pos FROM s)
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, sum(pos)::BIGINT AS pos_sum FROM p""")
def q_multi_position_table(spark, sf_dir):
    """S7 + F8: extra-position rows written to the ``<stem>_multi`` sibling of
    an output table and read back."""
    from ..functions.text import tokens
    from ..operators.corpus import sample_positions
    from ..sources.io import write_sibling
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.least(F.size(tokens("text")), F.lit(512)).alias("L"))
    rows = d.select("doc_id", F.explode(sample_positions("L", 4, 50)).alias("pos"))
    out = scratch_path(spark, f"extract/{uuid.uuid4().hex}/activations.parquet")
    p = write_sibling(rows, out)
    back = spark.read.parquet(p)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_docs"),
                    F.sum("pos").cast("bigint").alias("pos_sum"))


@register("restartable_batches", """
SELECT printf('%012d', dense_rank() OVER (ORDER BY lang) - 1) AS batch, lang, n, chars
FROM (SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IS NOT NULL GROUP BY lang)""")
def q_restartable_batches(spark, sf_dir):
    """One batch per language, the first of them written twice, as
    after a crash; every row is there once."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    langs = [r.lang for r in d.filter("lang is not null").select("lang").distinct().orderBy("lang").collect()]
    path = scratch_path(spark, f"batches/{uuid.uuid4().hex}")
    for i, lang in [*enumerate(langs), *list(enumerate(langs))[:1]]:
        write_batch(d.filter(F.col("lang") == lang), path, batch_id(i))
    return (read_batches(spark, path, d.schema).groupBy("batch", "lang")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")))


@register("log_tail", f"""
WITH {_RO_SQL}
SELECT run, step, round(mean_reward, 6) AS mean_reward FROM steps ORDER BY run DESC, step DESC LIMIT 10""")
def q_log_tail(spark, sf_dir):
    """The log appended in two batches, the second twice; its last ten rows."""
    log = step_log(spark, sf_dir).select("run", "step", "mean_reward")
    path = scratch_path(spark, f"log/{uuid.uuid4().hex}")
    for batch, part in ((0, "step <= 2"), (1, "step > 2"), (1, "step > 2")):
        append_log(log.filter(part), path, batch_id(batch))
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("step", T.LongType()), T.StructField("mean_reward", T.DoubleType())])
    return tail(read_log(spark, path, schema), ["run", "step"]).select("run", "step", "mean_reward")


@register("discovered_checkpoints", """
SELECT 'step_' || event_type AS ckpt, 'av_step_' || event_type AS tag, count(*) AS n, count(DISTINCT user_id) AS n_runs,
       round(avg(value), 6) AS mean_reward, count(DISTINCT props) AS n_unique FROM events GROUP BY event_type""")
def q_discovered_checkpoints(spark, sf_dir):
    """Checkpoint folders written, found again by a glob over their paths
    and evaluated in one grouped job."""
    e = read_table(spark, sf_dir, "events").select(F.concat(F.lit("step_"), "event_type").alias("ckpt"), "user_id", "value", "props")
    path = scratch_path(spark, f"checkpoints/{uuid.uuid4().hex}/av")
    write_checkpoints(e, path, "ckpt")
    found = discover_checkpoints(spark, f"{path}/ckpt=step_*", e.drop("ckpt").schema)
    return found.groupBy("ckpt", "tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_runs"),
                                            F.avg("value").alias("mean_reward"), F.countDistinct("props").alias("n_unique"))


_LAYER = 23


@register("extraction_carry", f"""
WITH t AS (SELECT *, list_slice(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), 1, 512) AS tok FROM documents),
u AS (SELECT *, len(tok) AS L FROM t WHERE len(tok) >= 2),
p AS (SELECT 'primary' AS tbl, *, L - 1 AS pos FROM u
      UNION ALL SELECT 'multi', *, unnest(list_slice(generate_series(least(50, L - 1), L - 2, greatest(1, (L - 1 - least(50, L - 1)) // 4)), 1, 4)) FROM u
      WHERE L - 1 - least(50, L - 1) > 0)
SELECT tbl, doc_id, lang, source, n_chars, {_LAYER} AS activation_layer, CASE tbl WHEN 'multi' THEN pos END::INTEGER AS position_idx,
       length(tok[pos + 1])::DOUBLE AS v_first, unicode(tok[pos + 1])::DOUBLE AS v_last, md5(text) AS text_md5 FROM p""")
def q_extraction_carry(spark, sf_dir):
    """F3 + F8 + S7: primary and extra-position rows of every document with all
    its columns, the first two of which are overwritten."""
    d = read_table(spark, sf_dir, "documents").withColumn("activation_layer", F.lit(-1))
    tok = F.slice(tokens("text"), 1, 512)
    states = F.transform(tok, lambda t: F.array(F.char_length(t).cast("double"), F.ascii(t).cast("double")))
    primary, multi = extraction_tables(d, states, _LAYER)
    rows = primary.withColumn("tbl", F.lit("primary")).withColumn("position_idx", F.lit(None).cast("int")).unionByName(multi.withColumn("tbl", F.lit("multi")))
    return rows.select("tbl", "doc_id", "lang", "source", "n_chars", "activation_layer", "position_idx",
                       F.get("activation_vector", F.lit(0)).alias("v_first"), F.get("activation_vector", F.lit(1)).alias("v_last"), F.md5("text").alias("text_md5"))
