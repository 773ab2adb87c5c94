"""Named evaluations over the driver tables: each is a Spark callable
``(spark, sf_dir) -> DataFrame`` plus, where SQL can express it, the
equivalent DuckDB SQL used as an oracle."""

from .registry import QUERIES, ORACLE  # noqa: F401
from . import vector_evals, stats_evals, corpus_evals, text_evals, rollout_evals, report_evals, tracking_evals, checkpoint_evals, sampling_evals, source_evals, model_evals  # noqa: F401,E401
