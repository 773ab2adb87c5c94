"""F3 with F8: extraction tables that carry every column of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import sample_positions


def free_name(taken, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def extraction_tables(rows: DataFrame, states: Column, layer: int, k: int = 4, min_pos: int = 50, vec_col: str = "activation_vector",
                      layer_col: str = "activation_layer", pos_col: str = "position_idx") -> tuple[DataFrame, DataFrame]:
    """(primary, multi). ``states``: one vector per position of a row's sequence
    (array of arrays). The primary table has each row's last vector, the other
    one row for each of F8's extra positions, with ``pos_col``.

    Both carry all columns of ``rows`` as they are, but for ``vec_col`` and
    ``layer_col`` (and ``pos_col`` in the second), which are overwritten where
    they exist. Rows whose sequence is null or shorter than two positions are
    left out. A vector leaves the sequence inside the sampler, so whole
    sequences are not repeated for each position."""
    s, x = (free_name(rows.columns, n) for n in ("states", "sampled"))
    held = rows.withColumn(s, states).filter(F.size(s) >= 2)
    def keep(*over):
        return [F.col(f"`{c}`") for c in rows.columns if c.lower() not in {o.lower() for o in over}]
    primary = held.select(*keep(vec_col, layer_col), F.element_at(s, -1).alias(vec_col), F.lit(layer).alias(layer_col))
    at = F.transform(sample_positions(F.size(s), k, min_pos), lambda p: F.struct(p.alias("p"), F.get(F.col(s), p).alias("v")))
    multi = (held.select(*keep(vec_col, layer_col, pos_col), F.explode(at).alias(x))
             .select(*keep(vec_col, layer_col, pos_col), F.col(f"{x}.v").alias(vec_col), F.lit(layer).alias(layer_col), F.col(f"{x}.p").alias(pos_col)))
    return primary, multi
