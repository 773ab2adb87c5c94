"""Columns of a caller's table beside an operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.extraction import free_name


def set_aside(docs: DataFrame, *private: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns that are called like one of ``private``
    renamed, and a function that gives a result their names back."""
    own, taken, names = {p.lower() for p in private}, [*docs.columns, *private], {}
    for c in docs.columns:
        if c.lower() in own:
            names[c] = free_name(taken, f"own{c}")
            taken.append(names[c])
    return docs.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})
