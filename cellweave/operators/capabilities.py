"""What the engine knows: every function with its arity, flags, and whether it compiles to a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.library import lookup, refused
from ..functions.registry import implemented


def capabilities(spark: SparkSession) -> DataFrame:
    """function, least and most arguments (null: any number), volatile, lazy, compiled, and the reason of a refusal."""
    from ..functions.columns import COMPILERS
    from .table import FORMS

    compiled = set(COMPILERS) | FORMS
    rows = []
    for name in sorted([*implemented(), *refused()]):
        f = lookup(name)
        rows.append((name, f.least, None if f.most < 0 else f.most, f.volatile, f.lazy, name in compiled and f.refused is None, f.refused))
    return spark.createDataFrame(rows, "function string, least int, most int, volatile boolean, lazy boolean, compiled boolean, refusal string")
