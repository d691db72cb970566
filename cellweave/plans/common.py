"""Helpers of the registered queries: tables, and values that hash alike in both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import Sheet


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(x) -> Column:
    """A double rounded to six decimals by way of a decimal."""
    x = F.col(x) if isinstance(x, str) else x
    return x.cast("decimal(30,6)").cast("double")


def money(x) -> Column:
    """An amount of two decimals as a decimal, so sums do not depend on their order."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")


def s6(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(30,6)) AS DOUBLE)"


def serial(column: str) -> Column:
    """The date serial of a timestamp's day, from 1 March 1900 on."""
    return F.datediff(F.to_date(column), F.lit("1899-12-30").cast("date")).cast("double")


def filled(df: DataFrame, columns: dict[str, str], formulas: dict[str, tuple[str, str]], keep: list[str], **options) -> DataFrame:
    """``keep`` and a column for each formula: ``formulas`` maps a name to (letter, formula); errors come as ``name_error``."""
    sheet = Sheet(df, columns, **options)
    for name, (letter, formula) in formulas.items():
        sheet = sheet.add(letter, name, formula)
    return sheet.df.select(*keep, *[c for name in formulas for c in (name, sheet.errors.get(name)) if c])
