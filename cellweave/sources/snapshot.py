"""Evaluated workbooks kept and read again: an overlay is plain columns, so a snapshot is a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cells import OVERLAY


def save(overlay: DataFrame, path: str) -> None:
    """Writes an overlay, sorted within files by workbook, so that reading one workbook skips the others."""
    overlay.sortWithinPartitions("workbook_id", "sheet_index", "row", "col").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OVERLAY).parquet(path)
