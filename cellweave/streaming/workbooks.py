"""Workbook files evaluated as they arrive.

Files are the events and each is evaluated once, so there is no state, window or watermark: a batch of new files is
read, evaluated by workbook and appended to a snapshot.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cells import evaluate_workbooks, shipped
from ..sources.xlsx import CELLS, _cells


def evaluate_arrivals(spark: SparkSession, folder: str, target: str, checkpoint: str, now: float = 0.0) -> StreamingQuery:
    """Starts a query that handles the files there are and then ends; run again, it takes up where it was.

    A batch is written to a folder of its own, so a batch that is repeated after a failure replaces itself.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content")

    def handle(batch, number: int) -> None:
        cells = shipped(batch).mapInPandas(lambda frames: _cells(frames, True), CELLS)  # with their names and calendars
        evaluate_workbooks(cells, now=now).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
