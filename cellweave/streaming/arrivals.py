"""Documents that arrive in a folder, turned into cells as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.read import cells_of


def arriving_cells(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Streaming cells of new files under ``folder``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).load(folder)
    return cells_of(files)


def store_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the cells of new documents to ``out``; each document exactly once, across restarts."""
    cells = arriving_cells(spark, folder)
    return cells.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
