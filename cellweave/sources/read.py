"""Documents of any number as one table of cells, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..operators.cells import SCHEMA
from . import parsers

#: What the reader yields: cells, or one row with ``error`` for a document nothing could read.
READ_SCHEMA = f"{SCHEMA}, error string"


def _parsed(batches: Iterator) -> Iterator:
    import pandas as pd

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            found, reason = parsers.attempt(bytes(content))
            rows = [(path, sheet, r, c, kind, v, None) for sheet, cells in found.items() for r, c, kind, v in cells]
            yield pd.DataFrame(rows or [(path, None, None, None, None, None, reason)], columns=["doc", "sheet", "row", "col", "data_type", "value", "error"]).astype({"row": "Int32", "col": "Int32"})


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of a frame of files (path, content); documents are parsed where they are read."""
    return files.select("path", "content").mapInPandas(_parsed, READ_SCHEMA)


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells of all documents under ``paths``; an error where none is named or one does not exist."""
    if not paths or not all(isinstance(p, str) and p.strip() for p in ([paths] if isinstance(paths, str) else paths)):
        raise ValueError("paths of documents are needed")
    return cells_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths))
