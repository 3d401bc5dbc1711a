"""From documents to tidy rows in one call, stopping at a named stage."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typing
from ..operators import collate, compose, structure
from ..options import Options
from ..sources.read import read_documents
from ..store import Workspace

#: Stages in order.
STAGES = ("read", "classify", "analyze", "compose", "collate")
BY = ["doc", "sheet"]


def read_cells(spark: SparkSession, paths: str | list[str], till: str | None = None, options: Options | None = None) -> DataFrame | structure.Analysis:
    """Cells, classified cells, an analysis, composed rows (``attr`` map) or one collated frame.

    Sheets without values or headers are left out of later stages; ``Analysis.status`` names them.
    """
    options = options or Options.of(spark)
    till = till or options.finalize_till
    if till not in STAGES:
        raise ValueError(f"till is one of {STAGES}, not {till!r}")
    work = Workspace(spark, "read")
    cells = work.write(read_documents(spark, paths))
    if till == "read":
        return cells
    classified = typing.classify(cells.filter("error is null").drop("error"), BY)
    if options.focus_range != (float("-inf"), float("inf")):
        classified = typing.focus(classified, *options.focus_range)
    low, high = options.focus_absolute_range
    if low > 0 or high < float("inf"):
        classified = typing.focus(classified, low, high, absolute=True)
    classified = work.write(classified)
    if till == "classify":
        return classified
    if till == "analyze":
        return structure.analyze(classified, BY, options)
    composed = work.write(compose.composed(classified, BY, options))
    if till == "compose":
        return composed
    return collate_composed(composed, options)


def collate_composed(composed: DataFrame, options: Options = Options()) -> DataFrame:
    """Composed blocks united by what their columns hold, within each document or (not on the whole) each sheet."""
    unit = ["doc"] if options.collate_on_whole else BY
    collated = Workspace(composed.sparkSession, "collated").write(collate.collate_blocks(composed, unit, [*BY, "data_gid"]))
    names = sorted((r[0] for r in collated.select(F.explode(F.map_keys("attr"))).distinct().collect()), key=lambda n: (n.rpartition("_")[0], int(n.rpartition("_")[2])))
    return collated.select(*BY, "data_gid", *[F.col("attr")[n].alias(n) for n in names], "value")
