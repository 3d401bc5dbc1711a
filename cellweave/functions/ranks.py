"""Ranks, runs, unique names and modes, each inside a partition and with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hierarchical_rank(by: list[str], order: list[str | Column]) -> Column:
    """Dense rank over several columns."""
    return F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))


def segments(c: Column) -> Column:
    """Sort key of the figures of a name such as ``1_4_2``: numbers compare as numbers, missing ones last."""
    figures = F.regexp_replace(F.regexp_replace(c, "[^0-9_]", ""), "_+$", "")
    none = F.lit(1 << 62)
    return F.concat(F.transform(F.split(figures, "_"), lambda x: F.coalesce(x.try_cast("bigint"), none)), F.array(none))


def natural_rank(c: Column, by: list[str]) -> Column:
    """Dense rank by ``segments``, as text; the empty text where a name has no figure."""
    blank = F.regexp_replace(c, "[^0-9_]", "") == ""
    rank = F.dense_rank().over(Window.partitionBy(*by, blank).orderBy(segments(c)))
    return F.when(blank, "").otherwise(rank.cast("string"))


def unique_minimal(c: Column, by: list[str], order: list[str | Column]) -> Column:
    """Names made unique: each repeated one gets _1, _2… in order, the first one too."""
    same = Window.partitionBy(*by, c)
    return F.when(F.count("*").over(same) > 1, F.concat_ws("_", c, F.row_number().over(same.orderBy(*order)))).otherwise(c)


def mode(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value of each group; of ties the largest."""
    counts = frame.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.max(F.struct("_n", value))[value].alias("mode"))


def runs(frame: DataFrame, by: list[str], position: str, name: str = "run") -> DataFrame:
    """Number of the run of successive positions that a row belongs to."""
    w = Window.partitionBy(*by).orderBy(position)
    start = F.when(F.col(position) - F.lag(position).over(w) > 1, 1).otherwise(0)
    return frame.withColumn("_start", start).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_start")
