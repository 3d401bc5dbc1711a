"""Connected blocks of cells, their boxes, borders and representatives.

Blocks are 4-connected.  Ordinary sheets are labelled by a grouped map (one sheet in one task, its size
checked first); larger sheets by alternating minima over row runs and column runs, which never holds a sheet
in a task.  Labels are 1, 2, … in the order of the leftmost column, then the topmost run of a block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import runs
from ..store import Workspace

#: Cells of a sheet up to which it is labelled in one task.
SHEET_CELLS = 200_000


def _run_keys(cells: DataFrame, by: list[str]) -> DataFrame:
    found = runs(runs(cells, [*by, "row"], "col", "_cr"), [*by, "col"], "row", "_rr")
    # a column run is named by its column, then its number: the order of labels
    return found.withColumns({"_rid": F.col("col").cast("bigint") * (1 << 31) + F.col("_rr"), "_cid": F.col("row").cast("bigint") * (1 << 31) + F.col("_cr")})


def _in_one_task(keyed: DataFrame, by: list[str], buckets: int = 8) -> DataFrame:
    """Whole sheets labelled in Python, many sheets a call: ``buckets`` keeps a call near ``SHEET_CELLS`` cells."""
    import pandas as pd
    from pyspark.sql import types as T

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        sheet = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        rows = pdf.assign(_s=sheet).groupby(["_s", "_rid"], sort=True).ngroup().to_numpy()  # in the order of labels
        cols = pdf.assign(_s=sheet).groupby(["_s", "_cid"], sort=False).ngroup().to_numpy()
        name = np.zeros(rows.max() + 1, np.int64)
        name[rows] = pdf["_rid"].to_numpy()
        least = np.arange(len(name))
        while True:
            over = np.full(cols.max() + 1, len(name))
            np.minimum.at(over, cols, least[rows])
            now = least.copy()
            np.minimum.at(now, rows, over[cols])
            if (now == least).all():
                break
            least = now[now]  # a label's own label is a shortcut
        return pdf.assign(_gid=name[least[rows]]).drop(columns="_bucket")

    schema = T.StructType([*keyed.schema.fields, T.StructField("_gid", T.LongType())])
    return keyed.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets))).groupBy("_bucket").applyInPandas(label, schema)


def _iterated(keyed: DataFrame, by: list[str]) -> DataFrame:
    work = Workspace(keyed.sparkSession, "blocks")
    current = work.write(keyed.withColumn("_gid", F.col("_rid")))
    while True:
        step = current.withColumn("_was", F.col("_gid"))
        for run in ("_cid", "_rid"):
            step = step.withColumn("_gid", F.min("_gid").over(Window.partitionBy(*by, run)))
        step = work.write(step)
        done = step.filter("_gid <> _was").isEmpty()
        work.drop(current)
        current = step.drop("_was")
        current._cellweave_path = step._cellweave_path
        if done:
            return current


def components(cells: DataFrame, by: list[str], name: str = "gid", method: str = "auto") -> DataFrame:
    """``cells`` (by, row, col, …; distinct addresses) with the label of their block in ``name``."""
    if method == "auto":
        # the input is written once, so that looking for large sheets does not compute it again
        cells = Workspace(cells.sparkSession, "cells").write(cells)
        sizes = cells.groupBy(*by).count()
        large = sizes.filter(F.col("count") > SHEET_CELLS).select(*by)
        total = sizes.agg(F.sum("count")).first()[0] or 0
        buckets = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHEET_CELLS))
        if large.isEmpty():
            labelled = _in_one_task(_run_keys(cells, by), by, buckets)
        else:
            big = _iterated(_run_keys(cells.join(large, by, "left_semi"), by), by)
            labelled = _in_one_task(_run_keys(cells.join(large, by, "left_anti"), by), by, buckets).unionByName(big)
    else:
        keyed = _run_keys(cells, by)
        labelled = _in_one_task(keyed, by) if method == "grouped" else _iterated(keyed, by)
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("_gid"))
    return labelled.withColumn(name, rank).select(*cells.columns, name)


def linked(edges: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """``by…, gid, target``: smallest label of the group that pairs of labels (a, b) of a sheet link together."""
    ends = edges.select(*by, F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(*by, F.col(b).alias("x"), F.col(a).alias("y")))
    work = Workspace(edges.sparkSession, "linked")
    ends = work.write(ends.distinct())
    label = work.write(ends.groupBy(*by, "x").agg(F.least(F.min("y"), F.col("x")).alias("t")))
    while True:
        sent = ends.join(label.withColumnsRenamed({"x": "y"}), [*by, "y"]).select(*by, "x", "t")
        step = work.write(sent.unionByName(label.select(*by, "x", "t")).groupBy(*by, "x").agg(F.min("t").alias("t")))
        if step.exceptAll(label.select(*step.columns)).isEmpty():
            return step.select(*by, F.col("x").alias("gid"), F.col("t").alias("target"))
        label = step


def boxes(cells: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box of each group of cells."""
    return cells.groupBy(*by).agg(F.min("row").alias("r_min"), F.max("row").alias("r_max"), F.min("col").alias("c_min"), F.max("col").alias("c_max"))


def covering_boxes(cells: DataFrame, by: list[str], share: float = 0.95) -> DataFrame:
    """Box of the middle ``share`` of each group's cells: first lines whose cumulative share reaches the bounds."""
    low, high = (1 - share) / 2, 1 - (1 - share) / 2
    parts = []
    for axis, tag in (("row", "r"), ("col", "c")):
        counts = cells.groupBy(*by, axis).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*by)
        part = counts.withColumn("_p", F.sum("_n").over(w.orderBy(axis)) / F.sum("_n").over(w))
        parts.append(part.groupBy(*by).agg(F.min(F.when(F.col("_p") >= low - 1e-12, F.col(axis))).alias(f"{tag}_min"), F.min(F.when(F.col("_p") >= high - 1e-12, F.col(axis))).alias(f"{tag}_max")))
    return parts[0].join(parts[1], by)


def border(box: DataFrame, by: list[str]) -> DataFrame:
    """Cells on the border of each box."""
    rows, cols = F.sequence("r_min", "r_max"), F.sequence("c_min", "c_max")
    sides = [
        box.select(*by, F.col(line).alias("row"), F.explode(cols).alias("col")) for line in ("r_min", "r_max")
    ] + [box.select(*by, F.explode(rows).alias("row"), F.col(line).alias("col")) for line in ("c_min", "c_max")]
    return reduce(DataFrame.unionByName, sides).distinct()


def representatives(cells: DataFrame, by: list[str], which: str = "both") -> DataFrame:
    """First and/or last cell of each group on each row and each column."""
    ends = {"min": [F.min], "max": [F.max], "both": [F.min, F.max]}[which]
    parts = [cells.groupBy(*by, "row").agg(f("col").alias("col")) for f in ends] + [cells.groupBy(*by, "col").agg(f("row").alias("row")) for f in ends]
    return reduce(DataFrame.unionByName, [p.select(*by, "row", "col") for p in parts]).distinct()


def overlaps(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of boxes of a sheet (gid < gid2) that share an area, with the area."""
    other = right.select(*by, *[F.col(c).alias(f"{c}2") for c in ("gid", "r_min", "r_max", "c_min", "c_max")])
    rows = F.least("r_max", "r_max2") - F.greatest("r_min", "r_min2") + 1
    cols = F.least("c_max", "c_max2") - F.greatest("c_min", "c_min2") + 1
    return left.join(other, by).filter((F.col("gid") < F.col("gid2")) & (rows > 0) & (cols > 0)).withColumn("area", rows * cols)


def inside(cells: DataFrame, box: DataFrame, by: list[str]) -> Column | DataFrame:
    """``cells`` joined to every box of their sheet that contains them."""
    return cells.join(box, by).filter("row between r_min and r_max and col between c_min and c_max")
