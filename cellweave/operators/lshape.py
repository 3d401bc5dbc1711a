"""Header cells that wrap data in an L: the L of least area around them, found sheet by sheet.

An L is the box of a group of connected cells without the rectangle at one of its corners (the opening).  All
header cells must lie in the L; the largest opening that holds none is sought.  Where the opening holds most of
the group's data, data outside it under the L become headers.  Groups are connected cells of one sheet; those up
to the size limit are searched in one task each, larger ones by aggregates over their rows, with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import Workspace
from . import blocks


#: Whether rows and columns are turned: pin SW, SE, NW, NE of the opening's inner corner, the first of equals counts.
FLIPS = ((0, 1), (0, 0), (1, 1), (1, 0))


def opening(box: tuple[int, int, int, int], headers: np.ndarray) -> tuple[int, tuple[int, int, int, int]] | None:
    """Largest corner rectangle of ``box`` (r0, r1, c0, c1) without a header, and the area of the L around it."""
    r0, r1, c0, c1 = box
    total = (r1 - r0 + 1) * (c1 - c0 + 1)
    best = None
    for flip_r, flip_c in FLIPS:
        # turn the sheet so that the opening lies at the far end of both axes
        rows = headers[:, 0] - r0 if not flip_r else r1 - headers[:, 0]
        cols = headers[:, 1] - c0 if not flip_c else c1 - headers[:, 1]
        height, width = r1 - r0 + 1, c1 - c0 + 1
        deepest = np.full(height, -1)
        np.maximum.at(deepest, rows, cols)
        # an opening that starts after row r must start after the deepest header column of all later rows
        later = np.concatenate([np.maximum.accumulate(deepest[::-1])[::-1][1:], [-1]])
        areas = (height - 1 - np.arange(height)) * (width - 1 - later)
        areas[(later < 0)] = -1  # an L has two legs
        r = int(areas.argmax())
        if areas[r] <= 0:
            continue
        c = int(later[r])
        size = total - int(areas[r])
        rows_of = (r0 + r + 1, r1) if not flip_r else (r0, r1 - r - 1)
        cols_of = (c0 + c + 1, c1) if not flip_c else (c0, c1 - c - 1)
        if best is None or size < best[0]:
            best = (size, (*rows_of, *cols_of))
    return best


def openings(grouped: DataFrame, by: list[str]) -> DataFrame:
    """``opening`` of each group: ``by, _size, _area`` (of the L and of the box) ``, _r0, _r1, _c0, _c1``.

    The L can only end at the group's first row or at a row with a header: further on the opening shrinks while the
    deepest header column of the later rows stays.  So one row for each such row of a group is enough.
    """
    long = lambda c: F.col(c).cast("bigint")
    box = blocks.boxes(grouped, by).select(*by, *[long(c).alias(c) for c in ("r_min", "r_max", "c_min", "c_max")])
    heads = grouped.filter("_a").select(*by, long("row").alias("row"), long("col").alias("col"))
    ends = box.select(*by, F.explode(F.array("r_min", "r_max")).alias("row"), F.lit(None).cast("bigint").alias("col"))
    lines = heads.unionByName(ends).groupBy(*by, "row").agg(F.min("col").alias("_lo"), F.max("col").alias("_hi")).join(box, by)
    turned = [
        F.struct(
            F.lit(k).alias("_k"), F.lit(flip_r).alias("_fr"), F.lit(flip_c).alias("_fc"),
            (F.col("r_max") - F.col("row") if flip_r else F.col("row") - F.col("r_min")).alias("_i"),
            F.coalesce(F.col("c_max") - F.col("_lo") if flip_c else F.col("_hi") - F.col("c_min"), F.lit(-1)).alias("_deep"),
        )
        for k, (flip_r, flip_c) in enumerate(FLIPS)
    ]
    corners = ["r_min", "r_max", "c_min", "c_max"]
    lines = lines.select(*by, *corners, F.inline(F.array(*turned)))
    after = Window.partitionBy(*by, "_k").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_later", F.max("_deep").over(after)).filter("_later >= 0")  # an L has two legs
    lines = lines.withColumn("_free", (F.col("r_max") - F.col("r_min") - F.col("_i")) * (F.col("c_max") - F.col("c_min") - F.col("_later")))
    order = F.struct("_free", -F.col("_k"), -F.col("_i"))
    best = lines.filter("_free > 0").groupBy(*by, *corners).agg(F.max_by(F.struct("_free", "_fr", "_fc", "_i", "_later"), order).alias("_b")).select(*by, *corners, "_b.*")
    area = (F.col("r_max") - F.col("r_min") + 1) * (F.col("c_max") - F.col("c_min") + 1)
    down, right = F.col("_fr") == 0, F.col("_fc") == 0
    return best.select(
        *by, (area - F.col("_free")).alias("_size"), area.alias("_area"),
        F.when(down, F.col("r_min") + F.col("_i") + 1).otherwise(F.col("r_min")).alias("_r0"), F.when(down, F.col("r_max")).otherwise(F.col("r_max") - F.col("_i") - 1).alias("_r1"),
        F.when(right, F.col("c_min") + F.col("_later") + 1).otherwise(F.col("c_min")).alias("_c0"), F.when(right, F.col("c_max")).otherwise(F.col("c_max") - F.col("_later") - 1).alias("_c1"),
    )


def _by_aggregates(grouped: DataFrame, by: list[str]) -> DataFrame:
    """``grouped`` with data under an L made headers; no group is held in a task."""
    found = openings(grouped, by)
    held = F.col("row").between(F.col("_r0"), F.col("_r1")) & F.col("col").between(F.col("_c0"), F.col("_c1"))
    share = grouped.filter("_d").join(found, by).groupBy(*by, *found.columns[len(by) :]).agg(F.avg(held.cast("double")).alias("_share"))
    wraps = share.filter("_share > 0.8 or (_share > 0.6 and _size / _area < 0.5)").drop("_share", "_size", "_area")
    under = F.col("_r0").isNotNull() & F.col("_d") & ~held
    return grouped.join(wraps, by, "left").withColumn("_u", F.coalesce(under, F.lit(False))).select(
        *[c for c in grouped.columns if c not in ("_d", "_a")], (F.col("_d") & ~F.col("_u")).alias("_d"), (F.col("_a") | F.col("_u")).alias("_a")
    )


def impose(data: DataFrame, attr: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``data`` and ``attr`` with data cells under an L made headers; both labelled anew."""
    d = data.select(*by, "row", "col").withColumn("_d", F.lit(True))
    a = attr.select(*by, "row", "col").withColumn("_a", F.lit(True))
    cells = d.join(a, [*by, "row", "col"], "full").fillna(False, ["_d", "_a"])
    work = Workspace(data.sparkSession, "lshape")
    grouped = work.write(blocks.components(cells, by, "_part"))
    sized = grouped.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    small = grouped.join(sized.filter(F.col("_size") <= blocks.SHEET_CELLS).drop("_size"), [*by, "_part"], "left_semi")
    large = sized.filter(F.col("_size") > blocks.SHEET_CELLS).drop("_size")

    def roles(pdf: pd.DataFrame) -> pd.DataFrame:
        is_d, is_a = pdf["_d"].to_numpy(bool), pdf["_a"].to_numpy(bool)
        if is_d.any() and is_a.any():
            at = pdf[["row", "col"]].to_numpy(int)
            box = (at[:, 0].min(), at[:, 0].max(), at[:, 1].min(), at[:, 1].max())
            found = opening(box, at[is_a])
            if found:
                size, (r0, r1, c0, c1) = found
                held = (at[:, 0] >= r0) & (at[:, 0] <= r1) & (at[:, 1] >= c0) & (at[:, 1] <= c1)
                share = held[is_d].mean()
                area = (box[1] - box[0] + 1) * (box[3] - box[2] + 1)
                if share > 0.8 or (share > 0.6 and size / area < 0.5):
                    under = is_d & ~held
                    pdf["_a"] = is_a | under
                    pdf["_d"] = is_d & held
        return pdf

    made = small.groupBy(*by, "_part").applyInPandas(roles, small.schema)
    if not large.isEmpty():
        made = made.unionByName(_by_aggregates(grouped.join(large, [*by, "_part"], "left_semi"), [*by, "_part"]))
    out = work.write(made)
    relabelled = blocks.components(out.filter("_d").select(*by, "row", "col"), by, "data_gid"), blocks.components(out.filter("_a").select(*by, "row", "col"), by, "attr_gid")
    return relabelled
