"""Attaching header cells to data cells by orientation tag.

Frames carry ``by`` (sheet and block keys).  For each line of data the header position that serves it is found over the
distinct lines and positions of a block (as few as the rows and columns of a sheet); data and headers then meet in an
equi-join on the block and the line, so no pair is made that does not belong together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The orientation tags.
TAGS = ("v", "vl", "vr", "vm", "h", "hu", "hd", "hm", "direct", "nothing")


def served(lines: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """``by…, _tag, _line, _pos``: the position (of ``places``: by, _tag, _pos) that serves each line (by, _tag, _line).

    Exact for ``v``/``h``, the last before or at the line for ``l``/``u``, the first at or after it for ``r``/``d``, the
    nearest for ``m``; a line midway between two goes to the larger.
    """
    both = lines.select(*by, "_tag", "_line", F.lit(None).cast("int").alias("_pos")).unionByName(places.select(*by, "_tag", F.col("_pos").alias("_line"), "_pos"))
    w = Window.partitionBy(*by, "_tag").orderBy("_line")
    before = F.max("_pos").over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("_pos").over(w.rangeBetween(0, Window.unboundedFollowing))
    kind = F.substring("_tag", 2, 1)
    nearer = F.when(F.col("_a").isNull() | (2 * F.col("_line") < F.col("_b") + F.col("_a")), F.col("_b")).otherwise(F.col("_a"))
    pos = (
        F.when(kind.isin("l", "u"), F.col("_b")).when(kind.isin("r", "d"), F.col("_a"))
        .when(kind == "m", F.coalesce(nearer, "_a", "_b")).otherwise(F.when(F.col("_b") == F.col("_line"), F.col("_b")))
    )
    found = both.withColumns({"_b": before, "_a": after}).withColumn("_at", pos)
    return found.filter("_pos is null and _at is not null").select(*by, "_tag", "_line", F.col("_at").alias("_pos")).distinct()


def attach(data: DataFrame, headers: DataFrame, by: list[str], tag: str | Column) -> DataFrame:
    """``data`` (by, row, col, …) inner-joined with ``headers`` (by, row, col, header) under ``tag``.

    One header cell of a block reaches all its data; equal positions of several headers all match.
    """
    families = "vh" if not isinstance(tag, str) else tag[:1] if tag[:1] in "vh" else ""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    one = F.count("*").over(Window.partitionBy(*by)) == 1
    pos = F.when(F.col("_tag").startswith("v"), F.col("col")).otherwise(F.col("row"))
    kept = headers.withColumns({"_tag": tag}).filter("_tag <> 'nothing'").withColumns({"_all": one | (F.col("_tag") == "direct"), "_pos": pos.cast("int")})
    extra = [c for c in headers.columns if c not in by and c not in ("row", "col")]
    out = data.join(kept.filter("_all").select(*by, *extra), by).select(*data.columns, *extra)
    placed = kept.filter("not _all")
    for family in families:
        axis = "col" if family == "v" else "row"
        own = placed.filter(F.col("_tag").startswith(family))
        places = own.select(*by, "_tag", "_pos").distinct()
        lines = data.select(*by, F.col(axis).cast("int").alias("_line")).distinct().join(places.select(*by, "_tag").distinct(), by)
        sides = served(lines, places, by).join(own.select(*by, "_tag", "_pos", *extra), [*by, "_tag", "_pos"])
        sides = sides.select(*by, F.col("_line").alias(axis), *extra)
        out = out.unionByName(data.join(sides, [*by, axis]).select(*data.columns, *extra))
    return out


def corner(data: DataFrame, headers: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of data and header cells that share neither row nor column: direction and Euclidean distance."""
    d = data.select(*by, F.col("row").alias("row_d"), F.col("col").alias("col_d"), "data_gid")
    a = headers.select(*by, F.col("row").alias("row_a"), F.col("col").alias("col_a"), "attr_gid")
    pairs = d.join(a, by).filter("row_d <> row_a and col_d <> col_a")
    side = F.concat(F.when(F.col("row_a") < F.col("row_d"), "N").otherwise("S"), F.when(F.col("col_a") < F.col("col_d"), "W").otherwise("E"))
    far = F.sqrt(F.pow(F.col("row_a") - F.col("row_d"), 2) + F.pow(F.col("col_a") - F.col("col_d"), 2))
    return pairs.withColumns({"direction": side, "dist": far})
