"""Which header cells describe which data block of a sheet, and how.

Everything is keyed by sheet (``by``); a driver loop never visits blocks.  Ordinary sheets are analysed in one shuffle
by ``sheet``; for larger ones the same is expressed as joins, windows and aggregates over representatives of blocks
(``by_joins``).  Block labels are integers (``data_gid``, ``attr_gid``).
Sheets without data or without headers are reported by ``status`` and give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options
from ..store import Workspace
from . import blocks, lshape


#: What counts as a number of its own accord.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass
class Analysis:
    """Result of ``analyze``: header map, data blocks, the classified cells, and a status for each sheet."""

    attr_data_map: DataFrame
    data_blocks: DataFrame
    cells: DataFrame
    status: DataFrame
    by: list[str]


def split_roles(classified: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Data cells with ``data_gid`` and header cells with ``attr_gid``; a cell may be both."""
    known = classified.filter("PoA is not null and PoV is not null and not isnan(PoA) and not isnan(PoV) and PoA + PoV > 0").select(*by, "row", "col", "PoA", "PoV")
    data = blocks.components(known.filter("PoV >= 0.5").select(*by, "row", "col"), by, "data_gid")
    attr = blocks.components(known.filter("PoA >= 0.5").select(*by, "row", "col"), by, "attr_gid")
    return data, attr


def free_of_headers(pairs: DataFrame, box: DataFrame, attr: DataFrame, by: list[str]) -> DataFrame:
    """``pairs`` (by, gid, target) whose joint box holds no header cell."""
    b = box.withColumnRenamed("data_gid", "gid")
    corners = ("r_min", "r_max", "c_min", "c_max")
    two = pairs.join(b, [*by, "gid"]).join(b.select(*by, F.col("gid").alias("target"), *[F.col(c).alias(f"{c}2") for c in corners]), [*by, "target"])
    joint = two.select(*by, "gid", "target", F.least("r_min", "r_min2").alias("r_min"), F.greatest("r_max", "r_max2").alias("r_max"), F.least("c_min", "c_min2").alias("c_min"), F.greatest("c_max", "c_max2").alias("c_max"))
    trapped = blocks.inside(attr.select(*by, "row", "col"), joint, by).select(*by, "gid", "target").distinct()
    return pairs.join(trapped, [*by, "gid", "target"], "left_anti")


def remap(frame: DataFrame, pairs: DataFrame, by: list[str], gid: str = "data_gid") -> DataFrame:
    """``frame`` with ``gid`` replaced by its target where one is given."""
    new = pairs.select(*by, F.col("gid").alias(gid), "target").distinct()
    return frame.join(new, [*by, gid], "left").withColumn(gid, F.coalesce("target", gid)).drop("target").distinct()


def merge_fragments(data: DataFrame, attr: DataFrame, by: list[str]) -> DataFrame:
    """Fragments of one data block joined: first those connected through headers, then those in one outline."""
    every = blocks.components(data.select(*by, "row", "col").unionByName(attr.select(*by, "row", "col")).distinct(), by, "part")
    owner = data.join(every, [*by, "row", "col"]).select(*by, "data_gid", "part").distinct()
    first = owner.withColumn("target", F.min("data_gid").over(Window.partitionBy(*by, "part"))).filter("target <> data_gid").select(*by, F.col("data_gid").alias("gid"), "target").distinct()
    data = remap(data, free_of_headers(first, blocks.boxes(data, [*by, "data_gid"]), attr, by), by)
    box = blocks.boxes(data, [*by, "data_gid"])
    outline = blocks.boxes(every, [*by, "part"]).select(*by, "part", *[F.col(c).alias(f"o_{c}") for c in ("r_min", "r_max", "c_min", "c_max")])
    within = box.join(outline, by).filter("r_min >= o_r_min and r_max <= o_r_max and c_min >= o_c_min and c_max <= o_c_max")
    w = Window.partitionBy(*by, "part")
    second = within.withColumns({"target": F.max("data_gid").over(w), "_n": F.count("*").over(w)}).filter("_n >= 2 and target <> data_gid")
    second = second.groupBy(*by, F.col("data_gid").alias("gid")).agg(F.max("target").alias("target"))
    return remap(data, free_of_headers(second, box, attr, by), by)


def axis_stats(data: DataFrame, attr: DataFrame, by: list[str], penalty: float = 0.5) -> DataFrame:
    """Per data block, header block and direction: distance, normalised length of the facing side, blocks between."""
    d = blocks.representatives(data, [*by, "data_gid"])
    a = blocks.representatives(attr, [*by, "attr_gid"])
    out = None
    for axis, pos, less, more, group in (("col", "row", "N", "S", "NS"), ("row", "col", "W", "E", "WE")):
        pairs = d.select(*by, "data_gid", axis, F.col(pos).alias("p_d")).join(a.select(*by, "attr_gid", axis, F.col(pos).alias("p_a")), [*by, axis]).filter("p_d <> p_a")
        pairs = pairs.withColumns({"direction": F.when(F.col("p_a") < F.col("p_d"), less).otherwise(more), "dist": F.abs(F.col("p_a") - F.col("p_d"))})
        nearest = F.min("dist").over(Window.partitionBy(*by, "data_gid", "attr_gid", "direction", axis))
        near = pairs.withColumn("_near", nearest).filter("dist = _near").drop("_near")  # all that are equally near
        extent = a.groupBy(*by, axis, F.col("attr_gid").alias("other")).agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"))
        gap = near.select(*by, axis, "data_gid", "attr_gid", "direction", F.least("p_d", "p_a").alias("g_lo"), F.greatest("p_d", "p_a").alias("g_hi")).filter("g_hi - g_lo > 1")
        ends = [*by, axis, "data_gid", "attr_gid", "direction", "g_lo", "g_hi"]
        crossed = gap.join(extent, [*by, axis]).filter("other <> attr_gid and hi > g_lo and lo < g_hi").groupBy(*ends).agg(F.count_distinct("other").alias("between"))
        lines = near.withColumns({"g_lo": F.least("p_d", "p_a"), "g_hi": F.greatest("p_d", "p_a")}).join(crossed, ends, "left").fillna(0, ["between"])
        w = Window.partitionBy(*by, "data_gid", "attr_gid", "direction")
        lines = lines.withColumn("_far", F.col("dist") - F.min("dist").over(w))
        stats = lines.groupBy(*by, "data_gid", "attr_gid", "direction").agg(F.min("dist").cast("double").alias("dist"), F.sum(1 / (1 + penalty * F.col("_far"))).alias("side"), F.max("between").alias("between"))
        stats = stats.withColumn("direction_group", F.lit(group))
        out = stats if out is None else out.unionByName(stats)
    w = Window.partitionBy(*by, "data_gid", "direction_group")
    return out.withColumn("side", F.col("side") / F.max("side").over(w))


def corner_stats(data: DataFrame, attr: DataFrame, by: list[str]) -> DataFrame:
    """Nearest distance of each data block and header block that face each other over a corner."""
    from .attach import corner

    pairs = corner(blocks.representatives(data, [*by, "data_gid"]), blocks.representatives(attr, [*by, "attr_gid"]), by)
    return pairs.groupBy(*by, "data_gid", "attr_gid", "direction").agg(F.min("dist").alias("dist")).withColumns({"side": F.lit(0.0), "between": F.lit(0).cast("bigint"), "direction_group": F.lit("corner")})


def best_of_group(stats: DataFrame, by: list[str]) -> DataFrame:
    """Per data block and direction group the header blocks with the longest side, then the nearest."""
    w = Window.partitionBy(*by, "data_gid", "direction_group")
    best = stats.withColumn("_s", F.max("side").over(w)).filter("side >= _s - 1e-12")
    return best.withColumn("_d", F.min("dist").over(w)).filter("dist = _d").drop("_s", "_d")


def major_directions(stats: DataFrame, by: list[str]) -> DataFrame:
    """Of the unobstructed header blocks the best in each direction group of a data block."""
    return best_of_group(stats.filter("between = 0"), by)


def minor_directions(data: DataFrame, attr: DataFrame, major: DataFrame, by: list[str]) -> DataFrame:
    """Header blocks without a data block go to the nearest one with its headers, corners included."""
    info = info_blocks(data, attr, major, by)
    rest = attr.join(major.select(*by, "attr_gid").distinct(), [*by, "attr_gid"], "left_anti")
    axis, corners = axis_stats(info, rest, by), corner_stats(info, rest, by)
    facing = axis.select(*by, "data_gid", "attr_gid").distinct()
    every = axis.unionByName(corners.join(facing, [*by, "data_gid", "attr_gid"], "left_anti").select(*axis.columns))
    order = Window.partitionBy(*by, "attr_gid").orderBy("dist", F.desc("side"), "data_gid", "direction")
    return every.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def info_blocks(data: DataFrame, attr: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """A data block's cells and its linked header cells, tagged."""
    headers = links.select(*by, "data_gid", "attr_gid").distinct().join(attr, [*by, "attr_gid"]).select(*by, "data_gid", "row", "col", F.lit("attr").alias("ad_type"))
    return data.select(*by, "data_gid", "row", "col", F.lit("data").alias("ad_type")).unionByName(headers).distinct()


def merge_blocks(data: DataFrame, attr: DataFrame, links: DataFrame, by: list[str], options: Options) -> tuple[DataFrame, DataFrame]:
    """Data blocks whose information boxes coincide or overlap joined, unless a header lies between them."""
    info = blocks.boxes(info_blocks(data, attr, links, by), [*by, "data_gid"]).withColumnRenamed("data_gid", "gid")
    own = blocks.boxes(data, [*by, "data_gid"])
    pairs = blocks.overlaps(info, info, by)
    same = pairs.filter("r_min = r_min2 and r_max = r_max2 and c_min = c_min2 and c_max = c_max2").select(*by, F.col("gid").alias("a"), F.col("gid2").alias("b"))
    other = pairs.filter("not (r_min = r_min2 and r_max = r_max2 and c_min = c_min2 and c_max = c_max2)")
    both = other.select(*by, F.col("gid").alias("a"), F.col("gid2").alias("b")).unionByName(other.select(*by, F.col("gid2").alias("a"), F.col("gid").alias("b")))
    corners = ("r_min", "r_max", "c_min", "c_max")

    def share_of(target: DataFrame, gid: str) -> DataFrame:
        """How much of the boxes ``target`` of b the information box of a covers."""
        seen = both.join(info.withColumnRenamed("gid", "a"), [*by, "a"]).join(target.select(*by, F.col(gid).alias("b"), *[F.col(c).alias(f"{c}2") for c in corners]), [*by, "b"])
        rows = F.greatest(F.least("r_max", "r_max2") - F.greatest("r_min", "r_min2") + 1, F.lit(0))
        cols = F.greatest(F.least("c_max", "c_max2") - F.greatest("c_min", "c_min2") + 1, F.lit(0))
        return seen.select(*by, "a", "b", (rows * cols / ((F.col("r_max2") - F.col("r_min2") + 1) * (F.col("c_max2") - F.col("c_min2") + 1))).alias("share"))

    seen = share_of(own, "data_gid").join(share_of(info, "gid").withColumnRenamed("share", "other"), [*by, "a", "b"])
    w = Window.partitionBy(*by, "b")
    # a block whose own box nobody covers goes by the box of its information
    seen = seen.withColumn("_m", F.max("share").over(w)).filter("share = _m").withColumn("_o", F.max("other").over(w)).filter("share > 0 or other = _o")
    chosen = seen.select(*by, "a", "b")
    candidates = (chosen.unionByName(same)).select(*by, F.col("b").alias("gid"), F.col("a").alias("target")).distinct()
    kept = free_of_headers(candidates, own, attr, by)
    if not options.check_entrapment_on_full_overlap:
        kept = kept.unionByName(same.select(*by, F.col("b").alias("gid"), F.col("a").alias("target"))).distinct()
    if kept.isEmpty():
        return data, links
    to = blocks.linked(kept, by, "gid", "target")
    data = remap(data, to, by)
    moved = remap(links, to, by)
    merged = moved.groupBy(*by, "data_gid", "attr_gid", "direction", "direction_group").agg(F.min("dist").alias("dist"), F.max("side").alias("side"), F.max("between").alias("between"))
    return data, best_of_group(merged, by)


def split_headers(data: DataFrame, attr: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Header cells of each block with a direction and a mark: each header row above or below, each header
    column beside, and each corner cell becomes a header of its own.  Headers enclosed by the box of the block
    and its headers are taken in."""
    linked = links.select(*by, "data_gid", "attr_gid").distinct().join(attr, [*by, "attr_gid"]).select(*by, "data_gid", "row", "col")
    outline = blocks.boxes(info_blocks(data, attr, links, by), [*by, "data_gid"])
    enclosed = blocks.inside(attr.select(*by, "row", "col"), outline, by).select(*by, "data_gid", "row", "col")
    box = blocks.boxes(data, [*by, "data_gid"])
    cells = linked.unionByName(enclosed).distinct().join(box, [*by, "data_gid"])
    cells = cells.join(data.select(*by, "data_gid", "row", "col"), [*by, "data_gid", "row", "col"], "left_anti")
    across, down = F.col("col").between(F.col("c_min"), F.col("c_max")), F.col("row").between(F.col("r_min"), F.col("r_max"))
    corner = F.concat(F.when(F.col("row") < F.col("r_min"), "N").otherwise("S"), F.when(F.col("col") < F.col("c_min"), "W").otherwise("E"))
    # a header inside the box heads the cells below it, or those to its right in the last row
    direction = (
        F.when(across & (F.col("row") < F.col("r_min")), "N").when(across & (F.col("row") > F.col("r_max")), "S")
        .when(down & (F.col("col") < F.col("c_min")), "W").when(down & (F.col("col") > F.col("c_max")), "E")
        .when(across & down, F.when(F.col("row") < F.col("r_max"), "N").otherwise("W")).otherwise(corner)
    )
    cells = cells.withColumn("direction", direction)
    mark = F.when(F.col("direction").isin("N", "S"), F.col("row").cast("string")).when(F.col("direction").isin("W", "E"), F.col("col").cast("string")).otherwise(F.concat_ws(":", "row", "col"))
    far = (
        F.when(F.col("direction") == "N", F.col("r_min") - F.col("row")).when(F.col("direction") == "S", F.col("row") - F.col("r_max"))
        .when(F.col("direction") == "W", F.col("c_min") - F.col("col")).when(F.col("direction") == "E", F.col("col") - F.col("c_max"))
        .otherwise(F.sqrt(F.pow(F.least(F.abs(F.col("row") - F.col("r_min")), F.abs(F.col("row") - F.col("r_max"))), 2) + F.pow(F.least(F.abs(F.col("col") - F.col("c_min")), F.abs(F.col("col") - F.col("c_max"))), 2)))
    )
    cells = cells.withColumns({"mark": mark, "dist": far.cast("double")})
    rank = F.dense_rank().over(Window.partitionBy(*by, "data_gid", "direction").orderBy("dist", "row_or_col", "mark"))
    line = F.when(F.col("direction").isin("N", "S"), F.col("row")).when(F.col("direction").isin("W", "E"), F.col("col")).otherwise(F.col("row"))
    nearest = Window.partitionBy(*by, "data_gid", "direction", "mark")
    cells = cells.withColumns({"dist": F.min("dist").over(nearest), "row_or_col": line}).withColumn("_k", rank)
    attr_gid = F.concat(F.lit("ad"), F.col("data_gid"), F.lit("_"), F.col("direction"), F.lit("_"), F.col("_k"))
    return cells.select(*by, "data_gid", attr_gid.alias("attr_gid"), "row", "col", "direction", "dist", "mark", "r_min", "r_max", "c_min", "c_max")


def orientation(headers: DataFrame, data: DataFrame, by: list[str], options: Options) -> DataFrame:
    """One row per header with its tag, coverage of the block's lines, and the block's side it lies on."""
    lines = data.groupBy(*by, "data_gid").agg(F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_cols"), F.min("row").alias("d_r0"), F.max("row").alias("d_r1"), F.min("col").alias("d_c0"), F.max("col").alias("d_c1"))
    on_row = data.select(*by, "data_gid", F.col("row").alias("_l")).distinct().withColumn("_axis", F.lit("WE"))
    on_col = data.select(*by, "data_gid", F.col("col").alias("_l")).distinct().withColumn("_axis", F.lit("NS"))
    axis = F.when(F.col("direction").isin("N", "S"), "NS").when(F.col("direction").isin("W", "E"), "WE")
    spots = headers.withColumns({"_axis": axis, "_l": F.when(axis == "NS", F.col("col")).otherwise(F.col("row"))})
    shared = spots.join(on_row.unionByName(on_col), [*by, "data_gid", "_axis", "_l"], "left_semi").groupBy(*by, "data_gid", "attr_gid").agg(F.count_distinct("_l").alias("shared"))
    one = headers.groupBy(*by, "data_gid", "attr_gid", "direction", "mark").agg(F.min("dist").alias("dist"), F.count("*").alias("cells"), F.min("row").alias("h_r0"), F.max("row").alias("h_r1"), F.min("col").alias("h_c0"), F.max("col").alias("h_c1"))
    one = one.join(shared, [*by, "data_gid", "attr_gid"], "left").fillna(0, ["shared"]).join(lines, [*by, "data_gid"])
    ns, we = F.col("direction").isin("N", "S"), F.col("direction").isin("W", "E")
    cover = F.when(ns, F.col("shared") / F.col("n_cols")).when(we, F.col("shared") / F.col("n_rows")).otherwise(F.lit(0.0))
    if options.reduced_orientations:
        partial_v, partial_h = F.lit("vl"), F.lit("hu")
    else:
        partial_v = F.when(F.col("h_c0") <= F.col("d_c0"), "vl").when(F.col("h_c1") >= F.col("d_c1"), "vr").otherwise("vm")
        partial_h = F.when(F.col("h_r0") <= F.col("d_r0"), "hu").when(F.col("h_r1") >= F.col("d_r1"), "hd").otherwise("hm")
    tag = (
        F.when(~ns & ~we & F.lit(options.delink_corner_headers), "nothing").when(F.col("cells") == 1, "direct")
        .when(ns, F.when(cover >= 1, "v").otherwise(partial_v)).when(we, F.when(cover >= 1, "h").otherwise(partial_h))
        .when(F.col("direction").isin("NE", "SE"), "vr").otherwise("vl")
    )
    long_ns = F.col("n_rows") <= F.col("n_cols")
    return one.withColumns({"header_orientation_tag": tag, "cover": cover, "is_long": F.when(ns, long_ns).when(we, ~long_ns).otherwise(F.lit(False))})


def name_headers(oriented: DataFrame, by: list[str]) -> DataFrame:
    """``nice_header_name`` of each header: how fully it covers, on which side, and its rank there."""
    ns, we = F.col("direction").isin("N", "S"), F.col("direction").isin("W", "E")
    level = F.when((ns | we) & (F.col("cover") >= 1), "high").when(ns | we, "mid").otherwise("low")
    named = oriented.withColumns({"_level": level, "_side": F.when(F.col("is_long"), "long").otherwise("short")})
    block = Window.partitionBy(*by, "data_gid")
    group = Window.partitionBy(*by, "data_gid", "_level", "_side")
    k = F.dense_rank().over(group.orderBy(F.desc("cover"), "dist", "mark"))
    both = (F.max((ns & (level == "high")).cast("int")).over(block) + F.max((we & (level == "high")).cast("int")).over(block)) == 2
    named = named.withColumns({"_k": k, "_both": both})
    single = F.count("*").over(group) == 1
    first = F.when(F.col("_both") & (F.col("_level") == "high") & single, F.concat_ws("_", "_level", "_side")).otherwise(F.concat_ws("_", "_level", "_side", "_k"))
    named = named.withColumn("_n", first)
    order = Window.partitionBy(*by, "data_gid", "_n").orderBy(F.when(F.col("direction").isin("N", "W"), 1).otherwise(2), "attr_gid")
    repeats = F.count("*").over(Window.partitionBy(*by, "data_gid", "_n")) > 1
    name = F.when(repeats, F.concat_ws("_", "_n", F.row_number().over(order))).otherwise(F.col("_n"))
    return named.withColumn("nice_header_name", name).drop("_level", "_side", "_k", "_both", "_n")


def keep_main_block(data: DataFrame, classified: DataFrame, by: list[str], share: float) -> DataFrame:
    """Blocks with more than ``share`` of a sheet's numeric values, where there is one; else all."""
    plain = F.trim("value").rlike(PLAIN_NUMBER)
    numeric = data.join(classified.filter(plain).select(*by, "row", "col"), [*by, "row", "col"]).groupBy(*by, "data_gid").agg(F.count("*").alias("nv"))
    w = Window.partitionBy(*by)
    main = numeric.withColumn("part", F.col("nv") / F.sum("nv").over(w)).filter(F.col("part") > share)
    kept = data.join(main.select(*by, "data_gid"), [*by, "data_gid"], "left_semi")
    rest = data.join(main.select(*by).distinct(), by, "left_anti")
    return kept.unionByName(rest)


def by_joins(classified: DataFrame, by: list[str], options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Data cells, header cells and links of sheets of any size, by joins and windows."""
    work = Workspace(classified.sparkSession, "analysis")
    data, attr = (work.write(x) for x in split_roles(classified, by))
    both = data.select(*by).distinct().join(attr.select(*by).distinct(), by, "left_semi")
    data, attr = (x.join(both, by, "left_semi") for x in (data, attr))
    data, attr = lshape.impose(data, attr, by)
    data, attr = work.write(data), work.write(attr)
    data = work.write(merge_fragments(data, attr, by))
    major = work.write(major_directions(axis_stats(data, attr, by), by))
    data, major = merge_blocks(data, attr, major, by, options)
    data, major = work.write(data), work.write(major)
    minor = minor_directions(data, attr, major, by)
    links = work.write(major.select(*by, "data_gid", "attr_gid").unionByName(minor.select(*by, "data_gid", "attr_gid")).distinct())
    if options.single_block_filter:
        data = work.write(keep_main_block(data, classified, by, options.single_block_share))
    relabel = F.dense_rank().over(Window.partitionBy(*by).orderBy("data_gid"))
    numbers = work.write(data.select(*by, "data_gid").distinct().withColumn("target", relabel).withColumnRenamed("data_gid", "gid"))
    data = work.write(remap(data, numbers, by))
    links = work.write(remap(links.join(numbers.select(*by, F.col("gid").alias("data_gid")), [*by, "data_gid"], "left_semi"), numbers, by))
    return data.select(*by, "row", "col", "data_gid"), attr.select(*by, "row", "col", "attr_gid"), links.select(*by, "data_gid", "attr_gid")


def by_sheets(classified: DataFrame, by: list[str], options: Options, buckets: int) -> DataFrame:
    """What ``by_joins`` and ``tagged`` find, for sheets that fit a task, as one frame: ``kind`` d (data), a (header
    blocks), l (links) or h (headers) with the columns it has."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from . import sheet

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        owner: list[int] = []
        keys = pdf.groupby(by, sort=False, dropna=False)
        number = keys.ngroup().to_numpy()
        order = np.argsort(number, kind="stable")
        starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        columns = {c: pdf[c].to_numpy()[order] for c in ("row", "col", "PoA", "PoV", "_plain")}
        for at, upto in zip(starts, [*starts[1:], len(order)]):
            part = {c: v[at:upto] for c, v in columns.items()}
            found, heads, links = sheet.analyze(part["row"], part["col"], part["PoA"].astype(float), part["PoV"].astype(float), part["_plain"].astype(bool), options)
            rows = [("d", r, c, g, None, None, None, None) for (r, c), g in found.items()]
            rows += [("a", r, c, None, g, None, None, None) for (r, c), g in heads.items()]
            rows += [("l", None, None, *pair, None, None, None) for pair in links]
            rows += [("h", r, c, g, None, name, tag, nice) for g, name, (r, c), tag, nice in sheet.headers(found, heads, links, options)]
            out += rows
            owner += [order[at]] * len(rows)
        made = pdf[by].iloc[owner].reset_index(drop=True)
        found = pd.DataFrame(out, columns=["kind", "row", "col", "data_gid", "attr_gid", *texts])
        for c in ("row", "col", "data_gid", "attr_gid"):
            made[c] = found[c].astype("Int32" if c in ("row", "col") else "Int64")
        for c in ("kind", *texts):
            made[c] = found[c].astype(object)
        return made

    texts = ["header", "header_orientation_tag", "nice_header_name"]
    fields = {f.name: f for f in classified.schema.fields}
    schema = T.StructType([*[fields[c] for c in by], *[T.StructField(c, T.IntegerType()) for c in ("row", "col")], *[T.StructField(c, T.LongType()) for c in ("data_gid", "attr_gid")], *[T.StructField(c, T.StringType()) for c in ("kind", *texts)]])
    plain = F.coalesce(F.trim("value").rlike(PLAIN_NUMBER), F.lit(False))
    told = F.col("PoA").isNotNull() & F.col("PoV").isNotNull() & (F.col("PoA") + F.col("PoV") > 0)
    cells = classified.filter(told).select(*by, "row", "col", "PoA", "PoV", plain.alias("_plain"), F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("_bucket"))
    return cells.groupBy("_bucket").applyInPandas(run, schema)


def tagged(data: DataFrame, attr: DataFrame, links: DataFrame, by: list[str], options: Options) -> DataFrame:
    """Header cells of each block with their header, orientation tag and name."""
    headers = Workspace(data.sparkSession, "headers").write(split_headers(data, attr, links, by))
    oriented = name_headers(orientation(headers, data, by, options), by)
    if not options.derive_nice_names:
        oriented = oriented.withColumn("nice_header_name", F.col("attr_gid"))
    tags = oriented.select(*by, "data_gid", "attr_gid", "header_orientation_tag", "nice_header_name")
    return headers.select(*by, "data_gid", "attr_gid", "row", "col").join(tags, [*by, "data_gid", "attr_gid"])


def analyze(classified: DataFrame, by: list[str], options: Options = Options()) -> Analysis:
    """Find data blocks, their headers, and how to attach them, in all sheets at once.

    Sheets up to ``blocks.SHEET_CELLS`` cells are analysed in one task each, many a call; larger ones by joins.
    """
    spark = classified.sparkSession
    work = Workspace(spark, "analysis")
    told = F.col("PoA").isNotNull() & F.col("PoV").isNotNull() & ~F.isnan("PoA") & ~F.isnan("PoV") & (F.col("PoA") + F.col("PoV") > 0)
    sizes = work.write(classified.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(told & (F.col("PoV") >= 0.5)).alias("_d"), F.count_if(told & (F.col("PoA") >= 0.5)).alias("_a")))
    status = sizes.select(*by, F.when(F.col("_d") == 0, "no values").when(F.col("_a") == 0, "no headers").otherwise("ok").alias("status"))
    usable = sizes.filter("_d > 0 and _a > 0")
    total, most = usable.agg(F.sum("_n"), F.max("_n")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // blocks.SHEET_CELLS))
    kept = classified.join(usable.filter(F.col("_n") <= blocks.SHEET_CELLS).select(*by), by, "left_semi")
    found = work.write(by_sheets(kept, by, options, buckets))
    data = found.filter("kind = 'd'").select(*by, "row", "col", "data_gid")
    cells = found.filter("kind = 'h'").select(*by, "data_gid", F.col("header").alias("attr_gid"), "row", "col", "header_orientation_tag", "nice_header_name")
    if (most or 0) > blocks.SHEET_CELLS:
        large = classified.join(usable.filter(F.col("_n") > blocks.SHEET_CELLS).select(*by), by, "left_semi")
        more, attr, links = by_joins(large, by, options)
        data, cells = data.unionByName(more), cells.unionByName(work.write(tagged(more, attr, links, by, options)))
    return Analysis(cells, data, classified, status, by)
