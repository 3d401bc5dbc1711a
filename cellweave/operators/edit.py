"""Edits of cells and of an analysis, as functions of frames: nothing is changed in place."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .structure import Analysis, remap


def crop(cells: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Only the chosen addresses."""
    return cells.join(chosen.select(*by, "row", "col").distinct(), [*by, "row", "col"], "left_semi")


def delete(cells: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """All but the chosen addresses."""
    return cells.join(chosen.select(*by, "row", "col").distinct(), [*by, "row", "col"], "left_anti")


def reclassify(cells: DataFrame, chosen: DataFrame, by: list[str], poa: float, pov: float) -> DataFrame:
    """Header and value probabilities of the chosen addresses set."""
    marked = cells.join(chosen.select(*by, "row", "col").distinct().withColumn("_set", F.lit(True)), [*by, "row", "col"], "left")
    return marked.withColumns({"PoA": F.when(F.col("_set"), poa).otherwise(F.col("PoA")), "PoV": F.when(F.col("_set"), pov).otherwise(F.col("PoV"))}).drop("_set")


def join_blocks(analysis: Analysis, pairs: DataFrame) -> Analysis:
    """Data blocks named by ``pairs`` (by, a, b) become one, under the smaller label."""
    to = blocks.linked(pairs, analysis.by)
    return replace(analysis, data_blocks=remap(analysis.data_blocks, to, analysis.by), attr_data_map=unique_names(remap(analysis.attr_data_map, to, analysis.by), analysis.by))


def connect(analysis: Analysis, links: DataFrame) -> Analysis:
    """Headers attached to data blocks: ``links`` (by, data_gid, attr_gid, header_orientation_tag, nice_header_name)."""
    cells = analysis.attr_data_map.select(*analysis.by, "attr_gid", "row", "col").distinct()
    added = links.join(cells, [*analysis.by, "attr_gid"]).select(*analysis.attr_data_map.columns)
    return replace(analysis, attr_data_map=unique_names(analysis.attr_data_map.unionByName(added).distinct(), analysis.by))


def detach(analysis: Analysis, links: DataFrame) -> Analysis:
    """Headers taken from data blocks: ``links`` (by, data_gid, attr_gid)."""
    keys = [*analysis.by, "data_gid", "attr_gid"]
    return replace(analysis, attr_data_map=analysis.attr_data_map.join(links.select(*keys).distinct(), keys, "left_anti"))


def change_orientation(analysis: Analysis, links: DataFrame) -> Analysis:
    """Tags replaced: ``links`` (by, data_gid, attr_gid, tag)."""
    keys = [*analysis.by, "data_gid", "attr_gid"]
    changed = analysis.attr_data_map.join(links.select(*keys, F.col("tag").alias("_tag")).distinct(), keys, "left")
    return replace(analysis, attr_data_map=changed.withColumn("header_orientation_tag", F.coalesce("_tag", "header_orientation_tag")).drop("_tag"))


def unique_names(attr_data_map: DataFrame, by: list[str]) -> DataFrame:
    """Header names made unique among the headers of a block."""
    from ..functions.ranks import unique_minimal

    names = attr_data_map.select(*by, "data_gid", "attr_gid", "nice_header_name").distinct()
    fixed = names.withColumn("_new", unique_minimal(F.col("nice_header_name"), [*by, "data_gid"], ["attr_gid"])).drop("nice_header_name")
    return attr_data_map.join(fixed, [*by, "data_gid", "attr_gid"]).withColumn("nice_header_name", F.col("_new")).drop("_new")


def focus_block(analysis: Analysis, data_gid: int) -> Analysis:
    """Only the block of one label in each sheet."""
    return replace(analysis, data_blocks=analysis.data_blocks.filter(F.col("data_gid") == data_gid), attr_data_map=analysis.attr_data_map.filter(F.col("data_gid") == data_gid))
