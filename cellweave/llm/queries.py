"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Workspace, table
from . import canonical, frequency, groups, language, leakage, lookalike, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.cell_groups(table(spark, sf_dir, "cells"), table(spark, sf_dir, "cell_links"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look(table(spark, sf_dir, "cells"), table(spark, sf_dir, "terms"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lookalike.label_counts(table(spark, sf_dir, "terms"))
    values = table(spark, sf_dir, "cells").select("value").distinct()
    return lookalike.forms(values, "value", counts)


_SLOTS = {1: "collated_1", 2: "collated_2"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.mapped(table(spark, sf_dir, "collated"), table(spark, sf_dir, "canon"), _SLOTS)


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    collated = table(spark, sf_dir, "collated")
    return canonical.unmatched(canonical.mapped(collated, table(spark, sf_dir, "canon"), _SLOTS), collated, _SLOTS)


def _counts(spark: SparkSession, sf_dir: str) -> tuple[frequency.TermCounts, int]:
    cells = table(spark, sf_dir, "cells")
    store = frequency.TermCounts(spark, Workspace(spark, "counts").root)
    store.catch_up(frequency.changes(cells, F.year("loaded_at")))  # a batch for each year of loading
    return store, cells.select(F.count_distinct("sheet_id")).first()[0]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, sheets = _counts(spark, sf_dir)
    return frequency.marks(store.frequencies(), sheets)


def p4_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)[0].frequencies()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.alignments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_labels"))
    return found.select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_labels"))
    return language.corrections(found).select("doc_id", "seg_no", "lang")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p4_found": p4_found,
    "p4_frequency": p4_frequency,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_alignments": p7_alignments,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
}

_COUNTED = """
select data_type, value, count(distinct cell_id) as cells, count(distinct sheet_id) as sheets
from cells where length(trim(value, ' ')) > 0 group by data_type, value
"""

SQL: dict[str, str] = {
    "p4_frequency": _COUNTED,
    "p4_found": f"""
select data_type, value, case when cells = 1 then 'rare' else 'common' end as mark
from ({_COUNTED}) where cells = 1 or sheets * 10 > (select count(distinct sheet_id) from cells)
""",
    "p1_found": """
with recursive c as (select distinct cell_id, sheet_id, "row" as r, col as k, gid from cells),
e as (
  select a.cell_id as u, b.cell_id as v from cell_links l
  join c a on a.sheet_id = l.sheet_a and a.r = l.row_a and a.k = l.col_a
  join c b on b.sheet_id = l.sheet_b and b.r = l.row_b and b.k = l.col_b
  union
  select a.cell_id, b.cell_id from c a join c b on a.sheet_id = b.sheet_id and a.gid = b.gid
),
s as (select u, v from e where u <> v union select v, u from e where u <> v),
reach(u, v) as (select u, v from s union select reach.u, s.v from reach join s on reach.v = s.u)
select u as cell_id, least(u, min(v)) as group_id from reach group by u
""",
}
