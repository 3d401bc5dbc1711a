"""Cells: one row per cell of a sheet, and ways to and from wide tables.

``KEY`` names a sheet; every operator takes all sheets of all documents in one frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Workspace

KEY = ["doc", "sheet"]
#: The recognised formats of a cell.
FORMATS = ("numeric", "character", "logical", "date", "time", "categorical", "blank")
SCHEMA = "doc string, sheet string, row int, col int, data_type string, value string"


def format_of(kind: T.DataType) -> str | None:
    """Format of a column's cells; None where cells of such a type are dropped."""
    if isinstance(kind, (T.NumericType, T.DayTimeIntervalType)):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "logical"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(kind, (T.StringType, T.BinaryType, T.NullType)):
        return "character"
    return None


def _numbered(df: DataFrame, names: list[str], order: list[str], first: int) -> DataFrame:
    """Texts ``_v0…`` of the columns ``names``, with the row's place by ``order`` after ``first`` in ``_row``."""
    keys = [f"_o{i}" for i in range(len(order))]
    texts = [F.col(f"`{c}`").cast("string").alias(f"_v{i}") for i, c in enumerate(names)]
    ranged = df.select(*[F.col(c).alias(k) for c, k in zip(order, keys)], *texts).repartitionByRange(*keys)
    # written once: the partitions must be the same when they are counted and when they are numbered
    ranged = Workspace(df.sparkSession, "rows").write(ranged.withColumn("_part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in ranged.groupBy("_part").count().collect())  # one row a partition
    starts, before = [], 0
    for part, n in counts:
        starts += [F.lit(part), F.lit(before)]
        before += n
    offset = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.withColumn("_row", (place + offset + first).cast("int"))


def as_cells(df: DataFrame, order: list[str], sheet: str = "sheet_default", doc: str = "", columns: list[str] | None = None, include_names: bool = True) -> DataFrame:
    """A wide table as cells; rows are numbered by ``order``, which must be a total order.

    Column names become row 1 (unless not included); columns of nested types are dropped.  Rows are sorted by
    range and numbered in each partition from the count of those before, so no task holds the sheet.
    """
    names = [c for c in (columns or df.columns) if format_of(df.schema[c].dataType)]
    first = 1 if include_names else 0
    numbered = _numbered(df, names, order, first)
    cell = [
        F.struct(F.lit(i + 1).alias("col"), F.lit(format_of(df.schema[c].dataType)).alias("data_type"), F.col(f"_v{i}").alias("value"))
        for i, c in enumerate(names)
    ]
    body = numbered.select("_row", F.inline(F.array(*cell))).select(F.col("_row").alias("row"), "col", "data_type", "value")
    if include_names:
        spark = df.sparkSession
        head = spark.createDataFrame([(1, i + 1, "character", c) for i, c in enumerate(names)], "row int, col int, data_type string, value string")
        body = head.unionByName(body)
    return body.select(F.lit(doc).alias("doc"), F.lit(sheet).alias("sheet"), "row", "col", "data_type", "value").filter("value is not null")


def as_sheets(frames: dict[str, DataFrame] | list[DataFrame]) -> DataFrame:
    """Cells of several sheets in one frame; unnamed, blank and repeated names are made up and unique."""
    items = list(frames.items()) if isinstance(frames, dict) else [("", f) for f in frames]
    seen: dict[str, int] = {}
    used: set[str] = set()
    out = []
    for i, (name, frame) in enumerate(items):
        name = name.strip() or f"sheet_{i + 1}"
        given = {n.strip() for n, _ in items}
        final = name
        while final in used or (final != name and final in given):  # a made-up name is nobody's own
            seen[name] = seen.get(name, 0) + 1
            final = f"{name}_{seen[name]}"
        used.add(final)
        out.append(frame.withColumn("sheet", F.lit(final)))
    return reduce(DataFrame.unionByName, out)


#: Columns by which foreign cell tables are told apart, and names of their types.
ADAPTERS = {
    "typed_workbook": {"needs": {"row", "col", "data_type", "is_blank"}, "values": ["error", "logical", "numeric", "date", "character"], "types": {"numeric": "numeric", "logical": "logical", "date": "date"}},
    "typed_columns": {"needs": {"row", "col", "data_type"}, "values": ["chr", "cpl", "cplx", "dbl", "fct", "int", "lgl", "ord", "date", "dttm"], "types": {"dbl": "numeric", "int": "numeric", "lgl": "logical", "date": "date", "dttm": "time", "fct": "categorical", "ord": "categorical"}},
    "melted": {"needs": {"row", "col", "data_type", "value"}, "values": [], "types": {"double": "numeric", "integer": "numeric", "logical": "logical", "date": "date", "datetime": "time"}},
    "cells": {"needs": {"row", "col", "data_type", "value"}, "values": [], "types": {f: f for f in FORMATS}},
}


def detect_adapter(df: DataFrame) -> str | None:
    """Which kind of cell table ``df`` is: all needed columns, then fewest others, then most known types."""
    fits = {n: a for n, a in ADAPTERS.items() if a["needs"] <= set(df.columns) and (not a["values"] or set(a["values"]) & set(df.columns))}
    if not fits:
        return None
    kinds = {r[0] for r in df.select("data_type").distinct().limit(1000).collect()}
    score = {n: (len(set(df.columns) - a["needs"] - set(a["values"])), -len(kinds & set(a["types"])), list(ADAPTERS).index(n)) for n, a in fits.items()}
    return min(score, key=score.get)


def adapt(df: DataFrame, kind: str | None = None, doc: str = "", sheet: str = "sheet_default") -> DataFrame:
    """A foreign cell table as cells: typed columns united, types renamed (others are character), blanks gone."""
    kind = kind or detect_adapter(df)
    if kind is None:
        raise ValueError("no known kind of cell table has these columns")
    adapter = ADAPTERS[kind]
    present = [c for c in adapter["values"] if c in df.columns]
    value = F.concat_ws("", *[F.col(c).cast("string") for c in present]) if present else F.col("value")
    types = F.create_map(*[F.lit(x) for pair in adapter["types"].items() for x in pair])
    out = df.filter(~F.col("is_blank")) if kind == "typed_workbook" else df
    out = out.select(
        (F.col("doc") if "doc" in df.columns else F.lit(doc)).alias("doc"),
        (F.col("sheet") if "sheet" in df.columns else F.lit(sheet)).alias("sheet"),
        F.col("row").cast("int").alias("row"),
        F.col("col").cast("int").alias("col"),
        F.coalesce(types[F.col("data_type")], F.lit("character")).alias("data_type"),
        value.alias("value"),
    )
    return out.distinct() if kind == "typed_workbook" else out


def normalise(cells: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Integer addresses and recognised formats only."""
    return cells.withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")}).filter(F.col("data_type").isin(*FORMATS))


def violations(cells: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row per sheet that breaks a rule of cells, with a count for each rule."""
    address = F.struct("row", "col")
    checks = {
        "null_address": F.count_if(F.col("row").isNull() | F.col("col").isNull()),
        "not_positive": F.count_if((F.col("row") <= 0) | (F.col("col") <= 0)),
        "repeated_address": F.count("*") - F.count_distinct(address),
        "unknown_format": F.count_if(F.col("data_type").isNull() | ~F.col("data_type").isin(*FORMATS)),
    }
    if {"PoA", "PoV"} <= set(cells.columns):
        checks["bad_probability"] = F.count_if((F.col("PoA") < 0) | (F.col("PoV") < 0) | (F.col("PoA") + F.col("PoV") > 1 + 1e-9))
    found = cells.groupBy(*keys).agg(*[c.alias(n) for n, c in checks.items()])
    return found.filter(reduce(Column.__or__, [F.col(n) > 0 for n in checks]))


def sheet_violations(frame: DataFrame, sheet: str = "sheet") -> list[str]:
    """Why ``frame`` is no table of the cells of several sheets: all reasons at once, none if it is one."""
    missing = [c for c in (sheet, "row", "col", "data_type", "value") if c not in frame.columns]
    if missing:
        return [f"no column {c}" for c in missing]
    unnamed = frame.filter(F.col(sheet).isNull() | (F.trim(sheet) == "")).isEmpty()
    totals = violations(frame, [sheet])
    broken = totals.agg(*[F.sum(c).alias(c) for c in totals.columns if c != sheet]).first().asDict()
    return ([] if unnamed else ["sheets without a name"]) + [f"{k} {v}" for k, v in broken.items() if v]


def summary(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells that share an address as one: the mean of numeric columns, the distinct values of others, parted by commas."""
    held = []
    for f in cells.schema:
        if f.name not in (*by, "row", "col"):
            one = F.avg(f.name) if isinstance(f.dataType, T.NumericType) else F.concat_ws(", ", F.array_sort(F.collect_set(F.col(f.name).cast("string"))))
            held.append(one.alias(f.name))
    return cells.groupBy(*by, "row", "col").agg(*held)


def validate(cells: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``cells``, or an error that names every broken rule at once."""
    bad = violations(cells, keys)
    totals = bad.agg(*[F.sum(c).alias(c) for c in bad.columns if c not in keys]).first()
    broken = {k: v for k, v in totals.asDict().items() if v}
    if broken:
        raise ValueError("not cells: " + ", ".join(f"{k} {v}" for k, v in broken.items()))
    return cells


def to_matrix(cells: DataFrame, keys: list[str], width: int = 0) -> DataFrame:
    """Dense rows ``c1…c<n>`` of each sheet, blank rows vanish; n is the largest column of all sheets, ``width`` at least."""
    width = max(width, cells.agg(F.max("col")).first()[0] or 0)
    return cells.groupBy(*keys, "row").agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"c{i}") for i in range(1, width + 1)])


def describe(cells: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Counts and extent of each sheet."""
    return cells.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.max("row").alias("rows"), F.max("col").alias("cols"), F.count_if(F.col("data_type") == "numeric").alias("numeric_cells")
    )


def window_of(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return cells.filter(F.col("row").between(*rows) & F.col("col").between(*cols))
