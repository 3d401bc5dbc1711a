"""Tidy rows from an analysis: every data cell with the headers that reach it.

The result is long, with a map from header name to text: one frame for all blocks of all sheets.  A data cell
that a header does not reach keeps its value.  ``pivoted`` makes columns at the edge, where a user wants them.

``composed`` goes from cells to rows in one shuffle by sheet, with nothing stored between; ``compose`` does the same
by joins, for sheets too large for a task and where the analysis is wanted as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import Options
from ..store import Workspace
from . import attach, blocks, sheet, structure
from .structure import Analysis

#: Entries of maps (32 characters of JSON) after which a task hands on a batch of rows.
BATCH_ENTRIES = 200_000


def compose(analysis: Analysis) -> DataFrame:
    """``by…, data_gid, row, col, value, attr`` (map) of every data cell."""
    by = analysis.by
    values = analysis.cells.select(*by, "row", "col", "value")
    heads = analysis.attr_data_map.join(values.withColumnRenamed("value", "header"), [*by, "row", "col"])
    data = analysis.data_blocks.select(*by, "data_gid", "row", "col")
    # blocks of a sheet carry several headers: a header is a block of its own in the attachment
    keys = [*by, "data_gid", "attr_gid"]
    names = heads.select(*by, "data_gid", "attr_gid").distinct()
    reached = attach.attach(data.join(names, [*by, "data_gid"]), heads.select(*keys, "row", "col", "header_orientation_tag", "nice_header_name", "header"), keys, F.col("header_orientation_tag"))
    pairs = reached.groupBy(*by, "data_gid", "row", "col", "nice_header_name").agg(F.concat_ws(" ", F.array_sort(F.collect_set("header"))).alias("header"))
    maps = pairs.groupBy(*by, "data_gid", "row", "col").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("nice_header_name", "header")))).alias("attr"))
    return data.join(values, [*by, "row", "col"]).join(maps, [*by, "data_gid", "row", "col"], "left").select(*by, "data_gid", "row", "col", "value", "attr")


def composed(cells: DataFrame, by: list[str], options: Options = Options(), classify: Callable[[DataFrame], DataFrame] = lambda cells: cells, as_json: bool = False) -> DataFrame:
    """``compose(analyze(classify(cells)))``, the map as JSON if so wanted.  ``classify`` works sheet by sheet, adds no cells and is called on cells that
    lie together by sheet, so that its own windows and the analysis need no further shuffle.

    Sheets above ``blocks.SHEET_CELLS`` cells go by joins.
    """
    spark = cells.sparkSession
    known = cells.dropna(subset=by)  # as in joins, no sheet without a key
    sizes = known.groupBy(*by).count()
    total, most = sizes.agg(F.sum("count"), F.max("count")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // blocks.SHEET_CELLS))
    if (most or 0) <= blocks.SHEET_CELLS:
        return _by_sheets(classify(known.repartition(tasks, *by)), by, options, as_json)
    work = Workspace(spark, "composed")
    large = work.write(sizes.filter(F.col("count") > blocks.SHEET_CELLS).select(*by))
    ordinary = _by_sheets(classify(known.join(large, by, "left_anti").repartition(tasks, *by)), by, options, as_json)
    analysis = structure.analyze(work.write(classify(known.join(large, by, "left_semi"))), by, options)
    rows = compose(analysis)
    return ordinary.unionByName(rows.withColumn("attr", F.to_json("attr")) if as_json else rows)


def _by_sheets(classified: DataFrame, by: list[str], options: Options, as_json: bool) -> DataFrame:
    """Composed rows of sheets that fit a task; cells lie together by sheet, or are brought together."""
    import pyarrow as pa

    plain = F.coalesce(F.trim("value").rlike(structure.PLAIN_NUMBER), F.lit(False)) if options.single_block_filter else F.lit(False)
    kept = classified.filter("row is not null and col is not null").select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value", "PoA", "PoV", plain.alias("_plain"))
    # the window has the cells of a sheet in one task, one after the other; where they are already, it moves nothing
    kept = kept.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    n, most = len(by), BATCH_ENTRIES
    schema = T.StructType([*kept.schema.fields[:n], T.StructField("data_gid", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("row", "col")], T.StructField("value", T.StringType()), T.StructField("attr", T.StringType() if as_json else T.MapType(T.StringType(), T.StringType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
        """Cells of whole sheets, with where each sheet starts and the end."""
        rest, wanted = [], 0  # the beginning of a sheet, and how many of its cells are still to come
        for batch in batches:
            if wanted:
                rest.append(batch.slice(0, wanted))
                if wanted > batch.num_rows:
                    wanted -= batch.num_rows
                    continue
                joined = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                yield joined, [0, joined.num_rows]
                batch, rest, wanted = batch.slice(wanted), [], 0
            counts, starts = batch.column("_n").to_numpy(), [0]
            while starts[-1] < len(counts) and starts[-1] + counts[starts[-1]] <= len(counts):
                starts.append(starts[-1] + int(counts[starts[-1]]))
            if len(starts) > 1:
                yield batch.slice(0, starts[-1]), starts
            if starts[-1] < len(counts):
                rest = [batch.slice(starts[-1])]
                wanted = int(counts[starts[-1]]) - rest[0].num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole(batches):
            row, col, texts = (batch.column(c).to_pylist() for c in ("row", "col", "value"))
            rows, cols, poa, pov = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "PoA", "PoV"))
            numeric = batch.column("_plain").to_numpy(zero_copy_only=False)
            out = Rows()
            for at, upto in zip(starts, starts[1:]):
                data, attr, links = sheet.analyze(rows[at:upto], cols[at:upto], poa[at:upto].astype(float), pov[at:upto].astype(float), numeric[at:upto], options)
                if not data:
                    continue
                values: dict[sheet.Cell, list[str | None]] = {}
                for r, c, text in zip(row[at:upto], col[at:upto], texts[at:upto]):
                    values.setdefault((r, c), []).append(text)
                for gid, own, made in sheet.all_headers(data, attr, links, options):
                    for cell, names, heads in sheet.compose(own, made, values, as_json):
                        for text in values[cell]:
                            out.add(at, gid, cell, text, names, heads)
                        if out.size > most:
                            yield out.batch(batch, n)
                            out = Rows()
            if out.owner:
                yield out.batch(batch, n)

    class Rows:
        def __init__(self):
            self.owner, self.gid, self.row, self.col, self.value, self.keys, self.items, self.ends = [], [], [], [], [], [], [], [0]
            self.size = 0

        def add(self, owner: int, gid: int, cell: sheet.Cell, value: str | None, names: list[str], heads: list[str]) -> None:
            self.owner.append(owner)
            self.gid.append(gid)
            self.row.append(cell[0])
            self.col.append(cell[1])
            self.value.append(value)
            if as_json:
                text = f"{{{','.join(heads)}}}" if heads else None  # None where no header reaches the cell
                self.items.append(text)
                self.size += 1 + len(text or "") // 32
            else:
                self.keys += names
                self.items += heads
                self.size = len(self.keys)
                self.ends.append(self.size)

        def batch(self, cells: pa.RecordBatch, n: int) -> pa.RecordBatch:
            attr = pa.array(self.items, pa.string())
            if not as_json:
                ends = np.array(self.ends, np.int32)
                none = np.append(ends[1:] == ends[:-1], False)
                attr = pa.MapArray.from_arrays(pa.array(ends, pa.int32(), mask=none), pa.array(self.keys, pa.string()), attr)
            owners = pa.array(self.owner, pa.int64())
            columns = [cells.column(i).take(owners) for i in range(n)]
            columns += [pa.array(self.gid, pa.int64()), pa.array(self.row, pa.int32()), pa.array(self.col, pa.int32()), pa.array(self.value, pa.string()), attr]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def pivoted(composed: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Columns from the map; ``names`` default to all distinct ones, which are few."""
    if names is None:
        names = sorted(r[0] for r in composed.select(F.explode(F.map_keys("attr"))).distinct().collect())
    return composed.select("*", *[F.col("attr")[n].alias(n) for n in names]).drop("attr")


def lineage(analysis: Analysis) -> DataFrame:
    """``by…, data_gid, row, col, name, row_from, col_from``: the header address each value got a name from."""
    by = analysis.by
    heads = analysis.attr_data_map.withColumns({"row_from": F.col("row"), "col_from": F.col("col")})
    keys = [*by, "data_gid", "attr_gid"]
    data = analysis.data_blocks.select(*by, "data_gid", "row", "col").join(heads.select(*keys).distinct(), [*by, "data_gid"])
    reached = attach.attach(data, heads, keys, F.col("header_orientation_tag"))
    return reached.select(*by, "data_gid", "row", "col", F.col("nice_header_name").alias("name"), "row_from", "col_from")
