"""Frequency of every distinct (data_type, value) pair, kept up to date by signed deltas.

``changes`` turns deliveries into signed records: of each batch the latest record of a cell counts +1, and the record
that stood for the cell before counts -1; a cell delivered again unchanged counts nothing.  ``TermCounts`` keeps counts
by (term, sheet), partitioned by a hash of the term.  A merge aggregates a batch's signed records and appends them as
a run of deltas to the partitions they touch; counts are sums over runs, and a partition with more than ``MAX_RUNS``
runs is compacted into one.  A manifest names the runs and the batches merged; it appears as a whole after a merge, so
that a store opened again goes on from the last finished merge, an aborted one leaves no trace in the counts, and a
batch sent twice counts once.  Record counts (in how many sheets) stay exact under deletes because counts are kept by
(term, sheet).

A term that holds a third of all cells is pre-aggregated in every map task and spread over its sheets; the
sum by term runs over one row per sheet and map task, again combined before the shuffle.

Defined results: null, empty and all-space values are no terms; a null data_type is a value of its own; a
null sheet counts cells but no sheet; a null cell_id cannot be counted once and is left out; of several
rows of one cell_id the latest ``loaded_at`` counts (nulls first; ties: the larger content); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import Manifest, names_in

TERM = ["data_type", "value"]
#: Runs of a partition beyond which they are compacted into one.
MAX_RUNS = 4


def latest_records(cells: DataFrame) -> DataFrame:
    """One row per cell_id: that of the latest delivery."""
    content = ["sheet_id", *TERM]
    order = Window.partitionBy("cell_id").orderBy(F.col("loaded_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in content])
    return (
        cells.select("cell_id", *content, "loaded_at")
        .filter(F.col("cell_id").isNotNull())
        .withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .select("cell_id", *content)
    )


def changes(deliveries: DataFrame, batch: Column) -> DataFrame:
    """``_batch, sheet_id, data_type, value, sign`` of all batches: after-images +1, before-images -1.

    ``batch`` names the batch of a delivery and must not fall as ``loaded_at`` grows.  One shuffle by cell_id serves
    all batches; a cell's rows are its own deliveries only.
    """
    content = ["sheet_id", *TERM]
    order = Window.partitionBy("cell_id").orderBy(F.col("loaded_at").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in content])
    rows = deliveries.select("cell_id", *content, "loaded_at", F.coalesce(batch.cast("string"), F.lit("0")).alias("_batch")).filter("cell_id is not null")
    kept = rows.withColumn("_next", F.lead("_batch").over(order)).filter("_next is null or _next <> _batch")
    image = F.struct(*content)
    kept = kept.withColumns({"_now": image, "_was": F.lag(image).over(order)})
    signed = lambda of, sign: F.struct(F.col(of).alias("image"), F.lit(sign).alias("sign"))
    moved = F.when(F.col("_was").isNull(), F.array(signed("_now", 1))).when(~F.col("_was").eqNullSafe(F.col("_now")), F.array(signed("_now", 1), signed("_was", -1)))
    return kept.select("_batch", F.inline(moved)).select("_batch", "image.*", "sign")


def signed_deltas(after: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Changes of counts by (data_type, value, sheet_id).

    ``after`` holds the records as added or changed, ``before`` those deleted or as they were.
    """
    signed = [
        d.filter(F.length(F.trim("value")) > 0).groupBy(*TERM, "sheet_id").agg(F.sum(F.lit(sign)).alias("cells"))
        for d, sign in ((after, 1), (before, -1))
        if d is not None
    ]
    if len(signed) == 1:
        return signed[0]
    return signed[0].unionByName(signed[1]).groupBy(*TERM, "sheet_id").agg(F.sum("cells").alias("cells")).filter("cells <> 0")


class TermCounts:
    """Persistent counts ``data_type, value, sheet_id, cells`` in ``buckets`` partitions by term.

    What lies under ``path`` is opened, with the number of buckets it was made with.
    """

    SCHEMA = "data_type string, value string, sheet_id bigint, cells bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, max_runs: int = MAX_RUNS):
        self.spark, self.max_runs = spark, max_runs
        self.manifest = Manifest(spark, path, {"buckets": buckets, "batches": [], "runs": {}})
        self.path = self.manifest.path

    @property
    def buckets(self) -> int:
        return self.manifest.body["buckets"]

    @property
    def runs(self) -> dict[str, list[str]]:
        """Folders of the runs of each partition."""
        return self.manifest.body["runs"]

    def counts(self, buckets: list[str] | None = None) -> DataFrame:
        """Deltas of all runs (of some partitions): several rows for a (term, sheet) that several runs touch."""
        keep = [f"{self.path}/{run}/_bucket={b}" for b, runs in sorted(self.runs.items()) if buckets is None or b in buckets for run in runs]
        if not keep:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*keep)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*TERM), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _commit(self, runs: dict[str, list[str]], batches: list[str]) -> None:
        self.manifest.commit({"buckets": self.buckets, "batches": self.manifest.body["batches"] + batches, "runs": runs})

    def _made(self, folder: str) -> list[str]:
        return [x.partition("=")[2] for x in names_in(self.spark, f"{self.path}/{folder}") if x.startswith("_bucket=")]

    def merge(self, deltas: DataFrame, batch: str | None = None) -> "TermCounts":
        """Append a batch of deltas; partitions it does not touch are neither read nor written.

        Nothing is done where ``batch`` was merged before.  An error, and no change, where the store has been changed
        since it was opened here.
        """
        if batch is not None and batch in self.manifest.body["batches"]:
            return self
        folder = self.manifest.folder()
        deltas.select(*TERM, "sheet_id", F.col("cells").cast("bigint").alias("cells"), self._bucket()).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        runs = {b: list(x) for b, x in self.runs.items()}
        for b in self._made(folder):
            runs.setdefault(b, []).append(folder)
        self._commit(runs, [] if batch is None else [batch])
        return self.compact()

    def catch_up(self, signed: DataFrame) -> "TermCounts":
        """Merge all batches of ``changes`` that are new here, in the order of their names, written by one job."""
        done = self.manifest.body["batches"]
        fresh = signed.filter(~F.col("_batch").isin(done)) if done else signed
        deltas = fresh.filter(F.length(F.trim("value")) > 0).groupBy("_batch", *TERM, "sheet_id").agg(F.sum("sign").alias("cells")).filter("cells <> 0")
        folder = self.manifest.folder()
        deltas.select(*TERM, "sheet_id", "cells", "_batch", self._bucket()).write.partitionBy("_batch", "_bucket").parquet(f"{self.path}/{folder}")
        for part in sorted(x for x in names_in(self.spark, f"{self.path}/{folder}") if x.startswith("_batch=")):
            runs = {b: list(x) for b, x in self.runs.items()}
            for b in self._made(f"{folder}/{part}"):
                runs.setdefault(b, []).append(f"{folder}/{part}")
            self._commit(runs, [part.partition("=")[2]])
        return self.compact()

    def compact(self) -> "TermCounts":
        """Sum the runs of partitions that have more than ``max_runs`` into one each."""
        full = [b for b, runs in self.runs.items() if len(runs) > self.max_runs]
        if full:
            folder = self.manifest.folder()
            summed = self.counts(full).groupBy(*TERM, "sheet_id").agg(F.sum("cells").alias("cells")).filter("cells <> 0")
            summed.select(*TERM, "sheet_id", "cells", self._bucket()).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            made = set(self._made(folder))
            self._commit({b: [folder] if b in made else x for b, x in self.runs.items() if b in made or b not in full}, [])
        return self

    def vacuum(self) -> list[str]:
        """Delete runs that have been compacted into others."""
        return self.manifest.vacuum({run.partition("/")[0] for runs in self.runs.values() for run in runs})

    def frequencies(self) -> DataFrame:
        """``data_type, value, cells, sheets`` of every term."""
        pairs = self.counts()
        if any(len(runs) > 1 for runs in self.runs.values()):
            pairs = pairs.groupBy(*TERM, "sheet_id").agg(F.sum("cells").alias("cells")).filter("cells <> 0")
        return pairs.groupBy(*TERM).agg(F.sum("cells").alias("cells"), F.count("sheet_id").alias("sheets"))


def marks(frequencies: DataFrame, total_sheets: int, common_tenths: int = 10) -> DataFrame:
    """Terms that one cell holds (``rare``) or more than a tenth of all sheets hold (``common``)."""
    mark = F.when(F.col("cells") == 1, "rare").when(F.col("sheets") * common_tenths > F.lit(total_sheets), "common")
    # a term in one cell is common too where there are fewer than ten sheets; rare is said once, first
    return frequencies.select(*TERM, mark.alias("mark")).filter(F.col("mark").isNotNull())
