"""Entity-attribute-value rows to wide typed rows, as log-structured upserts.

A batch of cells becomes *sparse wide deltas*: one row per (sheet, row) with a ``(version, num, txt)`` struct for
each field the batch touches and null elsewhere.  ``WideStore`` keeps each batch as a run sorted by entity; when a
level holds ``FANOUT`` runs they are merged into one run of the next level; ``latest`` merges what is left.  Per cell
the highest version wins, so runs may be merged in any order.

Cells are shuffled once, on their entity, and reduced to one per field there before columns are made; a hot sheet
spreads over its rows, and an entity never holds more than its own cells.

Defined results for odd input
* null or blank value: the batch does not touch that cell (use ``deletes`` for removals);
* a value that is not valid for its field: the cell holds null, and hides older versions;
* equal versions: the larger (num, txt) wins, so repeated rows and ties are stable;
* null sheet, row or column, or a header that names no field: left out;
* two columns naming one field: their cells merge, the later version wins;
* a batch that was merged before is not merged again;
* extra or clashing column names in the inputs are ignored: only named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Manifest, Workspace, names_in

#: Unicode blanks that a spreadsheet may use for padding or between thousands.
SPACES = " \t\r\n\f\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\ufeff"
BLANKS = "[" + SPACES + "]"


def field_key(c: Column) -> Column:
    """Spelling of a field or header apart from case, blanks, hyphens and underscores."""
    return F.translate(F.lower(c), SPACES + "-_\u2010\u2011", "")


def slug(field: str) -> str:
    """Column name of a field."""
    return "_".join(field.split())


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def parse_number(c: Column) -> Column:
    """Thousandths of a number in ledger notation, or null.

    Signs may lead or trail, brackets mean minus, U+2212 is a minus, thousands may be parted by commas,
    blanks or apostrophes in full groups of three, an exponent is allowed.
    """
    return _number(_signs(_strip(c)))


def _signs(stripped: Column) -> Column:
    return F.translate(stripped, "\u2212\u2019\u00a0\u202f\u2009\u2007", "-'    ")


def _number(t: Column) -> Column:
    body = r"(?:(?:\d{1,3}(?:,\d{3})+|\d{1,3}(?: \d{3})+|\d{1,3}(?:'\d{3})+|\d+)(?:\.\d*)?|\.\d+)"
    number = rf"(?:{body}(?:[eE][+-]?\d{{1,3}})?)"
    ledger = rf"^(?:[+-]? ?{number}|{number} ?[+-]|\( ?{number} ?\))$"
    negative = t.rlike(r"^[-(]|-$")
    figures = F.when(t.rlike("[eE]"), F.regexp_replace(t, r"^[-+( ]+|[-+) ]+$|[, ']", "")).otherwise(F.translate(t, "+-(), '", ""))
    value = figures.try_cast("decimal(30,6)") * F.lit(1000)
    return F.when(t.rlike(r"^-?\d+(?:\.\d+)?$"), F.round(t.try_cast("decimal(30,6)") * F.lit(1000)).try_cast("bigint")).when(
        t.rlike(ledger), F.round(F.when(negative, -value).otherwise(value)).try_cast("bigint")
    )


#: The English month names by their first three letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = (
    "(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)"
)
_TIME = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z?)?"


def parse_date(c: Column) -> Column:
    """Days since 1970-01-01 of a date, or null where it has no such notation or the day does not exist.

    Year first with ``-``, ``/`` or ``.``; eight figures; day first where the year ends; English months in
    ``2 Mar 2019``, ``16-MAR-2014`` and ``October 6, 2013``; a time of day is ignored.
    """
    return _date(_strip(c))


def _date(t: Column) -> Column:
    figures = [
        (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}$", "$1-$3-$4"),
        (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){_TIME}$", "$4-$3-$1"),
        (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    ]
    named = [
        (rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ \-/.]+({_MONTH})\.?[ \-/.,]+(\d{{4}}){_TIME}$", "$3 $2 $1"),
        (rf"^({_MONTH})\.?[ \-]+(\d{{1,2}})(?:st|nd|rd|th)?,?[ \-]+(\d{{4}}){_TIME}$", "$3 $1 $2"),
        (rf"^(\d{{4}})[ \-/.]+({_MONTH})\.?[ \-/.]+(\d{{1,2}}){_TIME}$", "$1 $2 $3"),
    ]
    out = F.lit(None).cast("date")
    for pattern, order in reversed(named):
        part = F.split(F.regexp_replace(t, pattern, order), " ")
        month = ((F.position(F.lower(F.substring(part[1], 1, 3)), F.lit(MONTHS)) + 2) / 3).cast("int")
        out = F.when(t.rlike(pattern), F.concat_ws("-", part[0], month, part[2]).try_cast("date")).otherwise(out)
    for pattern, order in reversed(figures):
        out = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, order).try_cast("date")).otherwise(out)
    iso = F.when((F.length(t) == 10) & t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")).when(F.length(t) >= 8, out)
    return F.unix_date(iso).cast("bigint")


def parse_logical(c: Column) -> Column:
    """1 or 0 of a truth value, or null."""
    return _logical(F.lower(_strip(c)))


def _logical(t: Column) -> Column:
    yes, no = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
    return F.when(t.isin(*yes), F.lit(1).cast("bigint")).when(t.isin(*no), F.lit(0).cast("bigint"))


def parse_as(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "numeric", parse_number(value))
        .when(kind == "date", parse_date(value))
        .when(kind == "logical", parse_logical(value))
    )


#: Stored bytes of resolved headers up to which they are broadcast (about 20 MB in memory); beyond, both sides are shuffled.
BROADCAST_BYTES = 1 << 20
#: Runs of a level that are merged into one of the next.
FANOUT = 4


def register_entries(cells: DataFrame, header_map: DataFrame, sheets: DataFrame, fields: DataFrame, layout: str = "register") -> DataFrame:
    """Entries ``sheet_id, row, field, kind, value, version`` below the header cells of sheets of ``layout``.

    ``fields`` is the agreed schema (it becomes columns, so it is small by nature): a cell can only be a
    header if its text is one of these keys, so header texts are found by a scan and small joins.  The
    resolved headers are written; if they are small they are broadcast, else cells are shuffled on (sheet, col).
    """
    kept = sheets.filter(F.col("layout") == layout).select(F.col("sheet_id").alias("s"))
    heads = header_map.select(F.col("sheet_id").alias("s"), F.col("row").alias("hr"), F.col("col").alias("hc")).join(kept, "s", "left_semi")
    body = cells.select("sheet_id", "row", "col", "value", F.col("loaded_at").alias("version")).filter("value <> ''")
    keys = {"".join(ch for ch in f.lower() if not ch.isspace() and ch not in "-_"): (f, k) for f, k in field_schema(fields)}
    if not keys:
        return body.filter("false").select("sheet_id", "row", F.lit("").alias("field"), F.lit("").alias("kind"), "value", "version")
    spelt = F.create_map(*[F.lit(x) for k, (f, kind) in keys.items() for x in (k, f)])
    kinds = F.create_map(*[F.lit(x) for k, (f, kind) in keys.items() for x in (k, kind)])
    headers = (
        body.withColumn("k", field_key(F.col("value")))
        .filter(F.col("k").isin(*keys))
        .join(heads, (F.col("sheet_id") == F.col("s")) & (F.col("col") == F.col("hc")) & (F.col("row") == F.col("hr")))
        .select(F.col("s").alias("s2"), F.col("hc").alias("c2"), F.col("hr").alias("r2"), spelt[F.col("k")].alias("field"), kinds[F.col("k")].alias("kind"))
        .distinct()
    )
    work = Workspace(cells.sparkSession, "headers")
    headers = work.write(headers)
    if work.bytes(headers) <= BROADCAST_BYTES:
        headers = F.broadcast(headers)
    return (
        body.join(headers, (F.col("sheet_id") == F.col("s2")) & (F.col("col") == F.col("c2")) & (F.col("row") > F.col("r2")))
        .select("sheet_id", "row", "field", "kind", _strip(F.col("value")).alias("value"), "version")
        .filter("value <> ''")
    )


def to_deltas(entries: DataFrame, schema: list[tuple[str, str]], deletes: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries as sparse wide deltas, a batch or (by the columns ``keys``) several; ``deletes`` (sheet_id, row,
    field, version, ``keys``) empties cells."""
    entity = ["sheet_id", "row", *keys]
    # texts are prepared in steps of their own, so that no branch below does it again
    steps = entries.select(*entity, "field", "kind", "version", _strip(F.col("value")).alias("_s"))
    steps = steps.withColumns({"_u": F.when(F.col("kind") == "numeric", _signs(F.col("_s"))), "_l": F.when(F.col("kind") == "logical", F.lower("_s"))})
    kind = F.col("kind")
    num = F.when(kind == "numeric", _number(F.col("_u"))).when(kind == "date", _date(F.col("_s"))).when(kind == "logical", _logical(F.col("_l")))
    value = F.struct("version", num.alias("num"), F.when(kind == "character", F.col("_s")).alias("txt"))
    rows = steps.select(*entity, "field", value.alias("cell"))
    if deletes is not None:
        rows = rows.unionByName(
            deletes.select(*entity, "field", F.struct("version", F.lit(None).cast("bigint").alias("num"), F.lit(None).cast("string").alias("txt")).alias("cell"))
        )
    rows = rows.filter(F.col("sheet_id").isNotNull() & F.col("row").isNotNull())
    # one shuffle serves both steps: an entity's cells, then the latest of each field
    latest = rows.repartition("sheet_id", "row").groupBy(*entity, "field").agg(F.max("cell").alias("cell"))
    held = latest.groupBy(*entity).agg(F.map_from_entries(F.collect_list(F.struct("field", "cell"))).alias("_held"))
    return held.select(*entity, *[F.col("_held")[f].alias(slug(f)) for f, _ in schema])


def compact(runs: list[DataFrame], schema: list[tuple[str, str]]) -> DataFrame:
    """Merge runs of deltas: per entity and field the cell of the latest version."""
    merged = reduce(DataFrame.unionByName, [r.select("sheet_id", "row", *[slug(f) for f, _ in schema]) for r in runs])
    return merged.groupBy("sheet_id", "row").agg(*[F.max(slug(f)).alias(slug(f)) for f, _ in schema])


class WideStore:
    """Runs of sparse wide deltas under ``path``, in levels; what lies there is opened."""

    def __init__(self, spark: SparkSession, path: str, schema: list[tuple[str, str]], fanout: int = FANOUT):
        self.spark, self.schema, self.fanout = spark, schema, fanout
        self.manifest = Manifest(spark, path, {"batches": [], "levels": [[]]})
        self.path = self.manifest.path

    def _row_type(self) -> str:
        cells = ", ".join(f"`{slug(f)}` struct<version: {self.manifest.body['version']}, num: bigint, txt: string>" for f, _ in self.schema)
        return f"sheet_id {self.manifest.body['sheet_id']}, row int, {cells}"

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self._row_type()).parquet(*[f"{self.path}/{x}" for x in folders])

    def upsert(self, entries: DataFrame, deletes: DataFrame | None = None, batch: str = "_batch") -> "WideStore":
        """Add ``entries`` (and ``deletes``), whose column ``batch`` names the batch: each becomes a sorted run.

        Several batches that have come in are written by one job; those merged before are left out.
        """
        done = self.manifest.body["batches"]
        fresh = lambda d: d.filter(~F.col(batch).isin(done)) if done else d
        folder = self.manifest.folder()
        deltas = to_deltas(fresh(entries), self.schema, None if deletes is None else fresh(deletes), (batch,))
        deltas.sortWithinPartitions(batch, "sheet_id", "row").write.partitionBy(batch).parquet(f"{self.path}/{folder}")
        made = sorted(x for x in names_in(self.spark, f"{self.path}/{folder}") if x.startswith(f"{batch}="))
        kinds = {"version": deltas.schema[slug(self.schema[0][0])].dataType["version"].dataType.simpleString(), "sheet_id": deltas.schema["sheet_id"].dataType.simpleString()} if self.schema else {}
        for run in made:
            levels = [list(x) for x in self.manifest.body["levels"]]
            levels[0].append(f"{folder}/{run}")
            self.manifest.commit({**kinds, "batches": [*self.manifest.body["batches"], run.partition("=")[2]], "levels": levels})
        return self.settle()

    def settle(self) -> "WideStore":
        """Merge the runs of full levels."""
        level = 0
        while level < len(self.manifest.body["levels"]):
            levels = [list(x) for x in self.manifest.body["levels"]]
            if len(levels[level]) >= self.fanout:
                folder = self.manifest.folder()
                compact([self._read(levels[level])], self.schema).sortWithinPartitions("sheet_id", "row").write.parquet(f"{self.path}/{folder}")
                levels[level] = []
                levels += [[]] * (level + 2 - len(levels))
                levels[level + 1] = [*levels[level + 1], folder]
                self.manifest.commit({**self.manifest.body, "levels": levels})
            level += 1
        return self

    def latest(self) -> DataFrame:
        """One row per entity with the latest version of each cell."""
        live = [x for level in self.manifest.body["levels"] for x in level]
        if not live:
            cells = ", ".join(f"`{slug(f)}` struct<version: timestamp_ntz, num: bigint, txt: string>" for f, _ in self.schema)
            return self.spark.createDataFrame([], f"sheet_id bigint, row int{', ' if cells else ''}{cells}")
        return compact([self._read(live)], self.schema) if len(live) > 1 else self._read(live)

    def vacuum(self) -> list[str]:
        """Delete runs that have been merged into others."""
        return self.manifest.vacuum({x.partition("/")[0] for level in self.manifest.body["levels"] for x in level})


def typed(wide: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """Compacted deltas as one row per entity with one typed column per field."""
    def column(field: str, kind: str) -> Column:
        cell = F.col(slug(field))
        made = {
            "numeric": (cell["num"].cast("decimal(27,0)") / F.lit(1000)).cast("decimal(24,3)"),
            "date": F.date_add(F.lit("1970-01-01").cast("date"), cell["num"].cast("int")),
            "logical": cell["num"] == 1,
        }.get(kind, cell["txt"])
        return made.alias(slug(field))

    return wide.select("sheet_id", "row", *[column(f, k) for f, k in schema])


def to_long(wide: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """The non-null numeric, date and logical cells as ``sheet_id, row, field, val``."""
    kept = [f for f, k in schema if k != "character"]
    nums = wide.select("sheet_id", "row", *[F.col(slug(f))["num"].alias(f) for f in kept])
    return nums.unpivot(["sheet_id", "row"], [F.col(f"`{f}`") for f in kept], "field", "val").filter(F.col("val").isNotNull())


def field_schema(fields: DataFrame) -> list[tuple[str, str]]:
    """The agreed fields on the driver: they are the columns of the result, hence few."""
    return sorted((r[0], r[1]) for r in fields.select("field", "data_type").filter(F.col("field").isNotNull()).distinct().collect())
