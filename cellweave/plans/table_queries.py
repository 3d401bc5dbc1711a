"""Queries of whole ways through the engine (documents, cross tables, collation, fuzzy keys), each with SQL from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typing
from ..operators import attach, blocks, cells as cell_ops, collate, compose, edit, structure, tidy
from ..sources.read import cells_of
from ..store import Workspace, table
from .cell_queries import BY
from .pipeline import read_cells

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# Cross tables of orders: a sheet for each nation, states across and priorities down.

_COUNTS = "select c_nationkey as nation, o_orderpriority as priority, o_orderstatus as state, count(*) as n from orders join customer on c_custkey = o_custkey group by all"


def _cross(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the cross tables, the empty places zero."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    counts = orders.groupBy(F.col("c_nationkey").cast("string").alias("sheet"), "o_orderpriority").pivot("o_orderstatus").count().na.fill(0)
    states = [c for c in counts.columns if c not in ("sheet", "o_orderpriority")]
    rank = F.dense_rank().over(cell_ops.Window.partitionBy("sheet").orderBy("o_orderpriority")) + 1
    body = counts.withColumn("row", rank)
    cell = lambda col, kind, value: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("data_type"), value.cast("string").alias("value"))
    inner = body.select("sheet", "row", F.inline(F.array(cell(1, "character", F.col("o_orderpriority")), *[cell(i, "character", F.col(c)) for i, c in enumerate(states, 2)])))
    head = body.select("sheet").distinct().select("sheet", F.lit(1).alias("row"), F.inline(F.array(cell(1, "character", F.lit("priority")), *[cell(i, "character", F.lit(f"state {c}")) for i, c in enumerate(states, 2)])))
    return inner.unionByName(head).select(F.lit("orders").alias("doc"), "sheet", "row", "col", "data_type", "value")


def _cross_analysis(spark: SparkSession, d: str) -> structure.Analysis:
    by = ["doc", "sheet"]
    return structure.analyze(Workspace(spark, "cross").write(typing.classify(_cross(spark, d), by)), by)


@query(f"""
with c as ({_COUNTS}), s as (select distinct nation from c), p as (select distinct nation, priority from c), t as (select distinct state from c)
select p.nation::varchar as sheet, p.priority, 'state ' || t.state as state, coalesce(n, 0) as n from p cross join t left join c using (nation, priority, state)
""")
def compose_cross_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cross tables laid out, analysed and composed: the counts come back with both their headers."""
    made = compose.compose(_cross_analysis(spark, d))
    return made.select("sheet", F.col("attr")["high_long"].alias("priority"), F.col("attr")["high_short"].alias("state"), F.col("value").cast("bigint").alias("n"))


@query("""
with c as (select distinct c_nationkey as nation, o_orderpriority as p from orders join customer on c_custkey = o_custkey), r as (select nation, dense_rank() over (partition by nation order by p) + 1 as r from c),
t as (select dense_rank() over (order by o_orderstatus) + 1 as k from (select distinct o_orderstatus from orders))
select nation::varchar as sheet, r::int as "row", k::int as col, 'high_long' as name, r::int as row_from, 1 as col_from from r cross join t
union all select nation::varchar, r::int, k::int, 'high_short', 1, k::int from r cross join t union all select nation::varchar, r::int, k::int, 'low_short_1', 1, 1 from r cross join t
""")
def lineage_of_cross_tables(spark: SparkSession, d: str) -> DataFrame:
    return compose.lineage(_cross_analysis(spark, d)).select("sheet", "row", "col", "name", "row_from", "col_from")


@query("""
with c as (select distinct c_nationkey as nation from orders join customer on c_custkey = o_custkey), h as (select * from (values ('W', 'h', 'high_long'), ('N', 'v', 'high_short'), ('NW', 'direct', 'low_short_1')) as x(side, tag, name))
select nation::varchar as sheet, 1 as data_gid, 'ad1_' || side || '_1' as attr_gid, tag as header_orientation_tag, name as nice_header_name from c cross join h
""")
def headers_of_cross_tables(spark: SparkSession, d: str) -> DataFrame:
    return _cross_analysis(spark, d).attr_data_map.select("sheet", F.col("data_gid").cast("int").alias("data_gid"), "attr_gid", "header_orientation_tag", "nice_header_name").distinct()


@query(SQL["compose_cross_tables"])
def read_cells_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The cross tables written as a file each and read, typed, analysed, composed and collated in one call."""
    lines = _cross(spark, d).groupBy("sheet", "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("col", "value")))["value"], "\t").alias("line"))
    files = lines.groupBy("sheet").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", "line")))["line"], "\n").alias("text"))
    folder = f"{Workspace(spark, 'files').root}/in"
    files.write.partitionBy("sheet").text(folder)
    tidy_rows = read_cells(spark, folder)
    nation = F.regexp_extract("doc", "sheet=([0-9]+)/", 1).alias("sheet")
    return tidy_rows.select(nation, F.col("high_2").alias("priority"), F.col("high_1").alias("state"), F.col("value").cast("bigint").alias("n"))


# Documents: rows of tables rendered as files of several kinds and read again.

_ROWS = """
r as (select 'n' || c_nationkey as doc, (row_number() over (partition by c_nationkey order by c_custkey) + 1)::int as r, c_custkey::varchar as a, c_name as b, c_mktsegment as c from customer
  union all select distinct 'n' || c_nationkey, 1, 'key', 'name', 'segment' from customer)
"""


def _read_sql(sheet: str, kinds: tuple[str, str, str] = ("'character'",) * 3) -> str:
    return f"with {_ROWS} " + " union all ".join(f"select doc, '{sheet}' as sheet, r as \"row\", {i} as col, {k} as data_type, {c} as value from r" for i, (c, k) in enumerate(zip("abc", kinds), 1))


def _rows(spark: SparkSession, d: str, left: str, between: str, right: str, first: str = "", last: str = "") -> DataFrame:
    """One file for each nation: its customers in order, their fields put between given texts."""
    line = lambda *cs: F.concat(F.lit(left), F.concat_ws(between, *cs), F.lit(right))
    customers = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("path"), "c_custkey", line(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("line"))
    held = customers.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line")))["line"].alias("lines"))
    text = F.concat(F.lit(first), line(*map(F.lit, ("key", "name", "segment"))), F.array_join("lines", ""), F.lit(last))
    return held.select("path", F.encode(text, "UTF-8").alias("content"))


def _cells(files: DataFrame) -> DataFrame:
    return cells_of(files).select("doc", "sheet", "row", "col", "data_type", "value")


@query(_read_sql("sheet_1"))
def read_comma_files(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_rows(spark, d, "", ",", "\n"))


@query(_read_sql("sheet_1"))
def read_tab_files(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_rows(spark, d, "", "\t", "\r\n"))


@query(_read_sql("table_1"))
def read_pages(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_rows(spark, d, "<tr><td>", "</td><td>", "</td></tr>", "<html><body><p>x</p><table>", "</table></body></html>"))


def _zipped(files: DataFrame, parts: dict[str, str], body: str) -> DataFrame:
    """Files as archives of fixed parts and their own content under the name ``body``."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            out = []
            for content in batch["content"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name, text in parts.items():
                        z.writestr(name, text)
                    z.writestr(body, bytes(content))
                out.append(held.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": out})

    return files.mapInPandas(run, "path string, content binary")


@query(_read_sql("Customers", ("case when r = 1 then 'character' else 'numeric' end", "'character'", "'character'")))
def read_workbooks(spark: SparkSession, d: str) -> DataFrame:
    book = {"xl/workbook.xml": '<workbook xmlns:r="u"><sheets><sheet name="Customers" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>'}
    text = '<c t="inlineStr"><is><t>'
    files = _rows(spark, d, "<row><c><v>", f"</v></c>{text}", "</t></is></c></row>", "<w>", "</w>")
    # the first field is a number, the two after it are texts; of the first row all are texts
    content = F.decode("content", "UTF-8")
    content = F.regexp_replace(content, r"<v>key</v></c>", "<x/></c>")
    content = F.regexp_replace(content, "<c><x/></c>", f"{text}key</t></is></c>")
    content = F.regexp_replace(content, r"</v></c>(<c t=.inlineStr.><is><t>[^<]*)</v></c>", "</v></c>$1</t></is></c>")
    content = F.regexp_replace(content, r"(<t>name)</v></c>", "$1</t></is></c>")
    return _cells(_zipped(files.withColumn("content", F.encode(content, "UTF-8")), book, "xl/worksheets/s.xml"))


@query(_read_sql("table_1"))
def read_text_documents(spark: SparkSession, d: str) -> DataFrame:
    cell, end = "<tc><p><t>", "</t></p></tc>"
    return _cells(_zipped(_rows(spark, d, f"<tr>{cell}", end + cell, f"{end}</tr>", "<document><tbl>", "</tbl></document>"), {}, "word/document.xml"))


@query("select 'n' || c_nationkey as doc, 'no reader for ' || case when c_nationkey % 2 = 0 then 'pdf' else 'xls_doc' end as error from customer group by c_nationkey")
def unreadable_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of kinds without a reader are told by their leading bytes, with the reason."""
    nations = table(spark, d, "customer").select("c_nationkey").distinct()
    lead = F.when(F.col("c_nationkey") % 2 == 0, F.unhex(F.lit("255044462D312E37"))).otherwise(F.unhex(F.lit("D0CF11E0A1B11AE1")))
    return cells_of(nations.select(F.concat(F.lit("n"), "c_nationkey").alias("path"), lead.alias("content"))).select("doc", "error")


# Foreign tables of cells.

def _foreign(spark: SparkSession, d: str, names: dict[str, str]) -> DataFrame:
    """Cells with a column of values for each of the types a (number), b (truth), c (date) and d (the rest)."""
    kind = F.when(F.col("data_type") == "numeric", "a").when(F.col("data_type") == "logical", "b").when(F.col("data_type") == "date", "c").otherwise("d")
    own = table(spark, d, "cells").filter("value <> ''").select(F.col("sheet_id").cast("string").alias("sheet"), "row", "col", "value", kind.alias("k")).distinct()
    kinds = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return own.select("sheet", "row", "col", kinds[F.col("k")].alias("data_type"), *[F.when(F.col("k") == k, F.col("value")).alias(n) for k, n in names.items()])


_ADAPTED = "select distinct sheet_id::varchar as sheet, \"row\", col, value, case when data_type in ('numeric', 'logical', 'date') then data_type else 'character' end as data_type from cells where value <> ''"


@query(_ADAPTED)
def adapt_typed_columns(spark: SparkSession, d: str) -> DataFrame:
    return cell_ops.adapt(_foreign(spark, d, {"a": "dbl", "b": "lgl", "c": "date", "d": "chr"})).select("sheet", "row", "col", "value", "data_type")


@query(_ADAPTED)
def adapt_typed_workbook(spark: SparkSession, d: str) -> DataFrame:
    """Every cell twice, and blank ones beside them."""
    frame = _foreign(spark, d, {"a": "numeric", "b": "logical", "c": "date", "d": "character"}).withColumn("is_blank", F.lit(False))
    blank = frame.withColumns({"is_blank": F.lit(True), "row": F.col("row") + 1000})
    return cell_ops.adapt(frame.unionByName(frame).unionByName(blank)).select("sheet", "row", "col", "value", "data_type")


@query(_ADAPTED)
def adapt_melted(spark: SparkSession, d: str) -> DataFrame:
    frame = _foreign(spark, d, {"a": "double", "b": "logical", "c": "date", "d": "text"})
    return cell_ops.adapt(frame.select("sheet", "row", "col", "data_type", F.coalesce("double", "logical", "date", "text").alias("value"))).select("sheet", "row", "col", "value", "data_type")


@query("""
with r as (select r_regionkey, r_name, row_number() over (order by r_regionkey) + 1 as r from region), n as (select n_name, row_number() over (order by n_nationkey) + 1 as r from nation)
select 'a' as sheet, 1 as "row", 1 as col, 'r_name' as value union all select 'a', r::int, 1, r_name from r union all select 'a_1', 1, 1, 'n_name' union all select 'a_1', r::int, 1, n_name from n
union all select 'sheet_3', 1, 1, 'r_name' union all select 'sheet_3', r::int, 1, r_name from r
""")
def sheets_of_frames(spark: SparkSession, d: str) -> DataFrame:
    region = cell_ops.as_cells(table(spark, d, "region"), ["r_regionkey"], columns=["r_name"])
    nation = cell_ops.as_cells(table(spark, d, "nation"), ["n_nationkey"], columns=["n_name"])
    return cell_ops.as_sheets({"a": region, "a ": nation, " ": region}).select("sheet", "row", "col", "value")


@query('select sheet_id, "row", col, nullif(string_agg(distinct value, \', \' order by value), \'\') as value, avg("PoV") as pov from cells group by all')
def cells_by_address(spark: SparkSession, d: str) -> DataFrame:
    held = cell_ops.summary(table(spark, d, "cells").select("sheet_id", "row", "col", "value", "PoV"), BY)
    return held.select("sheet_id", "row", "col", F.when(F.col("value") != "", F.col("value")).alias("value"), F.col("PoV").alias("pov"))


# Blocks and headers of the cells table.

_DATA = 'd as (select distinct sheet_id, "row", col from cells where "PoV" >= 0.5)'
_SIDE = 'h as (select sheet_id, "row" as pos, min(value) as header from cells where "PoA" >= 0.5 and col = 1 and value is not null group by sheet_id, "row"), k as (select *, count(*) over (partition by sheet_id) as n from h)'
_EVERY = 'select d.sheet_id, d."row", d.col, header from d join k using (sheet_id) where n = 1 union all '


def _attach_rows(tag: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        cells = table(spark, d, "cells")
        heads = cells.filter("PoA >= 0.5 and col = 1 and value is not null").groupBy("sheet_id", "row").agg(F.min("value").alias("header")).withColumn("col", F.lit(1))
        return attach.attach(cells.filter("PoV >= 0.5").select("sheet_id", "row", "col").distinct(), heads, BY, tag).select("sheet_id", "row", "col", "header")

    return run


for _tag, _sql in {
    "h": 'select d.sheet_id, d."row", d.col, header from d join k on d.sheet_id = k.sheet_id and d."row" = pos where n > 1',
    "hu": 'select d.sheet_id, d."row", d.col, header from d asof join (select * from k where n > 1) k on d.sheet_id = k.sheet_id and d."row" >= pos',
    "hd": 'select d.sheet_id, d."row", d.col, header from d asof join (select * from k where n > 1) k on d.sheet_id = k.sheet_id and d."row" <= pos',
    "hm": 'select d.sheet_id, d."row", d.col, header from d join (select *, (pos + lag(pos) over w) / 2.0 as lo, (pos + lead(pos) over w) / 2.0 as hi from k where n > 1 window w as (partition by sheet_id order by pos)) k on d.sheet_id = k.sheet_id and (lo is null or d."row" >= lo) and (hi is null or d."row" < hi)',
}.items():
    query(f"with {_DATA}, {_SIDE} {_EVERY}{_sql}", f"attach_{_tag}")(_attach_rows(_tag))
query(f"with {_DATA} select sheet_id, \"row\", col, null::varchar as header from d where false", "attach_nothing")(_attach_rows("nothing"))

_HEADS = "a as (select distinct sheet_id, attr_gid, \"row\", col from attr_data_map)"
_REPS = lambda cells, gid: f'select sheet_id, {gid} as gid, "row", min(col) as col from {cells} group by all union select sheet_id, {gid}, "row", max(col) from {cells} group by all union select sheet_id, {gid}, min("row"), col from {cells} group by sheet_id, {gid}, col union select sheet_id, {gid}, max("row"), col from {cells} group by sheet_id, {gid}, col'


def _axis_sql(axis: str, pos: str, less: str, more: str, group: str) -> str:
    return f"""
select sheet_id, attr_gid, direction, '{group}' as direction_group, min(dist)::double as dist, sum(1 / (1 + 0.5 * (dist - least_dist))) as side, max(between_) as between from (
  select *, min(dist) over (partition by sheet_id, attr_gid, direction) as least_dist, (select count(*) from ax x where x.sheet_id = n.sheet_id and x.axis = '{axis}' and x.line = n.line and x.gid <> n.attr_gid and x.hi > least(n.pd, n.pa) and x.lo < greatest(n.pd, n.pa)) as between_ from (
    select dr.sheet_id, ar.gid as attr_gid, dr.{axis} as line, case when ar.{pos} < dr.{pos} then '{less}' else '{more}' end as direction, abs(ar.{pos} - dr.{pos}) as dist, dr.{pos} as pd, ar.{pos} as pa
    from dr join ar on ar.sheet_id = dr.sheet_id and ar.{axis} = dr.{axis} and ar.{pos} <> dr.{pos}
    qualify dist = min(dist) over (partition by dr.sheet_id, ar.gid, dr.{axis}, direction)) n) group by sheet_id, attr_gid, direction"""


@query(f"""
with {_DATA}, {_HEADS}, dr as ({_REPS('d', '1')}), ar as ({_REPS('a', 'attr_gid')}),
ax as (select sheet_id, gid, 'col' as axis, col as line, min("row") as lo, max("row") as hi from ar group by all union all select sheet_id, gid, 'row', "row", min(col), max(col) from ar group by sheet_id, gid, "row"),
s as ({_axis_sql('col', '"row"', 'N', 'S', 'NS')} union all {_axis_sql('"row"', 'col', 'W', 'E', 'WE').replace("x.axis = '\"row\"'", "x.axis = 'row'")})
select sheet_id, attr_gid, direction, dist, round(side / max(side) over (partition by sheet_id, direction_group), 9) as side, between from s
""")
def axis_statistics(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "cells").filter("PoV >= 0.5").select("sheet_id", "row", "col").distinct().withColumn("data_gid", F.lit(1))
    heads = table(spark, d, "attr_data_map").select("sheet_id", "attr_gid", "row", "col").distinct()
    return structure.axis_stats(cells, heads, BY).select("sheet_id", "attr_gid", "direction", "dist", F.round("side", 9).alias("side"), F.col("between"))


@query(f"""
with {_DATA}, {_HEADS}, l as (select distinct sheet_id, data_gid, attr_gid from attr_data_map where header_orientation_tag in ('v', 'h')),
i as (select l.sheet_id, 'attr' as ad_type, a."row", a.col from l join a using (sheet_id, attr_gid) union select sheet_id, 'data', "row", col from d),
b as (select sheet_id, min("row") as r0, max("row") as r1, min(col) as c0, max(col) as c1 from i group by sheet_id)
select distinct a.sheet_id, a.attr_gid, a."row", a.col from a join b on a.sheet_id = b.sheet_id and a."row" between r0 and r1 and a.col between c0 and c1
""")
def headers_engulfed(spark: SparkSession, d: str) -> DataFrame:
    """Headers inside the box of the data and its headers of a sheet."""
    heads = table(spark, d, "attr_data_map").select("sheet_id", "attr_gid", "row", "col").distinct()
    data = table(spark, d, "cells").filter("PoV >= 0.5").select("sheet_id", "row", "col").distinct().withColumn("data_gid", F.lit(1))
    links = table(spark, d, "attr_data_map").filter("header_orientation_tag in ('v', 'h')").select("sheet_id", "attr_gid", F.lit(1).alias("data_gid"))
    outline = blocks.boxes(structure.info_blocks(data, heads, links, BY), [*BY, "data_gid"])
    return blocks.inside(heads, outline, BY).select("sheet_id", "attr_gid", "row", "col").distinct()


@query(r"""
with d as (select distinct sheet_id, "row", col from cells where "PoV" >= 0.5), v as (select distinct sheet_id, "row", col from cells where regexp_matches(trim(value), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')),
n as (select sheet_id, col, count(*) as n from d join v using (sheet_id, "row", col) group by all), m as (select sheet_id, col from n qualify n / sum(n) over (partition by sheet_id) > 0.3)
select d.* from d join m using (sheet_id, col) union all select d.* from d where sheet_id not in (select sheet_id from m)
""")
def main_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Columns as blocks: those with more than three tenths of a sheet's numbers, or all where there is none."""
    cells = table(spark, d, "cells")
    data = cells.filter("PoV >= 0.5").select("sheet_id", "row", "col").distinct().withColumn("data_gid", F.col("col"))
    return structure.keep_main_block(data, cells.select("sheet_id", "row", "col", "value").distinct(), BY, 0.3).select("sheet_id", "row", "col")


def _given(spark: SparkSession, d: str) -> structure.Analysis:
    """The stored header map as an analysis."""
    heads = table(spark, d, "attr_data_map").select("sheet_id", F.regexp_replace("data_gid", "[^0-9]", "").cast("long").alias("data_gid"), "attr_gid", "row", "col", "header_orientation_tag", "nice_header_name").distinct()
    cells = table(spark, d, "cells").select("sheet_id", "row", "col", "value").distinct()
    data = cells.join(heads.select("sheet_id", "data_gid").distinct(), "sheet_id").select("sheet_id", "row", "col", "data_gid")
    return structure.Analysis(heads, data, cells, heads.select("sheet_id").distinct(), BY)


_MAP = "m as (select distinct sheet_id, regexp_replace(data_gid, '[^0-9]', '', 'g')::bigint as data_gid, attr_gid, \"row\", col, header_orientation_tag as tag, nice_header_name as name from attr_data_map)"


@query(f"with {_MAP} select sheet_id, data_gid, attr_gid, \"row\", col from m where tag <> 'vl'")
def edit_detach(spark: SparkSession, d: str) -> DataFrame:
    given = _given(spark, d)
    links = given.attr_data_map.filter("header_orientation_tag = 'vl'").select("sheet_id", "data_gid", "attr_gid").distinct()
    loose = edit.detach(given, links).attr_data_map
    return loose.select("sheet_id", "data_gid", "attr_gid", "row", "col")


SQL["edit_detach"] = f"with {_MAP}, g as (select distinct sheet_id, data_gid, attr_gid from m where tag = 'vl') select sheet_id, data_gid, attr_gid, \"row\", col from m where not exists (select 1 from g where g.sheet_id = m.sheet_id and g.data_gid = m.data_gid and g.attr_gid = m.attr_gid)"


@query(f"with {_MAP} select sheet_id, attr_gid, \"row\", col, case when exists (select 1 from m x where x.sheet_id = m.sheet_id and x.data_gid = m.data_gid and x.attr_gid = m.attr_gid and x.tag = 'v') then 'vm' else tag end as tag from m")
def edit_orientation(spark: SparkSession, d: str) -> DataFrame:
    given = _given(spark, d)
    links = given.attr_data_map.filter("header_orientation_tag = 'v'").select("sheet_id", "data_gid", "attr_gid", F.lit("vm").alias("tag"))
    return edit.change_orientation(given, links).attr_data_map.select("sheet_id", "attr_gid", "row", "col", F.col("header_orientation_tag").alias("tag"))


@query(f"""
with {_MAP}, n as (select distinct sheet_id, data_gid, attr_gid, tag, 'header' as name from m),
u as (select *, count(*) over (partition by sheet_id, data_gid, name) as k, row_number() over (partition by sheet_id, data_gid, name order by attr_gid) as i from (select distinct sheet_id, data_gid, attr_gid, name from n))
select m.sheet_id, m.attr_gid, m."row", m.col, case when k > 1 then name_ || '_' || i else name_ end as name from m join (select sheet_id, data_gid, attr_gid, name as name_, k, i from u) using (sheet_id, data_gid, attr_gid)
""")
def edit_unique_names(spark: SparkSession, d: str) -> DataFrame:
    named = _given(spark, d).attr_data_map.withColumn("nice_header_name", F.lit("header"))
    return edit.unique_names(named, BY).select("sheet_id", "attr_gid", "row", "col", F.col("nice_header_name").alias("name"))


@query("""
with recursive e as (select distinct sheet_id, "row" as a, "row" + 1 as b from attr_data_map union select sheet_id, col, col + 2 from attr_data_map), s as (select sheet_id, a, b from e union select sheet_id, b, a from e),
r(sheet_id, a, b) as (select sheet_id, a, a from s union select r.sheet_id, r.a, s.b from r join s on s.sheet_id = r.sheet_id and s.a = r.b)
select sheet_id, a as gid, min(b) as target from r group by sheet_id, a
""")
def linked_labels(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "attr_data_map")
    pairs = heads.select("sheet_id", F.col("row").alias("a"), (F.col("row") + 1).alias("b")).unionByName(heads.select("sheet_id", F.col("col").alias("a"), (F.col("col") + 2).alias("b")))
    return blocks.linked(pairs, BY).select("sheet_id", "gid", "target")


# Collation and fuzzy keys.

@query("select distinct 'n' || c_nationkey as sheet, c_acctbal::varchar as value, c_mktsegment as collated_1, c_name as collated_2 from customer")
def collate_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every second nation have the names of their headers exchanged: only what they hold tells them apart."""
    customers = table(spark, d, "customer")
    odd = F.col("c_nationkey") % 2 == 1
    pair = lambda a, b: F.create_map(F.lit("high_long"), F.col(a), F.lit("high_short"), F.col(b))
    made = customers.select(
        F.lit("d").alias("doc"), F.concat(F.lit("n"), "c_nationkey").alias("sheet"), F.lit(1).alias("data_gid"), F.col("c_custkey").cast("int").alias("row"), F.lit(1).alias("col"),
        F.col("c_acctbal").cast("string").alias("value"), F.when(odd, pair("c_name", "c_mktsegment")).otherwise(pair("c_mktsegment", "c_name")).alias("attr"),
    )
    found = collate.collate_blocks(made, ["doc"], ["doc", "sheet", "data_gid"])
    return found.select("sheet", "value", F.col("attr")["collated_1"].alias("collated_1"), F.col("attr")["collated_2"].alias("collated_2"))


_FUZZY = """
x as (select distinct c_mktsegment || ' of ' || r_name as x from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey), y as (select distinct r_name || ' & ' || substr(r_name, 2, 3) as y from region),
cx as (select x, lower(trim(regexp_replace(x || ' ' || array_to_string(list_transform(string_split(x, ' '), lambda w: w[1]), ''), '[^\\p{L}]+', ' ', 'g'))) as c from x),
cy as (select y, lower(trim(regexp_replace(y || ' ' || array_to_string(list_transform(string_split(y, ' '), lambda w: w[1]), ''), '[^\\p{L}]+', ' ', 'g'))) as c from y),
w as (select x, y, list_distinct(string_split(cx.c, ' ')) as wx, list_distinct(string_split(cy.c, ' ')) as wy, replace(cx.c, ' ', '') as tx, replace(cy.c, ' ', '') as ty from cx cross join cy),
l as (select x, y, max(len(sub)) as lcs from (select x, y, ty, unnest(flatten(list_transform(range(1, len(tx)::bigint + 1), lambda i: list_transform(range(1, len(tx)::bigint - i + 2), lambda n: substr(tx, i, n))))) as sub from w) where contains(ty, sub) group by all),
p as (select w.x, w.y, len(list_intersect(wx, wy)) / (len(wx) + len(wy) - len(list_intersect(wx, wy))) as sw, len(list_intersect(list_distinct(string_split(tx, '')), list_distinct(string_split(ty, '')))) as ci,
  len(list_distinct(string_split(tx, ''))) + len(list_distinct(string_split(ty, ''))) as cu, case when coalesce(lcs, 0) >= 3 then lcs / greatest(len(tx), len(ty)) else 0 end as sl from w left join l using (x, y)),
t as (select x, y, 0.55 * sw + case when sw > 0 or sl > 0 then 0.15 * ci / (cu - ci) else 0 end + 0.30 * sl as score from p where 0.55 * sw + case when sw > 0 or sl > 0 then 0.15 * ci / (cu - ci) else 0 end + 0.30 * sl >= 0.10),
b as (select * from t qualify row_number() over (partition by x order by round(score, 9) desc, y) = 1)
"""


def _fuzzy_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    x = table(spark, d, "customer").join(F.broadcast(nations), F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat("c_mktsegment", F.lit(" of "), "r_name").alias("x")).distinct()
    return x, table(spark, d, "region").select(F.concat("r_name", F.lit(" & "), F.substring("r_name", 2, 3)).alias("y"), "r_regionkey")


@query(f"with {_FUZZY} select x, y, round(score, 9) as score from x left join b using (x) union all select null, y, null from y where y not in (select y from b where y is not null)")
def fuzzy_regions(spark: SparkSession, d: str) -> DataFrame:
    x, y = _fuzzy_sides(spark, d)
    return tidy.fuzzy_match(x, y.select("y")).select("x", "y", F.round("score", 9).alias("score"))


for _how in ("left", "inner", "right", "full"):
    query(
        f"with {_FUZZY}, r as (select r_name || ' & ' || substr(r_name, 2, 3) as y, r_regionkey from region) select x, r.y, r_regionkey from (select x, b.y from x left join b using (x)) q {_how} join r on r.y = q.y", f"fuzzy_join_{_how}"
    )(lambda spark, d, how=_how: tidy.fuzzy_join(*_fuzzy_sides(spark, d), by={"x": "y"}, how=how).select("x", "y", "r_regionkey"))
