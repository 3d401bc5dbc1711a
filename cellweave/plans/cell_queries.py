"""Queries of the table operators over the test tables, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks, typing
from ..operators import attach, blocks, cells as cell_ops, collate, compose, edit, structure, tidy
from ..store import Workspace, table

BY = ["sheet_id"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Each cell once."""
    return table(spark, d, "cells").select("sheet_id", "row", "col", "data_type", "value").distinct()


_C = 'c as (select distinct sheet_id, "row", col, data_type, value from cells)'
_BARE = r"coalesce(regexp_replace(lower(value), '[\s\p{Z}]+', '', 'g'), '')"
_Q = lambda p: p.replace("'", "''")
_NUM = {k: f"regexp_matches(t, '{_Q(p)}')" for k, p in typing.NUMBER.items()}
_NODATE = f"not regexp_matches(t, '{_Q(typing.PLAIN_DATE)}')"
_PLAIN = f"(regexp_matches(t, '{_Q(typing.NUMBER['most_relaxed'])}') and not regexp_matches(t, '{_Q(typing.PLAIN_DATE)}'))"
_DATE = {k: f"regexp_matches(t, '^({p})$')" for k, p in typing.DATE.items()}
_TANY = f"regexp_matches(t, '{typing.TIME_ONLY}')"
_TIME = f"({_TANY} and not {_NUM['most_relaxed']})"
_LOG = f"regexp_matches(t, '{typing.LOGICAL}')"
_TYPE = f"case when t = '' then 'blank' when {_TIME} then 'time' when {_DATE['base']} then 'date' when {_LOG} then 'logical' when {_PLAIN} then 'numeric' else 'character' end"
_PRIOR = "data_type in ('numeric', 'logical', 'date', 'time', 'categorical', 'blank')"
_YEAR = r"case when regexp_matches(value, '^\d{4}$') then (1 / (1 + exp(-0.1 * (try_cast(value as double) - 1600)))) * (1 / (1 + exp(0.1 * (try_cast(value as double) - 2100)))) else 0 end"
_PLAINNUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {_C}, b as (select *, {_BARE} as t from c) select sheet_id, \"row\", col, case when {_PRIOR} then data_type else {_TYPE} end as type from b")
def detect_types(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("sheet_id", "row", "col", typing.plain_type(F.col("value"), F.col("data_type")).alias("type"))


@query(f"with {_C}, b as (select *, {_BARE} as t from c) select sheet_id, \"row\", col, {_NUM['most_relaxed']} as most_relaxed, {_NUM['relaxed']} as relaxed, {_NUM['strict']} as strict, {_PLAIN} as no_date from b")
def number_levels(spark: SparkSession, d: str) -> DataFrame:
    t = typing.bare(F.col("value"))
    levels = [typing.is_numeric(t, k, exclude_dates=False).alias(k) for k in typing.NUMBER]
    return _cells(spark, d).select("sheet_id", "row", "col", *levels, typing.is_numeric(t).alias("no_date"))


@query(f"with {_C}, b as (select *, {_BARE} as t from c) select sheet_id, \"row\", col, " + ", ".join(f"{p} as d_{k}" for k, p in _DATE.items()) + f", {_TIME} as is_time, {_TANY} as is_time_any, {_LOG} as is_logical from b")
def date_and_time_levels(spark: SparkSession, d: str) -> DataFrame:
    t = typing.bare(F.col("value"))
    return _cells(spark, d).select(
        "sheet_id", "row", "col", *[typing.is_date(t, k).alias(f"d_{k}") for k in typing.DATE],
        typing.is_time(t).alias("is_time"), typing.is_time(t, exclude_numbers=False).alias("is_time_any"), typing.is_logical(t).alias("is_logical"),
    )


@query(f"with {_C} select sheet_id, \"row\", col, round({_YEAR}, 9) as p from c where value is not null")
def year_probability(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).filter("value is not null").select("sheet_id", "row", "col", F.round(typing.year_probability(F.col("value")), 9).alias("p"))


_PROB = f"""
with {_C}, b as (select sheet_id, "row", col, value, 'character' as data_type, {_BARE} as t, regexp_replace({_BARE}, 'fy', '', 'g') as t2, {_YEAR} as y from c),
v as (select *, {_PLAIN}::int + {_NUM['most_relaxed']}::int + ({_NUM['relaxed']} and {_NODATE})::int + ({_NUM['strict']} and {_NODATE})::int as n,
  {_DATE['base']}::int + {_DATE['extra'].replace('(t,', '(t2,')}::int as d, {_TIME}::int + {_TANY}::int as h, {_LOG}::int as l from b),
s as (select *, case when t = '' then 0 else least(n / 4.0, 1) end as sn0, case when t = '' then 0 else least(d / 2.0, 1) end as sd0, case when t = '' then 0 else least(h / 2.0, 1) end as st,
  case when t = '' then 0 else l end as sl, case when t = '' then 0 else (10 - n - d - h - l) / 10.0 end as sc, case when t = '' then 1 else 0 end as sb, max(coalesce(y, 0)) over (partition by sheet_id) > 0.6 as yr from v),
w as (select *, case when yr then greatest(sn0 - 0.5 * coalesce(y, 0), 0) else sn0 end as sn, case when yr then sd0 + 0.5 * coalesce(y, 0) else sd0 end as sd from s),
x as (select *, greatest(sl, sd, st, 0, sc) as cl from w)
select sheet_id, "row", col,
  case greatest(sn, sc, sl, sd, st, sb) when sn then 'numeric' when sc then 'character' when sl then 'logical' when sd then 'date' when st then 'time' else 'blank' end as type,
  round(cl / nullif(sn + cl + sb, 0), 6) as poa, round(sn / nullif(sn + cl + sb, 0), 6) as pov from x
"""


@query(_PROB)
def classify_probable(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d).withColumn("data_type", F.lit("character"))
    return typing.classify(cells, BY, method="probable").select("sheet_id", "row", "col", "type", F.round("PoA", 6).alias("poa"), F.round("PoV", 6).alias("pov"))


@query(f"with {_C}, b as (select *, {_BARE} as t from c), k as (select *, case when {_PRIOR} then data_type else {_TYPE} end as type from b) select sheet_id, \"row\", col, type, case when type in ('numeric', 'blank') then 0.0::double else 1.0::double end as poa, case when type = 'numeric' then 1.0::double else 0.0::double end as pov from k")
def classify_simple(spark: SparkSession, d: str) -> DataFrame:
    found = typing.classify(_cells(spark, d), BY, method="simple")
    return found.select("sheet_id", "row", "col", "type", F.col("PoA").alias("poa"), F.col("PoV").alias("pov"))


def _focus_sql(absolute: bool, low: float, high: float) -> str:
    number = f"case when regexp_matches(trim(value), '{_PLAINNUM}') then try_cast(trim(value) as double) end"
    number = f"abs({number})" if absolute else number
    return (
        f"with k as (select distinct sheet_id, \"row\", col, value, type, \"PoA\", \"PoV\" from cells), n as (select *, {number} as x from k), o as (select *, coalesce(\"PoV\" > 0.5 and (x is null or x < {low} or x > {high}), false) as out from n) "
        "select sheet_id, \"row\", col, case when out then 'blank' else type end as type, case when out then 0.0 else \"PoA\" end as poa, case when out then 0.0 else \"PoV\" end as pov from o"
    )


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").select("sheet_id", "row", "col", "value", "type", "PoA", "PoV").distinct()


@query(_focus_sql(False, 0.0, 1000.0))
def focus_range(spark: SparkSession, d: str) -> DataFrame:
    return typing.focus(_stored(spark, d), 0, 1000).select("sheet_id", "row", "col", "type", F.col("PoA").alias("poa"), F.col("PoV").alias("pov"))


@query(_focus_sql(True, 1.0, 100.0))
def focus_absolute_range(spark: SparkSession, d: str) -> DataFrame:
    return typing.focus(_stored(spark, d), 1, 100, absolute=True).select("sheet_id", "row", "col", "type", F.col("PoA").alias("poa"), F.col("PoV").alias("pov"))


@query("""
with w as (select sheet_id, unnest(string_split_regex(lower(value), '[^\\p{L}\\p{N}_]+')) as word from (select distinct sheet_id, "row", col, value from cells)),
n as (select sheet_id, word, count(*) as n from w where word <> '' group by all having count(*) > 1),
l as (select sheet_id, quantile_cont(n, 0.25) as q1, quantile_cont(n, 0.75) as q3 from n group by sheet_id)
select n.sheet_id, word, n from n join l using (sheet_id) where q3 > q1 and n > q3 + 1.5 * (q3 - q1)
""")
def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    return typing.frequent_words(_cells(spark, d), BY)


@query("""
with n as (select *, row_number() over (order by n_nationkey) + 1 as r from nation)
select * from (
  select 1 as "row", 1 as col, 'character' as data_type, 'n_nationkey' as value union all select 1, 2, 'character', 'n_name' union all select 1, 3, 'character', 'n_regionkey'
  union all select r::int, 1, 'numeric', n_nationkey::varchar from n union all select r::int, 2, 'character', n_name from n union all select r::int, 3, 'numeric', n_regionkey::varchar from n
) where value is not null
""")
def as_cells_nation(spark: SparkSession, d: str) -> DataFrame:
    return cell_ops.as_cells(table(spark, d, "nation"), ["n_nationkey"], columns=["n_nationkey", "n_name", "n_regionkey"]).select("row", "col", "data_type", "value")


@query("""
with n as (select *, row_number() over (order by o_orderkey) + 1 as r from orders)
select * from (
  select 1 as "row", 1 as col, 'character' as data_type, 'o_orderkey' as value union all select 1, 2, 'character', 'o_custkey' union all select 1, 3, 'character', 'o_orderstatus'
  union all select r::int, 1, 'numeric', o_orderkey::varchar from n union all select r::int, 2, 'numeric', o_custkey::varchar from n union all select r::int, 3, 'character', o_orderstatus from n
) where value is not null
""")
def as_cells_orders(spark: SparkSession, d: str) -> DataFrame:
    return cell_ops.as_cells(table(spark, d, "orders"), ["o_orderkey"], columns=["o_orderkey", "o_custkey", "o_orderstatus"]).select("row", "col", "data_type", "value")


@query('select sheet_id, "row", col, max(value) as value from cells where value is not null group by sheet_id, "row", col')
def cells_to_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Dense rows, as wide as the widest sheet, and their columns told one by one."""
    wide = cell_ops.to_matrix(table(spark, d, "cells"), BY)
    names = [c for c in wide.columns if c not in (*BY, "row")]
    long = wide.unpivot([*BY, "row"], names, "name", "value").filter("value is not null")
    return long.select(*BY, "row", F.substring("name", 2, 9).cast("int").alias("col"), "value")


@query("""
select sheet_id, count_if("row" is null or col is null) as null_address, count_if("row" <= 0 or col <= 0) as not_positive, count(*) - count(distinct ("row", col)) as repeated_address,
  count_if(data_type is null or data_type not in ('numeric', 'character', 'logical', 'date', 'time', 'categorical', 'blank')) as unknown_format,
  count_if("PoA" < 0 or "PoV" < 0 or "PoA" + "PoV" > 1.000000001) as bad_probability
from cells group by sheet_id having null_address + not_positive + repeated_address + unknown_format + bad_probability > 0
""")
def cell_violations(spark: SparkSession, d: str) -> DataFrame:
    return cell_ops.violations(table(spark, d, "cells"), BY)


@query(f"with {_C} select sheet_id, count(*) as cells, max(\"row\") as rows, max(col) as cols, count_if(data_type = 'numeric') as numeric_cells from c group by sheet_id")
def describe_sheets(spark: SparkSession, d: str) -> DataFrame:
    return cell_ops.describe(_cells(spark, d), BY)


_GRID = 'g as (select distinct sheet_id, "row", col from cells where "PoV" >= 0.5)'


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").filter("PoV >= 0.5").select("sheet_id", "row", "col").distinct()


@query(f'with {_GRID}, f as (select *, case when col - lag(col) over (partition by sheet_id, "row" order by col) > 1 then 1 else 0 end as s from g) select sheet_id, "row", col, 1 + sum(s) over (partition by sheet_id, "row" order by col rows unbounded preceding) as run from f')
def row_runs(spark: SparkSession, d: str) -> DataFrame:
    return ranks.runs(_grid(spark, d), ["sheet_id", "row"], "col")


_COMP = f"""
with recursive {_GRID},
n as (select a.sheet_id, a."row" as r, a.col as c, b."row" as r2, b.col as c2 from g a join g b on a.sheet_id = b.sheet_id and abs(a."row" - b."row") + abs(a.col - b.col) <= 1),
f as (select *, case when "row" - lag("row") over (partition by sheet_id, col order by "row") > 1 then 1 else 0 end as s from g),
k as (select sheet_id, "row" as r, col as c, col::bigint * 2147483648 + 1 + sum(s) over (partition by sheet_id, col order by "row" rows unbounded preceding) as id from f),
reach as (select sheet_id, r, c, r as r2, c as c2 from k union select reach.sheet_id, reach.r, reach.c, n.r2, n.c2 from reach join n on n.sheet_id = reach.sheet_id and n.r = reach.r2 and n.c = reach.c2),
m as (select reach.sheet_id, reach.r, reach.c, min(k.id) as id from reach join k on k.sheet_id = reach.sheet_id and k.r = reach.r2 and k.c = reach.c2 group by all)
select sheet_id, r as "row", c as col, dense_rank() over (partition by sheet_id order by id) as gid from m
"""


@query(_COMP)
def components(spark: SparkSession, d: str) -> DataFrame:
    return blocks.components(_grid(spark, d), BY)


@query(_COMP)
def components_iterated(spark: SparkSession, d: str) -> DataFrame:
    return blocks.components(_grid(spark, d), BY, method="iterated")


@query(f'with {_GRID} select sheet_id, col, min("row") as r_min, max("row") as r_max, min(col) as c_min, max(col) as c_max from g group by sheet_id, col')
def column_boxes(spark: SparkSession, d: str) -> DataFrame:
    grid = _grid(spark, d)
    return blocks.boxes(grid.withColumn("g", F.col("col")), ["sheet_id", "g"]).withColumnRenamed("g", "col")


def _cover_sql(axis: str, tag: str) -> str:
    return f'(select sheet_id, min(case when p >= 0.025 - 1e-12 then x end) as {tag}_min, min(case when p >= 0.975 - 1e-12 then x end) as {tag}_max from (select sheet_id, "{axis}" as x, sum(count(*)) over (partition by sheet_id order by "{axis}") / sum(count(*)) over (partition by sheet_id)::double as p from g group by sheet_id, "{axis}") group by sheet_id) {tag}'


@query(f"with {_GRID} select r.sheet_id, r_min, r_max, c_min, c_max from {_cover_sql('row', 'r')} join {_cover_sql('col', 'c')} using (sheet_id)")
def covering_boxes(spark: SparkSession, d: str) -> DataFrame:
    return blocks.covering_boxes(_grid(spark, d), BY)


@query(f"""
with {_GRID}, b as (select sheet_id, min("row") as r0, max("row") as r1, min(col) as c0, max(col) as c1 from g group by sheet_id)
select distinct sheet_id, "row", col from (
  select sheet_id, r0 as "row", unnest(generate_series(c0, c1))::int as col from b union all select sheet_id, r1, unnest(generate_series(c0, c1))::int from b
  union all select sheet_id, unnest(generate_series(r0, r1))::int, c0 from b union all select sheet_id, unnest(generate_series(r0, r1))::int, c1 from b)
""")
def box_borders(spark: SparkSession, d: str) -> DataFrame:
    return blocks.border(blocks.boxes(_grid(spark, d), BY), BY)


@query(f"""
with {_GRID} select distinct sheet_id, "row", col from (
  select sheet_id, "row", min(col) as col from g group by all union all select sheet_id, "row", max(col) from g group by all
  union all select sheet_id, min("row"), col from g group by sheet_id, col union all select sheet_id, max("row"), col from g group by sheet_id, col)
""")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    return blocks.representatives(_grid(spark, d), BY)


@query(f"""
with h as (select distinct m.sheet_id, m.col as gid, c."row", c.col from attr_data_map m join cells c on c.sheet_id = m.sheet_id and c.col between m.col - 1 and m.col and c."row" > m."row"),
b as (select sheet_id, gid, min("row") as r_min, max("row") as r_max, min(col) as c_min, max(col) as c_max from h group by all)
select a.sheet_id, a.gid, o.gid as gid2, (least(a.r_max, o.r_max) - greatest(a.r_min, o.r_min) + 1) * (least(a.c_max, o.c_max) - greatest(a.c_min, o.c_min) + 1) as area
from b a join b o on a.sheet_id = o.sheet_id and a.gid < o.gid
where least(a.r_max, o.r_max) >= greatest(a.r_min, o.r_min) and least(a.c_max, o.c_max) >= greatest(a.c_min, o.c_min)
""")
def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "attr_data_map").select("sheet_id", F.col("row").alias("hr"), F.col("col").alias("gid"))
    cells = table(spark, d, "cells").select("sheet_id", "row", "col").distinct().withColumn("gid", F.explode(F.array(F.col("col"), F.col("col") + 1)))
    box = blocks.boxes(cells.join(heads, ["sheet_id", "gid"]).filter("row > hr"), ["sheet_id", "gid"])
    return blocks.overlaps(box, box, BY).select("sheet_id", "gid", "gid2", "area")


_DATA = 'd as (select distinct sheet_id, "row", col from cells where "PoV" >= 0.5)'
_HEAD = 'h as (select distinct m.sheet_id, m."row", m.col, c.value as header from attr_data_map m join (select distinct sheet_id, "row", col, value from cells) c using (sheet_id, "row", col))'
_LINE = 'l as (select sheet_id, col as pos, min(header) as header from h where header is not null group by sheet_id, col), k as (select *, count(*) over (partition by sheet_id) as n from l)'


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Data cells, and one header a column of each sheet."""
    named = table(spark, d, "attr_data_map").select("sheet_id", "row", "col").join(table(spark, d, "cells").select("sheet_id", "row", "col", "value").distinct(), ["sheet_id", "row", "col"])
    heads = named.filter("value is not null").groupBy("sheet_id", "col").agg(F.min("value").alias("header"), F.min("row").alias("row"))
    return _grid(spark, d), heads


def _attach_query(tag: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        data, heads = _sides(spark, d)
        return attach.attach(data, heads, BY, tag).select("sheet_id", "row", "col", "header")

    return run


_EVERY = "select d.sheet_id, d.\"row\", d.col, header from d join k using (sheet_id) where n = 1 union all "
_ATTACH = {
    "v": _EVERY + 'select d.sheet_id, d."row", d.col, header from d join k on d.sheet_id = k.sheet_id and d.col = pos where n > 1',
    "vl": _EVERY + 'select d.sheet_id, d."row", d.col, header from d asof join (select * from k where n > 1) k on d.sheet_id = k.sheet_id and d.col >= pos',
    "vr": _EVERY + 'select d.sheet_id, d."row", d.col, header from d asof join (select * from k where n > 1) k on d.sheet_id = k.sheet_id and d.col <= pos',
    "vm": _EVERY + 'select d.sheet_id, d."row", d.col, header from d join (select *, (pos + lag(pos) over w) / 2.0 as lo, (pos + lead(pos) over w) / 2.0 as hi from k where n > 1 window w as (partition by sheet_id order by pos)) k on d.sheet_id = k.sheet_id and (lo is null or d.col >= lo) and (hi is null or d.col < hi)',
    "direct": 'select d.sheet_id, d."row", d.col, header from d join k using (sheet_id)',
}
for _tag, _sql in _ATTACH.items():
    QUERIES[f"attach_{_tag}"] = _attach_query(_tag)
    SQL[f"attach_{_tag}"] = f"with {_DATA}, {_HEAD}, {_LINE} {_sql}"


@query(f"""
with {_DATA}, h as (select distinct sheet_id, "row", col from attr_data_map)
select d.sheet_id, case when h."row" < d."row" then 'N' else 'S' end || case when h.col < d.col then 'W' else 'E' end as direction, count(*) as pairs, round(min(sqrt((h."row" - d."row") ** 2 + (h.col - d.col) ** 2)), 9) as dist
from d join h on d.sheet_id = h.sheet_id and d."row" <> h."row" and d.col <> h.col group by all
""")
def corner_stats(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "attr_data_map").select("sheet_id", "row", "col", F.lit(1).alias("attr_gid")).distinct()
    pairs = attach.corner(_grid(spark, d).withColumn("data_gid", F.lit(1)), heads, BY)
    return pairs.groupBy("sheet_id", "direction").agg(F.count("*").alias("pairs"), F.round(F.min("dist"), 9).alias("dist"))


def _untyped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").select("sheet_id", "row", "col", "value", F.lit("character").alias("data_type"))


def _analysis(spark: SparkSession, d: str) -> structure.Analysis:
    return structure.analyze(Workspace(spark, "typed").write(typing.classify(_untyped(spark, d).distinct(), BY)), BY)


@query()
def analyze_sheets(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).attr_data_map


@query()
def compose_sheets(spark: SparkSession, d: str) -> DataFrame:
    return compose.composed(_untyped(spark, d), BY, classify=lambda cells: typing.classify(cells.distinct(), BY), as_json=True)


@query("select n_regionkey, n_name, dense_rank() over (partition by n_regionkey order by length(n_name), n_name) as r from nation")
def hierarchical_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_regionkey", "n_name", ranks.hierarchical_rank(["n_regionkey"], [F.length("n_name"), F.col("n_name")]).alias("r"))


@query("""
with g as (select distinct sheet_id, attr_gid from attr_data_map), s as (select *, regexp_replace(attr_gid, '[^0-9_]', '', 'g') as f from g),
k as (select *, list_append(list_transform(string_split(rtrim(f, '_'), '_'), lambda x: coalesce(try_cast(x as bigint), 4611686018427387904)), 4611686018427387904) as key from s)
select sheet_id, attr_gid, case when f = '' then '' else dense_rank() over (partition by sheet_id, f = '' order by key)::varchar end as r from k
""")
def natural_rank(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "attr_data_map").select("sheet_id", "attr_gid").distinct()
    return names.select("sheet_id", "attr_gid", ranks.natural_rank(F.col("attr_gid"), BY).alias("r"))


@query("select sheet_id, book_id, case when count(*) over (partition by book_id, sheet) > 1 then sheet || '_' || row_number() over (partition by book_id, sheet order by sheet_id) else sheet end as name from sheets")
def unique_sheet_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sheets").select("sheet_id", "book_id", ranks.unique_minimal(F.col("sheet"), ["book_id"], ["sheet_id"]).alias("name"))


@query("select sheet_id, arg_max(value, (n, value)) as mode from (select sheet_id, value, count(*) as n from cells where value is not null group by all) group by sheet_id")
def most_frequent_value(spark: SparkSession, d: str) -> DataFrame:
    return ranks.mode(table(spark, d, "cells"), BY, "value")


_FAR = "case when s_acctbal = floor(s_acctbal) or abs(s_acctbal) > 100 then round(s_acctbal, 0) when abs(s_acctbal) >= 1 then round(s_acctbal, 2) else round(s_acctbal * power(10, greatest(2, -floor(log10(abs(s_acctbal)))))) / power(10, greatest(2, -floor(log10(abs(s_acctbal))))) end"


@query(f"select s_suppkey, {_FAR} as shown from supplier")
def display_rounding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", typing.auto_round(F.col("s_acctbal")).alias("shown"))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem")
def drop_constant_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("x").alias("fixed"), F.when(F.col("l_quantity") > 0, 1).alias("holed"))
    return tidy.drop_constants(lines)


@query("select l_orderkey, l_linenumber, case when l_linenumber > 1 then 1 end as holed from lineitem")
def drop_constant_columns_with_null(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("x").alias("fixed"), F.when(F.col("l_linenumber") > 1, 1).alias("holed"))
    return tidy.drop_constants(lines, ignore_null=False)


@query("select c_custkey as id, c_mktsegment as segment, c_name as customer from customer")
def rename_by_content(spark: SparkSession, d: str) -> DataFrame:
    frame = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("a"), F.col("c_name").alias("b"))
    return tidy.rename_by_content(frame, {"segment": ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]}, {"customer": r"^Customer#\d+$"}, include=["a", "b"])


@query()
def fuzzy_matches(spark: SparkSession, d: str) -> DataFrame:
    towns = table(spark, d, "collated").select("collated_1").distinct()
    return tidy.fuzzy_match(towns, table(spark, d, "canon").filter("slot = 1").select("label"))


@query()
def fuzzy_join_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "collated").select("obs_id", "collated_2")
    return tidy.fuzzy_join(jobs, table(spark, d, "canon").filter("slot = 2").select("canon_id", "label"), by={"collated_2": "label"}, keep_score=True)


@query("""
select distinct name as collated_1, k as collated_2, uncollated_1 from (
  select c_name as name, c_nationkey::varchar as k, c_mktsegment as uncollated_1 from customer union all select c_name, c_nationkey::varchar, null from customer)
""")
def collate_frames(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "customer").select(F.col("c_name").alias("a"), F.col("c_nationkey").alias("b"), F.col("c_mktsegment").alias("c"))
    narrow = table(spark, d, "customer").select(F.col("c_nationkey").alias("p"), F.col("c_name").alias("q"))
    return collate.collate([wide, narrow], threshold=0.5)


@query('select distinct sheet_id, "row", col from cells c where "row" between 2 and 5 and col between 1 and 3 and not exists (select 1 from attr_data_map m where m.sheet_id = c.sheet_id and m."row" = c."row" and m.col = c.col)')
def crop_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "cells").select("sheet_id", "row", "col").distinct()
    return edit.delete(cell_ops.window_of(cells, (2, 5), (1, 3)), table(spark, d, "attr_data_map"), BY)


@query("""
select c.sheet_id, c."row", c.col, case when m.sheet_id is not null then 1.0 else c."PoA" end as poa, case when m.sheet_id is not null then 0.0 else c."PoV" end as pov
from (select distinct sheet_id, "row", col, "PoA", "PoV" from cells) c left join (select distinct sheet_id, "row", col from attr_data_map) m on m.sheet_id = c.sheet_id and m."row" = c."row" and m.col = c.col
""")
def reclassify_headers(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "cells").select("sheet_id", "row", "col", "PoA", "PoV").distinct()
    return edit.reclassify(cells, table(spark, d, "attr_data_map"), BY, 1.0, 0.0).select("sheet_id", "row", "col", F.col("PoA").alias("poa"), F.col("PoV").alias("pov"))
