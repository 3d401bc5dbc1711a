from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cellweave.operators import widen

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def one(spark, kind, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", widen.parse_as(F.lit(kind), F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_numbers(spark):
    good = {"12": 12000, "-4.5": -4500, "(1,234.5)": -1234500, "3.7-": -3700, "−" + "18": -18000, " +1.007 ": 1007, "2 338.093": 2338093,
            "1'000": 1000000, "1.9E+1": 19000, "-1.1e1": -11000, ".5": 500, "2 338.0": 2338000, "-0": 0}
    assert one(spark, "numeric", list(good)) == list(good.values())
    bad = ["5-7", "12.5.7", "1O5", "#REF!", "-", "?", "n/a", "1,23", "", None, "see note 3", "1e", "(5"]
    assert one(spark, "numeric", bad) == [None] * len(bad)


def test_dates(spark):
    day = lambda y, m, d: (date(y, m, d) - date(1970, 1, 1)).days
    good = {"2013-12-06": day(2013, 12, 6), "30/09/2020": day(2020, 9, 30), "2017/10/24": day(2017, 10, 24), "05.07.2023": day(2023, 7, 5), "20181014": day(2018, 10, 14),
            "20 Feb 2019": day(2019, 2, 20), "16-MAR-2014": day(2014, 3, 16), "October 6, 2013": day(2013, 10, 6), "2018-10-01 00:00:00": day(2018, 10, 1), "1/2/1969": day(1969, 2, 1)}
    assert one(spark, "date", list(good)) == list(good.values())
    bad = ["2023-13-05", "30.02.2021", "31 Feb 2023", "2022-00-10", "Q3", "tbc", "week 7", "2019", "", None, "1/2-2003"]
    assert one(spark, "date", bad) == [None] * len(bad)


def test_truth_values(spark):
    assert one(spark, "logical", ["TRUE", "yes", "t", "Y", "1", "False", "no", "N", "f", "0", "2", "maybe", "yes/no", "", None]) == [1] * 5 + [0] * 5 + [None] * 5


def tables(spark, cells):
    c = spark.createDataFrame(cells, "sheet_id long, row int, col int, value string, loaded_at timestamp, kind string, s string")
    heads = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 1, None), (2, 1, 1)], "sheet_id long, row int, col int")
    sheets = spark.createDataFrame([(1, "register"), (2, "notes"), (None, "register")], "sheet_id long, layout string")
    fields = spark.createDataFrame([("net weight", "numeric"), ("is active", "logical"), ("note", "character")], "field string, data_type string")
    return c, heads, sheets, fields


CELLS = [
    (1, 1, 1, "Net_Weight", T1, "x", "x"), (1, 1, 2, "IS-ACTIVE", T1, "x", "x"), (1, 1, 3, "misc", T1, "x", "x"),
    (1, 2, 1, "5", T1, "x", "x"), (1, 2, 1, "7", T2, "x", "x"), (1, 2, 1, "7", T2, "x", "x"), (1, 2, 2, "yes", T1, "x", "x"), (1, 2, 3, "9", T1, "x", "x"),
    (1, 3, 1, "8", T1, "x", "x"), (1, 3, 1, "tbc", T2, "x", "x"), (1, 4, 1, None, T1, "x", "x"), (1, 4, 1, " ", T1, "x", "x"), (None, 5, 1, "1", T1, "x", "x"),
    (2, 2, 1, "3", T1, "x", "x"), (1, 6, 1, "4" * 25, None, "x", "x"),
]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_found(spark, limit, monkeypatch):
    monkeypatch.setattr(widen, "BROADCAST_BYTES", limit)
    c, heads, sheets, fields = tables(spark, CELLS)
    schema = widen.field_schema(fields)
    wide = widen.to_deltas(widen.register_entries(c, heads, sheets, fields), schema)
    got = {tuple(r) for r in widen.to_long(wide, schema).collect()}
    # the latest version wins, an invalid later one hides the valid one, overflow is no number
    assert got == {(1, 2, "net weight", 7000), (1, 2, "is active", 1)}
    assert [r.net_weight for r in widen.typed(wide, schema).orderBy("row").collect()] == [7, None, None]


def test_runs_compact_in_any_order(spark):
    schema = [("net weight", "numeric")]
    entry = lambda v, t: spark.createDataFrame([(1, 2, "net weight", "numeric", v, t)], "sheet_id long, row int, field string, kind string, value string, version timestamp")
    a, b = (widen.to_deltas(entry(v, t), schema) for v, t in (("1", T1), ("2", T2)))
    for runs in ([a, b], [b, a], [b, a, a]):
        assert widen.to_long(widen.compact(runs, schema), schema).collect()[0].val == 2000


def test_empty(spark):
    c, heads, sheets, fields = tables(spark, CELLS)
    empty = c.filter("false")
    schema = widen.field_schema(fields)
    assert widen.to_long(widen.to_deltas(widen.register_entries(empty, heads, sheets, fields), schema), schema).collect() == []
    assert widen.register_entries(c, heads, sheets, fields.filter("false")).collect() == []


def test_store_of_runs(spark, tmp_path):
    schema = [("net weight", "numeric"), ("note", "character")]
    kind = "sheet_id long, row int, field string, kind string, value string, version timestamp, _batch string, junk string"
    batch = lambda *rows: spark.createDataFrame([(1, r, "note" if k == "character" else "net weight", k, v, t, b, "x") for r, k, v, t, b in rows], kind)
    opened = lambda: widen.WideStore(spark, str(tmp_path / "w"), schema, fanout=3)
    rows = lambda: {(r.row, r.net_weight, r.note) for r in widen.typed(opened().latest(), schema).collect()}
    assert rows() == set()
    opened().upsert(batch((2, "numeric", "1", T1, "a"), (2, "numeric", "2", T2, "b"), (3, "character", " x ", None, "a")))
    assert rows() == {(2, 2, None), (3, None, "x")}
    opened().upsert(batch((2, "numeric", "9", T2, "a")))  # a batch that is there already
    assert rows() == {(2, 2, None), (3, None, "x")}
    gone = spark.createDataFrame([(1, 3, "note", T2, "c")], "sheet_id long, row int, field string, version timestamp, _batch string")
    opened().upsert(batch((4, "numeric", "5", T1, "c")), deletes=gone)
    store = opened()
    assert [len(x) for x in store.manifest.body["levels"]] == [0, 1]  # three runs became one of the next level
    assert rows() == {(2, 2, None), (3, None, None), (4, 5, None)}
    assert len(store.vacuum()) > 0 and rows() == {(2, 2, None), (3, None, None), (4, 5, None)}
    late, now = opened(), opened().upsert(batch((4, "numeric", "6", T2, "d")))
    with pytest.raises(RuntimeError, match="another writer"):
        late.upsert(batch((4, "numeric", "7", T2, "e")))
    assert now.latest().count() == 3


def test_shared_folder(spark):
    from cellweave import store

    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        store.shared_dir(Session)
    work = store.Workspace(spark, "t")
    kept = work.write(spark.range(3))
    assert work.bytes(kept) > 0
    store.clean(spark)
    assert store.names_in(spark, work.root) == []


def test_entry_is_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
