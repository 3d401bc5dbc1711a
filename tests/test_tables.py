import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.functions import ranks, typing
from cellweave.operators import assignment, attach, blocks, cells, collate, compose, edit, lshape, structure, tidy
from cellweave.options import Options
from cellweave.sources import parsers, sniff

BY = ["doc", "sheet"]


def sheet(spark, rows, name="s", doc="d"):
    data = [(doc, name, i, j, "character", v) for i, row in enumerate(rows, 1) for j, v in enumerate(row, 1) if v is not None]
    return spark.createDataFrame(data, cells.SCHEMA)


def test_probabilities(spark):
    expected = {"Kid Name": ("character", 1, 0), "12": ("numeric", 0.3333, 0.6667), "6": ("numeric", 0.375, 0.625), "1,000": ("numeric", 0.375, 0.625), "1-2": ("character", 0.5833, 0.4167),
                "2019": ("date", 0.6666, 0.3334), "31-03-2023": ("date", 0.8, 0.2), "10:40": ("time", 1, 0), "yes": ("logical", 1, 0), "12%": ("character", 1, 0), "": ("blank", 0, 0)}
    df = spark.createDataFrame([(i, v, "character") for i, v in enumerate(expected)], "sheet int, value string, data_type string")
    for r in typing.classify(df, ["sheet"]).collect():
        kind, poa, pov = expected[r.value]
        assert (r.type, round(r.PoA, 4), round(r.PoV, 4)) == (kind, poa, pov)


def test_null_values_and_priors(spark):
    df = spark.createDataFrame([(1, None, None), (1, "5", "date"), (1, "x", "odd")], "sheet int, value string, data_type string")
    assert [r.type for r in typing.classify(df, ["sheet"], method="simple").orderBy("value").collect()] == ["blank", "date", "character"]


def test_ranks(spark):
    deep = "1_" * 14
    rank = spark.createDataFrame([(deep + "10",), (deep + "9",), ("1_2_",), ("1_2",)], "x string").select("x", ranks.natural_rank(F.col("x"), []).alias("r"))
    assert {r.x: r.r for r in rank.collect()} == {deep + "9": "1", deep + "10": "2", "1_2_": "3", "1_2": "3"}
    names = ["1_4_1", "1_5", "1_4_2", "1_40_1", "1_3", "1_20", "abc"]
    df = spark.createDataFrame([(n,) for n in names], "x string").select("x", ranks.natural_rank(F.col("x"), []).alias("r"))
    assert {r.x: r.r for r in df.collect()} == dict(zip(names, ["2", "4", "3", "6", "1", "5", ""]))
    df = spark.createDataFrame(list(enumerate("abbca")), "i int, x string").select("i", ranks.unique_minimal(F.col("x"), [], ["i"]).alias("u"))
    assert [r.u for r in df.orderBy("i").collect()] == ["a_1", "b_1", "b_2", "c", "a_2"]


@pytest.mark.parametrize("tag,expected", [
    ("v", {2: "2", 5: "5"}), ("vl", {2: "2", 3: "2", 4: "2", 5: "5", 6: "5", 7: "5"}), ("vr", {1: "2", 2: "2", 3: "5", 4: "5", 5: "5"}),
    ("vm", {1: "2", 2: "2", 3: "2", 4: "5", 5: "5", 6: "5", 7: "5"}), ("nothing", {}),
])
def test_attach(spark, tag, expected):
    data = spark.createDataFrame([(1, 2, c) for c in range(1, 8)], "b int, row int, col int")
    heads = spark.createDataFrame([(1, 1, 2, "2"), (1, 1, 5, "5")], "b int, row int, col int, header string")
    assert {r.col: r.header for r in attach.attach(data, heads, ["b"], tag).collect()} == expected


def test_midpoint_goes_to_the_larger_header_and_one_header_reaches_all(spark):
    data = spark.createDataFrame([(1, 2, c) for c in range(1, 6)], "b int, row int, col int")
    heads = spark.createDataFrame([(1, 1, 2, "2"), (1, 1, 4, "4")], "b int, row int, col int, header string")
    assert {r.col: r.header for r in attach.attach(data, heads, ["b"], "vm").collect()}[3] == "4"
    assert attach.attach(data, heads.filter("col = 2"), ["b"], "h").count() == 5
    assert attach.attach(data, heads, ["b"], "direct").count() == 10


@settings(max_examples=5, deadline=None)
@given(st.sets(st.tuples(st.integers(1, 9), st.integers(1, 9)), min_size=1, max_size=50))
def test_components_agree(spark, grid):
    df = spark.createDataFrame([(1, r, c) for r, c in grid], "s int, row int, col int")
    a, b = ({(r.row, r.col): r.gid for r in blocks.components(df, ["s"], method=m).collect()} for m in ("grouped", "iterated"))
    assert a == b
    for (r, c), g in a.items():
        for n in ((r + 1, c), (r, c + 1)):
            assert n not in a or a[n] == g
    assert set(a.values()) == set(range(1, len(set(a.values())) + 1))


def test_linked_edges(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 5, 6)], "s int, a int, b int")
    assert {r.gid: r.target for r in blocks.linked(df, ["s"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_l_opening():
    import numpy as np

    headers = np.array([(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)])
    size, box = lshape.opening((1, 3, 1, 3), headers)
    assert (size, box) == (5, (2, 3, 2, 3))
    assert lshape.opening((1, 1, 1, 2), np.array([(1, 1)])) is None


def test_l_shape_is_found_at_any_size(spark, monkeypatch):
    import random

    random.seed(7)
    d, a = [(0, r, c) for r in range(1, 7) for c in range(1, 7) if (r, c) == (1, 3) or r > 1 < c], [(0, 1, c) for c in (1, 2, 4, 5, 6)] + [(0, r, 1) for r in range(2, 7)]
    for s in range(1, 80):
        h, w, flip_r, flip_c = random.randint(1, 8), random.randint(1, 8), random.random() < 0.5, random.random() < 0.5
        for r in range(h):
            for c in range(w):
                at = (s, h - r if flip_r else r + 1, w - c if flip_c else c + 1)
                edge = r == 0 or c == 0 or random.random() < 0.02
                if random.random() < (0.8 if edge else 0.02):
                    a.append(at)
                elif random.random() < 0.95:
                    d.append(at)
    data, attr = (spark.createDataFrame(x, "s int, row int, col int") for x in (d, a))
    got = []
    for limit in (blocks.SHEET_CELLS, 1, 20):  # all groups in tasks, all by aggregates, some of either
        monkeypatch.setattr(blocks, "SHEET_CELLS", limit)
        got.append([{tuple(r) for r in x.collect()} for x in lshape.impose(data, attr, ["s"])])
    assert got[0] == got[1] == got[2]
    assert (0, 1, 3) not in {x[:3] for x in got[1][0]} and (0, 1, 3) in {x[:3] for x in got[1][1]}
    assert len({x[0] for x in set(d) - {x[:3] for x in got[0][0]}}) > 10


def test_pipeline_on_a_cross_table(spark):
    both = sheet(spark, [["Kid Name", "Weight", "Age"], ["Nakshatra", "12", "1.5"], ["Titas", "16", "6"]]).unionByName(sheet(spark, [["only", "words"]], "t"))
    analysis = structure.analyze(typing.classify(both, BY), BY)
    assert {r.sheet: r.status for r in analysis.status.collect()} == {"s": "ok", "t": "no values"}
    got = {(r.row, r.col): (r.value, r.attr) for r in compose.compose(analysis).collect()}
    assert got[2, 2] == ("12", {"high_long": "Weight", "high_short": "Nakshatra", "low_short_1": "Kid Name"})
    assert got[3, 3] == ("6", {"high_long": "Age", "high_short": "Titas", "low_short_1": "Kid Name"})
    origin = {(r.row, r.col, r.name): (r.row_from, r.col_from) for r in compose.lineage(analysis).collect()}
    assert origin[3, 3, "high_long"] == (1, 3)
    tag = spark.createDataFrame([("d", "s", 1, "ad1_N_1", "vl")], "doc string, sheet string, data_gid int, attr_gid string, tag string")
    assert edit.change_orientation(analysis, tag).attr_data_map.filter("header_orientation_tag = 'vl'").count() == 2
    assert edit.detach(analysis, tag).attr_data_map.filter("attr_gid = 'ad1_N_1'").count() == 0


def test_cells_round_trip_and_checks(spark):
    wide = spark.createDataFrame([(1, "a", True), (2, None, False)], "k int, x string, y boolean")
    c = cells.as_cells(wide, ["k"])
    assert cells.to_matrix(c, BY, 3).orderBy("row").collect()[1][3:] == ("a", "true") or cells.to_matrix(c, BY, 3).filter("row = 2").collect()[0].c2 == "a"
    assert cells.validate(c).count() == 8
    with pytest.raises(ValueError, match="repeated_address 8.*") as e:
        cells.validate(c.unionByName(c).withColumn("row", F.col("row") - 1))
    assert "not_positive" in str(e.value)
    assert cells.detect_adapter(spark.createDataFrame([(1, 1, "double", "2")], "row int, col int, data_type string, value string")) == "melted"


def test_matrix_keeps_every_column(spark, tmp_path):
    from cellweave.plans.cell_queries import QUERIES

    rows = [(1, 1, 1, "a"), (1, 1, 13, "b"), (2, 1, 15, "c"), (2, 2, 2, "d")]
    c = spark.createDataFrame(rows, "sheet_id long, row int, col int, value string")
    c.write.parquet(str(tmp_path / "cells.parquet"))
    assert {tuple(r) for r in QUERIES["cells_to_matrix"](spark, str(tmp_path)).collect()} == set(rows)
    assert cells.to_matrix(c, ["sheet_id"]).columns == ["sheet_id", "row", *[f"c{i}" for i in range(1, 16)]]
    assert cells.to_matrix(c.filter("col < 3"), ["sheet_id"]).columns == ["sheet_id", "row", "c1", "c2"]
    assert cells.to_matrix(c.filter("false"), ["sheet_id"], 2).columns == ["sheet_id", "row", "c1", "c2"]


def test_rows_are_numbered_without_one_task(spark):
    df = spark.range(2000).select(((F.col("id") * 7919) % 2000).alias("k"), F.col("id").cast("string").alias("x"))
    made = cells.as_cells(df, ["k"], include_names=False)
    assert {r.row: r.value for r in made.filter("col = 1").collect()} == {k + 1: str(k) for k in range(2000)}
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
    assert cells.as_cells(df.filter("false"), ["k"]).count() == 2


def test_assignment():
    import numpy as np

    s = np.array([[0.9, 0.8], [0.85, 0.1]])
    assert assignment.optimal(s) == [(0, 1), (1, 0)]
    assert assignment.greedy(s) == [(0, 0), (1, 1)]
    assert assignment.optimal(np.array([[1.0], [2.0], [3.0]])) == [(2, 0)]


def test_tidy(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 5, 1)], "id int, c int, n int")
    assert tidy.drop_constants(df).columns == ["id"]
    assert tidy.drop_constants(df, ignore_null=False).columns == ["id", "n"]
    x = spark.createDataFrame([("Agriculture sector",), ("Mining",), (None,), ("zzz",)], "k string")
    y = spark.createDataFrame([("Agriculture", 1), ("Mining and quarrying", 2), ("Transport", 3), (None, 4)], "name string, w int")
    got = {r.k: r.w for r in tidy.fuzzy_join(x, y, by={"k": "name"}).collect()}
    assert got == {"Agriculture sector": 1, "Mining": 2, None: None, "zzz": None}
    assert {(r.x, r.y) for r in tidy.fuzzy_match(x, y.select("name"), relationship="one_to_one").collect()} == {("Agriculture sector", "Agriculture"), ("Mining", "Mining and quarrying"), ("zzz", None), (None, "Transport")}
    clash = spark.createDataFrame([("Mining", 1, 2)], "x string, y int, score int")
    other = spark.createDataFrame([("Mining & co", 7)], "y string, score int")
    assert tidy.fuzzy_join(clash, other, by={"x": "y"}).collect()[0][:] == ("Mining", 1, 2, "Mining & co", 7)
    assert tidy.fuzzy_join(clash, other, by={"x": "y"}, name_from="x", keep_keys=True).columns == ["x", "y", "score", "score_y", "x_key", "y_key"]
    assert tidy.common_lengths(["abcdef", "", "xyz"], ["zzcdez", "a", "abc"]).tolist() == [3, 0, 0]
    with pytest.raises(ValueError):
        tidy.rename_by_content(df, {"a": ["x"]}, {"a": "x"})


def test_collate(spark):
    assert collate.similarity(["a b"], ["a b"]) == pytest.approx(1)
    assert collate.similarity([], ["a"]) == 0
    a = spark.createDataFrame([("x1", "red", "q"), ("x2", "blue", "q")], "a string, b string, c string")
    b = spark.createDataFrame([("red", "x1"), ("green", "x3")], "p string, q string")
    got = collate.collate([b, a], threshold=0.2)
    assert sorted(got.columns) == ["collated_1", "collated_2", "uncollated_1"]
    assert {(r.collated_1, r.collated_2) for r in got.collect()} == {("x1", "red"), ("x2", "blue"), ("x3", "green")}


def test_blocks_are_collated_by_content(spark, monkeypatch):
    towns, days = ["Aachen", "Bonn", "Celle", "Dorsten"], ["2020-01-02", "2020-03-04", "2021-05-06"]
    rows = []
    for block in range(1, 9):  # the same header names mean different things in every second block
        for i in range(12):
            a, b = towns[i % 4], days[i % 3]
            attr = {"high_long": a, "high_short": b} if block % 2 else {"high_long": b, "high_short": a}
            rows.append(("d", f"s{block % 3}", block, i, 1, str(i), attr | ({"low_1": "only here"} if block == 3 else {}) | ({"low_2": f"x{i}"} if block == 4 else {})))
    rows += [("e", "s", 1, i, 1, str(i), {"high_long": "p", "high_short": f"q{i}", "low_1": "r"}) for i in range(3)] * 2
    rows += [("e", "t", 1, 1, 1, "9", None)]
    df = spark.createDataFrame(rows, "doc string, sheet string, data_gid long, row int, col int, value string, attr map<string,string>")
    got = []
    for size in (64, 3):  # all blocks of a document at once, and in a tree
        monkeypatch.setattr(collate, "FOLD", size)
        found = collate.collate_blocks(df, ["doc"], ["doc", "sheet", "data_gid"], threshold=0.2).collect()
        got.append({(r.doc, r.sheet, r.data_gid, r.value, tuple(sorted((r.attr or {}).items()))) for r in found})
        assert len(found) == len(got[-1]) == 8 * 12 + 3 + 1
    assert got[0] == got[1]
    first = {k: v for r in got[0] if r[0] == "d" for k, v in r[4] if v in towns}
    assert set(first) == {"collated_1"} or set(first) == {"collated_2"}
    keys = {k for r in got[0] if r[0] == "d" for k, _ in r[4]}
    assert keys == {"collated_1", "collated_2", "info_1", "uncollated_1"}
    assert {k for r in got[0] if r[0] == "e" for k, _ in r[4]} == {"high_1", "high_2", "low_1"}
    assert collate.collate_blocks(df, ["doc"], ["doc", "sheet", "data_gid"], keep_duplicates=True).count() == len(rows)
    assert collate.collate_blocks(df.filter("false"), ["doc"], ["doc", "sheet", "data_gid"]).collect() == []


def test_edit_similarity():
    from functools import cache

    def plain(a, b):
        @cache
        def far(i, j):
            return max(i, j) if not i or not j else min(far(i - 1, j) + 1, far(i, j - 1) + 1, far(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

        return 1 - far(len(a), len(b)) / max(len(a), len(b), 1)

    x, y = ["kitten", "", "abc", "łódź"], ["sitting", "abc", "x", "lodz", "kit"]
    assert collate.edit_similarity(x, y) == pytest.approx(sum(plain(a, b) for a in x for b in y) / 20)
    columns = {f"c{i}": ([(k, v) for k, v in enumerate(vs)], False) for i, vs in enumerate([["red", "blue"], ["red", "green"], ["10", "20"], []])}
    assert collate.best_pairs({"a": columns["c0"], "b": columns["c2"]}, {"p": columns["c2"], "q": columns["c1"], "r": columns["c3"]}, 0.0)[0] == ("b", "p")


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="u"><sheets><sheet name="A" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Name</t></si></sst>")
        z.writestr("xl/styles.xml", '<s><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></s>')
        z.writestr("xl/worksheets/s.xml", '<w><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>1.5</v></c><c r="AA2" s="1"><v>44562</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"/></row></w>')
    return out.getvalue()


def test_parsers():
    assert parsers.parse(workbook()) == {"A": [(2, 2, "character", "Name"), (2, 3, "numeric", "1.5"), (2, 27, "date", "2022-01-01"), (2, 4, "logical", "TRUE")]}
    assert parsers.parse(b"a\tb\n1\t2\n")["sheet_1"] == [(1, 1, "character", "a"), (1, 2, "character", "b"), (2, 1, "character", "1"), (2, 2, "character", "2")]
    page = b"<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>a<td>b</tr><tr><td>c</tr></table>"
    assert [(r, c, v) for r, c, _, v in parsers.parse(page)["table_1"]] == [(1, 1, "h"), (1, 2, "h"), (2, 1, "a"), (2, 2, "b"), (3, 1, "a"), (3, 2, "c")]
    assert parsers.parse(b"") == {} and parsers.parse(b"\xff\x00\x01") == {}
    assert sniff.kind_of(b"%PDF-1.7") == "pdf" and sniff.kind_of("é".encode()) == "text"


def test_options(spark):
    spark.conf.set("cellweave.single_block_filter", "true")
    assert Options.of(spark).single_block_filter and not Options.of(spark, single_block_filter=False).single_block_filter
    spark.conf.unset("cellweave.single_block_filter")


@pytest.mark.parametrize("name", ["finalize_through_stages", "pairwise_join_limit"])
def test_options_without_effect_are_refused(spark, name):
    with pytest.raises(TypeError):
        Options(**{name: 0})
    spark.conf.set(f"cellweave.{name}", "false")
    try:
        with pytest.raises(ValueError, match=name):
            Options.of(spark)
    finally:
        spark.conf.unset(f"cellweave.{name}")


def test_stream_equals_batch(spark, tmp_path):
    from cellweave.sources.read import read_documents
    from cellweave.streaming.arrivals import store_arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x,y\n1,2\n")
    (tmp_path / "in" / "b.bin").write_bytes(b"\xff\x00")
    for _ in range(2):  # a restart adds nothing
        store_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.select("doc", "row", "col", "value", "error").collect()), key=str)
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(read_documents(spark, str(tmp_path / "in")))


def test_sheets_in_tasks_and_by_joins_agree(spark):
    import random

    random.seed(21)
    rows = []
    for s in range(40):
        h, w = random.randint(2, 9), random.randint(2, 9)
        for r in range(1, h + 1):
            for c in range(1, w + 1):
                kind = random.random()
                if kind < 0.12:
                    continue
                head = (r in (1, h // 2 + 1) or c == 1) if s % 2 else random.random() < 0.3
                rows.append((s, r, c, "x" if head else "5", 1.0 if head else 0.0, 0.0 if head else 1.0))
    rows += [(100, 1, 1, "x", 1.0, 0.0), (101, 1, 1, "5", 0.0, 1.0), (102, 1, 1, "5", None, None)]
    df = spark.createDataFrame(rows, "s int, row int, col int, value string, PoA double, PoV double")
    for options in (Options(single_block_filter=True, single_block_share=0.5),):
        found = structure.by_sheets(df, ["s"], options, 4).collect()
        got = [{(r.s, r.row, r.col, r.data_gid) for r in found if r.kind == "d"}, {(r.s, r.row, r.col, r.attr_gid) for r in found if r.kind == "a"}, {(r.s, r.data_gid, r.attr_gid) for r in found if r.kind == "l"}]
        large = structure.by_joins(df, ["s"], options)
        for own, other in zip(got, large):
            assert own == {tuple(r) for r in other.collect()}
        heads = {(r.s, r.data_gid, r.header, r.row, r.col, r.header_orientation_tag, r.nice_header_name) for r in found if r.kind == "h"}
        assert len({x[5] for x in heads}) > 5 and heads == {tuple(r) for r in structure.tagged(*large, ["s"], options).collect()}
    assert {r.s: r.status for r in structure.analyze(df, ["s"]).status.filter("s > 99").collect()} == {100: "no values", 101: "no headers", 102: "no values"}


def test_composed_in_tasks_and_by_joins_agree(spark, monkeypatch):
    import random
    from collections import Counter

    random.seed(4)
    rows = []
    for s in range(24):
        h, w = random.randint(3, 9), random.randint(3, 9)
        for r in range(1, h + 1):
            for c in range(1, w + 1):
                head = (r in (1, h // 2 + 1) or c == 1) if s % 2 else random.random() < 0.3
                if random.random() > 0.12:
                    rows.append((s, r, c, f"t{random.randint(0, 99)}" if head else str(random.randint(0, 99)), float(head), float(not head)))
                if random.random() < 0.04:  # an address more than once, without text, without a role
                    rows.append((s, r, c, random.choice(["é", "Z", None]), *random.choice([(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (None, None)])))
    rows += [(None, 1, 1, "x", 1.0, 0.0), (None, 2, 1, "5", 0.0, 1.0), (50, None, 1, "5", 0.0, 1.0), (101, 1, 1, "5", 0.0, 1.0), (102, 1, 1, "x", 1.0, 0.0), (103, 1, 1, "x", 1.0, 0.0), (103, 2, 2, "5", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "s int, row int, col int, value string, PoA double, PoV double")
    key = lambda found: Counter((r.s, r.data_gid, r.row, r.col, r.value, r.attr and tuple(r.attr.items())) for r in found.collect())
    expected = {}
    for options in (Options(), Options(delink_corner_headers=True, derive_nice_names=False)):
        expected[options] = key(compose.compose(structure.analyze(df.filter("row is not null"), ["s"], options)))
        assert len(expected[options]) > 300
    assert any(x[5] is None for rows_of in expected.values() for x in rows_of)  # a cell that no header reaches
    monkeypatch.setattr(compose, "BATCH_ENTRIES", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", "200", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for options, rows_of in expected.items():
                assert key(compose.composed(df, ["s"], options)) == rows_of
        text = lambda found: Counter(map(tuple, found.collect()))
        for options in expected:
            as_map = compose.composed(df.replace({"é": 'é"\\\x01\n\u2028'}), ["s"], options).withColumn("attr", F.to_json("attr"))
            assert text(compose.composed(df.replace({"é": 'é"\\\x01\n\u2028'}), ["s"], options, as_json=True)) == text(as_map)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(blocks, "SHEET_CELLS", 45)  # some sheets by joins
    assert key(compose.composed(df.filter("row is not null"), ["s"])) == expected[Options()]


def test_sheets_are_composed_in_one_shuffle(spark, tmp_path):
    from cellweave.plans import catalogue

    rows = [(1, r, c, "7" if r > 1 < c else f"h{r}{c}") for r in range(1, 5) for c in range(1, 4)]
    spark.createDataFrame(rows, "sheet_id long, row int, col int, value string").write.parquet(str(tmp_path / "cells.parquet"))
    found = catalogue.QUERIES["compose_sheets"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # a plan of 60 shuffles took the driver's memory
    assert {(r.row, r.col): r.attr for r in found.collect()}[3, 2] == '{"high_long":"h31","high_short":"h12","low_short_1":"h11"}'
