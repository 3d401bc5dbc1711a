"""Each operator against brute force, a round trip or known cases, with the odd inputs its docstring names."""

import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.llm import canonical, frequency, groups, language, leakage, lookalike, queries, tokenizer

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_noise(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(random.randrange(1000, 1060), random.randrange(1000, 1060)) for _ in range(40)]
    edges = [(u, v) for u, v in edges if u != v]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    assert {r.vertex: r.component for r in groups.components(groups._edges(df)).collect()} == union_find(edges)
    assert groups.components(groups._edges(df.filter("false"))).collect() == []


def test_groups_of_cells(spark):
    cells = spark.createDataFrame(
        [(1, 7, 1, 1, "g", "x"), (2, 7, 1, 2, "g", "x"), (2, 7, 1, 2, "g", "x"), (3, 8, 1, 1, "g", "x"), (4, 8, 1, 2, None, "x"), (5, 8, 9, 9, None, "x"), (6, 8, None, 3, "h", "x"), (7, 8, 4, 4, "h", "x"), (None, 8, 5, 5, "h", "x")],
        "cell_id long, sheet_id long, row int, col int, gid string, score string",
    )
    links = spark.createDataFrame(
        [(7, 1, 2, 8, 1, 1), (8, 1, 1, 7, 1, 2), (8, 1, 2, 8, 1, 2), (8, 9, 9, 8, 99, 9), (8, 9, 9, None, 1, 1)],
        "sheet_a long, row_a int, col_a int, sheet_b long, row_b int, col_b int",
    )
    got = {r.cell_id: r.group_id for r in groups.cell_groups(cells, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6}


RECORDS = "cell_id long, sheet_id long, data_type string, value string, loaded_at timestamp, cells int"


def test_counts_follow_signed_deltas(spark, tmp_path):
    first = [(1, 1, "n", "5", T1, 0), (1, 1, "n", "5", T2, 0), (2, 1, "n", "5", T1, 0), (3, 2, "n", "5", T1, 0), (4, 2, None, "x", T1, 0), (5, 2, "n", " ", T1, 0), (6, 2, "n", None, T1, 0), (None, 1, "n", "q", T1, 0), (7, None, "n", "z", T1, 0)]
    latest = frequency.latest_records(spark.createDataFrame(first, RECORDS))
    store = frequency.TermCounts(spark, str(tmp_path / "s"), buckets=4).merge(frequency.signed_deltas(after=latest))
    counts = lambda: {(r.data_type, r.value): (r.cells, r.sheets) for r in store.frequencies().collect()}
    assert counts() == {("n", "5"): (3, 2), (None, "x"): (1, 1), ("n", "z"): (1, 0)}
    # cell 3 changes its value, cell 4 goes, cell 8 comes
    before = latest.filter("cell_id in (3, 4)")
    after = spark.createDataFrame([(3, 2, "n", "6", T2, 0), (8, 3, "n", "5", T2, 0)], RECORDS)
    store.merge(frequency.signed_deltas(after=after, before=before))
    assert counts() == {("n", "5"): (3, 2), ("n", "6"): (1, 1), ("n", "z"): (1, 0)}
    assert {(r.value, r.mark) for r in frequency.marks(store.frequencies(), 15).collect()} == {("5", "common"), ("6", "rare"), ("z", "rare")}
    assert frequency.TermCounts(spark, str(tmp_path / "e")).merge(frequency.signed_deltas(after=latest.filter("false"))).frequencies().collect() == []


def test_counts_outlive_the_object(spark, tmp_path):
    records = lambda *rows: spark.createDataFrame([(*r, T1, 0) for r in rows], RECORDS)
    opened = lambda: frequency.TermCounts(spark, str(tmp_path / "s"))
    counts = lambda store: {(r.data_type, r.value): (r.cells, r.sheets) for r in store.frequencies().collect()}
    first = records(*[(i, i % 3, "n", str(i % 40)) for i in range(120)])
    frequency.TermCounts(spark, str(tmp_path / "s"), buckets=4).merge(frequency.signed_deltas(after=first))
    expected = {("n", str(v)): (3, 3) for v in range(40)}
    assert counts(opened()) == expected
    opened().merge(frequency.signed_deltas(after=records((200, 7, "n", "5")), before=records((6, 0, "n", "6"))))
    expected |= {("n", "5"): (4, 4), ("n", "6"): (2, 2)}
    store, late = opened(), opened()
    assert (counts(store), store.buckets, store.manifest.n) == (expected, 4, 2)
    (tmp_path / "s" / "v3-aborted").mkdir()  # a merge that never ended
    store.merge(frequency.signed_deltas(after=records((201, 8, "n", "new"))))
    with pytest.raises(RuntimeError, match="another writer"):
        late.merge(frequency.signed_deltas(after=records((202, 8, "n", "lost"))))
    assert counts(opened()) == expected | {("n", "new"): (1, 1)}


def test_batches_with_before_images(spark, tmp_path):
    random.seed(11)
    T3 = datetime(2025, 5, 1)
    rows = [(random.randrange(40), random.randrange(4), random.choice("ab"), random.choice(["5", "6", " ", None]), random.choice([T1, T2, T3, None]), 0) for _ in range(300)]
    rows += [(99, 1, "a", "5", t, 0) for t in (T1, T2, T3)] + [(None, 1, "a", "5", T1, 0)]
    cells = spark.createDataFrame(rows, RECORDS)
    batch = F.date_format("loaded_at", "yyyyMM")
    counts = lambda store: sorted(map(tuple, store.frequencies().collect()), key=str)
    whole = frequency.TermCounts(spark, str(tmp_path / "w")).merge(frequency.signed_deltas(after=frequency.latest_records(cells)))
    every = frequency.changes(cells, batch)
    assert every.filter("sign < 0").count() > 0
    assert counts(frequency.TermCounts(spark, str(tmp_path / "a"), buckets=3).catch_up(every)) == counts(whole)
    opened = lambda: frequency.TermCounts(spark, str(tmp_path / "b"), buckets=3, max_runs=2)
    for name in sorted(r[0] for r in every.select("_batch").distinct().collect()):  # one after another, each sent twice
        part = every.filter(F.col("_batch") == name)
        opened().catch_up(part)
        opened().catch_up(part)
    assert counts(opened()) == counts(whole)
    assert max(map(len, opened().runs.values())) <= 2
    opened().vacuum()
    assert counts(opened()) == counts(whole)
    assert opened().merge(frequency.signed_deltas(after=cells), batch="202501x").manifest.n == opened().merge(frequency.signed_deltas(after=cells), batch="202501x").manifest.n


def test_look_alikes(spark):
    terms = spark.createDataFrame([(1, "Côte nord"), (2, "Cote nord"), (3, "Floor area m²"), (4, "Floor area m2"), (5, "Self-supply ratio"), (6, "ガス ポンプ"), (7, "Resistance in Ω"), (8, "office"), (9, None)], "term_id int, label string")
    same = {"Côte nord": 1, "﻿Соte nоrd ": 2, "Ｆｌｏｏｒ area m²": 3, "Floor area m２": 4, "Self‐supply rat⁠io": 5, "ｶﾞｽ ﾎﾟﾝﾌﾟ": 6, "Resistance in \u2126": 7, "oﬃce": 8, " office ": 8}
    other = ["côte nord", "Self–supply ratio", "Self supply ratio", "OFFICE", "Côte nord", "", None, "​", "office office", "x" * 10000]
    values = spark.createDataFrame([(i, v, "a") for i, v in enumerate([*same, *other])] + [(0, next(iter(same)), "a")], "cell_id long, value string, label string")
    got = {(r.cell_id, r.term_id) for r in lookalike.same_look(values, terms).collect()}
    assert got == {(i, t) for i, t in enumerate(same.values())}


def test_forms_agree_with_equal_looks():
    made = lookalike.Forms(["Rural tax receipts", "Расход воды"])
    random.seed(5)
    for text in ("Rural tax receipts", "Расход воды", "XOPA", "Côte"):
        form = made.form(text)
        for _ in range(30):
            mixed = "".join(random.choice(lookalike._ALIKE.get(ch, ch)) + random.choice(["", "", "​"]) for ch in text)
            assert made.form(mixed) == form
    assert made.form("Rural tax receipts") != made.form("rural tax receipts")


def test_letters_of_the_public_table(spark):
    letters = lookalike.public_letters(spark)
    assert len(letters) > 70 and {"\u0585": "o", "\u0261": "g", "\u0251": "a", "\u13aa": "A", "\u13df": "C", "\ua4d0": "B"}.items() <= letters.items()
    assert not {"\u0131", "\u03b1", "\u03b3", "\u0433", "\u03c3"} & set(letters)
    made = lookalike.Forms(["Rural tax receipts", "Gross cereal output"], letters)
    missed = [ch for ch, base in letters.items() for word in ("Rural {}", "x{}y") if made.form(word.format(ch)) != made.form(word.format(base))]
    assert missed == []  # recall on the whole table
    other = [ch for ch in lookalike.UNLIKE for base in "aeiouygrAEIOUYGR" if made.form("x" + ch) == made.form("x" + base)]
    assert other == []
    terms = spark.createDataFrame([(1, "Cargo rate")], "term_id int, label string")
    values = spark.createDataFrame([(1, "\u13df\u0251r\u0261\u0585 rate"), (2, "C\u03b1rgo rate"), (3, "Cargo rate")], "cell_id long, value string")
    assert [tuple(r) for r in lookalike.same_look(values, terms).collect()] == [(1, 1)]


def test_every_label_counts(spark, tmp_path):
    cyrillic = ["«ХОРА»", "«РОСА»", "«ТЕСТ»"]  # each is the only label that tells how its word is written
    latin = ["«XOPA»", "«POCA»", "«TECT»"]
    lots = spark.range(120_000).selectExpr("cast(id as int) term_id", "concat('Lot ', id) label")
    lots.union(spark.createDataFrame(list(enumerate(cyrillic)), "term_id int, label string")).write.parquet(f"{tmp_path}/terms.parquet")
    spark.createDataFrame([(v,) for v in latin + cyrillic], "value string").write.parquet(f"{tmp_path}/cells.parquet")
    made = {r.value: r.form for r in queries.p2_forms(spark, str(tmp_path)).collect()}
    assert made == dict(zip(latin + cyrillic, cyrillic * 2))


def test_counted_pairs_equal_those_of_one_list(spark, monkeypatch):
    labels = ["Rural tax", "Расход воды", "ガス ポンプ", "", "​", "Côte", "x" * 3000, "№-№"] + [f"AB {i}" for i in range(300)]
    terms = spark.createDataFrame([(v,) for v in [*labels, *labels, None]], "label string").repartition(7)
    expected = lookalike.count_pairs(labels)
    assert lookalike.label_counts(terms) == expected and expected["A", "B"] == 300 and expected["B", ""] == 300
    monkeypatch.setattr(lookalike, "MEMO", 1)  # a sum for each Arrow batch
    assert lookalike.label_counts(terms) == expected
    assert lookalike.label_counts(terms.filter("false")) == {}
    whole = expected + Counter((a, b) for v in labels for a, b in zip(f" {v} ", f" {v} "[1:]) if (a, b) not in expected)
    made, all_pairs = lookalike.Forms(labels), lookalike.Forms(counts=whole)
    random.seed(6)
    for _ in range(2000):  # pairs left out change no form
        text = "".join(random.choice("Rural tAxРасходводыガス ポ-XOPAХОРАΧΟΡΑ") for _ in range(random.randrange(30)))
        assert made.form(text) == all_pairs.form(text)


TOWNS = [(1, "Lower Polstovik"), (2, "Upper Polstovik"), (3, "Saint Dunrenholtz"), (4, "Fenmalihavn-on-Wend"), (5, "Halthelhavn")]
JOBS = [(11, "Orchard Signal Clerk"), (12, "Glass Quality Fitter"), (13, "Ferry & Survey Labourer"), (14, "Parcel Packing Coordinator"), (15, "Glass Loading Foreman")]


@pytest.mark.parametrize("value,expected", [
    ("L. Polstovik", 1), ("Upr Polstvoik", 2), ("1182 St. Dunrenholtz,", 3), ("near Fenmalihavn/Wend", 4), ("fENMALIHAVN o. wEND", 4), ("Halthelhvan (town)", 5),
    ("Haltrenstadt", 0), ("Polstovik", 0), ("see remarks", 0), ("?", 0), ("99", 0), ("x" * 3000, 0),
])
def test_towns(value, expected):
    assert canonical.SlotMatcher(TOWNS).match(value) == expected


@pytest.mark.parametrize("value,expected", [
    ("the old part of the town in the north Halthelhvan", 5), ("near the centre of the town in the county of Upr Polstvoik", 2),
    ("we moved there with all our goods and both dogs, see note below: Halthelhvan, as was said", 5), ("word " * 5000 + "Halthelhvan", 5),
    ("F e n m a l i h a v n o n W e n t", 4), ("word " * 20, 0), ("near the centre of the town in the county of Polstovik", 0),
])
def test_towns_in_long_entries(value, expected):
    assert canonical.SlotMatcher(TOWNS).match(value) == expected


@pytest.mark.parametrize("value,expected", [
    ("Clerk, Orchard Signal", 11), ("Orchard Clerk", 11), ("senior glass qualtiy fitter", 12), ("Qual. Fitter", 12), ("FSL", 13), ("Ferry and Survey Lab.", 13), ("Parcel-Packing", 14),
    ("ParcelPacking Coord.", 14), ("Fitter (Glass / Quality)", 12), ("Glass Signal Foreman", 0), ("Glass", 0), ("yoga coach", 0),
])
def test_jobs(value, expected):
    assert canonical.SlotMatcher(JOBS).match(value) == expected


def test_unrelated_entries_change_nothing():
    few, many = canonical.SlotMatcher(JOBS), canonical.SlotMatcher(JOBS + [(50 + i, x) for i, x in enumerate(["Wonk", "Zyx", "Quaver Hill", "Umbo", "Vexil", "Hwyl", "Jynx Moor"])])
    for value in ("Clerk, Orchard Signal", "Qual. Fitter", "FSL", "word " * 30 + "senior glass qualtiy fitter"):
        assert few.match(value) == many.match(value) != 0
    towns = canonical.SlotMatcher(TOWNS + JOBS)
    assert towns.match("Upr Polstvoik") == 2 and towns.match("Qual. Fitter") == 12 and towns.match("see remarks") == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 4))
def test_distance_equals_the_table_of_distances(a, b, most):
    table = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            table[i, j] = max(i, j) if not i or not j else min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 < j and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
    far = table[len(a), len(b)]
    assert canonical.distance(a, b, most) == min(far, most + 1)
    assert far > most or b in canonical.Near([b]).candidates(a, most)  # no near text is left out


def test_mapped_rows(spark, monkeypatch):
    canon = spark.createDataFrame([(1, i, v) for i, v in TOWNS] + [(2, i, v) for i, v in JOBS] + [(2, None, "x"), (None, 7, "y")], "slot int, canon_id int, label string")
    obs = spark.createDataFrame([(1, "Lower Polstovik", "FSL", 5), (2, None, " ", 5), (3, "Orchard Signal Clerk", "", 5), (3, "Orchard Signal Clerk", "", 5)], "obs_id long, a string, b string, canon_id int")
    got = sorted(map(tuple, canonical.mapped(obs, canon, {1: "a", 2: "b"}).collect()))
    assert got == [(1, 2, 13), (3, 1, 0), (3, 1, 0)]
    assert canonical.mapped(obs.filter("false"), canon, {1: "a"}).collect() == []
    assert [r.canon_id for r in canonical.mapped(obs, canon.filter("false"), {1: "a"}).collect()] == [0, 0, 0]
    monkeypatch.setattr(canonical, "LIST_CHARS", 10)
    with pytest.raises(ValueError, match="fits no task"):
        canonical.mapped(obs, canon, {1: "a"})


TEXTS = ["", " ", "a  b", " lead", "trail ", "it's\n\n x", "　x \u0085 y", "<|endoftext|> ok", "日本語のテキスト、です。", "x" * 5000, "naïve — €5", "\x1c a \x1d", "tab\there ", "1 234,5 km²"]


def test_tokens_against_public_libraries_and_back(spark):
    import base64
    from pathlib import Path

    import tiktoken
    from tokenizers import Tokenizer

    folder = Path(tokenizer.VOCABULARIES)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (folder / "byte_bpe_50k.tiktoken").read_bytes().splitlines())}
    own = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = Tokenizer.from_file(str(folder / "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    bpe = tokenizer.ByteBPE((folder / "byte_bpe_50k.json").read_text())
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("ab 'st\n\té語1.,") for _ in range(60)) for _ in range(200)]
    for text in texts:
        ids = bpe.encode(text)
        assert ids == own.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids) == text
    df = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "a b", "n")], "doc_id long, text string, ids string")
    assert {r.doc_id: r.ids for r in tokenizer.encode(df).collect()} == {1: None, 2: [], 3: bpe.encode("a b")}


def test_alignment_scores():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 2, 0, 3, 4, 9])
    assert [int(x[0]) for x in leakage.align_many([a], [b])] == [7, 2]
    many = leakage.align_many([a, a[:2]], [b, np.array([2, 1])])
    assert many[0].tolist() == [7, 2] and many[1].tolist() == [2, 1]


ITEM = "Before the coal strike, Korvale the weaver misplaced 594 ancient teacups in the orchard near the old village school."


def test_leaks(spark):
    w = ITEM.split()
    docs = {
        1: "intro " + ITEM + " outro", 2: ITEM.upper(), 3: "x " + " ".join(w[:12]) + " y", 4: " ".join(w[:11]) + " y", 5: ITEM.replace("weaver", "wea-\nver"), 6: ITEM.replace("ancient", "<b>áncient</b> [0123]"),
        7: " filler ".join(" ".join(w[i : i + 11]) for i in range(0, len(w), 11)), 8: None, 9: "", 10: "\t".join(w[3:16]), 11: "word " * 20000 + ITEM,
    }
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()] + [(1, docs[1], 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, "too short to count"), (3, None), (4, " ".join(["the"] * 30))], "item_id int, text string")
    assert {tuple(r) for r in leakage.leaks(df, items).collect()} == {(i, 1) for i in (1, 2, 3, 5, 6, 10, 11)}
    near = {r.doc_id for r in leakage.alignments(df, items, least=18).collect()}
    assert 7 in near  # an edited copy is scored though it is no leak
    assert leakage.leaks(df.filter("false"), items).collect() == []
    assert leakage.leaks(df, items.filter("false")).collect() == []


def test_several_texts_of_one_item(spark):
    other = "the a of in to and is it that was for on are as with his they at be this have from or one"
    w = ITEM.split()
    docs = spark.createDataFrame([(1, "x " + " ".join(w[2:14]) + " y"), (2, other), (3, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (1, other), (1, ITEM + " and more words here")], "item_id int, text string")
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == {(1, 1), (2, 1), (3, 1)}
    # the score and the longest run of each pair against a plain search of the whole text
    words = {r.doc_id: leakage.words(r.text) for r in docs.collect()}
    for r in leakage.alignments(docs, items).collect():
        runs = [n for t in items.collect() for a in [leakage.words(t.text)] for n in range(1, len(a) + 1) for i in range(len(a) - n + 1) if f" {' '.join(a[i:i + n])} " in f" {' '.join(words[r.doc_id])} "]
        assert r.longest == max(runs) and r.score >= 2 * r.longest


def test_every_block_of_items_is_searched(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    items = spark.createDataFrame([(1, ITEM), (2, " ".join(reversed(ITEM.split())))], "item_id int, text string")
    docs = spark.createDataFrame([(1, ITEM), (2, " ".join(reversed(ITEM.split())))], "doc_id long, text string")
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == {(1, 1), (2, 2)}


EN = "The temperature of the pump is kept below the limit while the switch is moving and the unit is on."
DE = "Die Temperatur der Pumpe wird unter der Grenze gehalten, wenn sich der Schalter bewegt und das Gerät an ist."
FR = "La température de la pompe est maintenue sous la limite lorsque le commutateur se déplace avec les autres."
RU = "Температура насоса поддерживается ниже предела."
ZH = "当电缆运动时，齿轮的温度保持在99以下。"
JA = "各サイクルの後、冷却路は最初の位置に戻り、清掃される。"


def test_languages(spark):
    rows = [(1, "en", EN), (2, "de", EN), (3, None, DE), (4, "fr_XK", FR), (5, "EN-XA", EN + "\n\n" + EN + "\n\n" + DE), (6, "ru", RU), (7, "", ZH), (8, "und", JA), (9, "en", None), (10, "en", " \n "), (11, "xx", "123 45"), (12, "en", EN + " la batería " + EN), (13, "en", EN * 400)]
    df = spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, lang string, text string, seg_no string")
    got = {(r.doc_id, r.seg_no, r.lang) for r in language.corrections(language.languages(df)).collect()}
    assert got == {(2, 0, "en"), (3, 0, "de"), (5, 1, "en"), (5, 2, "en"), (5, 3, "de"), (7, 0, "zh"), (8, 0, "ja")}
    assert all(0 < r.confidence <= 1 if r.lang != "und" else r.doc_id == 11 and r.confidence == 0 for r in language.languages(df).collect())
    assert language.languages(df.filter("false")).collect() == []


KO, EL, AR = "펌프의 온도는 한계 이하로 유지된다.", "Η θερμοκρασία της αντλίας διατηρείται κάτω από το όριο.", "تبقى درجة حرارة المضخة تحت الحد"
UK = "Температура насоса підтримується нижче межі, якщо її вимикач рухається і пристрій увімкнено."
IT = "La temperatura della pompa viene mantenuta sotto il limite mentre il commutatore si muove e gli altri dispositivi sono accesi."


def test_other_languages(spark):
    rows = [(1, "en", KO), (2, "el", EL), (3, None, AR), (4, None, UK), (5, None, IT), (6, "en", "12 345"), (7, "en", EN), (8, "de", EN + "\n\n" + AR)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {(r.doc_id, r.seg_no): (r.lang, r.confidence) for r in language.languages(df).collect()}
    assert {k: v[0] for k, v in got.items() if k[0] not in (4, 5)} == {(1, 0): "ko", (2, 0): "el", (3, 0): "und", (6, 0): "und", (7, 0): "en", (8, 0): "en"}
    assert got[4, 0][0] != "ru" or got[4, 0][1] < 0.6
    assert got[3, 0][1] == got[6, 0][1] == 0 and got[5, 0][1] < got[7, 0][1]
    assert {(r.doc_id, r.lang) for r in language.corrections(language.languages(df)).collect()} == {(1, "ko"), (4, got[4, 0][0]), (5, got[5, 0][0]), (8, "en")} - {(4, "und"), (5, "und")}
    # a language is fitted where labels name it
    more = [(100 + i, "it", IT + f" parola{i}") for i in range(40)] + [(200 + i, "uk", UK) for i in range(40)] + [(300 + i, "ru", RU + " Когда пределы и насос были там, он не мог.") for i in range(40)]
    big = df.unionByName(spark.createDataFrame(more, df.schema))
    assert {r.lang for r in language.languages(big).filter("doc_id = 5 or doc_id between 100 and 150").collect()} == {"it"}
    assert {(r.doc_id // 100, r.lang) for r in language.languages(big).filter("doc_id = 4 or doc_id >= 200").collect()} == {(0, "uk"), (2, "uk"), (3, "ru")}
    hand = spark.createDataFrame([(100, "it"), (101, "it")], "doc_id long, lang string")
    few = df.unionByName(spark.createDataFrame([(100, None, IT), (101, "en", IT)], df.schema))
    assert {r.lang for r in language.languages(few, hand).filter("doc_id = 5 or doc_id > 99").collect()} == {"it"}


def test_trellis_equals_exhaustive_search():
    import itertools

    rng = np.random.default_rng(0)
    scores = rng.normal(size=(4, 5, 3)).astype(np.float32) * 4
    path = language.trellis(scores, np.full(4, 5), switch=3.0)
    cost = lambda s, p: sum(s[t, x] for t, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
    for s, p in zip(scores, path):
        best = max(itertools.product(range(3), repeat=5), key=lambda q: cost(s, q))
        assert cost(s, tuple(p)) == pytest.approx(cost(s, best), abs=1e-4)
