"""Parsers from bytes to cells, with the standard library only: delimited text, HTML, OOXML workbooks and documents.

Each returns ``{sheet: [(row, col, data_type, value), …]}``; no header row is ever made up.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

from . import sniff

Sheets = dict[str, list[tuple[int, int, str, str]]]


def _table(rows: list[list[str | None]]) -> list[tuple[int, int, str, str]]:
    return [(i, j, "character", v) for i, row in enumerate(rows, 1) for j, v in enumerate(row, 1) if v is not None and v != ""]


#: Spellings by which single cells of delimited text are typed.
_TYPES = (
    ("numeric", re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")), ("logical", re.compile("true|false|TRUE|FALSE|T|F")),
    ("date", re.compile(r"\d{4}-\d{2}-\d{2}")), ("time", re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?Z?")),
)


def typed(sheets: Sheets) -> Sheets:
    """Cells of text with the type that each one's spelling shows."""
    kind = lambda v: next((name for name, pattern in _TYPES if pattern.fullmatch(v)), "character")
    return {name: [(r, c, kind(v), v) for r, c, _, v in cells] for name, cells in sheets.items()}


def delimited(content: bytes) -> Sheets:
    """Commas or tabs, whichever makes more cells of the first five lines (commas if equal); all cells are character."""
    text = content.decode("utf-8-sig", "replace")
    head = text.splitlines()[:5]
    count = lambda sep: sum(len(r) for r in csv.reader(head, delimiter=sep))
    sep = "\t" if count("\t") > count(",") else ","
    csv.field_size_limit(1 << 30)
    cells = _table([[v.strip() for v in row] for row in csv.reader(io.StringIO(text), delimiter=sep)])
    return {"sheet_1": cells} if cells else {}


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[dict]] = []
        self.open: list[list[dict]] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append({"cells": []})
            self.cell = None
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append({"cells": []})
            a = dict(attrs)
            span = lambda k: int(a[k]) if (a.get(k) or "").strip().isdigit() else 1
            self.cell = {"text": [], "rows": max(1, span("rowspan")), "cols": max(1, span("colspan"))}
            self.open[-1][-1]["cells"].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell["text"].append(data)


def html(content: bytes) -> Sheets:
    """Every table of a page; merged cells fill all the addresses they cover."""
    parser = _Tables()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    out: Sheets = {}
    for k, table in enumerate([*parser.tables, *reversed(parser.open)], 1):
        grid: dict[tuple[int, int], str] = {}
        for i, row in enumerate(table, 1):
            j = 1
            for cell in row["cells"]:
                while (i, j) in grid:
                    j += 1
                text = " ".join("".join(cell["text"]).split())
                for a in range(min(cell["rows"], len(table) - i + 1)):
                    for b in range(min(cell["cols"], 1000)):  # the standard of the format has no wider cells
                        grid[i + a, j + b] = text
                j += cell["cols"]
        cells = [(i, j, "character", v) for (i, j), v in sorted(grid.items()) if v]
        if cells:
            out[f"table_{k}"] = cells
    return out


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


#: Built-in number formats of workbooks that show dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _address(ref: str) -> tuple[int, int]:
    letters, figures = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(figures), col


def serial_date(number: float, base_1904: bool = False) -> tuple[str, str]:
    """A workbook's day number as (format, text): whole numbers are dates, others timestamps."""
    start = datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 30)
    moment = start + timedelta(seconds=round(number * 86400))
    return ("date", f"{moment:%Y-%m-%d}") if float(number).is_integer() else ("time", f"{moment:%Y-%m-%d %H:%M:%S}")


def workbook(content: bytes) -> Sheets:
    """All sheets of an OOXML workbook with typed cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "xl/workbook.xml" not in names:
            raise ValueError("no workbook")
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter() if _name(t.tag) == "t") for si in read("xl/sharedStrings.xml") if _name(si.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in styles.iter() if _name(f.tag) == "numFmt"}
            for group in styles:
                if _name(group.tag) == "cellXfs":
                    for xf in group:
                        i = int(xf.get("numFmtId") or 0)
                        dated.append(i in _DATE_FORMATS or bool(re.search("[ymdhs]", own.get(i, ""), re.I)))
        book = read("xl/workbook.xml")
        old = any(_name(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        targets = {e.get("Id"): e.get("Target") for e in read("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
        out: Sheets = {}
        for k, sheet in enumerate((e for e in book.iter() if _name(e.tag) == "sheet"), 1):
            link = next((v for a, v in sheet.attrib.items() if _name(a) == "id"), None)
            target = targets.get(link, f"worksheets/sheet{k}.xml")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            cells, row, col = [], 0, 0
            for e in read(path).iter():
                if _name(e.tag) == "row":
                    row, col = int(e.get("r") or row + 1), 0
                elif _name(e.tag) == "c":
                    row, col = _address(e.get("r")) if e.get("r") else (row, col + 1)
                    value = next((x.text or "" for x in e if _name(x.tag) == "v"), None)
                    kind = e.get("t") or "n"
                    if kind == "inlineStr":
                        value, kind = "".join(t.text or "" for t in e.iter() if _name(t.tag) == "t"), "str"
                    if value is None or value == "":
                        continue
                    if kind == "s":
                        cells.append((row, col, "character", shared[int(value)]))
                    elif kind == "b":
                        cells.append((row, col, "logical", "TRUE" if value == "1" else "FALSE"))
                    elif kind == "n":
                        style = int(e.get("s") or 0)
                        typed = serial_date(float(value), old) if style < len(dated) and dated[style] else ("numeric", re.sub(r"\.0$", "", repr(float(value)) if "E" not in value.upper() and "." in value else value))
                        cells.append((row, col, *typed))
                    elif kind == "d":
                        cells.append((row, col, "date", value))
                    elif kind != "e":
                        cells.append((row, col, "character", value))
            cells = [c for c in cells if c[3] != ""]
            if cells:
                out[sheet.get("name") or f"sheet_{k}"] = cells
        return out


def document(content: bytes) -> Sheets:
    """All tables of an OOXML text document; cells merged across columns fill them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out: Sheets = {}
    for k, table in enumerate((e for e in body.iter() if _name(e.tag) == "tbl"), 1):
        cells = []
        for i, row in enumerate((e for e in table if _name(e.tag) == "tr"), 1):
            j = 1
            for cell in (e for e in row if _name(e.tag) == "tc"):
                span = next((int(v) for e in cell.iter() if _name(e.tag) == "gridSpan" for a, v in e.attrib.items() if _name(a) == "val"), 1)
                parts = ["".join(t.text or "" for t in p.iter() if _name(t.tag) == "t") for p in cell.iter() if _name(p.tag) == "p"]
                text = " ".join(x for x in parts if x).strip()
                cells += [(i, j + b, "character", text) for b in range(span) if text]
                j += span
        if cells:
            out[f"table_{k}"] = cells
    return out


def attempt(content: bytes) -> tuple[Sheets, str | None]:
    """Cells of a document by its bytes, whatever its name says, and why there are none.

    Readers of its kind are tried in turn, then plug-ins; what each of them stumbled over is told.
    """
    chains = {"text": [html, delimited], "xlsx_docx": [workbook, document], "xls_doc": [], "pdf": [], "unknown": []}
    kind = sniff.kind_of(content)
    readers = [*chains[kind], *([sniff.PLUGINS[kind]] if kind in sniff.PLUGINS else [])]
    if not readers:
        return {}, f"no reader for {kind}"
    reasons = []
    for reader in readers:
        try:
            found = reader(content)
        except Exception as e:  # the next reader may do
            reasons.append(f"{reader.__name__}: {type(e).__name__}: {e}")
            continue
        if found:
            return found, None
        reasons.append(f"{reader.__name__}: no table found")
    return {}, "; ".join(reasons)


def parse(content: bytes) -> Sheets:
    """Cells of a document, none where nothing can read it."""
    return attempt(content)[0]
