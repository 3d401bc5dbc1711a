"""What kind of document bytes are, and the chain of readers to try."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes of known formats, in hexadecimal.
SIGNATURES = {"D0CF11E0A1B11AE1": "xls_doc", "504B0304": "xlsx_docx", "25504446": "pdf"}


def signature(content: Column) -> Column:
    """Format by leading bytes, as a column expression."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("unknown")
    for mark, name in SIGNATURES.items():
        out = F.when(head.startswith(mark), name).otherwise(out)
    return out


def is_text(content: bytes) -> bool:
    """Whether bytes are text: valid UTF-8 as far as the first 1000 bytes go; empty is text."""
    head = content[:1000]
    if b"\0" in head:
        return False
    for cut in range(4):  # a character may be cut in two
        try:
            head[: len(head) - cut].decode("utf-8")
            return True
        except UnicodeDecodeError:
            continue
    return False


def kind_of(content: bytes) -> str:
    head = content[:8].hex().upper()
    for mark, name in SIGNATURES.items():
        if head.startswith(mark):
            return name
    return "text" if is_text(content) else "unknown"


Reader = Callable[[bytes], dict[str, list[tuple[int, int, str, str]]]]
#: Readers added at run time, by format: for formats without a parser here (xls, doc, pdf).
PLUGINS: dict[str, Reader] = {}


def register(kind: str, reader: Reader) -> None:
    """Add a reader for ``kind``: from bytes to {sheet: [(row, col, data_type, value)]}."""
    PLUGINS[kind] = reader


def best_extraction(first: list[list[list[str | None]]], second: list[list[list[str | None]]]) -> list[list[list[str | None]]]:
    """Of two extractions of the tables of a document the better: as many tables are compared one by one
    (not degenerate, then fewer empty cells, then smaller area), else the one with more cells wins."""
    area = lambda t: len(t) * max(map(len, t), default=0)
    empty = lambda t: area(t) - sum(v is not None and v != "" for r in t for v in r)
    flat = lambda t: len(t) < 2 or max(map(len, t), default=0) < 2
    if len(first) != len(second):
        return first if sum(map(area, first)) >= sum(map(area, second)) else second
    return [min((a, b), key=lambda t: (flat(t), empty(t), area(t))) for a, b in zip(first, second)]
