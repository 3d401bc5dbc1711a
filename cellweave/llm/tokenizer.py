"""Encoding of texts with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern and each part is merged with a priority queue of merge ranks over
a doubly linked list of symbols; entries whose pair has changed meanwhile are skipped when they surface.
Decoding concatenates the vocabulary strings.

Texts are encoded where they lie: one map over Arrow batches, no shuffle.  A blank between two visible
characters always begins a new part, so a text is first cut there and the cuts are looked up in a bounded
memo; only new cuts are split by the pattern, only new parts are merged.

Defined results: null gives null, the empty text an empty list; special tokens in a text are ordinary text;
the vocabulary file is a parameter and of fixed size, the driver reads and broadcasts it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the public vocabulary files.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries a worker's memo holds before it starts anew, and characters up to which a cut is kept in it.
MEMO, MEMO_CHARS = 200_000, 48


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary in its JSON form."""

    def __init__(self, text: str):
        import regex

        model = json.loads(text)["model"]
        letters = byte_letters()
        self.split = regex.compile(PATTERN).findall
        self.strings: dict[int, bytes] = {i: bytes(letters[ch] for ch in s) for s, i in model["vocab"].items() if all(ch in letters for ch in s)}
        self.whole = {s: i for i, s in self.strings.items()}
        self.single = [self.whole[bytes([b])] for b in range(256)]
        vocab = model["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.parts: dict[str, bytes] = {}
        self.cuts: dict[str, bytes | None] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one part: lowest merge rank first, leftmost of equals first."""
        symbols = [self.single[b] for b in raw]
        n = len(symbols)
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        queue = [(found[0], i, found[1], a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (found := pairs.get((a, b)))]
        heapify(queue)
        while queue:
            _, i, made, a, b = heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # the pair is gone
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((made, symbols[k])):
                    heappush(queue, (found[0], i, found[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbols[h], made))):
                heappush(queue, (found[0], h, found[1], symbols[h], made))
        return [s for s in symbols if s >= 0]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = array("i", self.merge(part.encode("utf-8", "replace"))).tobytes()
            if len(self.parts) >= MEMO:
                self.parts.clear()
            if len(part) <= MEMO_CHARS:
                self.parts[part] = ids
        return ids

    def _run(self, text: str) -> bytes:
        return b"".join(map(self._part, self.split(text)))

    def _cut(self, cut: str) -> bytes | None:
        """Ids of a blank and ``cut``; None where the cut's ends do not settle by themselves."""
        ids = None if not cut or cut[0].isspace() or cut[-1].isspace() else self._run(" " + cut)
        if len(self.cuts) >= MEMO:
            self.cuts.clear()
        if len(cut) <= MEMO_CHARS:
            self.cuts[cut] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids of ``text`` as native 32-bit integers."""
        first, *rest = text.split(" ")
        known = self.cuts
        ids = [known[c] if c in known else self._cut(c) for c in rest]
        if None in ids or first[-1:].isspace() or (rest and not first):
            return self._uneven([first, *rest])
        return self._run(first) + b"".join(ids)

    def _uneven(self, cuts: list[str]) -> bytes:
        """As ``encode_bytes`` where blanks meet other white space: such cuts are joined before splitting."""
        out, held = [], cuts[0]
        for a, b in zip(cuts, cuts[1:]):
            if a and b and not a[-1].isspace() and not b[0].isspace():
                out.append(self._run(held))
                held = " " + b
            else:
                held += " " + b
        out.append(self._run(held))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def encode(documents: DataFrame, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.json") -> DataFrame:
    """``doc_id, ids`` of every row of ``documents`` (doc_id, text)."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = ByteBPE(shared.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):  # bounds what a slice holds in Python objects
                piece = texts.slice(at, 512)
                made, ends, null = [], [0], []
                for text in piece:
                    value = text.as_py()
                    null.append(value is None)
                    ids = b"" if not value else bpe.encode_bytes(value)
                    made.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(made))])
                offsets = pa.array(ends, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, values, mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), lists], names=["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select("doc_id", "text").mapInArrow(run, schema)
