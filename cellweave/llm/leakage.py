"""Evaluation texts leaking into training text.

1. One map over the corpus keeps, of each text, the stretches whose words form n-grams of some test item
   (with the words around them), as word numbers of the items' vocabulary.  No shuffle; the rest of the text
   never leaves the task.
2. Document frequencies of these n-grams are counted over the whole corpus; of every ``RUN`` successive words
   of an item the rarest n-gram becomes a seed, so each run that may count holds a seed and none is lost.
3. Seeds join stretches to items: an equi-join on the n-gram, of which the items' side is small by the block
   size; a common n-gram is a seed only where a whole run of an item has nothing rarer.
4. Each candidate pair is scored by Smith-Waterman alignment, which also finds edited or thinned-out copies;
   ``leaks`` keeps pairs that hold ``RUN`` successive words unchanged, ``alignments`` gives all with scores.

Items are the query set: they are taken in blocks of at most ``BLOCK_CHARS`` characters, each run against
the whole corpus, so what is broadcast is bounded however many items there are.

Words are runs of letters and digits after compatibility decomposition and case folding, without accents and
invisible characters; mark-up tags and bracketed paragraph numbers are left out, words divided at a line end
are joined.  Defined results: null or blank texts and items hold nothing; items shorter than ``RUN`` words
are in no document; repeated rows give one row; several texts of one item_id are each searched whole, and the item is
in a document that holds a run of any; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import Workspace

#: Successive words that make a leak.
RUN = 12
#: Words of a seed.
GRAM = 4
#: Characters of items in a block that is broadcast.
BLOCK_CHARS = 32 << 20
#: Alignment scores: equal words, unequal words, a word left out or put in.
MATCH, MISMATCH, GAP = 2, -1, -1

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_NUMBER = re.compile(r"\[\d+\]")
_DIVIDED = re.compile("(?<=\\w)[-\u2010\u00ad][ \\t\\r]*\n\\s*(?=\\w)")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text in the form in which they are compared."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _NUMBER.sub(" ", text)
    if "\n" in text:
        text = _DIVIDED.sub("", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)).casefold()
    return _WORD.findall("".join(ch for ch in text if not unicodedata.combining(ch)))


def grams(numbers: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A 64-bit key of the ``n`` words from each position; 0 where one of them is unknown (number 0)."""
    if len(numbers) < n:
        return np.zeros(0, np.int64)
    key = np.zeros(len(numbers) - n + 1, np.uint64)
    known = np.ones(len(key), bool)
    for k in range(n):
        part = numbers[k : len(key) + k]
        known &= part > 0
        key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.where(known, key, 0).astype(np.int64)


def align_many(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score of each pair of word sequences, and its longest run of equal successive words."""
    def padded(parts: list[np.ndarray], fill: int) -> np.ndarray:
        out = np.full((len(parts), max(map(len, parts), default=0)), fill, np.int32)
        for k, part in enumerate(parts):
            out[k, : len(part)] = part
        return out

    a, b = padded(left, -1), padded(right, -2)
    b[b == 0] = -2  # an unknown word equals none
    shape = (len(left), b.shape[1] + 1)
    slope = GAP * np.arange(shape[1], dtype=np.int32)
    row, run = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    score, longest = np.zeros(len(left), np.int32), np.zeros(len(left), np.int32)
    for t in range(a.shape[1]):
        same = b == a[:, t : t + 1]
        step = np.zeros(shape, np.int32)
        step[:, 1:] = np.maximum(np.maximum(row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(step - slope, axis=1) + slope  # a gap on the right of any length
        now = np.zeros(shape, np.int32)
        now[:, 1:] = (run[:, :-1] + 1) * same
        run = now
        np.maximum(score, row.max(axis=1, initial=0), out=score)
        np.maximum(longest, run.max(axis=1, initial=0), out=longest)
    return score, longest


def _stretches(documents: DataFrame, vocabulary, keys) -> DataFrame:
    """``doc_id, part, numbers``: the stretches of each text around n-grams of the items."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, wanted = vocabulary.value, keys.value
        for batch in batches:
            ids, parts, numbers = [], [], []
            for doc, text in zip(batch.column(0), batch.column(1)):
                value = text.as_py()
                if not value:
                    continue
                found = np.fromiter((known.get(w, 0) for w in words(value)), np.int64)
                key = grams(found)
                at = np.flatnonzero(key)
                if not len(at):
                    continue
                at = at[wanted[np.minimum(np.searchsorted(wanted, key[at]), len(wanted) - 1)] == key[at]]
                if not len(at):
                    continue
                # stretches: hits no more than RUN words apart, with RUN words on either side
                for k, group in enumerate(np.split(at, np.flatnonzero(np.diff(at) > 2 * RUN) + 1)):
                    ids.append(doc.as_py())
                    parts.append(k)
                    numbers.append(found[max(0, group[0] - RUN) : group[-1] + GRAM + RUN].astype(np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(numbers, pa.list_(pa.int32()))], names=["doc_id", "part", "numbers"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, part int, numbers array<int>")


def _keyed(frame: DataFrame, ids: list[str]) -> DataFrame:
    """One row per n-gram of ``numbers``: ``ids``, pos, gram."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = [grams(np.asarray(x.as_py(), np.int64)) for x in batch.column("numbers")]
            kept = [np.flatnonzero(k) for k in keys]
            times = np.array([len(k) for k in kept], np.int64)
            take = pa.array(np.repeat(np.arange(batch.num_rows), times))
            pos = np.concatenate([np.zeros(0, np.int64), *kept]).astype(np.int32)
            gram = np.concatenate([np.zeros(0, np.int64), *[k[at] for k, at in zip(keys, kept)]])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in ids], pa.array(pos), pa.array(gram)], names=[*ids, "pos", "gram"])

    kinds = ", ".join(f"{i} {frame.schema[i].dataType.simpleString()}" for i in ids)
    return frame.select(*ids, "numbers").mapInArrow(run, f"{kinds}, pos int, gram bigint")


def _seeds(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """``gram, item_id``: of every RUN successive words of an item the n-gram in the fewest documents."""
    ahead = Window.partitionBy("item_id", "text_no").orderBy("pos").rowsBetween(0, RUN - GRAM)
    ranked = items.join(frequency, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = F.min(F.struct("df", "gram")).over(ahead)
    return ranked.select("item_id", rarest["gram"].alias("gram")).distinct()


def alignments(documents: DataFrame, items: DataFrame, least: int = MATCH * RUN) -> DataFrame:
    """``doc_id, item_id, score, longest`` of all pairs that share a seed and align with ``least`` or more."""
    spark = documents.sparkSession
    context = spark.sparkContext
    work = Workspace(spark, "leaks")
    kept = items.select("item_id", "text").filter(F.length(F.trim("text")) > 0)
    blocks = 1 + int(kept.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // BLOCK_CHARS
    out = None
    for block in range(blocks):
        part = kept.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if blocks > 1 else kept.collect()
        known: dict[str, int] = {}
        numbered = [(r[0], [known.setdefault(w, len(known) + 1) for w in words(r[1])]) for r in part]
        numbered = [(i, w) for i, w in numbered if len(w) >= RUN]
        if not numbered:
            continue
        keys = np.unique(np.concatenate([grams(np.array(w)) for _, w in numbered]))
        shared, wanted = context.broadcast(known), context.broadcast(keys)
        by_item: dict[int, list[np.ndarray]] = {}
        for item, numbers in numbered:
            by_item.setdefault(item, []).append(np.array(numbers))
        texts = context.broadcast(by_item)
        stretches = work.write(_stretches(documents, shared, wanted))
        # an item_id may have several texts: windows of seeds never run over two of them
        own = spark.createDataFrame([(i, k, w) for k, (i, w) in enumerate(numbered)], f"item_id {items.schema['item_id'].dataType.simpleString()}, text_no int, numbers array<int>")
        in_corpus = _keyed(stretches, ["doc_id", "part"]).select("doc_id", "part", "gram").distinct()
        # distinct pairs first, so that a common n-gram is counted by many tasks
        frequency = in_corpus.select("doc_id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))
        seeds = _seeds(_keyed(own, ["item_id", "text_no"]), frequency)
        pairs = in_corpus.join(seeds, "gram").groupBy("doc_id", "part").agg(F.collect_set("item_id").alias("items"))  # at most one block of items
        # few bytes but much work: spread over all tasks, which adaptive merging of small partitions would undo
        spread = pairs.join(stretches, ["doc_id", "part"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "part")
        scored = spread.select("doc_id", "items", "numbers").mapInArrow(_score(texts, least), f"doc_id bigint, item_id {items.schema['item_id'].dataType.simpleString()}, score int, longest int")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).alias("item_id"), F.lit(0).alias("score"), F.lit(0).alias("longest")).filter("false")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("longest").alias("longest"))


#: Cells of the padded right sides that are aligned at once.
_CELLS = 60_000


def _score(texts, least: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pairs = [
                (doc, item, text, stretch)
                for doc, items, numbers in zip(*(c.to_pylist() for c in batch.columns))
                for stretch in [np.array(numbers, np.int32)]
                for item in items
                for text in texts.value[item]
            ]
            pairs.sort(key=lambda p: len(p[3]))
            rows, at = [], 0
            while at < len(pairs):
                upto = at + 1
                while upto < len(pairs) and (upto - at + 1) * len(pairs[upto][3]) <= _CELLS:
                    upto += 1
                group = pairs[at:upto]
                at = upto
                score, longest = align_many([p[2] for p in group], [p[3] for p in group])
                rows += [(p[0], p[1], x, y) for p, x, y in zip(group, score.tolist(), longest.tolist()) if x >= least]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], batch.schema.field("items").type.value_type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["doc_id", "item_id", "score", "longest"])

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` where RUN successive words of an item stand in succession in a document."""
    return alignments(documents, items).filter(F.col("longest") >= RUN).select("doc_id", "item_id")
