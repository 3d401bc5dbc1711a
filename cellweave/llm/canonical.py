"""Free-entered values mapped to the entries of a reference list.

1. A multi-pattern automaton over the labels and their aliases finds embedded mentions at word boundaries;
   the longest non-overlapping match wins, unless a word left over belongs to the list's own vocabulary: then
   the value names something else built of the same words.
2. Remaining values go to token-set similarity: each word is matched to the list's vocabulary (exactly, as an
   abbreviation, or misspelt), an inverted index from words to entries gives the candidates, and an entry must hold all
   recognised words; two words suffice if one entry only holds both.  Initials of a title count where a single entry
   has them.  For entries of one or two words, whose letters are all there is to tell them by, every window of the
   value's words is compared as a whole, so that words written together or apart are found too.
3. What matches no entry, or several equally well, is reported with 0.

How an entry is compared depends on its own length in words only; unrelated entries change nothing.  Misspelt words are
looked up among those of like length and letters (``Near``), abbreviations among those of the same first letter.

The list is agreed and travels with the code: an error beyond ``LIST_CHARS`` characters.  Values are a table of any
size, handled where they lie, each distinct value of an Arrow batch once.  Defined results: null and blank values are
left out, values that are a label character for character too; labels that fall together after normalisation are
resolved to the smaller canon_id; a value may have any number of words, known or not.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that decorate a name or title without changing what is meant.
DECORATIONS = frozenset(
    "a an the of in at near by nr c o co city town village municipality district county region area north south east west side"
    " centre center greater outer inner senior sr junior jr deputy trainee assistant acting head chief lead interim part full time"
    " night day late early shift temp temporary i ii iii iv 1st 2nd and for".split()
)
#: Words that only connect.
_LINKS = frozenset("and for of the on o in".split())
_WORD = re.compile(r"[^\W\d_]+")
MEMO = 100_000
#: Cost of a word that abbreviates another; misspelt ones cost one more than their edits.
ABBREVIATED = 1
#: Characters of a reference list up to which it is handed to every task.
LIST_CHARS = 64 << 20


def words(text: str) -> list[str]:
    """Words of letters in lower case, without accents, figures and punctuation."""
    text = unicodedata.normalize("NFKD", text)
    return _WORD.findall("".join(ch for ch in text if not unicodedata.combining(ch)).casefold())


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most + 1`` where it is larger than ``most``.

    A column of the table of distances is kept as differences of neighbours in the bits of two numbers.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, diagonal, before, far = every, 0, 0, 0, len(a)
    for ch in b:
        same = at.get(ch, 0)
        swapped = (~diagonal & same) << 1 & before
        diagonal = (((same & up) + up) ^ up | same | down | swapped) & every
        right, left = (down | ~(diagonal | up)) & every, diagonal & up
        far += 1 if right & last else -1 if left & last else 0
        right, left = right << 1 | 1, left << 1
        up, down, before = (left | ~(diagonal | right)) & every, right & diagonal & every, same
    return min(far, most + 1)


def abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` is a beginning of ``long``, or its letters stand in ``long`` in order from the first on."""
    if len(short) >= len(long) or short[0] != long[0]:
        return False
    if long.startswith(short):
        return len(short) >= 2
    letters = iter(long)
    return 2 <= len(short) <= max(4, len(long) // 2) and all(ch in letters for ch in short) and (short[-1] == long[-1] or short[-1] not in "aeiou")


def _skeleton(word: str) -> str:
    rest = re.sub("[aeiou]", "", word[1:])
    return re.sub(r"(.)\1", r"\1", word[0] + rest)


def _allowed(length: int) -> int:
    return 3 if length >= 9 else 2 if length >= 6 else 1 if length >= 4 else 0


def _bag(text: str) -> list[int]:
    """How often each letter of a to z occurs, and all others together."""
    out = [text.count(chr(97 + k)) for k in range(26)]
    return [*out, len(text) - sum(out)]


class Near:
    """Texts by length and letters: of those, the ones that few edits may turn into another text."""

    def __init__(self, texts: list[str]):
        self.by_length: dict[int, tuple[list[str], np.ndarray]] = {}
        groups: dict[int, list[str]] = defaultdict(list)
        for text in texts:
            groups[len(text)].append(text)
        for length, group in groups.items():
            self.by_length[length] = group, np.array([_bag(t) for t in group], np.int16).reshape(len(group), 27)

    def candidates(self, text: str, most: int) -> Iterator[str]:
        # an edit changes at most one letter on either side, so the bags of letters of nearer texts differ by no more
        own = None
        for length in range(len(text) - most, len(text) + most + 1):
            if length in self.by_length:
                own = np.array(_bag(text), np.int16) if own is None else own
                group, bags = self.by_length[length]
                # letters too many on the one side and on the other sum to this; their difference is that of the lengths
                for k in np.flatnonzero(np.abs(bags - own).sum(axis=1) <= 2 * most - abs(length - len(text))):
                    yield group[k]


class SlotMatcher:
    """Entries of one slot: (canon_id, label)."""

    def __init__(self, entries: list[tuple[int, str]]):
        import ahocorasick

        self.entries = sorted(entries)
        self.tokens = {i: [w for w in words(label) if w not in _LINKS] or words(label) for i, label in self.entries}
        self.vocabulary = sorted({w for ws in self.tokens.values() for w in ws})
        self.short = {i for i, ws in self.tokens.items() if len(ws) < 3}
        self.holders: dict[str, set[int]] = defaultdict(set)
        for i, ws in self.tokens.items():
            for w in ws:
                self.holders[w].add(i)
        initials: dict[str, set[int]] = defaultdict(set)
        for i, ws in self.tokens.items():
            if len(ws) >= 3:
                initials["".join(w[0] for w in ws)].add(i)
        self.initials = {k: min(v) for k, v in initials.items() if len(v) == 1}
        claims: dict[str, set[int]] = defaultdict(set)
        for i, label in self.entries:
            for alias in self._aliases(words(label)):
                claims[alias].add(i)
        for i, label in reversed(self.entries):  # a label itself is never ambiguous
            claims[" ".join(words(label))] = {i}
        self.aliases = {a: next(iter(ids)) for a, ids in claims.items() if len(ids) == 1 and a}
        self.automaton = ahocorasick.Automaton()
        for alias, i in self.aliases.items():
            self.automaton.add_word(f" {alias} ", (len(alias), i))
        self.automaton.make_automaton()
        self.compact: dict[str, int] = {}
        for alias, i in self.aliases.items():
            self.compact.setdefault(alias.replace(" ", ""), i)
        self.texts = list(self.compact)
        self.near, self.near_words = Near(self.texts), Near(self.vocabulary)
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for v in self.vocabulary:
            self.by_first[v[0]].append(v)
        # letters of the longest text that may be close to an entry: edits and a decoration that sticks to it included
        self.reach = max(map(len, self.texts), default=0) + _allowed(99) + max(map(len, DECORATIONS))
        self.memo: dict[str, int] = {}
        self._known: dict[str, list[tuple[str, int]]] = {}
        self._parts: dict[str, list[str]] = {}
        self._longest_first = sorted(self.vocabulary, key=len, reverse=True)

    def _aliases(self, ws: list[str]) -> set[str]:
        core = [w for w in ws if w not in _LINKS] or ws
        out = {" ".join(ws), "".join(ws), " ".join(core), "".join(core)}
        if len(core) >= 2:
            if core != ws:
                out |= {" ".join([*core[:-1], "o", core[-1]])}
            if len(core) < 3:
                first = core[0]
                for short in {first[0], first[0] + first[-1], _skeleton(first)} - {first}:
                    out |= {" ".join([short, *ws[1:]]), " ".join([short + ws[1], *ws[2:]]) if len(short) > 1 else ""}
        return out

    def match(self, value: str) -> int:
        found = self.memo.get(value)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            ws = words(value)
            found = self.memo[value] = self._mention(ws) or self._set(ws) or (self._name(ws) if self.short else 0)
        return found

    def _mention(self, ws: list[str]) -> int:
        text = f" {' '.join(ws)} "
        spans = []
        if not self.aliases:
            return 0
        for end, (length, i) in self.automaton.iter(text):
            spans.append((length, end - length - 1, end, i))
        if not spans:
            return 0
        spans.sort(key=lambda x: (-x[0], x[1]))
        length, start, end, best = spans[0]
        rest = (text[: start + 1] + " " + text[end:]).split()
        return 0 if any(w in self.holders for w in rest if w not in DECORATIONS) else best

    def _name(self, ws: list[str]) -> int:
        """Closest entry to any window of words, if there is one."""
        best: dict[int, int] = {}
        # how many words before each place are the list's own, and how many no decoration
        own = [0, *accumulate(w in self.holders and w not in DECORATIONS for w in ws)]
        plain = [0, *accumulate(w not in DECORATIONS for w in ws)]
        for i in range(len(ws)):
            letters = 0
            for j in range(i + 1, len(ws) + 1):
                letters += len(ws[j - 1])
                if letters > self.reach:
                    break
                if own[-1] > own[j] - own[i]:
                    continue
                strange = plain[-1] - plain[j] + plain[i]
                for text in self._joined(ws[i:j]):
                    for entry, far in self._close(text):
                        best[entry] = min(best.get(entry, 10 * strange + far), 10 * strange + far)
        if not best:
            return 0
        low = min(best.values())
        nearest = [e for e, far in best.items() if far == low]
        return nearest[0] if len(nearest) == 1 else 0

    def _joined(self, ws: list[str]) -> Iterator[str]:
        text = "".join(ws)
        yield text
        for word in DECORATIONS:  # a decoration may stick to the name
            if len(word) >= 4 and len(text) >= len(word) + 6:
                if text.startswith(word):
                    yield text[len(word) :]
                if text.endswith(word):
                    yield text[: -len(word)]

    def _close(self, text: str) -> Iterator[tuple[int, int]]:
        most = _allowed(len(text))
        if text in self.compact:
            yield self.compact[text], 0
            return
        if not most:
            return
        for other in self.near.candidates(text, most):
            limit = min(most, _allowed(len(other)))
            far = distance(text, other, limit)
            if far <= limit:
                yield self.compact[other], far

    def _meanings(self, word: str) -> list[tuple[str, int]]:
        """Vocabulary words that ``word`` may stand for, with a cost."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= MEMO:
                self._known.clear()
            found = self._known[word] = self._look_up(word)
        return found

    def _look_up(self, word: str) -> list[tuple[str, int]]:
        if word in self.holders:
            return [(word, 0)]
        short = [(v, ABBREVIATED) for v in self.by_first[word[0]] if abbreviates(word, v)] if word[0] in self.by_first else []
        if short and len(word) <= 5:
            return short
        most = 1 if len(word) == 4 else 2 if len(word) <= 7 else 3
        wrong = []
        for v in self.near_words.candidates(word, most) if len(word) >= 4 else ():
            limit = min(most, max(1, len(v) // 3))
            if (far := distance(word, v, limit)) <= limit:
                wrong.append((v, 1 + far))
        return short + sorted(wrong)

    def _split(self, word: str) -> list[str]:
        """A word written together as vocabulary words, if it can be."""
        for v in self._longest_first:
            if len(word) >= len(v) + 2:
                if word.startswith(v):
                    return [v, *self._split(word[len(v) :])]
                if word.endswith(v):
                    return [*self._split(word[: -len(v)]), v]
        return [word]

    def _set(self, ws: list[str]) -> int:
        """Entry whose set of words is closest to that of ``ws``, if there is one."""
        joined = "".join(ws)
        if len(ws) == 1 and joined in self.initials:
            return self.initials[joined]
        # as a whole: misspelt or written together
        whole = sorted((far, e) for e, far in self._close("".join(w for w in ws if w not in _LINKS)))
        if whole and (len(whole) == 1 or whole[0][0] < whole[1][0] or whole[0][1] == whole[1][1]):
            return whole[0][1]
        kept = [w for w in ws if w not in _LINKS]
        if len("".join(kept)) >= 8:
            kept = [p for w in kept for p in (self._split(w) if w not in self.holders and w not in DECORATIONS else [w])]
        costs: dict[int, tuple] = {}
        meanings = [(w, self._meanings(w) if w not in DECORATIONS or w in self.holders else []) for w in kept]
        reached = {e for _, options in meanings for v, _ in options for e in self.holders[v]}
        for entry in sorted(reached):
            own = self.tokens[entry]
            left, cost, hits, strange = list(own), 0, 0, []
            for w, options in sorted(meanings, key=lambda m: min((c for _, c in m[1]), default=9)):
                # nothing vouches for the abbreviation of a name of one word
                usable = [(c, v) for v, c in options if v in left and not (c == ABBREVIATED and len(own) == 1)]
                if usable:
                    c, v = min(usable)
                    left.remove(v)
                    cost, hits = cost + c, hits + 1
                elif options:
                    if w in DECORATIONS and w in self.holders and hits + len(left) == len(own) and not left:
                        continue
                    strange.append(w)
                elif w not in DECORATIONS:
                    strange.append(w)
            # of a longer title a badly misspelt word may be the one that is missing; a name has no other word to vouch for it
            for w in list(strange) if entry not in self.short else ():
                near = [v for v in left if len(w) >= 4 and distance(w, v, 1 + len(v) // 3) <= 1 + len(v) // 3 and w not in self.holders]
                if near:
                    left.remove(near[0])
                    strange.remove(w)
                    cost, hits = cost + 3, hits + 1
            if strange and (left or any(w in self.holders for w in strange if w not in DECORATIONS)):
                continue
            if hits >= 2 or (hits == len(own)):
                costs[entry] = (len(left), len(strange), cost)
        if not costs:
            return 0
        low = min(costs.values())
        # a shortened title is meant only if it fits one entry however well the others fit
        nearest = [e for e, c in costs.items() if c == low]
        if low[0]:
            cheap = [e for e, c in costs.items() if c[0] == low[0] and c[2] <= low[2] + 1]
            nearest = cheap if len(cheap) > 1 else nearest
        return nearest[0] if len(nearest) == 1 else 0


def mapped(observations: DataFrame, canon: DataFrame, columns: dict[int, str]) -> DataFrame:
    """``obs_id, slot, canon_id`` of each value of ``columns`` (slot -> column) that is no label as it stands."""
    spark = observations.sparkSession
    listed = canon.select("slot", "canon_id", "label").filter("label is not null and canon_id is not null").distinct()
    size = listed.agg(F.sum(F.length("label"))).first()[0] or 0
    if size > LIST_CHARS:
        raise ValueError(f"the reference list has {size} characters, more than {LIST_CHARS}: an automaton of it fits no task")
    rows = listed.collect()
    entries = {slot: [(r[1], r[2]) for r in rows if r[0] == slot] for slot in columns}
    shared = spark.sparkContext.broadcast(entries)
    slots = list(columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = {slot: SlotMatcher(shared.value[slot]) for slot in slots}
        labels = {slot: {label for _, label in shared.value[slot]} for slot in slots}
        for batch in batches:
            for k, slot in enumerate(slots):
                coded = batch.column(k + 1).dictionary_encode()
                found = [None if v is None or not v.strip() or v in labels[slot] else known[slot].match(v) for v in coded.dictionary.to_pylist()]
                ids = pa.array(found, pa.int32()).take(coded.indices)
                kept = ids.is_valid()
                ids = ids.filter(kept)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), pa.array([slot] * len(ids), pa.int32()), ids], names=["obs_id", "slot", "canon_id"])

    kind = observations.schema["obs_id"].dataType.simpleString()
    return observations.select("obs_id", *[F.col(c) for c in columns.values()]).mapInArrow(run, f"obs_id {kind}, slot int, canon_id int")


def unmatched(found: DataFrame, observations: DataFrame, columns: dict[int, str]) -> DataFrame:
    """``slot, value, rows`` of the values that no entry is meant by."""
    values = None
    for slot, column in columns.items():
        part = observations.select("obs_id", F.lit(slot).alias("slot"), F.col(column).alias("value"))
        values = part if values is None else values.unionByName(part)
    return found.filter("canon_id = 0").join(values, ["obs_id", "slot"]).groupBy("slot", "value").agg(F.count("*").alias("rows"))
