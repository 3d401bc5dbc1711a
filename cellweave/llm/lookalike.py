"""One form for texts that look the same.

A text is compatibility-normalised (super- and subscripts stay, they look different), invisible characters
are deleted, all kinds of blank become a space and blanks at the ends go.  Its base characters then span a
lattice: each position offers all characters of the same look; Viterbi picks the path that is best under
bigram scores of characters and a cost for changing the script inside a word.  Equal-looking texts span the
same lattice, hence get the same form, and texts that look different never share one.

Letters that are written in several languages are grouped by hand; rarer ones (phonetic, Armenian, Cherokee, Coptic,
Lisu and others) come from the public table of confusable characters that Spark carries along (``public_letters``),
limited to single letters of the same case and without those that it holds alike though they are drawn differently.

Every distinct value of an Arrow batch is processed once; there is no shuffle of the texts.  Defined
results: null gives null, a text of invisible characters gives the empty form, ties go to the lower code point.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Workspace

#: Letters that are drawn alike in Latin, Greek and Cyrillic type, one group of equal look a word.
GROUPS = (
    "AΑА BΒВ CСϹ EΕЕ HΗН IΙІӀ JЈ KΚК MΜМ NΝ OΟО PΡР SЅ TΤТ XΧХ YΥҮ ZΖ QԚ WԜ GԌ DԀ LԼ ΓГ ΠП ΦФ ΛЛ"
    " aа cсϲ dԁ eе hһ iі jјϳ lӏ oοо pрρ qԛ sѕ wԝ xх yу vνѵ uυ kκк"
).split()
#: Hyphens that are drawn alike.
HYPHENS = "-\u2010\u2011"
_INVISIBLE = re.compile(
    "[\x00-\x08\x0e-\x1f\x7f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    "\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]"
)
_BLANK = re.compile("[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Cost of a change of script inside a word, and entries of a worker's memo before it starts anew.
SCRIPT_COST, MEMO = 6.0, 100_000
#: Scores are whole multiples of one part in this many: sums of a path are exact, and what all paths share decides no tie.
GRID = 1 << 20
#: Letters that the public table sets beside a Latin one of the same case but that are drawn differently.
UNLIKE = frozenset("ıɩɪιꙇӏαγɣʏყᶌỿꭚσᴑჿʋᴜꞟꭎꭒɯѡաƍցᶃքẝꞙꬵҽꬲгᴦⲅꭇꭈռգƽƦϜꞘᏴᏳƝꞲᏔᎠϺУᎩƖᏕᎡᎢᏃҺЬƄ")
#: Stored bytes of reference forms up to which they are broadcast.
BROADCAST_BYTES = 4 << 20

_ALIKE = {ch: "".join(sorted(group)) for group in [*GROUPS, HYPHENS] for ch in group}


#: Letters that the table is asked about: alphabets beyond Latin, Greek and Cyrillic in common use, and their supplements.
_ASKED = ((0x180, 0x5A0), (0x10A0, 0x1100), (0x13A0, 0x1400), (0x1D00, 0x1F00), (0x2C60, 0x2D30), (0xA4D0, 0xA500), (0xA640, 0xA700), (0xA720, 0xAB70))
_PUBLIC: dict[str, str] = {}


def public_letters(spark: SparkSession) -> dict[str, str]:
    """Rarer letters and the Latin letter each is drawn like, from the table of confusables; none without the library."""
    if not _PUBLIC:
        try:
            checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            asked = [c for a, b in _ASKED for c in map(chr, range(a, b)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFKD", c) == c]
            # one call: the skeleton of a text is that of its characters, parted by one that stands for itself
            bare = checker.getSkeleton(0, "\n".join(asked)).split("\n")
        except (TypeError, AttributeError, Py4JError):
            return {}
        for ch, base in zip(asked, bare):
            base = "I" if base == "l" and unicodedata.category(ch) != "Ll" else base
            lisu = 0xA4D0 <= ord(ch) < 0xA500
            same_case = unicodedata.category(ch) == ("Lu" if base.isupper() else "Ll") or (lisu and base.isupper())
            if len(base) == 1 and base.isascii() and base.isalpha() and same_case and ch not in UNLIKE and ch not in _ALIKE:
                _PUBLIC[ch] = base
    return _PUBLIC


def visible(text: str) -> str:
    """Decomposed text without what cannot be seen; super- and subscripts keep their characters."""
    text = _BLANK.sub(" ", _INVISIBLE.sub("", text)).strip(" ")
    if text.isascii():
        return text
    kept = "".join(ch if ch in _ALIKE or unicodedata.decomposition(ch)[:5] in ("<supe", "<sub>") else unicodedata.normalize("NFKD", ch) for ch in text)
    return unicodedata.normalize("NFD", _BLANK.sub(" ", kept)).strip(" ")


def _script(ch: str) -> int:
    point = ord(ch)
    if point < 0x250 or 0x1E00 <= point < 0x1F00:
        return 1 if ch.isalpha() else 0
    if 0x370 <= point < 0x400:
        return 2
    if 0x400 <= point < 0x530:
        return 3
    return 0


def count_pairs(texts: Iterable[str]) -> Counter:
    """How often one character follows another in ``texts``, and under ``(a, "")`` how often any follows ``a``.

    Pairs of two characters without look-alikes are left out, since all paths of a lattice share them.
    """
    pairs: Counter = Counter()
    for text in texts:
        bases = " " + "".join(ch for ch in visible(text) if not unicodedata.combining(ch)) + " "
        pairs.update(zip(bases, bases[1:]))
    counts = Counter({(a, b): n for (a, b), n in pairs.items() if a in _ALIKE or b in _ALIKE})
    for (a, _), n in pairs.items():
        counts[a, ""] += n
    return counts


class Forms:
    """Forms of texts under bigram scores of given texts or their ``counts``; ``letters`` are drawn like the letters they name."""

    def __init__(self, texts: Iterable[str] = (), letters: dict[str, str] | None = None, counts: Counter | None = None):
        self.alike = {ch: _ALIKE.get(base, base) for ch, base in (letters or {}).items()} | _ALIKE
        counts = count_pairs(texts) if counts is None else counts
        self.scores = {(a, b): round(log((n + 0.5) / (counts[a, ""] + 50)) * GRID) / GRID for (a, b), n in counts.items() if b}
        self.floor = round((log(0.5 / 50) - 2) * GRID) / GRID
        self.memo: dict[str, str] = {}

    def step(self, a: str, b: str) -> float:
        x, y = _script(a), _script(b)
        return self.scores.get((a, b), self.floor) - (SCRIPT_COST if x and y and x != y else 0)

    def form(self, text: str) -> str:
        made = self.memo.get(text)
        if made is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            made = self.memo[text] = self._search(text)
        return made

    def _search(self, text: str) -> str:
        shown = visible(text)
        if not any(ch in self.alike for ch in shown):
            return unicodedata.normalize("NFC", shown)
        best = {" ": 0.0}
        trail: list[dict[str, str]] = []
        for ch in shown:
            if unicodedata.combining(ch):
                trail.append({})  # marks stay on whatever carries them
                continue
            came, now = {}, {}
            for to in self.alike.get(ch, ch):
                score, source = max((total + self.step(a, to), -ord(a)) for a, total in best.items())
                now[to], came[to] = score, chr(-source)
            best = now
            trail.append(came)
        at = max(best, key=lambda ch: (best[ch] + self.scores.get((ch, " "), self.floor), -ord(ch)))
        out = []
        for ch, came in zip(reversed(shown), reversed(trail)):
            if not came:
                out.append(ch)
            else:
                out.append(at)
                at = came[at]
        return unicodedata.normalize("NFC", "".join(reversed(out)))


def forms(frame: DataFrame, column: str, counts: Counter, name: str = "form") -> DataFrame:
    """``frame`` with the form of ``column`` in a new column; ``counts`` of pairs give the bigram scores."""
    from pyspark.sql import types as T

    # bounded by the characters in use: one entry a pair and one a letter
    model = frame.sparkSession.sparkContext.broadcast((counts, public_letters(frame.sparkSession)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counted, letters = model.value
        made = Forms(letters=letters, counts=counted)
        for batch in batches:
            coded = batch.column(at).dictionary_encode()
            table = pa.array([None if v is None else made.form(v) for v in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, table.take(coded.indices)], names=[*batch.schema.names, name])

    at = frame.columns.index(column)
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(name, T.StringType())]))


def label_counts(terms: DataFrame) -> Counter:
    """``count_pairs`` of all distinct labels, counted where they lie and summed by pair."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made() -> pa.RecordBatch:
            pairs = list(counts)
            columns = [pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        counts: Counter = Counter()
        for batch in batches:
            counts.update(count_pairs(batch.column(0).to_pylist()))
            if len(counts) >= MEMO:
                yield made()
                counts.clear()
        yield made()

    labels = terms.select("label").filter("label is not null").distinct()
    found = labels.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n"))
    return Counter({(a, b): n for a, b, n in found.collect()})


def same_look(values: DataFrame, terms: DataFrame, id_col: str = "cell_id", value_col: str = "value") -> DataFrame:
    """``id_col, term_id`` of values displayed like a term's label but written with other characters.

    The forms of all terms are joined: by broadcast while they are small, by shuffle beyond that.
    """
    counts = label_counts(terms)
    work = Workspace(values.sparkSession, "forms")
    labels = work.write(forms(terms.select("term_id", "label").filter("label is not null"), "label", counts))
    if work.bytes(labels) <= BROADCAST_BYTES:
        labels = F.broadcast(labels)
    shown = forms(values.select(id_col, value_col).filter(F.length(value_col) > 0), value_col, counts)
    return shown.join(labels, "form").filter(F.col(value_col) != F.col("label")).select(id_col, "term_id").distinct()
