"""Languages of documents and of the paragraphs of mixed documents.

Script ranges narrow the candidates of each word; a word of the fitted vocabulary scores each language by how
much less likely it is there than in its best language; Viterbi over the words of a paragraph, with a penalty
for switching, labels spans, and the language that carries most of the paragraph's informative words is its
label.  Single foreign words, names and formulas cost less than two switches, and a heading is outweighed.

Languages are those with function words here, those a script stands for alone, and every other language that the labels
given to ``fit`` name often enough.  The word scores are fitted on a bounded sample of labelled documents
(``PER_LANGUAGE`` a language, chosen by a hash of the id, hand-made labels and stored ones); paragraphs whose function
words speak against the label are left out of the fit, as stored labels may be wrong.  Words are counted where the
texts lie; the driver sees counts.  Everything else runs over all rows: one map over Arrow batches without a shuffle,
whole texts, every paragraph.

Where the best single language loses less than one switch would cost, no path with switches can be better, so
only the other paragraphs go through the trellis, many at a time.

Defined results: null and blank texts have no row; blank paragraphs are not counted; a paragraph without any
informative word, or in a script without a language here, takes the document's language with confidence 0; a document
of only such paragraphs is ``und`` with confidence 0, and no label is corrected to that; confidence falls where few
words are known; if no language has more than half of the paragraphs the one with most, then most words, is the
document's.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by script; a script with one language stands for it.
SCRIPTS = {"latin": ["en", "de", "fr", "es", "pt", "nl"], "cyrillic": ["ru"], "kana": ["ja"], "han": ["zh", "ja"], "greek": ["el"], "hangul": ["ko"], "hebrew": ["he"], "thai": ["th"], "armenian": ["hy"], "georgian": ["ka"]}
#: What a text is in where nothing speaks for a language.
UNKNOWN = "und"
#: Stored labels of a language without function words here from which on it is fitted; one hand-made label is enough.
LABELLED = 30
#: Sampled documents of each language for the fit, from either kind of label.
PER_LANGUAGE = 150
#: Share of known words from which on confidence does not fall for want of them.
SURE = 0.4
#: Cost of a switch, and the most that one word can speak against a language.
SWITCH, FLOOR = 6.0, -4.0

#: Common function words, the prior of the fit.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with was on be by this are or from at which an not have has its can between their were been when if while after into than",
    "de": "der die das und ist in den von zu mit dem ein eine des auf für nicht sich als auch im wird bei oder aus nach einer einem wie durch zum zur kann werden dass wenn über wobei",
    "fr": "le la les de des et est un une du en à dans que pour qui au par sur pas ne avec ce il sont plus se ou aux cette lorsque entre être dont comme après ainsi",
    "es": "el la los las de y que en un una del es por con para no se al lo como más su o sus este entre está cuando sobre también según después mientras desde son",
    "pt": "o a os as de e que em um uma do da dos das no na é por com para não se ao mais como seu ou à entre quando está são pelo pela enquanto depois também foi segundo",
    "nl": "de het een en van in is dat op te met voor zijn niet aan er door bij ook als uit naar of wordt worden deze tussen die om tot dan maar wanneer volgens terwijl kan",
}

#: Ranges of letters by script, words of which are told apart; Greek letters of formulas stand alone.
_RANGES = {
    "latin": "[a-z\u00df-\u024f\u1e00-\u1eff]+",
    "cyrillic": "[\u0400-\u052f]+",
    "kana": "[\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f]+",
    "han": "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+",
    "greek": "[\u0370-\u03ff\u1f00-\u1fff]{3,}",
    "hangul": "[\u1100-\u11ff\u3130-\u318f\uac00-\ud7a3]+",
    "hebrew": "[\u0590-\u05ff]{2,}",
    "thai": "[\u0e00-\u0e7f]{2,}",
    "armenian": "[\u0530-\u058f]{2,}",
    "georgian": "[\u10a0-\u10ff\u1c90-\u1cbf]{2,}",
    "other": "[\u0600-\u08ff\u0900-\u0dff\u0e80-\u10ff\u1200-\u139f\u1780-\u17ff]{2,}",
}
_TOKEN = re.compile("|".join(_RANGES.values()))
#: Letters that are not in the Russian alphabet.
_NOT_RUSSIAN = re.compile("[\u0400\u0402-\u040f\u0450\u0452-\u052f]")
_BREAK = re.compile(r"\n[ \t\r]*\n")
#: Longest run of one CJK script that is told apart by its length.
_RUN = 24


_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&[A-Za-z]+;|<\|[a-z]+\|>")


def tokens(text: str) -> list[str]:
    """Words of one script in lower case, without mark-up."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _TOKEN.findall(text.lower())


def paragraphs(text: str) -> list[str]:
    return [p for p in _BREAK.split(text) if p.strip()]


_ONE = {name: re.compile(pattern[: pattern.index("]") + 1]) for name, pattern in _RANGES.items()}


def _script(token: str) -> str:
    first = token[0]
    if first < "\u0370":
        return "latin"
    return next(name for name, one in _ONE.items() if one.match(first))


class WordScores:
    """Rows of scores by language for words; words outside the vocabulary share a row of their script."""

    def __init__(self, counts: dict[str, Counter], scripts: dict[str, list[str]] = SCRIPTS):
        self.languages = [*dict.fromkeys(lang for langs in scripts.values() for lang in langs), UNKNOWN]
        n = len(self.languages)
        self.kept = 9  # the languages of the first four scripts
        at = {lang: i for i, lang in enumerate(self.languages)}
        rows, weights = [], []

        def add(row: np.ndarray, weight: float) -> int:
            rows.append(row)
            weights.append(weight)
            return len(rows) - 1

        def only(*langs: str, other: float = FLOOR) -> np.ndarray:
            row = np.full(n, other)
            row[[at[x] for x in langs]] = 0
            return row

        self.sole_russian = scripts["cyrillic"] == ["ru"]
        self.unknown = {
            name: add(only(*langs), 1.0) if len(langs) == 1 else add(only(*langs, UNKNOWN, other=-1.0), 0.0)
            for name, langs in scripts.items() if name not in ("kana", "han")
        }
        self.unknown["other"] = add(only(UNKNOWN), 1.0)
        self.runs = {"kana": [], "han": []}
        for k in range(_RUN + 1):
            self.runs["kana"].append(add(only("ja"), k / 2))
            han = only("zh", "ja")
            han[at["ja"]] = -0.5
            self.runs["han"].append(add(han, k / 2))
        self.known: dict[str, int] = {}
        blocks, heavy, upto = [np.array(rows)], [np.array(weights)], len(rows)
        for name, langs in scripts.items():
            if name in ("kana", "han") or len(langs) == 1:
                continue
            vocabulary = sorted(w for w in set().union(*(counts.get(lang, ()) for lang in langs)) if _script(w) == name)
            if not vocabulary:
                continue
            seen = np.array([[counts.get(lang, {}).get(w, 0) for lang in langs] for w in vocabulary], float)
            logs = np.log((seen + 0.2) / (seen.sum(axis=0) + 0.2 * len(vocabulary)))
            logs -= logs.max(axis=1, keepdims=True)
            second = np.maximum(np.sort(logs, axis=1)[:, -2:-1], FLOOR)  # near 0: a word of several languages
            full = np.repeat(np.maximum(second - 1, FLOOR), n, axis=1)
            full[:, [at[x] for x in langs]] = np.maximum(logs, FLOOR)
            self.known.update({w: upto + i for i, w in enumerate(vocabulary)})
            upto += len(vocabulary)
            blocks.append(full)
            heavy.append(1 - np.exp(second[:, 0]))
        self.table = np.vstack(blocks).astype(np.float32)
        self.weights = np.concatenate(heavy).astype(np.float32)
        self.vague = np.zeros(len(self.table), bool)  # rows of words that nothing is known of
        self.vague[[i for name, i in self.unknown.items() if len(scripts.get(name, ())) != 1]] = True

    def row(self, token: str) -> int:
        script = _script(token)
        if script in self.runs:
            return self.runs[script][min(len(token), _RUN)]
        if script == "cyrillic" and self.sole_russian and _NOT_RUSSIAN.search(token):
            return self.unknown["other"]
        return self.unknown[script]

    def rows(self, found: list[str]) -> list[int]:
        known, other = self.known, self.row
        return [known[t] if t in known else other(t) for t in found]


def trellis(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: ``scores`` is paragraphs x words x languages, zero past a paragraph's end."""
    count, steps, n = scores.shape
    best = scores[:, 0].copy()
    came = np.empty((steps, count, n), np.int8)
    stay = np.arange(n, dtype=np.int8)
    for t in range(1, steps):
        top = best.argmax(axis=1)
        jump = best[np.arange(count), top][:, None] - switch
        moved = jump > best
        came[t] = np.where(moved, top[:, None], stay)
        best = np.where(moved, jump, best) + scores[:, t]
    path = np.empty((count, steps), np.int8)
    path[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = came[t, np.arange(count), path[:, t]]
    return path


class Labeller:
    def __init__(self, scores: WordScores):
        self.scores = scores

    def paragraphs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), confidence and informative words of each paragraph."""
        weights = self.scores.weights
        rows = [self.scores.rows(tokens(t)) for t in texts]
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        # a language that no word here speaks for is never better than those that are always kept, nor nearer to the best
        spoken = self.scores.table[np.unique(flat)].max(axis=0, initial=FLOOR) > FLOOR
        spoken[: self.scores.kept] = True
        columns = np.flatnonzero(spoken)
        table, n = np.ascontiguousarray(self.scores.table[:, columns]), len(columns)
        sums = np.zeros((len(texts), n), np.float32)
        weight = np.zeros(len(texts), np.float32)
        vague = np.zeros(len(texts), np.float32)
        some = lengths > 0
        if some.any():
            sums[some] = np.add.reduceat(table[flat], starts[some], axis=0)
            weight[some] = np.add.reduceat(weights[flat], starts[some])
            vague[some] = np.add.reduceat(self.scores.vague[flat].astype(np.float32), starts[some]) / lengths[some]
        best = sums.argmax(axis=1)
        share = np.ones(len(texts), np.float32)
        open_ = np.flatnonzero((sums.max(axis=1) <= -SWITCH) & (weight > 0))
        open_ = open_[np.argsort(lengths[open_], kind="stable")]
        at = 0
        while at < len(open_):  # as many paragraphs of like length as fit a fixed number of words
            longest, upto = 0, at
            while upto < len(open_) and (upto == at or (upto - at + 1) * lengths[open_[upto]] <= 200_000):
                longest = int(lengths[open_[upto]])
                upto += 1
            group = open_[at:upto]
            at = upto
            grid = np.zeros((len(group), longest, n), np.float32)
            heavy = np.zeros((len(group), longest), np.float32)
            for k, p in enumerate(group):
                own = flat[starts[p] : ends[p]]
                grid[k, : len(own)] = table[own]
                heavy[k, : len(own)] = weights[own]
            path = trellis(grid, lengths[group])
            carried = np.stack([np.where(path == lang, heavy, 0).sum(axis=1) for lang in range(n)], axis=1)
            best[group] = carried.argmax(axis=1)
            share[group] = carried.max(axis=1) / np.maximum(carried.sum(axis=1), 1e-6)
        rest = sums.copy()
        rest[np.arange(len(texts)), best] = -np.inf
        margin = np.maximum(sums[np.arange(len(texts)), best] - rest.max(axis=1), 0)
        confidence = share * (1 - np.exp(-(1 + margin) / 4)) * np.minimum(1, (1 - vague) / SURE)
        return np.where(weight > 0, columns[best], -1), np.where(weight > 0, confidence, 0), weight

    def documents(self, texts: list[str]) -> list[list[tuple[int, str, float]]]:
        """Per text its rows (seg_no, lang, confidence): 0 for the document, 1… if its paragraphs differ."""
        parts = [paragraphs(t) for t in texts]
        lang, confidence, weight = self.paragraphs([p for ps in parts for p in ps])
        names, out, at = self.scores.languages, [], 0
        for ps in parts:
            own, sure, heavy = lang[at : at + len(ps)], confidence[at : at + len(ps)], weight[at : at + len(ps)]
            at += len(ps)
            own = np.where(own == len(names) - 1, -1, own)  # a script without a language here
            votes = Counter(own[own >= 0].tolist())
            if not votes:
                out.append([(0, UNKNOWN, 0.0)] if ps else [])
                continue
            main = max(votes, key=lambda x: (votes[x], float(heavy[own == x].sum()), -x))
            sure = np.where(own < 0, 0.0, sure)
            own = np.where(own < 0, main, own)
            rows = [(0, names[main], float(np.where(own == main, sure, 0).sum() / len(ps)))]
            if len(votes) > 1:
                rows += [(k + 1, names[x], float(c)) for k, (x, c) in enumerate(zip(own, sure))]
            out.append(rows)
        return out


def label_code(label: Column) -> Column:
    """Two-letter code of a stored label, apart from case and region; null where it says nothing."""
    code = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(code != "", code)


def fit(documents: DataFrame, hand: DataFrame | None = None, per_language: int = PER_LANGUAGE) -> WordScores:
    """Word scores from function words and a bounded sample of labelled documents."""
    spark = documents.sparkSession
    prior = {lang: Counter({w: 5 for w in ws.split()}) for lang, ws in FUNCTION_WORDS.items()}
    coded = documents.select("doc_id", label_code(F.col("lang")).alias("code")).filter("code is not null")
    named = None if hand is None else hand.select("doc_id", label_code(F.col("lang")).alias("code")).filter("code is not null").distinct()
    sizes = [{} if x is None else {r[0]: r[1] for r in x.groupBy("code").count().collect()} for x in (coded, named)]  # two-letter codes
    settled = {lang for name, langs in SCRIPTS.items() if name not in ("latin", "cyrillic") for lang in langs}
    fresh = [c for c in {*sizes[0], *sizes[1]} - settled - {x for langs in SCRIPTS.values() for x in langs} if sizes[0].get(c, 0) >= LABELLED or c in sizes[1]]
    wanted = [lang for lang in {*sizes[0], *sizes[1]} if lang in prior or lang in fresh or (lang == "ru" and fresh)]
    if not wanted:
        return WordScores(prior)

    def rate(of: dict[str, int]) -> Column:
        """About ``per_language`` rows of each language: the rate comes from counts over all rows."""
        out = F.lit(0.0)
        for lang in wanted:
            if of.get(lang):
                out = F.when(F.col("code") == lang, per_language / of[lang]).otherwise(out)
        return out * 1_000_003

    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    labels = documents.select("doc_id", F.explode(F.array(label_code(F.col("lang")))).alias("code"), "text").filter(picked < rate(sizes[0]))
    if named is not None:
        # the ids first: about ``per_language`` a language, so that texts are read once for both kinds of label
        by_hand = named.filter(picked < rate(sizes[1])).groupBy("doc_id").agg(F.collect_set("code").alias("_hand"))
        both = documents.select("doc_id", label_code(F.col("lang")).alias("code"), "text").join(F.broadcast(by_hand), "doc_id", "left")
        stored = F.when(picked < rate(sizes[0]), F.array("code")).otherwise(F.array().cast("array<string>"))
        labels = both.select("doc_id", F.explode(F.concat(stored, F.coalesce("_hand", F.array().cast("array<string>")))).alias("code"), "text")
    guess = spark.sparkContext.broadcast(vars(WordScores(prior)))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scores = WordScores.__new__(WordScores)
        vars(scores).update(guess.value)
        label = Labeller(scores)
        for batch in batches:
            found: dict[str, Counter] = {}
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = paragraphs(text or "")
                lang, _, weight = label.paragraphs(parts)
                for part, x, heavy in zip(parts, lang, weight):
                    words = tokens(part)
                    own = scores.languages[x] if x >= 0 else None
                    # of a language without function words here: where few of the others' stand
                    if own == code or (code not in FUNCTION_WORDS and (own in ("ru", None, UNKNOWN) or heavy < 0.2 * len(words))):
                        found.setdefault(code, Counter()).update(words)
            rows = [(c, w, k) for c, words in found.items() for w, k in words.items()]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["code", "word", "n"])

    counts = {lang: Counter(words) for lang, words in prior.items()}
    counted = labels.select("code", "text").mapInArrow(count, "code string, word string, n bigint").groupBy("code", "word").agg(F.sum("n").alias("n"))
    for code, word, k in counted.toLocalIterator():  # the vocabulary of the sample
        counts.setdefault(code, Counter())[word] += k
    scripts = {name: list(langs) for name, langs in SCRIPTS.items()}
    for lang in sorted(fresh):
        size = Counter(_script(w) for w in counts.get(lang, ()))
        top = max(("latin", "cyrillic"), key=lambda name: size[name])
        if size[top]:
            scripts[top].append(lang)
    return WordScores(counts, scripts)


def languages(documents: DataFrame, hand: DataFrame | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, seg_no, lang, confidence, stored``: the document (0) and the paragraphs of mixed ones (1…)."""
    model = documents.sparkSession.sparkContext.broadcast(vars(fit(documents, hand, per_language)))  # plain data: workers need no import

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scores = WordScores.__new__(WordScores)
        vars(scores).update(model.value)
        label = Labeller(scores)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what a slice holds in Python objects
                piece = batch.slice(at, 256)
                found = label.documents([t or "" for t in piece.column(2).to_pylist()])
                times = [len(rows) for rows in found]
                take = pa.array(np.repeat(np.arange(piece.num_rows), times))
                flat = [row for rows in found for row in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(take),
                        pa.array([r[0] for r in flat], pa.int32()),
                        pa.array([r[1] for r in flat], pa.string()),
                        pa.array([r[2] for r in flat], pa.float64()),
                        piece.column(1).take(take),
                    ],
                    names=["doc_id", "seg_no", "lang", "confidence", "stored"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", label_code(F.col("lang")).alias("stored"), "text").mapInArrow(
        run, f"doc_id {kind}, seg_no int, lang string, confidence double, stored string"
    )


def corrections(found: DataFrame) -> DataFrame:
    """Of ``languages``: documents without a label or with another one, and the paragraphs of mixed ones."""
    return found.filter(F.col("lang") != UNKNOWN).filter((F.col("seg_no") > 0) | F.col("stored").isNull() | (F.col("stored") != F.col("lang")))
