"""Types of cell values from their text: detectors, votes and value/header probabilities.

All detectors are column expressions over a lower-cased value without white space, so a whole table is typed
in one pass of generated code; only conditions about a whole sheet (has it a prior type, has it a year) need a
grouped pass.  Null and blank values are ``blank``; unknown prior types count as none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The recognised types, in the order in which ties are resolved.
TYPES = ("numeric", "character", "logical", "date", "time", "categorical", "blank")

SPACE = r"[\s\p{Z}]"

#: Spellings of numbers, from loose to strict.
_RUN = r"([.,]?[0-9]+)+[.,]?"
NUMBER = {
    "most_relaxed": r"^[\d.,+-]+$",
    "relaxed": rf"^(\+(([.,]?[0-9]+)|([.,]?-))+[.,]?|-{_RUN}|{_RUN})$",
    "strict": rf"^(\+{_RUN}|-{_RUN}|{_RUN})$",
}
PLAIN_DATE = r"(^\d{4}[-/. ]\d{1,2}[-/. ]\d{1,2}$)|(^\d{1,2}[-/. ]\d{1,2}[-/. ]\d{4}$)"

#: Spellings of dates; each level adds to the one before.
_MON = (
    "(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(tember)?|oct(ober)?"
    "|nov(ember)?|dec(ember)?)"
)
_S = "[-./]"
_BASE = [rf"\d{{1,2}}{_S}?{_MON}{_S}?\d{{2,4}}", rf"\d{{4}}{_S}?{_MON}{_S}?\d{{1,2}}", rf"\d{{4}}{_S}\d{{1,2}}{_S}\d{{1,2}}", rf"\d{{1,2}}{_S}\d{{1,2}}{_S}\d{{4}}"]
_QUARTERS = [rf"q[1-4]{_S}?\d{{4}}", rf"\d{{4}}{_S}?q[1-4]", "q[1-4]"]
_FISCAL = [rf"(fy{_S}?)?\d{{2,4}}({_S}\d{{2,4}})?", rf"\d{{1,2}}{_S}?{_MON}{_S}?\d{{4}}{_S}?\d{{2}}", rf"\d{{4}}{_S}?\d{{2}}{_S}?{_MON}{_S}?\d{{1,2}}"]
_EXTRA = [rf"\d{{4}}{_S}\d{{4}}", rf"{_MON}[ -./]*\d{{2,4}}[ ]*[-][ ]*{_MON}[ -./]*\d{{2,4}}", r"\d{4}[-]?w\d{2}", rf"\d{{4}}{_S}\d{{1,2}}", rf"\d{{1,2}}{_S}\d{{4}}"]
DATE = {
    "base": "|".join(_BASE),
    "quarters": "|".join(_BASE + _QUARTERS),
    "fiscal": "|".join(_BASE + _QUARTERS + _FISCAL),
    "extra": "|".join(_BASE + _QUARTERS + _FISCAL + _EXTRA),
}

#: Spellings of times of day and durations.
_H, _M, _SEC = r"\d+(h(rs?|ours?)?)", r"\d+(m(in(utes?)?)?)", r"\d+(s(ec(onds?)?)?)"
_UNITS = "|".join(f"{a}{b}({c})?" for a, b, c in ((_H, _M, _SEC), (_H, _SEC, _M), (_M, _H, _SEC), (_M, _SEC, _H), (_SEC, _H, _M), (_SEC, _M, _H)))
TIME = rf"(\d{{1,2}}([:.-]\d{{1,2}}){{1,2}}(am|pm)?|\d{{1,2}}([:.-]\d{{1,2}})?(am|pm)|(\d+(hr(s?|ours?)?|min(utes?)?|sec(onds?)?))+|({_UNITS}))"
TIME_ONLY = rf"^(?:{DATE['base']})?{TIME}$"
LOGICAL = "^(true|false|t|f|yes|no|y|n)$"

#: Votes that a type can get from the detectors.
WEIGHTS = {"logical": 1, "categorical": 1, "numeric": 4, "date": 2, "time": 2, "character": 10, "blank": 10}


def bare(value: Column) -> Column:
    """Lower case without any white space; null becomes the empty text."""
    return F.coalesce(F.regexp_replace(F.lower(value), SPACE + "+", ""), F.lit(""))


def without(text: Column, allowed: list[str]) -> Column:
    """``text`` (bare) with every allowed substring deleted."""
    if not allowed:
        return text
    escaped = "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in "".join(a.lower().split())) for a in allowed)
    return F.regexp_replace(text, escaped, "")


def is_numeric(text: Column, level: str = "most_relaxed", exclude_dates: bool = True) -> Column:
    found = text.rlike(NUMBER[level])
    return found & ~text.rlike(PLAIN_DATE) if exclude_dates else found


def is_date(text: Column, level: str = "base") -> Column:
    return text.rlike("[0-9]") & text.rlike(f"^({DATE[level]})$")  # a cheap test first: most texts have no figure


def is_time(text: Column, exclude_numbers: bool = True) -> Column:
    found = text.rlike("[0-9]") & text.rlike(TIME_ONLY)
    return found & ~text.rlike(NUMBER["most_relaxed"]) if exclude_numbers else found


def is_logical(text: Column) -> Column:
    return text.rlike(LOGICAL)


def plain_type(value: Column, prior: Column | None = None, categorical: Column | None = None) -> Column:
    """Type by the first detector that fires: time, date, logical, numeric, categorical, else character."""
    text = bare(value)
    found = (
        F.when(text == "", "blank")
        .when(is_time(text), "time")
        .when(is_date(text), "date")
        .when(is_logical(text), "logical")
        .when(is_numeric(text), "numeric")
    )
    if categorical is not None:
        found = found.when(categorical, "categorical")
    found = found.otherwise("character")
    return found if prior is None else F.when(prior.isin(*TYPES) & (prior != "character"), prior).otherwise(found)


def year_probability(value: Column, first: float = 1600, last: float = 2100, alpha: float = 0.1) -> Column:
    """How likely a text of four figures is a year: the product of two logistic curves."""
    year = F.when(value.rlike(r"^\d{4}$"), value.try_cast("double"))
    made = (1 / (1 + F.exp(-alpha * (year - first)))) * (1 / (1 + F.exp(alpha * (year - last))))
    return F.coalesce(made, F.lit(0.0))


def detectors(text: Column) -> Column:
    """The single detectors over a bare text as one struct, so that each pattern is matched once."""
    tests = {
        "n_plain": is_numeric(text),
        "n_any": is_numeric(text, exclude_dates=False),
        "n_relaxed": is_numeric(text, "relaxed"),
        "n_strict": is_numeric(text, "strict"),
        "d_plain": is_date(text),
        "d_extra": is_date(F.regexp_replace(text, "fy", ""), "extra"),
        "t_plain": is_time(text),
        "t_any": is_time(text, exclude_numbers=False),
        "l": is_logical(text),
        "blank": text == "",
    }
    return F.struct(*[c.alias(n) for n, c in tests.items()])


def votes(found: Column, prior: Column, categorical: Column) -> dict[str, Column]:
    """Number of single detectors that give each type; a prior type other than character takes all ten."""
    single = {"numeric": ["n_plain", "n_any", "n_relaxed", "n_strict"], "date": ["d_plain", "d_extra"], "time": ["t_plain", "t_any"], "logical": ["l"]}
    counts = {t: reduce(lambda a, b: a + b, [found[n].cast("int") for n in ns]) for t, ns in single.items()}
    counts["categorical"] = categorical.cast("int")
    counts["character"] = F.lit(10) - reduce(lambda a, b: a + b, counts.values())
    kept = prior.isin(*[t for t in TYPES if t != "character"])
    return {
        t: F.when(found["blank"], F.lit(10 if t == "blank" else 0)).when(kept, F.when(prior == t, 10).otherwise(0)).otherwise(counts.get(t, F.lit(0)))
        for t in TYPES
    }


def classify(cells: DataFrame, sheet: list[str], value: str = "value", prior: str = "data_type", method: str = "auto", words: DataFrame | None = None, many: int = 30_000) -> DataFrame:
    """Cells with ``type``, ``PoA`` (header) and ``PoV`` (value).

    ``auto`` weighs all detectors where a sheet has fewer than ``many`` cells, else it takes the plain type.
    ``words`` (sheet keys, word) holds a sheet's categorical words.
    """
    v, p = F.col(value), F.coalesce(F.col(prior), F.lit("character"))
    over = Window.partitionBy(*sheet)
    base = cells
    if words is not None:
        listed = words.select(*sheet, F.col("word").alias("_word")).distinct().withColumn("_listed", F.lit(True))
        base = base.withColumn("_word", bare(v)).join(listed, [*sheet, "_word"], "left")
        categorical = F.coalesce(F.col("_listed"), F.lit(False))
    else:
        categorical = F.lit(False)
    if method == "auto":
        base = base.withColumn("_many", F.count("*").over(over) >= many)
    elif method in ("simple", "probable"):
        base = base.withColumn("_many", F.lit(method == "simple"))
    else:
        raise ValueError(f"method is auto, simple or probable, not {method!r}")
    base = base.withColumn("_text", bare(v)).withColumns({"_found": detectors(F.col("_text")), "_p": p, "_cat": categorical, "_y": year_probability(v)})
    p, f = F.col("_p"), F.col("_found")
    base = (
        base.withColumn("_kinds", F.collect_set(p).over(over))  # at most the recognised types and a few others
        .withColumn("_votes", F.array(*[votes(f, p, F.col("_cat"))[t] for t in TYPES]))
        .withColumn("_year", F.max("_y").over(over) > 0.6)
    )
    taken = F.size(F.array_except("_kinds", F.array(F.lit("character"), F.lit("blank")))) > 0
    taken = taken & (F.size(F.array_except("_kinds", F.array(*map(F.lit, TYPES)))) == 0)
    share = {}
    for i, t in enumerate(TYPES):
        bonus = F.when(taken & (p == t), 1).otherwise(0)
        weight = F.lit(WEIGHTS[t]) + F.when(taken & F.array_contains("_kinds", t), 1).otherwise(0)
        share[t] = F.least((F.col("_votes")[i] + bonus) / weight, F.lit(1.0))
    year = F.col("_y")
    share["date"] = share["date"] + F.when(F.col("_year"), 0.5 * year).otherwise(0.0)
    share["numeric"] = F.when(F.col("_year"), F.greatest(share["numeric"] - 0.5 * year, F.lit(0.0))).otherwise(share["numeric"])
    base = base.withColumn("_share", F.array(*[share[t].cast("double") for t in TYPES]))
    s = {t: F.col("_share")[i] for i, t in enumerate(TYPES)}
    top = F.element_at(F.array(*map(F.lit, TYPES)), F.array_position("_share", F.array_max("_share")).cast("int"))
    char_like = F.greatest(*[s[t] for t in ("logical", "date", "time", "categorical", "character")])
    total = F.nullif(s["numeric"] + char_like + s["blank"], F.lit(0.0))
    first = F.when(f["blank"], "blank").when(f["t_plain"], "time").when(f["d_plain"], "date").when(f["l"], "logical").when(f["n_plain"], "numeric").when(F.col("_cat"), "categorical").otherwise("character")
    plain = F.when(p.isin(*TYPES) & (p != "character"), p).otherwise(first)
    extra = [c for c in base.columns if c.startswith("_")]
    return base.select(
        *[c for c in cells.columns if c not in ("type", "PoA", "PoV")],
        F.when(F.col("_many"), plain).otherwise(top).alias("type"),
        F.when(F.col("_many"), F.when(plain.isin("numeric", "blank"), 0.0).otherwise(1.0)).otherwise(char_like / total).alias("PoA"),
        F.when(F.col("_many"), F.when(plain == "numeric", 1.0).otherwise(0.0)).otherwise(s["numeric"] / total).alias("PoV"),
    ).drop(*extra)


def classify_manual(cells: DataFrame, tag: str = "av_class_tag") -> DataFrame:
    """Header/value probabilities from hand-set tags ``attr``, ``val`` and ``empty``."""
    t = F.col(tag)
    kind = F.when(t == "attr", "character").when(t == "val", "numeric").otherwise("blank")
    return cells.withColumns({"type": kind, "PoA": F.when(t == "attr", 1.0).otherwise(0.0), "PoV": F.when(t == "val", 1.0).otherwise(0.0)})


def focus(classified: DataFrame, low: float = float("-inf"), high: float = float("inf"), absolute: bool = False, value: str = "value") -> DataFrame:
    """Values (PoV > .5) that are no plain number or lie outside the range become blank."""
    text = F.trim(F.col(value))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    number = F.abs(number) if absolute else number
    out = (F.col("PoV") > 0.5) & (number.isNull() | (number < low) | (number > high))
    out = F.coalesce(out, F.lit(False))
    return classified.withColumns({"type": F.when(out, "blank").otherwise(F.col("type")), "PoA": F.when(out, 0.0).otherwise(F.col("PoA")), "PoV": F.when(out, 0.0).otherwise(F.col("PoV"))})


def frequent_words(cells: DataFrame, sheet: list[str], value: str = "value", threshold: float | None = None) -> DataFrame:
    """``sheet…, word, n``: words of a sheet that occur more often than Q3 + 1.5 IQR (or ``threshold``)."""
    split = F.explode(F.split(F.lower(F.col(value)), r"[^\p{L}\p{N}_]+"))
    counts = cells.select(*sheet, split.alias("word")).filter("word <> ''").groupBy(*sheet, "word").agg(F.count("*").alias("n")).filter("n > 1")
    if threshold is not None:
        return counts.filter(F.col("n") > threshold)
    limits = counts.groupBy(*sheet).agg(F.percentile("n", F.lit(0.25)).alias("q1"), F.percentile("n", F.lit(0.75)).alias("q3"))
    limits = limits.filter("q3 > q1").select(*sheet, (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_limit"))
    return counts.join(limits, sheet).filter("n > _limit").drop("_limit")


def auto_round(x: Column) -> Column:
    """Rounding for display: whole numbers and those above 100 to 0 places, above 1 to 2, else to the leading figure."""
    size = F.abs(x)
    places = F.greatest(F.lit(2), (-F.floor(F.log10(size))).cast("int"))
    scale = F.pow(F.lit(10.0), places)
    return F.when((x == F.floor(x)) | (size > 100), F.round(x, 0)).when(size >= 1, F.round(x, 2)).otherwise(F.round(x * scale) / scale)
