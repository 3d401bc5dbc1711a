"""Tools on tidy frames: dropping constant columns, renaming columns by their content, fuzzy joins.

Null keys match nothing in a fuzzy join.  Column profiles and distinct keys are aggregated in Spark; only score
matrices of columns by names (both few) are resolved on the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Workspace
from . import assignment


def drop_constants(df: DataFrame, ignore_null: bool = True) -> DataFrame:
    """``df`` without columns of at most one distinct value; nulls are ignored or count as a value."""
    if not df.columns:
        return df
    counts = df.agg(*[(F.count_distinct(F.col(f"`{c}`")) + (0 if ignore_null else F.coalesce(F.max(F.col(f"`{c}`").isNull().cast("int")), F.lit(0)))).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if counts[i] > 1])


def _words(c: Column, lower: bool = True) -> Column:
    text = F.lower(c) if lower else c
    return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != ""))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n``: the distinct values of each column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def content_scores(df: DataFrame, names: dict[str, list[str]], patterns: dict[str, str], columns: list[str], w_word: float = 0.5, w_phrase: float = 0.5, penalty: float = 0.5, case_sensitive: bool = False, pattern_bias: float = 0.1) -> DataFrame:
    """``node, column, score``: how well a column's values fit each list of example texts or each pattern."""
    profile = column_profile(df, columns)
    out = None
    for node, targets in names.items():
        best: Column | None = None
        value = F.col("value") if case_sensitive else F.lower("value")
        words = _words(F.col("value"), not case_sensitive)
        hits = []
        for target in targets:
            text = target if case_sensitive else target.lower()
            own = sorted(set(re.findall(r"[^\W_]+", text)))
            common = F.size(F.array_intersect(words, F.array(*map(F.lit, own)))) if own else F.lit(0)
            phrase = (value.contains(text) | F.lit(text).contains(value)).cast("double")
            size = F.greatest(F.size(words), F.lit(1))
            score = (w_word * common / max(len(own), 1) + w_phrase * phrase) * (1 - penalty * (size - common) / size)
            best = score if best is None else F.greatest(best, score)
            hits.append(F.max(score > 0))
        scored = profile.withColumn("_s", best)
        used = F.sum(F.when(F.col("_s") > 0, F.col("n")))
        part = scored.groupBy("column").agg(
            (F.sum(F.when(F.col("_s") > 0, F.col("_s") * F.col("n"))) / used * (used / F.sum("n")) * sum((F.coalesce(h.cast("int"), F.lit(0)) for h in hits), F.lit(0)) / len(targets)).alias("score")
        ).withColumn("node", F.lit(node))
        out = part if out is None else out.unionByName(part)
    for node, pattern in patterns.items():
        matched = F.length(F.regexp_substr("value", F.lit(pattern)))
        size = F.greatest(F.length("value"), F.lit(1))
        score = F.when(matched.isNotNull(), 1 - penalty * (1 - F.least(matched, size) / size) + pattern_bias * matched)
        used = F.sum(F.when(F.col("_s").isNotNull(), F.col("n")))
        part = profile.withColumn("_s", score).groupBy("column").agg((F.sum(F.col("_s") * F.col("n")) / used * (used / F.sum("n"))).alias("score")).withColumn("node", F.lit(node))
        out = part if out is None else out.unionByName(part)
    return out.select("node", "column", F.coalesce("score", F.lit(0.0)).alias("score"))


def rename_by_content(df: DataFrame, names: dict[str, list[str]], patterns: dict[str, str] | None = None, include: list[str] | None = None, exclude: list[str] = (), method: str = "optimal", min_score: float = 0.1, unite_others: str | None = None, **weights: object) -> DataFrame:
    """``df`` with columns renamed to the nodes whose texts or patterns their content fits best."""
    patterns = patterns or {}
    if set(names) & set(patterns):
        raise ValueError(f"named in both maps: {sorted(set(names) & set(patterns))}")
    columns = [c for c in (include or df.columns) if c not in exclude]
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    nodes = [*names, *patterns]
    if not nodes or not columns:
        return df
    found = {(r[0], r[1]): r[2] for r in content_scores(df, names, patterns, columns, **weights).collect()}  # nodes x columns
    scores = np.array([[found.get((n, c), 0.0) for c in columns] for n in nodes])
    pairs = assignment.optimal(scores) if method == "optimal" else assignment.greedy(scores)
    chosen = {columns[c]: nodes[r] for r, c in pairs if scores[r, c] >= min_score}
    out = df.withColumnsRenamed(chosen)
    if unite_others:
        others = [c for c in columns if c not in chosen]
        out = out.withColumn(unite_others, F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in others])).drop(*others)
    return out


def common_lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """Length of the longest common substring of each pair, many pairs at a time."""
    def coded(texts: list[str], fill: int) -> np.ndarray:
        out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.int32)
        for k, t in enumerate(texts):
            out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
        return out

    best = np.zeros(len(xs), np.int32)
    order = np.argsort([len(x) + len(y) for x, y in zip(xs, ys)], kind="stable")
    for at in range(0, len(order), 2048):  # pairs of like length
        some = order[at : at + 2048]
        a, b = coded([xs[k] for k in some], -1), coded([ys[k] for k in some], -2)
        row, top = np.zeros((len(some), b.shape[1] + 1), np.int32), np.zeros(len(some), np.int32)
        for j in range(a.shape[1]):
            now = np.zeros_like(row)
            now[:, 1:] = (row[:, :-1] + 1) * (b == a[:, j : j + 1])
            row = now
            np.maximum(top, row.max(axis=1), out=top)
        best[some] = top
    return best


def _lcs_udf():
    @F.pandas_udf(T.IntegerType())
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(common_lengths(a.fillna("").tolist(), b.fillna("").tolist()))

    return common


def clean_key(c: Column, acronyms: bool = True, keep_figures: bool = False, case_sensitive: bool = False) -> Column:
    """A key as it is compared: the initials of its words added if it has two or more, then letters only, squeezed."""
    kept = r"[^\p{L}\p{N}]+" if keep_figures else r"[^\p{L}]+"
    text = c
    if acronyms:
        words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
        initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
        text = F.when(F.size(words) >= 2, F.concat_ws(" ", c, initials)).otherwise(c)
    text = F.trim(F.regexp_replace(text, kept, " "))
    return text if case_sensitive else F.lower(text)


def fuzzy_scores(x: DataFrame, y: DataFrame, w_word: float = 0.55, w_char: float = 0.15, w_common: float = 0.30, min_common: int = 3, threshold: float = 0.10, **clean: bool) -> DataFrame:
    """``x, y, score`` of distinct keys that share a word or a substring of ``min_common`` letters.

    Only such pairs can score: they meet through an equi-join on words and on ``min_common``-grams, so keys
    without anything in common never do.
    """
    a = x.select(F.col(x.columns[0]).alias("x")).filter("x is not null and x <> ''").distinct().withColumn("cx", clean_key(F.col("x"), **clean))
    b = y.select(F.col(y.columns[0]).alias("y")).filter("y is not null and y <> ''").distinct().withColumn("cy", clean_key(F.col("y"), **clean))

    def signs(c: str) -> Column:
        tight = F.regexp_replace(c, " ", "")
        last = F.length(tight) - min_common
        grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.lit("#"), F.substr(tight, i + 1, F.lit(min_common))))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.split(F.col(c), " "), grams))

    pairs = a.withColumn("sign", F.explode(signs("cx"))).join(b.withColumn("sign", F.explode(signs("cy"))), "sign").select("x", "y", "cx", "cy").distinct()
    wx, wy = F.array_distinct(F.split("cx", " ")), F.array_distinct(F.split("cy", " "))
    tx, ty = F.regexp_replace("cx", " ", ""), F.regexp_replace("cy", " ", "")
    lx, ly = F.array_distinct(F.split(tx, "")), F.array_distinct(F.split(ty, ""))
    jaccard = lambda p, q: F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))
    pairs = pairs.withColumns({"sw": jaccard(wx, wy), "sc": jaccard(lx, ly), "lcs": _lcs_udf()(tx, ty), "_longest": F.greatest(F.length(tx), F.length(ty))})
    common = F.when(F.col("lcs") >= min_common, F.col("lcs") / F.col("_longest")).otherwise(0.0)
    score = w_word * F.col("sw") + w_char * F.when((F.col("sw") > 0) | (common > 0), F.col("sc")).otherwise(0.0) + w_common * common
    return pairs.select("x", "y", score.alias("score")).filter(F.col("score") >= threshold)


def fuzzy_match(x: DataFrame, y: DataFrame, relationship: str = "many_to_many", method: str = "optimal", **weights: object) -> DataFrame:
    """``x, y, score`` shaped like a full join: every distinct x with its match, and every y without one."""
    scores = Workspace(x.sparkSession, "fuzzy").write(fuzzy_scores(x, y, **weights))
    if relationship == "one_to_one":
        rows = scores.collect()  # an assignment needs the whole matrix: for key lists that people read
        xs, ys = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        grid = np.zeros((len(xs), len(ys)))
        for r in rows:
            grid[xs.index(r[0]), ys.index(r[1])] = r[2]
        pairs = assignment.optimal(grid) if method == "optimal" else assignment.greedy(grid)
        made = [(xs[i], ys[j], float(grid[i, j])) for i, j in pairs if grid[i, j] > 0]
        best = x.sparkSession.createDataFrame(made, "x string, y string, score double")
    else:
        order = Window.partitionBy("x").orderBy(F.desc("score"), "y")
        best = scores.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    every_x = x.select(F.col(x.columns[0]).alias("x")).filter("x is not null and x <> ''").distinct()
    every_y = y.select(F.col(y.columns[0]).alias("y")).filter("y is not null and y <> ''").distinct()
    left = every_x.join(best, "x", "left")
    rest = every_y.join(best.select("y").distinct(), "y", "left_anti").select(F.lit(None).cast("string").alias("x"), "y", F.lit(None).cast("double").alias("score"))
    return left.unionByName(rest)


def fuzzy_join(x: DataFrame, y: DataFrame, by: str | dict[str, str] | None = None, how: str = "left", keep_score: bool = False, name_from: str | None = None, keep_keys: bool = False, **match: object) -> DataFrame:
    """``x`` joined to ``y`` on keys that match best; ``by`` is a common column or {x's: y's}.

    Both key columns stay, or under ``name_from`` ("x" or "y") that one only; ``keep_keys`` adds them as ``x_key`` and
    ``y_key``.  Columns of ``y`` named as one of ``x`` get the ending ``_y``.
    """
    if name_from not in (None, "x", "y"):
        raise ValueError(f"name_from is x, y or None, not {name_from!r}")
    if by is None:
        common = [c for c in x.columns if c in y.columns]
        if len(common) != 1:
            raise ValueError("by is needed unless exactly one column is common")
        by = common[0]
    kx, ky = next(iter(by.items())) if isinstance(by, dict) else (by, by)
    bridge = fuzzy_match(x.select(kx), y.select(ky), **match).filter("x is not null and y is not null")
    bridge = bridge.select(F.col("x").alias("_from"), F.col("y").alias("_key"), F.col("score").alias("_score"))
    left = x.join(bridge, F.col(f"`{kx}`") == F.col("_from"), "left").drop("_from")
    right = y.withColumnsRenamed({c: f"{c}_y" for c in y.columns if c in x.columns and c != ky} | {ky: "_key_y"})
    out = left.join(right, left["_key"] == right["_key_y"], how)
    if keep_keys:
        out = out.withColumns({"x_key": F.col(f"`{kx}`"), "y_key": F.col("_key_y")})
    if name_from == "y":
        out = out.drop(kx).withColumnRenamed("_key_y", ky)
    elif name_from == "x":
        out = out.drop("_key_y")
    else:
        out = out.withColumnRenamed("_key_y", f"{ky}_y" if ky in x.columns else ky)
    return out.drop("_key").withColumnRenamed("_score", "score") if keep_score else out.drop("_key", "_score")
