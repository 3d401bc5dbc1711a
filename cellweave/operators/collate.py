"""Frames of different columns united by what their columns hold.

Of each column only a small profile is compared: its distinct lower-cased values, or the ten with the smallest hashes
where there are more than 500; profiles of united columns follow from those of the parts.  Frames are folded widest
first; the columns of the best-scoring pairs are united, those without a counterpart stay apart.  Equal rows collapse
unless ``keep_duplicates``.  ``collate`` takes whole frames, ``collate_blocks`` any number of composed blocks.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import Workspace

#: Distinct values up to which a profile holds all of them, and how many it holds otherwise.
PROFILE, SAMPLE = 500, 10
#: Weights of shared values, shared words, shared words by length, shared letters, and edit similarity.
WEIGHTS = (0.4, 0.3, 0.2, 0.05, 0.05)


#: Frames that one task folds; what they make is folded further in the same way.
FOLD = 64

#: A column's profile: (hash, value) in order, and whether it is a sample.
Profile = tuple[list[tuple[int, str]], bool]


def _profiled(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys…, n, values`` (array of hash and value) of the distinct values (keys, value) of columns of any size."""
    spread = values.select(*keys, "value").distinct().withColumn("h", F.xxhash64("value").bitwiseAND(F.lit((1 << 62) - 1)))
    sizes = spread.groupBy(*keys).agg(F.count("*").alias("n"))
    # of a large column about six times the sample pass, of which the smallest are taken
    few = spread.join(sizes, keys).filter((F.col("n") <= PROFILE) | (F.col("h") < F.lit(float(1 << 62)) * (6 * SAMPLE) / F.col("n")))
    held = few.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("values"))
    return held.withColumn("values", F.when(F.col("n") <= PROFILE, F.col("values")).otherwise(F.slice("values", 1, SAMPLE)))


def united(a: Profile, b: Profile) -> Profile:
    values = sorted(set(a[0]) | set(b[0]))
    big = a[1] or b[1] or len(values) > PROFILE
    return (values[:SAMPLE] if big else values), big


def profiles(df: DataFrame, columns: list[str]) -> dict[str, Profile]:
    """Profile of each column: at most ``PROFILE`` values a column come to the driver."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.trim(F.col(f"`{c}`").cast("string"))).alias("value")) for c in columns]))
    values = df.select(pairs.alias("p")).select("p.*").filter("value is not null and value <> ''")
    out: dict[str, Profile] = {c: ([], False) for c in columns}
    for column, n, held in _profiled(values, ["column"]).collect():
        out[column] = [(h, v) for h, v in held], n > PROFILE
    return out


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(lengths.max(initial=0))), -1, np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out, lengths


def edit_similarity(x: list[str], y: list[str]) -> float:
    """Mean of 1 - distance / longer length over all pairs, the distances of all pairs computed at once."""
    (a, la), (b, lb) = _coded(x), _coded(y)
    row = np.repeat(np.arange(b.shape[1] + 1, dtype=np.int32)[:, None, None], len(x), 1).repeat(len(y), 2)
    far = np.where(la[:, None] == 0, lb[None, :], 0).astype(np.int32)
    for i in range(a.shape[1]):
        left, now = row[0].copy(), np.empty_like(row)
        now[0] = i + 1
        for j in range(b.shape[1]):
            now[j + 1] = np.minimum(np.minimum(row[j + 1], now[j]) + 1, left + (a[:, i, None] != b[None, :, j]))
            left = row[j + 1]
        row = now
        done = np.flatnonzero(la == i + 1)
        far[done] = row[:, done, :][lb, :, np.arange(len(y))].T if len(done) else far[done]
    return float((1 - far / np.maximum(np.maximum(la[:, None], lb[None, :]), 1)).mean())


def _shares(x: set[str], y: set[str]) -> float:
    """All of the similarity but its edit part."""
    wx, wy = {w for v in x for w in v.split()}, {w for v in y for w in v.split()}
    cx, cy = {ch for v in x for ch in v}, {ch for v in y for ch in v}
    share = lambda p, q: len(p & q) / len(p | q) if p | q else 0.0
    long = lambda ws: sum(map(len, ws))
    by_length = long(wx & wy) / long(wx | wy) if wx | wy else 0.0
    return sum(w * s for w, s in zip(WEIGHTS, (share(x, y), share(wx, wy), by_length, share(cx, cy))))


def similarity(a: list[str], b: list[str]) -> float:
    """How alike two columns are by their representative values, from 0 to 1."""
    x, y = set(a), set(b)
    return _shares(x, y) + WEIGHTS[-1] * edit_similarity(sorted(x), sorted(y)) if x and y else 0.0


def best_pairs(a: dict[str, Profile], b: dict[str, Profile], threshold: float) -> list[tuple[str, str]]:
    """Best pairs first, equal ones by name; a column is used once.

    Edit similarity is computed only of pairs whose other parts could still make them the best.
    """
    texts = {id(p): [v for _, v in p[0]] for p in [*a.values(), *b.values()]}
    queue = []
    for x, p in a.items():
        for y, q in b.items():
            if p[0] and q[0]:
                shares = _shares(set(texts[id(p)]), set(texts[id(q)]))
                heapq.heappush(queue, (-shares - WEIGHTS[-1], x, y, False))
    used_a, used_b, out = set(), set(), []
    while queue:
        score, x, y, exact = heapq.heappop(queue)
        if x in used_a or y in used_b:
            continue
        if not exact:
            edit = edit_similarity(sorted(texts[id(a[x])]), sorted(texts[id(b[y])]))
            heapq.heappush(queue, (score + WEIGHTS[-1] * (1 - edit), x, y, True))
        elif -score > threshold:
            used_a.add(x)
            used_b.add(y)
            out.append((x, y))
    return out


def collate(frames: list[DataFrame], fixed: list[str] = (), threshold: float = 0.0, keep_duplicates: bool = False) -> DataFrame:
    """One frame of all: ``fixed`` columns, ``collated_<i>``, ``uncollated_<i>``; a single frame stays as it is."""
    if len(frames) == 1:
        return frames[0]
    order = sorted(range(len(frames)), key=lambda i: (-len(frames[i].columns), i))
    out = frames[order[0]]
    held = profiles(out, [c for c in out.columns if c not in fixed])
    matched: Counter = Counter()
    for step, i in enumerate(order[1:]):
        frame = frames[i]
        own = profiles(frame, [c for c in frame.columns if c not in fixed])
        pairs = best_pairs(held, own, threshold)
        names = {y: x for x, y in pairs}
        rest = {c: f"{c}__{step}" for c in own if c not in names}
        frame = frame.withColumnsRenamed(names | rest)
        matched.update(x for x, _ in pairs)
        held |= {rest[c]: own[c] for c in rest} | {x: united(held[x], own[y]) for x, y in pairs}
        out = out.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in out.columns]).unionByName(frame.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in frame.columns]), allowMissingColumns=True)
    loose = [c for c in out.columns if c not in fixed]
    joined, apart = [c for c in loose if matched[c]], [c for c in loose if not matched[c]]
    out = out.withColumnsRenamed({c: f"collated_{k}" for k, c in enumerate(joined, 1)} | {c: f"uncollated_{k}" for k, c in enumerate(apart, 1)})
    return out if keep_duplicates else out.distinct()


def constant_info(collated: DataFrame, block: list[str]) -> DataFrame:
    """``uncollated_`` columns with at most one value in every block become ``info_`` columns."""
    loose = [c for c in collated.columns if c.startswith("uncollated_")]
    if not loose:
        return collated
    counts = collated.groupBy(*block).agg(*[F.count_distinct(c).alias(c) for c in loose]).agg(*[F.max(c).alias(c) for c in loose]).first()
    infos = [c for c in loose if (counts[c] or 0) <= 1]
    kept = [c for c in loose if c not in infos]
    return collated.withColumnsRenamed({c: f"info_{k}" for k, c in enumerate(infos, 1)} | {c: f"uncollated_{k}" for k, c in enumerate(kept, 1)})


def ordered(collated: DataFrame, fixed: list[str] = (), value: str = "value") -> DataFrame:
    """Columns renumbered within their prefix, least distinct and fullest first; natural order, value last."""
    groups: dict[str, list[str]] = {}
    for c in collated.columns:
        if c not in fixed and c != value:
            groups.setdefault(c.split("_")[0], []).append(c)
    loose = [c for cs in groups.values() for c in cs]
    if not loose:
        return collated
    held = collated.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(loose)], *[F.count(c).alias(f"v{i}") for i, c in enumerate(loose)]).first()
    stats = {c: (held[f"v{i}"], held[f"d{i}"] + (held[f"v{i}"] < held["_n"])) for i, c in enumerate(loose)}  # null is a value too
    score = {}
    for cs in groups.values():
        most, widest = max(max(stats[c][0] for c in cs), 1), max(max(stats[c][1] for c in cs), 1)
        score |= {c: 0.4 * (1 - stats[c][1] / widest) + 0.8 * stats[c][0] / most for c in cs}
    names, final = {}, []
    for prefix in sorted(groups):
        for k, c in enumerate(sorted(groups[prefix], key=lambda c: (-score[c], groups[prefix].index(c))), 1):
            names[c] = f"{prefix}_{k}"
            final.append((prefix, k, c))
    tail = [value] if value in collated.columns else []
    return collated.select(*[F.col(c) for c in fixed if c in collated.columns], *[F.col(c).alias(names[c]) for _, _, c in final], *tail)


def fold(frames: dict[int, dict[str, Profile]], threshold: float) -> tuple[dict[tuple[int, str], str], dict[str, Profile]]:
    """New column of each (frame, column), and the profiles of the new columns."""
    order = sorted(frames, key=lambda k: (-len(frames[k]), k))
    names: dict[tuple[int, str], str] = {}
    held: dict[str, Profile] = {}
    for k in order:
        own = frames[k]
        to = {y: x for x, y in best_pairs(held, own, threshold)}
        for c in sorted(own):
            if c in to:
                held[to[c]] = united(held[to[c]], own[c])
            else:
                to[c] = f"c{len(held)}"
                held[to[c]] = own[c]
            names[k, c] = to[c]
    return names, held


def _fold_level(columns: DataFrame, unit: list[str], threshold: float) -> DataFrame:
    """``unit…, node, column, up, new`` and (``node`` null) ``unit…, up, new, values, big`` of one level of folding."""
    import pandas as pd
    from pyspark.sql import types as T

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frames: dict[int, dict[str, Profile]] = {}
        for node, column, values, big in zip(pdf["node"], pdf["column"], pdf["values"], pdf["big"]):
            frames.setdefault(int(node), {})[column] = [(int(v["h"]), v["value"]) for v in values], bool(big)
        names, held = fold(frames, threshold)
        rows = [(k, c, new, None, None) for (k, c), new in names.items()]
        rows += [(None, None, new, [{"h": h, "value": v} for h, v in values], big) for new, (values, big) in held.items()]
        made = pd.DataFrame(rows, columns=["node", "column", "new", "values", "big"])
        made["node"] = pd.array([r[0] for r in rows], dtype="Int64")  # as they are: floats would round them
        for c in [*unit, "up"]:
            made[c] = pdf[c].iloc[0]
        return made

    fields = {f.name: f for f in columns.schema.fields}
    schema = T.StructType([fields["node"], fields["column"], T.StructField("new", T.StringType()), fields["values"], fields["big"], *[fields[c] for c in unit], T.StructField("up", T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return columns.groupBy(*unit, "up").applyInPandas(run, schema)


def collate_blocks(composed: DataFrame, unit: list[str], block: list[str], threshold: float = 0.0, keep_duplicates: bool = False) -> DataFrame:
    """Composed rows (``block``, row, col, value, attr) with the names in ``attr`` replaced by ``collated_``,
    ``uncollated_`` and ``info_`` numbers: columns of the blocks of a ``unit`` that hold alike are one.

    Names of headers say nothing, only what stands under them counts.  Each column is profiled once, wherever its rows
    lie; then ``FOLD`` blocks a task are folded, and what they make again, until a unit is one.  A unit of one block
    keeps its names, renumbered.  Without ``keep_duplicates`` addresses go and equal rows collapse.
    """
    work = Workspace(composed.sparkSession, "collate")
    named = composed.withColumn("_block", F.xxhash64(*block))
    cells = named.select(*unit, "_block", F.explode("attr").alias("column", "text"))
    values = cells.select(*unit, "_block", "column", F.lower(F.trim("text")).alias("value")).filter("value <> ''")
    profile = work.write(_profiled(values, [*unit, "_block", "column"]))
    empty = F.array().cast(profile.schema["values"].dataType)
    every = cells.select(*unit, "_block", "column").distinct().join(profile, [*unit, "_block", "column"], "left")
    nodes = work.write(every.select(*unit, F.col("_block").alias("node"), "column", F.coalesce("values", empty).alias("values"), F.coalesce(F.col("n") > PROFILE, F.lit(False)).alias("big"), F.coalesce("n", F.lit(0)).alias("n")))
    steps: list[DataFrame] = []
    level = nodes.drop("n")
    while True:
        counts = level.groupBy(*unit).agg(F.count_distinct("node").alias("_nodes"))
        chunk = F.pmod("node", F.ceil(F.col("_nodes") / FOLD)).cast("bigint")
        made = work.write(_fold_level(level.join(counts, unit).withColumn("up", chunk).drop("_nodes"), unit, threshold))
        steps.append(made.filter("node is not null").select(*unit, "node", "column", "up", "new"))
        level = made.filter("node is null").select(*unit, F.col("up").alias("node"), F.col("new").alias("column"), "values", "big")
        if level.groupBy(*unit).agg(F.count_distinct("node").alias("k")).filter("k > 1").isEmpty():
            break
    place = steps[0]
    for step in steps[1:]:
        upper = step.select(*unit, F.col("node").alias("up"), F.col("column").alias("new"), F.col("up").alias("_up"), F.col("new").alias("_new"))
        place = place.join(upper, [*unit, "up", "new"]).select(*unit, "node", "column", F.col("_up").alias("up"), F.col("_new").alias("new"))
    place = place.join(nodes.select(*unit, "node", "column", "n"), [*unit, "node", "column"])
    shared = place.groupBy(*unit, "new").agg(F.count("*").alias("_k"), F.max("n").alias("_n"))
    alone = nodes.groupBy(*unit).agg((F.count_distinct("node") == 1).alias("_alone"))
    prefix = F.when(F.col("_alone"), F.substring_index("column", "_", 1)).when(F.col("_k") > 1, "collated").when(F.col("_n") <= 1, "info").otherwise("uncollated")
    place = work.write(place.join(shared, [*unit, "new"]).join(alone, unit).withColumn("prefix", prefix).select(*unit, F.col("node").alias("_block"), "column", "new", "prefix"))
    # columns of a unit and prefix are numbered, the fullest and least distinct first
    total = named.groupBy(*unit).agg(F.count("*").alias("_rows"))
    seen = cells.join(place, [*unit, "_block", "column"])
    stats = seen.groupBy(*unit, "prefix", "new", "text").agg(F.count("*").alias("c")).groupBy(*unit, "prefix", "new").agg(F.sum("c").alias("vals"), F.count("*").alias("kinds"))
    stats = stats.join(total, unit).withColumn("kinds", F.col("kinds") + (F.col("vals") < F.col("_rows")).cast("int"))
    w = Window.partitionBy(*unit, "prefix")
    score = F.round(0.4 * (1 - F.col("kinds") / F.max("kinds").over(w)) + 0.8 * F.col("vals") / F.max("vals").over(w), 12)
    ranked = stats.withColumn("_s", score).withColumn("_at", F.row_number().over(w.orderBy(F.desc("_s"), F.substring("new", 2, 9).cast("int"))))
    final = place.join(ranked.select(*unit, "prefix", "new", F.concat_ws("_", "prefix", "_at").alias("name")), [*unit, "prefix", "new"])
    names = final.groupBy(*unit, "_block").agg(F.map_from_entries(F.collect_list(F.struct("column", "name"))).alias("_names"))
    out = named.join(names, [*unit, "_block"], "left").withColumn("_attr", F.array_sort(F.transform(F.map_entries("attr"), lambda e: F.struct(F.col("_names")[e["key"]].alias("key"), e["value"].alias("value")))))
    kept = [*block, *(["row", "col"] if keep_duplicates else []), "value", "_attr"]
    out = out.select(*kept)
    return (out if keep_duplicates else out.distinct()).withColumn("attr", F.map_from_entries("_attr")).drop("_attr")
