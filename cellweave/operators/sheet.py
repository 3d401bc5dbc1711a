"""The analysis of one sheet in one task: the same steps as in ``structure``, over arrays.

Ordinary sheets are small, and all sheets of a task are handled in one call, so that the whole analysis is one shuffle by
sheet.  ``structure.analyze`` measures sheets first and takes its own way, by joins and windows, for larger ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np

from ..options import Options
from .lshape import opening

Cell = tuple[int, int]
Labels = dict[Cell, int]
Box = tuple[int, int, int, int]  # rows from, to, columns from, to


def components(cells: set[Cell]) -> Labels:
    """4-connected blocks, numbered by their leftmost column, then the topmost cell there."""
    out: Labels = {}
    number = 0
    for start in sorted(cells, key=lambda at: (at[1], at[0])):
        if start in out:
            continue
        number += 1
        out[start], todo = number, [start]
        while todo:
            r, c = todo.pop()
            for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if near in cells and near not in out:
                    out[near] = number
                    todo.append(near)
    return out


def members(labels: Labels) -> dict[int, list[Cell]]:
    out: dict[int, list[Cell]] = defaultdict(list)
    for at, gid in labels.items():
        out[gid].append(at)
    return out


def box_of(cells: list[Cell]) -> Box:
    rows, cols = [r for r, _ in cells], [c for _, c in cells]
    return min(rows), max(rows), min(cols), max(cols)


def boxes(labels: Labels) -> dict[int, Box]:
    return {gid: box_of(cells) for gid, cells in members(labels).items()}


def union(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])


def common(a: Box, b: Box) -> int:
    """Area that two boxes share."""
    return max(min(a[1], b[1]) - max(a[0], b[0]) + 1, 0) * max(min(a[3], b[3]) - max(a[2], b[2]) + 1, 0)


def area(b: Box) -> int:
    return (b[1] - b[0] + 1) * (b[3] - b[2] + 1)


class Headers:
    """Header cells, asked whether any lies in a box."""

    def __init__(self, cells: Labels):
        at = np.array(sorted(cells), np.int64).reshape(len(cells), 2)
        self.rows, self.cols = at[:, 0], at[:, 1]

    def inside(self, b: Box) -> bool:
        return bool(((self.rows >= b[0]) & (self.rows <= b[1]) & (self.cols >= b[2]) & (self.cols <= b[3])).any())


def impose(data: set[Cell], attr: set[Cell]) -> tuple[Labels, Labels, Labels]:
    """Data under an L of headers made headers; also the parts that data and headers form together."""
    data, attr = set(data), set(attr)
    parts = components(data | attr)
    for part in members(parts).values():
        d, a = [x for x in part if x in data], [x for x in part if x in attr]
        found = opening(box_of(part), np.array(a)) if d and a else None
        if found:
            size, (r0, r1, c0, c1) = found
            held = {(r, c) for r, c in d if r0 <= r <= r1 and c0 <= c <= c1}
            share = len(held) / len(d)
            if share > 0.8 or (share > 0.6 and size / area(box_of(part)) < 0.5):
                under = set(d) - held
                data -= under
                attr |= under
    return components(data), components(attr), parts


def renamed(labels: Labels, to: dict[int, int]) -> Labels:
    return {at: to.get(gid, gid) for at, gid in labels.items()}


def merge_fragments(data: Labels, attr: Labels, parts: Labels) -> Labels:
    heads = Headers(attr)
    held: dict[int, set[int]] = defaultdict(set)
    for at, gid in data.items():
        held[parts[at]].add(gid)
    box = boxes(data)
    to = {gid: min(gids) for gids in held.values() for gid in gids if gid != min(gids)}
    data = renamed(data, {gid: target for gid, target in to.items() if not heads.inside(union(box[gid], box[target]))})
    box = boxes(data)
    targets: dict[int, int] = {}
    for outline in boxes(parts).values():
        within = [g for g, b in box.items() if b[0] >= outline[0] and b[1] <= outline[1] and b[2] >= outline[2] and b[3] <= outline[3]]
        if len(within) >= 2:
            for gid in within:
                if gid != max(within):
                    targets[gid] = max(targets.get(gid, 0), max(within))
    return renamed(data, {gid: target for gid, target in targets.items() if not heads.inside(union(box[gid], box[target]))})


def representatives(cells: dict[int, list[Cell]]) -> dict[int, set[Cell]]:
    """First and last cell of each block on each row and each column."""
    out = {}
    for gid, own in cells.items():
        found, last = set(), None
        for axis in (0, 1):
            line = None
            for at in sorted(own) if axis == 0 else sorted(own, key=_turned):
                if at[axis] != line:
                    if last:
                        found.add(last)
                    found.add(at)
                    line = at[axis]
                last = at
            found.add(last)
        out[gid] = found
    return out


_turned = itemgetter(1, 0)


#: (data block, header block, direction) -> (distance, length of the facing side, blocks between, direction group)
Stats = dict[tuple[int, int, str], tuple[float, float, int, str]]


def axis_stats(d: dict[int, set[Cell]], a: dict[int, set[Cell]], penalty: float = 0.5) -> Stats:
    """Of representatives of data blocks and header blocks."""
    out: Stats = {}
    for axis, less, more, group in ((1, "N", "S", "NS"), (0, "W", "E", "WE")):
        lines_d, lines_a = lines_of(d, axis), lines_of(a, axis)
        found: dict[tuple[int, int, str], tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for line, own in lines_d.items():
            others = lines_a.get(line)
            if not others:
                continue
            spans = [(y[0], y[-1]) for _, y in others]
            for dg, x in own:
                for (ag, y), (low, high) in zip(others, spans):
                    for direction, near in ((less, nearest(x, y, -1) if low < x[-1] else ()), (more, nearest(x, y, 1) if high > x[0] else ())):
                        if not near:
                            continue
                        fars, between = found[dg, ag, direction]
                        for g0, g1 in near:
                            fars.append(g1 - g0)
                            if g1 - g0 > 1 and len(spans) > 1:
                                between.append(sum([h > g0 and lo < g1 for lo, h in spans]) - (high > g0 and low < g1))
        longest: dict[int, float] = defaultdict(float)
        part = {}
        for key, (fars, between) in found.items():
            dist = min(fars)
            side = sum([1 / (1 + penalty * (far - dist)) for far in sorted(fars)])
            part[key] = float(dist), side, max(between, default=0), group
            longest[key[0]] = max(longest[key[0]], side)
        out |= {key: (dist, side / longest[key[0]], between, g) for key, (dist, side, between, g) in part.items()}
    return out


def lines_of(blocks: dict[int, set[Cell]], axis: int) -> dict[int, list[tuple[int, list[int]]]]:
    """By line the blocks that have cells there, with their sorted places."""
    out: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for gid, cells in blocks.items():
        own: dict[int, list[int]] = defaultdict(list)
        for at in cells:
            own[at[axis]].append(at[1 - axis])
        for line, places in own.items():
            places.sort()
            out[line].append((gid, places))
    return out


def nearest(x: list[int], y: list[int], way: int) -> list[tuple[int, int]]:
    """Gaps from places x to the places y before (-1) or after (1) them: all that are equally short."""
    best, out = None, []
    for p in x:
        k = bisect_left(y, p) - 1 if way < 0 else bisect_right(y, p)
        if 0 <= k < len(y):
            q = y[k]
            far = abs(p - q)
            if best is None or far < best:
                best, out = far, []
            if far == best:
                out.append((p, q) if p < q else (q, p))
    return out


def corner_stats(data: dict[int, set[Cell]], attr: dict[int, set[Cell]], but: set[tuple[int, int]] = frozenset()) -> dict[tuple[int, int, str], float]:
    """Nearest distance of representatives that face each other over a corner, without the pairs of blocks ``but``."""
    d, a = ({g: np.array(sorted(x)) for g, x in blocks.items()} for blocks in (data, attr))
    out = {}
    for dg, x in d.items():
        for ag, y in a.items():
            if (dg, ag) in but:
                continue
            for at in range(0, len(y), 512):
                rows = y[None, at : at + 512, 0] - x[:, 0, None]
                cols = y[None, at : at + 512, 1] - x[:, 1, None]
                square = rows * rows + cols * cols
                for name, where in (("NW", (rows < 0) & (cols < 0)), ("NE", (rows < 0) & (cols > 0)), ("SW", (rows > 0) & (cols < 0)), ("SE", (rows > 0) & (cols > 0))):
                    if where.any():
                        far = float(np.sqrt(square[where].min()))
                        out[dg, ag, name] = min(out.get((dg, ag, name), far), far)
    return out


def best_of_group(stats: Stats, open_only: bool) -> Stats:
    """Per data block and direction group the longest sides, of these the nearest."""
    groups: dict[tuple[int, str], list] = defaultdict(list)
    for key, value in stats.items():
        if not open_only or value[2] == 0:
            groups[key[0], value[3]].append((key, value))
    out: Stats = {}
    for found in groups.values():
        longest = max(v[1] for _, v in found)
        long = [(k, v) for k, v in found if v[1] >= longest - 1e-12]
        nearest = min(v[0] for _, v in long)
        out |= {k: v for k, v in long if v[0] == nearest}
    return out


def info_cells(data: Labels, attr: dict[int, list[Cell]], pairs: set[tuple[int, int]]) -> dict[int, list[Cell]]:
    """A data block's cells and those of its headers."""
    own = {gid: set(cells) for gid, cells in members(data).items()}
    for dg, ag in pairs:
        if dg in own:
            own[dg] |= set(attr.get(ag, ()))
    return {gid: sorted(cells) for gid, cells in own.items()}


def linked(pairs: set[tuple[int, int]]) -> dict[int, int]:
    """Smallest label of the group that pairs link together."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def merge_blocks(data: Labels, attr: Labels, major: Stats, options: Options) -> tuple[Labels, Stats]:
    heads = Headers(attr)
    own = boxes(data)
    info = {g: box_of(cells) for g, cells in info_cells(data, members(attr), {k[:2] for k in major}).items()}
    gids = sorted(info)
    same, seen = set(), []
    for i, x in enumerate(gids):
        for y in gids[i + 1 :]:
            if info[x] == info[y]:
                same.add((y, x))
            elif common(info[x], info[y]):
                seen += [(y, x, common(info[x], own[y]) / area(own[y]), common(info[x], info[y]) / area(info[y]))]
                seen += [(x, y, common(info[y], own[x]) / area(own[x]), common(info[y], info[x]) / area(info[x]))]
    most: dict[int, tuple[float, float]] = {}
    for gid, _, share, fallback in seen:
        most[gid] = max(most.get(gid, (0.0, 0.0)), (share, 0.0 if share else fallback))
    chosen = {(gid, target) for gid, target, share, fallback in seen if (share, 0.0 if share else fallback) == most[gid]}
    free = lambda pair: not heads.inside(union(own[pair[0]], own[pair[1]]))
    kept = {pair for pair in chosen | same if free(pair)}
    if not options.check_entrapment_on_full_overlap:
        kept |= same
    if not kept:
        return data, major
    to = linked(kept)
    merged: Stats = {}
    for (dg, ag, direction), (dist, side, between, group) in major.items():
        key = to.get(dg, dg), ag, direction
        old = merged.get(key, (dist, side, between, group))
        merged[key] = min(old[0], dist), max(old[1], side), max(old[2], between), group
    return renamed(data, to), best_of_group(merged, False)


def minor_links(data: Labels, attr: Labels, major: Stats) -> set[tuple[int, int]]:
    """Headers without a data block go to the nearest one with its headers, corners included."""
    every = members(attr)
    taken = {k[1] for k in major}
    rest = {g: cells for g, cells in every.items() if g not in taken}
    if not rest:
        return set()
    info, rest = representatives(info_cells(data, every, {k[:2] for k in major})), representatives(rest)
    axis = axis_stats(info, rest)
    facing = {k[:2] for k in axis}
    found = [(ag, dist, -side, dg, direction) for (dg, ag, direction), (dist, side, _, _) in axis.items()]
    found += [(ag, dist, 0.0, dg, direction) for (dg, ag, direction), dist in corner_stats(info, rest, facing).items()]
    out, done = set(), set()
    for ag, _, _, dg, _ in sorted(found):
        if ag not in done:
            done.add(ag)
            out.add((dg, ag))
    return out


def dense(keys: dict) -> dict:
    """Dense rank of each item by its sort key."""
    place = {key: k for k, key in enumerate(sorted(set(keys.values())), 1)}
    return {item: place[key] for item, key in keys.items()}


#: Header of a block: its name, cells, orientation tag and the name people read.
Head = tuple[str, list[Cell], str, str]


def block_headers(gid: int, own: list[Cell], linked_cells: set[Cell], lines: dict[int, list[int]], options: Options) -> list[Head]:
    """Headers of one block.  ``lines`` has the columns of all header cells of the sheet by row.

    Each header row above or below a block, each header column beside it, and each corner cell is a header of its own;
    headers enclosed by the box of the block and its headers are taken in.
    """
    cells = set(own)
    r0, r1, c0, c1 = b = box_of(own)
    outline = union(b, box_of(list(linked_cells))) if linked_cells else b
    found = set(linked_cells)
    for r in range(outline[0], outline[1] + 1) if outline[1] - outline[0] < len(lines) else sorted(lines):
        if r in lines and outline[0] <= r <= outline[1]:
            found.update([(r, c) for c in lines[r] if outline[2] <= c <= outline[3]])
    groups: dict[tuple[str, int], list[Cell]] = defaultdict(list)
    corners: dict[str, list[tuple[float, int, str, Cell]]] = defaultdict(list)
    for at in found - cells:
        r, c = at
        if c0 <= c <= c1:  # inside the box it heads the cells below, or in the last row those to the right
            if r < r1:
                groups["N", r].append(at)
            elif r > r1:
                groups["S", r].append(at)
            else:
                groups["W", c].append(at)
        elif r0 <= r <= r1:
            groups["W" if c < c0 else "E", c].append(at)
        else:
            dr, dc = r0 - r if r < r0 else r - r1, c0 - c if c < c0 else c - c1
            corners[("N" if r < r0 else "S") + ("W" if c < c0 else "E")].append((math.sqrt(dr * dr + dc * dc), r, f"{r}:{c}", at))
    rows, cols = {r for r, _ in own}, {c for _, c in own}
    made = {}
    by_direction: dict[str, list] = defaultdict(list)
    for (direction, line), at in groups.items():
        far = {"N": r0 - line, "S": line - r1, "W": c0 - line, "E": line - c1}[direction]
        by_direction[direction].append((float(far), line, str(line), at))
    for direction, spots in by_direction.items():
        ns = direction in "NS"
        side = "long" if (len(rows) <= len(cols)) == ns else "short"
        for rank, (far, _, mark, at) in enumerate(sorted(spots), 1):
            h = box_of(at)
            cover = len({c for _, c in at} & cols) / len(cols) if ns else len({r for r, _ in at} & rows) / len(rows)
            if len(at) == 1:
                tag = "direct"
            elif ns:
                tag = "v" if cover >= 1 else "vl" if options.reduced_orientations or h[2] <= b[2] else "vr" if h[3] >= b[3] else "vm"
            else:
                tag = "h" if cover >= 1 else "hu" if options.reduced_orientations or h[0] <= b[0] else "hd" if h[1] >= b[1] else "hm"
            made[f"ad{gid}_{direction}_{rank}"] = direction, at, tag, (-cover, far, mark), "high" if cover >= 1 else "mid", side
    kinds: dict[tuple[str, str], list[str]] = defaultdict(list)
    for name, v in made.items():
        kinds[v[4], v[5]].append(name)
    both = any(v[4] == "high" and v[0] in "NS" for v in made.values()) and any(v[4] == "high" and v[0] in "WE" for v in made.values())
    same: dict[str, list[str]] = defaultdict(list)
    for (level, side), names in kinds.items():
        places = dense({name: made[name][3] for name in names})
        plain = both and level == "high" and len(names) == 1
        for name in names:
            same[f"{level}_{side}" if plain else f"{level}_{side}_{places[name]}"].append(name)
    out = []
    for nice, names in same.items():
        for k, name in enumerate(sorted(names, key=lambda x: (made[x][0] not in ("N", "W"), x)), 1):
            out.append((name, made[name][1], made[name][2], nice if len(names) == 1 else f"{nice}_{k}"))
    # corner cells differ in their marks, so that none share a place
    named = {at: f"ad{gid}_{direction}_{k}" for direction, spots in corners.items() for k, (_, _, _, at) in enumerate(sorted(spots), 1)}
    tag = "nothing" if options.delink_corner_headers else "direct"
    nearest = sorted((far, mark, at) for spots in corners.values() for far, _, mark, at in spots)
    out += [(named[at], [at], tag, f"low_short_{k}") for k, (_, _, at) in enumerate(nearest, 1)]
    return out if options.derive_nice_names else [(name, at, tag, name) for name, at, tag, _ in out]


def all_headers(data: Labels, attr: Labels, links: set[tuple[int, int]], options: Options) -> Iterator[tuple[int, list[Cell], list[Head]]]:
    """Each block with its cells and its headers."""
    every, lines = members(attr), defaultdict(list)
    for r, c in attr:
        lines[r].append(c)
    linked_cells: dict[int, set[Cell]] = defaultdict(set)
    for dg, ag in links:
        linked_cells[dg].update(every[ag])
    for gid, own in sorted(members(data).items()):
        yield gid, own, block_headers(gid, own, linked_cells[gid], lines, options)


def headers(data: Labels, attr: Labels, links: set[tuple[int, int]], options: Options) -> list[tuple[int, str, Cell, str, str]]:
    """Block, header, address, orientation tag and name of each header cell."""
    return [(gid, name, x, tag, nice) for gid, _, made in all_headers(data, attr, links, options) for name, at, tag, nice in made for x in at]


def served(tag: str, places: list[int], line: int) -> int | None:
    """The position (of sorted ``places``) that serves a line, as in ``attach.served``."""
    k = bisect_right(places, line)
    before = places[k - 1] if k else None
    if before == line:
        return before
    after = places[k] if k < len(places) else None
    kind = tag[1:2]
    if kind in ("l", "u"):
        return before
    if kind in ("r", "d"):
        return after
    if kind != "m":
        return None
    return before if after is None else after if before is None or 2 * line >= before + after else before


#: Characters that a JSON text escapes, as Spark writes them.
_ESCAPED = {k: f"\\u{k:04X}" for k in range(32)} | {ord(k): f"\\{v}" for k, v in zip('"\\\b\t\n\f\r', '"\\btnfr')}
_SPECIAL = re.compile(r'[\x00-\x1f"\\]')


def quoted(text: str) -> str:
    return f'"{text.translate(_ESCAPED) if _SPECIAL.search(text) else text}"'


def compose(own: list[Cell], made: list[Head], values: dict[Cell, list[str | None]], as_json: bool = False) -> Iterator[tuple[Cell, list[str], list[str]]]:
    """Each cell of a block with the names of the headers that reach it, in order, and their texts.

    As JSON there are no names, and the texts are members of an object (one or several each).
    """
    by_name: dict[str, list[tuple[str, list[Cell]]]] = defaultdict(list)
    for _, at, tag, nice in made:
        if tag != "nothing":
            by_name[nice].append((tag, at))
    lines = [sorted({x[axis] for x in own}) for axis in (0, 1)]
    names: list[str] = []
    fixed: list[str | None] = []  # a text for all cells, or None
    varied: list[tuple[int, int, dict]] = []  # place of a name, axis, text by line
    several = []  # names of more than one header
    joins = False
    for name in sorted(by_name):
        tell = (lambda texts, key=quoted(name): f"{key}:{quoted(joined(texts))}") if as_json else joined
        heads = by_name[name]
        if len(heads) == 1 and heads[0][0] == "direct":
            text = tell([x for cell in heads[0][1] for x in values[cell]])
            if joins:
                fixed[-1] = f"{fixed[-1]},{text}"
            else:
                names.append(name)
                fixed.append(text)
                joins = as_json
            continue
        joins = False
        found: dict[int | None, dict[int | None, set]] = defaultdict(lambda: defaultdict(set))
        for tag, at in heads:
            if tag == "direct":
                found[None][None].update(x for cell in at for x in values[cell])
                continue
            axis = 1 if tag[0] == "v" else 0
            texts = defaultdict(list)
            for cell in at:
                texts[cell[axis]] += values[cell]
            places = sorted(texts)
            for line in lines[axis]:
                position = served(tag, places, line)
                if position is not None:
                    found[axis][line].update(texts[position])
        if not found:
            continue
        place = len(names)
        names.append(name)
        fixed.append(None)
        if len(found) > 1:
            several.append((place, tell, found))
            continue
        for axis, parts in found.items():
            if axis is None:
                fixed[place] = tell(parts[None])
            else:
                varied.append((place, axis, {line: tell(texts) for line, texts in parts.items()}))
    for cell in own:
        texts = fixed.copy()
        whole = True
        for place, axis, told in varied:
            texts[place] = text = told.get(cell[axis])
            whole = whole and text is not None
        for place, tell, found in several:
            reached = [parts[line] for axis, parts in found.items() for line in [None if axis is None else cell[axis]] if line in parts]
            texts[place] = tell(set().union(*reached)) if reached else None
            whole = whole and bool(reached)
        if whole:
            yield cell, names, texts
        else:
            kept = [k for k, text in enumerate(texts) if text is not None]
            yield cell, [names[k] for k in kept], [texts[k] for k in kept]


def joined(texts: Iterable[str | None]) -> str:
    """Distinct texts of one header in order."""
    return " ".join(sorted({x for x in texts if x is not None}))


def analyze(row: np.ndarray, col: np.ndarray, poa: np.ndarray, pov: np.ndarray, numeric: np.ndarray, options: Options) -> tuple[Labels, Labels, set[tuple[int, int]]]:
    """Data blocks, header blocks and the links between them of a sheet's cells."""
    known = ~(np.isnan(poa) | np.isnan(pov)) & (poa + pov > 0)
    at = list(zip(row.tolist(), col.tolist()))
    data = {at[i] for i in np.flatnonzero(known & (pov >= 0.5))}
    attr = {at[i] for i in np.flatnonzero(known & (poa >= 0.5))}
    if not data or not attr:
        return {}, {}, set()
    blocks, heads, parts = impose(data, attr)
    blocks = merge_fragments(blocks, heads, parts)
    major = best_of_group(axis_stats(representatives(members(blocks)), representatives(members(heads))), True)
    blocks, major = merge_blocks(blocks, heads, major, options)
    links = {k[:2] for k in major} | minor_links(blocks, heads, major)
    if options.single_block_filter:
        plain = {at[i] for i in np.flatnonzero(numeric)}
        held = {g: sum(x in plain for x in cells) for g, cells in members(blocks).items()}
        total = sum(held.values())
        main = {g for g, n in held.items() if total and n / total > options.single_block_share}
        if main:
            blocks = {x: g for x, g in blocks.items() if g in main}
    number = {g: k for k, g in enumerate(sorted(set(blocks.values())), 1)}
    return renamed(blocks, number), heads, {(number[dg], ag) for dg, ag in links if dg in number}
