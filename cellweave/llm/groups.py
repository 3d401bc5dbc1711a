"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponentially distributed shift; clusters start growing from their centre at minus
that shift, one hop per unit of time, and a vertex joins the cluster that reaches it first.  Clusters then
contract to super-vertices, the edges between clusters form the next, smaller graph, and the procedure
recurses until no edge is left.  Composing the assignments of all levels from the last to the first gives
each vertex its component.

A level is a fixed number of join + grouped-minimum steps over its edges, so nothing is ever gathered by
component: a component of a third of all vertices is just rows.  The grouped minimum combines map-side
(a hub with many edges sends one row per map task) and the joins from edges to vertex states have one row per
key on one side, so a hub's partition can be split by adaptive skew handling.  States and edges are written
to the shared folder each level; a lost executor re-reads them.

Defined results: links with a null or unknown end, links of a cell to itself, and null gids match nothing;
repeated and reversed links count once; if several cell_ids share an address a link to it names them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Workspace

#: Rate of the exponential shifts. Were clusters to grow to the end, an edge would stay between two of them with
#: probability of about 1 - exp(-rate).
RATE = 0.05
#: Hops that clusters grow in a level; a vertex not reached by then keeps what reached it so far. Three hops leave about a
#: quarter of the edges of a long path between clusters; more hops would leave fewer, at one join over the edges each.
HOPS = 3


def matches(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Edges ``u < v`` between cell_ids: links by address, and equal gids inside a sheet."""
    where = ["sheet", "row", "col"]
    cell = cells.select("cell_id", F.col("sheet_id").alias("sheet"), "row", "col").dropna()
    a, b = (F.struct(*[F.col(f"{'sheet' if c == 'sheet' else c}_{end}").alias(c) for c in where]) for end in "ab")
    pairs = (
        links.dropna(subset=[f"{c}_{end}" for c in where for end in "ab"])
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .filter("a <> b")
        .select(*[F.col(f"{end}.{c}").alias(f"{c}_{end}") for end in "ab" for c in where])
        .distinct()
    )
    for end, name in (("a", "u"), ("b", "v")):
        at = cell.select(F.col("cell_id").alias(name), *[F.col(c).alias(f"{c}_{end}") for c in where])
        pairs = pairs.join(at, [f"{c}_{end}" for c in where]).drop(*[f"{c}_{end}" for c in where])
    labelled = cells.filter("gid is not null and sheet_id is not null and cell_id is not null").select("cell_id", "sheet_id", "gid")
    first = labelled.groupBy("sheet_id", "gid").agg(F.min("cell_id").alias("u"), F.max("cell_id").alias("top")).filter("u < top").drop("top")
    stars = labelled.join(first, ["sheet_id", "gid"]).select("u", F.col("cell_id").alias("v"))
    return _edges(pairs.select("u", "v").unionByName(stars))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _shift(vertex: Column, level: int, rate: float) -> Column:
    """Exponential draw of a vertex at a level, the same whenever it is computed."""
    bits = F.shiftrightunsigned(F.xxhash64(vertex, F.lit(level)), 11)
    return -F.log((bits + F.lit(1)) / F.lit(float(1 << 53))) / F.lit(rate)


def decompose(edges: DataFrame, level: int, rate: float = RATE, hops: int = HOPS) -> DataFrame:
    """``vertex, centre`` of one level of growing clusters over ``edges`` (u, v)."""
    ends = edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))

    def settle(reached: DataFrame) -> DataFrame:
        return reached.groupBy("vertex").agg(F.min("t").alias("t"), F.min_by("centre", "t").alias("centre"))

    own = -_shift(F.col("dst"), level, rate)
    first = ends.select(F.col("dst").alias("vertex"), (1 - _shift(F.col("src"), level, rate)).alias("t"), F.col("src").alias("centre"))
    state = settle(first).select(
        "vertex",
        F.least(F.col("t"), -_shift(F.col("vertex"), level, rate)).alias("t"),
        F.when(F.col("t") < -_shift(F.col("vertex"), level, rate), F.col("centre")).otherwise(F.col("vertex")).alias("centre"),
    )
    for _ in range(hops - 1):
        sent = ends.join(state.withColumnRenamed("vertex", "src"), "src").select(F.col("dst").alias("vertex"), (F.col("t") + 1).alias("t"), "centre")
        state = settle(sent.unionByName(state))
    return state.select("vertex", "centre")


def contract(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Edges between the clusters of ``state``."""
    out = edges
    for end in "uv":
        out = out.join(state.select(F.col("vertex").alias(end), F.col("centre").alias(f"c{end}")), end).drop(end).withColumnRenamed(f"c{end}", end)
    return _edges(out)


def components(edges: DataFrame, rate: float = RATE, hops: int = HOPS) -> DataFrame:
    """``vertex, component`` of every vertex with an edge; component is the smallest vertex in it."""
    work = Workspace(edges.sparkSession, "groups")
    edges = work.write(_edges(edges) if set(edges.columns) != {"u", "v"} else edges)
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        state = work.write(decompose(edges, len(levels), rate, hops))
        levels.append(state)
        smaller = work.write(contract(edges, state))
        work.drop(edges)
        edges = smaller
    if not levels:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    out = levels.pop()
    while levels:
        upper = out.select(F.col("vertex").alias("centre"), F.col("centre").alias("_root"))
        out = levels.pop().join(upper, "centre", "left").select("vertex", F.coalesce("_root", "centre").alias("centre"))
    out = work.write(out)
    least = out.groupBy("centre").agg(F.min("vertex").alias("component"))
    return out.join(least, "centre").select("vertex", "component")


def cell_groups(cells: DataFrame, links: DataFrame) -> DataFrame:
    """``cell_id, group_id`` of each cell that is linked to another, group_id the smallest cell_id."""
    found = components(matches(cells, links))
    return found.select(F.col("vertex").alias("cell_id"), F.col("component").alias("group_id"))
