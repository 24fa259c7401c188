"""Bounded walks, reachability and paths.

Walks go level by level: the frontier is joined with the edges of the kinds in
question, and each level is checkpointed, so that no level is computed twice
and the plan of a deep walk stays as short as that of a shallow one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.plans.iterate import cut, union
from symgrove.sources.derived import Graph

ARROW = " -> "
#: Ids of a frontier up to which it is sent to where the edges are read, in place of all edges to where it is.
BROADCAST_IDS = 1 << 18


def _steps(g: Graph, forward: bool, kinds: list[str]) -> DataFrame:
    """(here, id, call_line, name, kind, ...): each edge with the node it leads to."""
    here, there = ("source_id", "target_id") if forward else ("target_id", "source_id")
    edges = g.calls(*kinds).select(F.col(here).alias("here"), F.col(there).alias("id"), F.col("source_line").alias("call_line"))
    return edges


def _walk(g: Graph, start: str, depth: int, forward: bool, kinds: list[str]) -> DataFrame:
    names = g.nodes.select("id", "name", "kind", "file_path", "line_start")
    edges = _steps(g, forward, kinds)
    first = names.filter(F.col("id") == start).select("id", F.col("name").alias("path"), F.array("name").alias("names"), F.array().cast("array<int>").alias("lines"))
    frontier, levels = first, []
    for d in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("here"), "path", "names", "lines").join(edges, "here").join(names, "id")
        path = F.concat("path", F.lit(ARROW), "name") if forward else F.concat("name", F.lit(ARROW), "path")
        level = cut(step.select("id", "name", "kind", "file_path", "line_start", F.lit(d).alias("depth"), path.alias("path"), "call_line", F.concat("names", F.array("name")).alias("names"), F.concat("lines", F.array("call_line")).alias("lines")).distinct())
        levels.append(level)
        if d < depth and level.isEmpty():
            break
        frontier = level.select("id", "path", "names", "lines")
    return union(levels)


def call_chain(g: Graph, start: str, depth: int = 3) -> DataFrame:
    """Every walk forward over calls, fetches and route handlers; cycles are walked again."""
    return _walk(g, start, depth, True, schema.TRAVERSED).select("id", "name", "kind", "depth", "path", "call_line").distinct().orderBy("depth", "name", "id", "path", "call_line")


def reverse_call_chain(g: Graph, target: str, depth: int = 2) -> DataFrame:
    """Every walk backward; a path reads from the caller to the target."""
    return _walk(g, target, depth, False, schema.TRAVERSED).select("id", "name", "kind", "file_path", "line_start", "depth", "path", "call_line").distinct().orderBy("depth", "name", "id", "path", "call_line")


def chain_arrays(g: Graph, start: str, depth: int = 3) -> DataFrame:
    """The walks over calls with their names and call lines as arrays."""
    return _walk(g, start, depth, True, ["CALLS"]).select("id", "depth", "names", "lines").distinct()


def blast_radius_files(g: Graph, target: str, depth: int = 2, churn: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The files with the most rows of the reverse walk, with their churn if given."""
    rows = reverse_call_chain(g, target, depth).groupBy("file_path").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("callers"))
    if churn is not None:
        rows = rows.join(churn, "file_path", "left").withColumn("commits_in_window", F.coalesce("commits_in_window", F.lit(0)))
    return rows.orderBy(F.desc("rows"), "file_path").limit(limit)


def blast_radius_depths(g: Graph, target: str, depth: int = 2) -> DataFrame:
    return reverse_call_chain(g, target, depth).groupBy("depth").agg(F.countDistinct("id").alias("callers"), F.count("*").alias("rows"))


def _among(rows: DataFrame, on: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose ``on`` is one of ``n`` ids: few are sent to the scans, before anything of the rows is made distinct or shuffled."""
    ids = ids.select(F.col("id").alias(on))
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, on, "left_semi")


def _onward(edges: DataFrame, front: DataFrame, n: int, directed: bool) -> DataFrame:
    """(a, b, ...): the steps from the ``n`` nodes of ``front(id, ...)`` with what it has of them."""
    ways = [("source_id", "target_id"), ("target_id", "source_id")][: 2 - directed]
    steps = union([edges.select(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ways])
    front = front.withColumnRenamed("id", "a")
    if n > BROADCAST_IDS:
        return steps.join(front, "a")
    return _among(steps, "a", front.select(F.col("a").alias("id")), n).join(F.broadcast(front), "a")


def reach(g: Graph, starts: DataFrame, depth: int, kinds: list[str] | None = None, directed: bool = True) -> DataFrame:
    """(id, depth): the least depth of each node within ``depth`` of ``starts(id)``, these included.

    Each node is expanded once, so unlike the walks this is linear in the edges.
    """
    edges = g.edges if kinds is None else g.calls(*kinds)
    seen = cut(starts.select("id", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        n = frontier.count()
        if not n:
            break
        new = _onward(edges, frontier.select("id"), n, directed).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = cut(new.select("id", F.lit(d).alias("depth")))
        seen = seen.unionByName(frontier)
    return seen


def neighbors(g: Graph, start: str, depth: int = 1) -> DataFrame:
    """Nodes within ``depth`` undirected steps over all kinds, the start included."""
    here = g.nodes.filter(F.col("id") == start)
    found = reach(g, here, depth, directed=False)
    n = found.count()
    shown = _among(g.nodes.select("id", "name", "kind"), "id", found, n)
    return shown.join(F.broadcast(found) if n <= BROADCAST_IDS else found, "id").select("id", "name", "kind", "depth")


def shortest_path(g: Graph, start: str, end: str, max_depth: int = 15) -> DataFrame:
    """(id, name, depth, trail) of the least trail among the shortest undirected ones, or no row.

    Both ends are searched, the smaller frontier first.  All shortest paths
    pass the level on which the frontiers meet, and the least trail through a
    node is the least one to it and on from it.
    """
    names = g.nodes.select("id", "name")
    none = names.limit(0).select("id", "name", F.lit(0).alias("depth"), F.lit("").alias("trail"))
    fronts = [cut(names.filter(F.col("id") == x).select("id", F.col("id").alias("trail")).distinct()) for x in (start, end)]
    seen = [f.select("id") for f in fronts]
    sizes, depth = [f.count() for f in fronts], 0
    while all(sizes):
        joined = fronts[0].join(fronts[1].select("id", F.col("trail").alias("rest")), "id")
        tail = F.substring("rest", F.length("id") + 1, F.length("rest"))  # without the node itself
        met = joined.select(F.concat("trail", tail).alias("trail")).agg(F.min("trail").alias("trail")).first()["trail"]
        if met is not None:
            return names.filter(F.col("id") == end).limit(1).select("id", "name", F.lit(depth).alias("depth"), F.lit(met).alias("trail"))
        if depth == max_depth:
            break
        i, depth = int(sizes[1] < sizes[0]), depth + 1
        trail = F.concat("trail", F.lit(","), "b") if i == 0 else F.concat("b", F.lit(","), "trail")
        step = _onward(g.edges, fronts[i], sizes[i], False).select(F.col("b").alias("id"), trail.alias("trail"))
        fronts[i] = cut(step.join(seen[i], "id", "left_anti").groupBy("id").agg(F.min("trail").alias("trail")))
        sizes[i] = fronts[i].count()
        seen[i] = seen[i].unionByName(fronts[i].select("id"))
    return none


def find_implementations(g: Graph, trait: str, depth: int = 5) -> DataFrame:
    """Nodes that implement ``trait`` (or ``trait::...``), up to ``depth`` steps away, with each depth they have."""
    shown = g.nodes.select("id", "name", "kind", "file_path", F.col("line_start").alias("line"))
    edges = g.calls("IMPLEMENTS").select(F.col("target_id").alias("here"), F.col("source_id").alias("id"))
    frontier = g.nodes.filter((F.col("name") == trait) | F.col("name").startswith(f"{trait}::")).select("id")
    levels = []
    for d in range(1, depth + 1):
        level = cut(edges.join(frontier.withColumnRenamed("id", "here"), "here").select("id").distinct())
        levels.append(level.withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        frontier = level
    return union(levels).join(shown, "id").select(*shown.columns, "depth").orderBy("depth", "name", "id")


def first_of_each(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
