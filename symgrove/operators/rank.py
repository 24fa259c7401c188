"""Statistics, look-ups and rankings over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.functions.text import contains, member_name
from symgrove.sources.derived import Graph

BRIEF = ["id", "name", "kind", "file_path"]
#: Build output, dependencies and bundles, which are not a project's own code.
DEAD_EXCLUDES = "build/ dist/ target/ vendor/ third_party/ node_modules pdf.worker .bundle.js .min.js .min.mjs".split()

#: Estimated size of a partition of pairs of ends.
TASK_BYTES = 1 << 24


def stats_totals(g: Graph) -> DataFrame:
    """One row: nodes, files, edges."""
    a = g.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"))
    return a.crossJoin(g.edges.agg(F.count("*").alias("edges"))).select("nodes", "edges", "files")


def stats_by(g: Graph, column: str) -> DataFrame:
    return g.nodes.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def metadata(g: Graph) -> DataFrame:
    """One row: total files, nodes, edges and the sorted languages."""
    a = g.nodes.agg(F.countDistinct("file_path").alias("total_files"), F.count("*").alias("total_nodes"), F.array_sort(F.collect_set("language")).alias("languages"))
    return a.crossJoin(g.edges.agg(F.count("*").alias("total_edges")))


def partitions(df: DataFrame) -> int:
    """In how many partitions to shuffle ``df``: as the session has it, or more, so that each has ``TASK_BYTES`` at most by the plan's estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size > 1 << 50 else max(least, -(-size // TASK_BYTES))  # beyond that it isn't known


def degrees(g: Graph) -> DataFrame:
    """(id, outgoing, incoming): distinct neighbours of each node that has any.

    Pairs of ends are made distinct once for both directions, in as many
    partitions as their size asks for, so what a task holds doesn't grow with
    the edges; their ends are counted where they are, and only counts go on.
    """
    pairs = g.edges.select("source_id", "target_id")
    pairs = pairs.repartition(partitions(pairs), "source_id", "target_id").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def hotspots(g: Graph, limit: int = 20) -> DataFrame:
    """The most connected symbols; files and imports don't count as such."""
    shown = g.nodes.filter(~F.col("kind").isin(schema.HIDDEN))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = shown.join(degrees(g), "id", "left").select(*BRIEF, zero("outgoing"), zero("incoming"))
    return out.withColumn("connections", F.col("outgoing") + F.col("incoming")).orderBy(F.desc("connections"), "id").limit(limit)


def _kind_rank() -> Column:
    return F.when(F.col("kind").isin("Class", "Interface", "Trait", "Struct", "Enum"), 1).when(F.col("kind").isin(schema.CALLABLE), 2).otherwise(3)


def find_symbols(nodes: DataFrame, pattern: str, limit: int = 20, raw: bool = False) -> DataFrame:
    """Symbols whose name contains ``pattern`` in any case; ``raw`` keeps the wildcards % and _."""
    hit = F.lower("name").like(f"%{pattern.lower()}%") if raw else contains(F.col("name"), pattern)
    shown = nodes.filter(hit & ~F.col("kind").isin(schema.HIDDEN))
    return shown.orderBy(_kind_rank(), F.length("name"), "name", "id").limit(limit).select("id", "name", "kind", "file_path", "line_start", "line_end", "signature", "parent_id")


def graph_query(nodes: DataFrame, kind: str | None = None, language: str | None = None, file_contains: str | None = None, name_contains: str | None = None) -> DataFrame:
    """All the given conditions; substrings are case-sensitive."""
    for test in (kind and F.col("kind") == kind, language and F.col("language") == language, file_contains and F.col("file_path").contains(file_contains), name_contains and F.col("name").contains(name_contains)):
        if test is not None and test is not False and not isinstance(test, str):
            nodes = nodes.filter(test)
    return nodes


def find_by_name(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.filter(F.col("name").contains(part))


def outgoing(g: Graph, node_id: str) -> DataFrame:
    return g.edges.filter(F.col("source_id") == node_id)


def incoming(g: Graph, node_id: str) -> DataFrame:
    return g.edges.filter(F.col("target_id") == node_id)


def symbol_callers(g: Graph, node_id: str) -> DataFrame:
    calls = g.edges.filter((F.col("target_id") == node_id) & (F.col("kind") == "CALLS")).select(F.col("source_id").alias("id"), F.col("source_line").alias("call_site_line"))
    return g.nodes.join(calls, "id").select(*BRIEF, F.col("line_start").alias("line"), "call_site_line").orderBy("file_path", "call_site_line", "id")


def symbol_callees(g: Graph, node_id: str) -> DataFrame:
    calls = g.edges.filter((F.col("source_id") == node_id) & (F.col("kind") == "CALLS")).select(F.col("target_id").alias("id"), F.col("source_line").alias("call_site_line"))
    return g.nodes.join(calls, "id").select(*BRIEF, F.col("line_start").alias("line"), "call_site_line").orderBy("call_site_line", "name", "id")


def symbol_members(nodes: DataFrame, node_id: str) -> DataFrame:
    rank = F.when(F.col("kind") == "Constructor", 1).when(F.col("kind") == "Method", 2).when(F.col("kind") == "Property", 3).when(F.col("kind") == "Field", 4).otherwise(5)
    own = nodes.filter((F.col("parent_id") == node_id) & (F.col("kind") != "Import"))
    return own.orderBy(rank, "line_start", "id").select("id", "name", "kind", "line_start", "line_end", "signature", "visibility")


def dead_symbols(g: Graph, kinds: list[str] = schema.CALLABLE, excludes: list[str] = DEAD_EXCLUDES, limit: int | None = 200) -> DataFrame:
    """Symbols that nothing calls; a negative or no limit gives all."""
    own = g.nodes.filter(F.col("kind").isin(kinds))
    for x in excludes:
        own = own.filter(~contains(F.col("file_path"), x))
    called = g.calls("CALLS").select(F.col("target_id").alias("id"))
    dead = own.join(called, "id", "left_anti").select("id", "name", "kind", "file_path", "line_start", "line_end", "signature", "visibility", "language").orderBy("file_path", "line_start", "id")
    return dead if limit is None or limit < 0 else dead.limit(limit)


def routes(g: Graph, limit: int | None = 100) -> DataFrame:
    """Routes with their number of handlers."""
    handlers = g.calls("HANDLES_ROUTE").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("handlers"))
    out = g.nodes.filter("kind = 'Route'").join(handlers, "id", "left").select("id", "name", "file_path", F.coalesce("handlers", F.lit(0)).alias("handlers")).orderBy("name", "id")
    return out if limit is None else out.limit(limit)


def processes(g: Graph, limit: int | None = 20) -> DataFrame:
    """Processes with their number of steps."""
    steps = g.calls("STEP_IN_PROCESS").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("steps"))
    out = g.nodes.filter("kind = 'Process'").join(steps, "id", "left").select("id", "name", F.coalesce("steps", F.lit(0)).alias("steps")).orderBy(F.desc("steps"), "name", "id")
    return out if limit is None else out.limit(limit)


def resolve_symbol(nodes: DataFrame, name: str, kinds: list[str] | None = None, candidates: int = 10) -> str | None:
    """The id that a command means by ``name``: an exact name in any case first."""
    rows = find_symbols(nodes, name, candidates).collect()  # a handful
    rows = [r for r in rows if kinds is None or r["kind"] in kinds]
    exact = [r for r in rows if r["name"].lower() == name.lower()]
    return (exact or rows)[0]["id"] if rows else None


def symbol_detail(g: Graph, name: str, limit: int = 10) -> dict[str, DataFrame] | None:
    """Callers, callees and, of types, members of the symbol that ``name`` means."""
    node_id = resolve_symbol(g.nodes, name)
    if node_id is None:
        return None
    own = ~F.lower("file_path").rlike("pdfjs|pdf\\.js|node_modules")
    this = g.nodes.filter(F.col("id") == node_id)
    members = symbol_members(g.nodes, node_id).join(this.filter(F.col("kind").isin(schema.CONTAINERS)).select(F.lit(True).alias("is_type")), how="cross").drop("is_type")
    return {"symbol": this, "callers": symbol_callers(g, node_id).filter(own).limit(limit), "callees": symbol_callees(g, node_id).filter(own).limit(limit), "members": members.withColumn("member", member_name(F.col("name")))}
