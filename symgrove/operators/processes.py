"""Entry points and the processes that start there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.functions.text import simple_name
from symgrove.plans.iterate import cut, union
from symgrove.sources.derived import Graph

MAX_DEPTH, MAX_STEPS = 6, 50


def entry_points(g: Graph) -> DataFrame:
    """(id, label, reason): handlers of routes under their first route's name, then mains and tests."""
    names = g.nodes.select("id", "name", "kind")
    routes = g.nodes.filter("kind = 'Route'").select(F.col("id").alias("target_id"), F.col("name").alias("route"))
    handlers = g.calls("HANDLES_ROUTE").join(routes, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.min("route").alias("label"))
    handlers = handlers.join(names.select("id"), "id", "left_semi").select("id", "label", F.lit("route").alias("reason"))
    last, name = simple_name(F.col("name")), F.col("name")
    main = last.isin("main", "Main") | (name == "Program.Main")
    test = last.startswith("test_") | last.startswith("Test") | last.endswith("Test") | last.endswith("_test")
    rest = names.filter(F.col("kind").isin(schema.CALLABLE) & (main | test)).select("id", name.alias("label"), F.when(main, "main").otherwise("test").alias("reason"))
    return handlers.unionByName(rest.join(handlers, "id", "left_anti"))


def trace(g: Graph, entries: DataFrame, max_depth: int = MAX_DEPTH, max_steps: int = MAX_STEPS) -> DataFrame:
    """(process_id, label, id, step, depth, confidence) of ``entries(id, label)``.

    Step 1 is the entry.  Calls are followed breadth first; within a level
    nodes are numbered by (step of the caller, line, name, id), and each counts
    where it is met first.
    """
    names = g.nodes.select("id", "name")
    calls = g.calls("CALLS").select(F.col("source_id").alias("here"), F.col("target_id").alias("id"), "source_line", "confidence")
    start = entries.select(F.concat(F.lit("process:"), "id").alias("process_id"), F.concat(F.lit("Process: "), "label").alias("label"), "id", F.lit(1).alias("step"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"))
    frontier = cut(start)
    levels = [frontier]
    for d in range(1, max_depth + 1):
        seen = union([x.select("process_id", "id") for x in levels])
        last = F.max("step").over(Window.partitionBy("process_id"))
        front = frontier.select("process_id", "label", F.col("id").alias("here"), F.col("step").alias("from"), last.alias("last"))
        met = front.join(calls, "here").join(seen, ["process_id", "id"], "left_anti").join(names, "id")
        first = Window.partitionBy("process_id", "id").orderBy("from", "source_line", F.desc("confidence"))
        order = Window.partitionBy("process_id").orderBy("from", "source_line", "name", "id")
        new = met.withColumn("n", F.row_number().over(first)).filter("n = 1").withColumn("step", F.col("last") + F.row_number().over(order))
        frontier = cut(new.filter(F.col("step") <= max_steps).select("process_id", "label", "id", "step", F.lit(d).alias("depth"), "confidence"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return union(levels)


def process_graph(steps: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The Process nodes and the ENTRY_POINT_OF and STEP_IN_PROCESS edges of trace()."""
    own = steps.filter("step = 1").join(nodes, "id")
    null = F.lit(None).cast("string")
    made = own.select(F.col("process_id").alias("id"), F.col("label").alias("name"), F.lit("Process").alias("kind"), "file_path", "line_start", "line_end", null.alias("signature"), null.alias("doc_comment"), F.lit("Public").alias("visibility"), "language", null.alias("parent_id"))
    edge = lambda kind, line: [F.col("id").alias("source_id"), F.col("process_id").alias("target_id"), F.lit(kind).alias("kind"), line.alias("source_line"), F.col("confidence")]
    edges = steps.select(*edge("STEP_IN_PROCESS", F.col("step"))).unionByName(steps.filter("step = 1").select(*edge("ENTRY_POINT_OF", F.lit(0))))
    return made, edges
