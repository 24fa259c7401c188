"""Python's method resolution order and calls of super()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from symgrove.functions.text import member_name, super_method
from symgrove.plans.iterate import connected, cut, union

MRO = "class_id string, pos int, ancestor_id string"
#: Links of a hierarchy that one task takes whole.
WHOLE = 5000


def python_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, parent_id, ord): the bases of each Python class in source order."""
    classes = nodes.filter("kind = 'Class' AND language = 'python'").select("id")
    ext = edges.filter("kind = 'EXTENDS'").select(F.col("source_id").alias("class_id"), F.col("target_id").alias("parent_id"), "source_line")
    own = ext.join(classes.withColumnRenamed("id", "class_id"), "class_id", "left_semi").join(classes.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi")
    first = own.groupBy("class_id", "parent_id").agg(F.min("source_line").alias("source_line"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("class_id").orderBy("source_line", "parent_id"))).select("class_id", "parent_id", "ord")


def linearize(parents: dict[str, list[str]]) -> dict[str, list[str] | None]:
    """The C3 order of every class; None for a cycle or an inconsistent hierarchy."""
    done: dict[str, list[str] | None] = {}
    for root in sorted({*parents, *(p for ps in parents.values() for p in ps)}):
        stack, open_ = [root], set()
        while stack:
            c = stack[-1]
            if c in done:
                stack.pop()
                continue
            todo = [p for p in parents.get(c, []) if p not in done]
            if todo and c not in open_:
                open_.add(c)
                cycle = [p for p in todo if p in open_]
                if cycle:
                    done[c] = None
                else:
                    stack += todo
                continue
            done[c] = None if todo else _merge(c, [done[p] for p in parents.get(c, [])], parents.get(c, []))
            open_.discard(c)
            stack.pop()
    return done


def _merge(c: str, orders: list[list[str] | None], bases: list[str]) -> list[str] | None:
    if any(o is None for o in orders):
        return None
    lists = [list(o) for o in orders] + [list(bases)]
    out = [c]
    while lists := [x for x in lists if x]:
        tails = {y for x in lists for y in x[1:]}
        head = next((x[0] for x in lists if x[0] not in tails), None)
        if head is None:
            return None
        out.append(head)
        lists = [x[1:] if x[0] == head else x for x in lists]
    return out


@F.pandas_udf(ArrayType(StringType()))
def _merged(own: pd.Series, orders: pd.Series, bases: pd.Series) -> pd.Series:
    one = lambda c, os, bs: None if bs is None else _merge(c, [None if o is None else list(o) for o in os], list(bs))
    return pd.Series([one(*x) for x in zip(own, orders, bases, strict=True)], dtype=object)


def c3_orders(parents: DataFrame) -> DataFrame:
    """(class_id, order): the C3 order of each class of ``parents(class_id, parent_id, ord)``, null if it has none.

    Level by level: a class is merged once all its parents are, so a task sees
    the orders of one class's parents, however many classes share a base.
    Members of a cycle, and what inherits from them, are never merged and have
    no row.
    """
    parents = parents.select("class_id", "parent_id", "ord").distinct()
    parents = cut(parents.join(parents.groupBy("class_id").agg(F.count("*").alias("n")), "class_id"))
    own = parents.select("class_id").distinct()
    inbox = None
    level = cut(parents.select(F.col("parent_id").alias("class_id")).distinct().join(own, "class_id", "left_anti").select("class_id", F.lit(True).alias("ready"), F.array("class_id").alias("order")))
    levels = [level]
    while True:
        front = level.filter("ready").select(F.col("class_id").alias("parent_id"), "order")
        sent = parents.join(front, "parent_id").select("class_id", "n", F.struct("ord", "parent_id", "order").alias("p"))
        if inbox is not None:
            sent = sent.unionByName(inbox)
        got = sent.groupBy("class_id", "n").agg(F.sort_array(F.collect_list("p")).alias("p")).withColumn("ready", F.size("p") == F.col("n"))
        bases = lambda c: F.when(F.col("ready"), F.transform("p", lambda x: x[c]))
        level = cut(got.withColumn("order", _merged("class_id", bases("order"), bases("parent_id"))))
        if level.filter("ready").isEmpty():
            return union([x.filter("ready").select("class_id", "order") for x in levels])
        levels.append(level)
        inbox = level.filter("NOT ready").select("class_id", "n", F.explode("p").alias("p"))


def _component(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["class_id", "ord"])
    parents: dict[str, list[str]] = {}
    for c, p in zip(pdf["class_id"], pdf["parent_id"], strict=True):
        parents.setdefault(c, []).append(p)
    rows = [(c, i, a) for c, order in linearize(parents).items() if order is not None for i, a in enumerate(order)]
    return pd.DataFrame(rows, columns=["class_id", "pos", "ancestor_id"])


def c3_mro(parents: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(class_id, pos, ancestor_id) of ``parents(class_id, parent_id, ord)``: a row for each class in each class's order.

    Connected hierarchies of at most ``whole`` links are one group each; larger
    ones, such as all that share a common base, go level by level.  Both give
    the same.  A class without a consistent order has no rows, nor have those
    that inherit from it.
    """
    parents = cut(parents.select("class_id", "parent_id", "ord").distinct())
    comp = connected(parents.select(F.col("class_id").alias("a"), F.col("parent_id").alias("b")))
    own = cut(parents.join(comp.withColumnRenamed("id", "class_id"), "class_id"))
    large = own.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("component")
    out = own.join(large, "component", "left_anti").select("component", "class_id", "parent_id", "ord").groupBy("component").applyInPandas(_component, MRO)
    rest = cut(own.join(large, "component", "left_semi"))
    if rest.isEmpty():
        return out
    return out.unionByName(c3_orders(rest).filter("order IS NOT NULL").select("class_id", F.posexplode("order").alias("pos", "ancestor_id")))


def enclosing_class(nodes: DataFrame) -> DataFrame:
    """(id, class_id): each node whose parent is a type."""
    types = nodes.filter(F.col("kind").isin("Class", "Struct", "Trait", "Interface")).select(F.col("id").alias("class_id"))
    return nodes.select("id", F.col("parent_id").alias("class_id")).join(types, "class_id", "left_semi").select("id", "class_id")


def super_targets(raw: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(raw_id, target_id) of calls ``super().m`` in Python: the first ancestor's method ``m``; constructors don't count."""
    python = nodes.filter("language = 'python'").select(F.col("id").alias("source_id"))
    calls = raw.filter("kind = 'CALLS'").join(python, "source_id", "left_semi").withColumn("member", super_method(F.col("target_name"))).filter("member IS NOT NULL")
    calls = calls.join(enclosing_class(nodes).withColumnRenamed("id", "source_id"), "source_id").select("raw_id", "class_id", "member")
    order = c3_mro(python_parents(nodes, edges)).filter("pos > 0")
    members = nodes.filter(F.col("kind").isin("Method", "Function") & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("ancestor_id"), member_name(F.col("name")).alias("member"), F.col("id").alias("target_id"))
    hits = calls.join(order, "class_id").join(members, ["ancestor_id", "member"])
    return hits.groupBy("raw_id").agg(F.min(F.struct("pos", "target_id")).alias("m")).select("raw_id", "m.target_id")
