"""Building blocks of iterative plans."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """The folder of ``spark.checkpoint.dir``; where none is set, a local one under a local master, and an error under any other."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="symgrove-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so a lost executor costs one step."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of undirected ``edges(a, b)``: the smallest id reachable.

    Every round hooks each id to the least label among its neighbours and then
    to that label's own label, so paths shorten by about half each time.
    """
    links = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        near = links.join(label, links["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("m"))
        hooked = label.join(near, label["id"] == near["a"]).select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = hooked.select(F.col("id").alias("j"), F.col("component").alias("further"))
        new = cut(hooked.join(jump, hooked["component"] == jump["j"], "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        label = new.select("id", "component")
        if new.filter("component <> was").isEmpty():
            return label
