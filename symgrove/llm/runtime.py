"""Spark plumbing shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; set one only where none is set.

    The fallback is for local masters alone.  A cluster has to name a folder
    that all executors share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="symgrove-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder.

    The files survive lost executors; Spark's cleaner removes them once no
    plan refers to them any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Like cut(), but as a compressed Parquet table in the same folder, and a function that deletes it.

    For tables that hold texts, which a checkpoint would write uncompressed.
    What is not deleted goes when the JVM ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString()), lambda: fs.delete(path, True)


def named(columns: list[str]) -> list[Column]:
    """Columns by names that may hold dots and backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def uniform(seed: str, *cols: Column) -> Column:
    """A number in (0, 1) from MD5 of the seed and the columns: equal in any SQL engine."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


#: Id lists up to this number are handed to every task; longer ones are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in the one-column ``ids``; null keys stay.

    The list is counted first, and only a short one is broadcast, so that the
    texts aren't shuffled to drop a few of them.
    """
    ids = cut(ids.toDF(key).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_anti").select(*named(df.columns))


#: Tables of parts up to this number of rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_PARTS = 1 << 16


def handed(df: DataFrame, few: bool) -> DataFrame:
    """``df`` as a side of a join: broadcast if it was counted and has few rows."""
    return F.broadcast(df) if few else df


def cut_points(df: DataFrame, part: str, key: str, tie: str, quota: DataFrame, bins: int = 4096, few: bool = True) -> DataFrame:
    """(part, last_key, last_tie): the ``quota.n``-th smallest (key, tie) of each ``part``.

    ``key`` lies in (0, 1).  Instead of sorting a whole part in one task, count
    a histogram of the keys, find the bin in which each quota ends and rank
    only the rows of that bin.  A part with no more rows than its quota has
    (2.0, null), above every key; a quota of 0 has (-1.0, null).  ``few`` says
    that the parts are at most BROADCAST_PARTS.
    """
    binned = df.select(part, key, tie, F.least(F.floor(F.col(key) * bins), F.lit(bins - 1)).cast("int").alias("__bin"))
    w = Window.partitionBy(part).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = binned.groupBy(part, "__bin").agg(F.count("*").alias("__c")).withColumn("__upto", F.sum("__c").over(w))
    ends = hist.join(handed(quota.select(part, F.col("n").alias("__n")), few), part).filter("__upto >= __n AND __upto - __c < __n AND __n > 0")
    ends = cut(ends.select(part, "__bin", (F.col("__n") - F.col("__upto") + F.col("__c")).alias("__need")))
    rank = Window.partitionBy(part).orderBy(key, tie)
    last = binned.join(handed(ends, few), [part, "__bin"]).withColumn("__r", F.row_number().over(rank)).filter("__r = __need")
    found = last.select(part, F.col(key).alias("last_key"), F.col(tie).alias("last_tie"))
    return quota.join(found, part, "left").select(part, F.when(F.col("n") <= 0, -1.0).otherwise(F.coalesce("last_key", F.lit(2.0))).alias("last_key"), "last_tie")


def up_to_cut(key: Column, tie: Column) -> Column:
    """Whether (key, tie) is among the rows that cut_points() delimits."""
    return (key < F.col("last_key")) | ((key == F.col("last_key")) & (tie <= F.col("last_tie")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: (id, root), root = smallest id.

    Alternating large-star and small-star contraction; each round is cut
    through the checkpoint folder, so the plan doesn't grow and a lost
    executor costs one round at most.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cur = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        n = both(cur).groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both(cur).join(n, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        nxt = cut(small)
        same = nxt.groupBy("a").count().filter("count > 1").limit(1).count() == 0 and nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0
        cur = nxt
        if same:
            break
    return cur.select(F.col("a").alias("id"), F.col("b").alias("root"))
