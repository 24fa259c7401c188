"""The graph on disk: versioned Parquet snapshots.

A save writes a whole new snapshot next to the old ones and is visible once its
marker file is there, so a lost driver leaves the last one intact.  The last
``KEPT`` ones stay, for readers that are still at them.  Edges are partitioned
by kind, which prunes reads as indexes on the kind would.  The raw edges are
kept beside the resolved ones, so that changed files can be resolved anew
against all others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.operators import search
from symgrove.operators.resolve import dedup_edges
from symgrove.plans.iterate import checkpoint_folder
from symgrove.sources.derived import Graph

BACKEND = "spark"
KEPT = 2


def contains_edges(nodes: DataFrame) -> DataFrame:
    """A CONTAINS edge from each parent that exists to its child."""
    parents = nodes.select(F.col("id").alias("parent_id"))
    own = nodes.filter("parent_id IS NOT NULL").join(parents, "parent_id", "left_semi")
    return own.select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("kind"), F.col("line_start").alias("source_line"), F.lit(schema.CERTAIN).alias("confidence"))


def consistent_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id, no dangling parents."""
    cols = schema.columns(schema.NODES)
    known = nodes.select(F.col("id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    nodes = nodes.groupBy("id").agg(F.max(F.struct(*[c for c in cols if c != "id"])).alias("n")).select("id", "n.*").select(*cols)
    return nodes.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).select(*cols)


def consistent_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """No dangling edges, CONTAINS for every parent, one edge per key; of nodes that are consistent, and best read from where they are stored.

    The check of the sources comes last, so that its shuffle serves for what follows.
    """
    ids = nodes.select("id")
    every = edges.select(*schema.columns(schema.EDGES)).unionByName(contains_edges(nodes))
    both = every.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return dedup_edges(both)


def consistent(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node per id, no dangling parents or edges, CONTAINS for every parent, one edge per key."""
    nodes = consistent_nodes(nodes)
    return nodes, consistent_edges(nodes, edges)


def without_file(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything but the nodes, edges and hashes of ``paths(file_path)``."""
    gone = nodes.join(paths, "file_path", "left_semi").select("id")
    edges = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(paths, "file_path", "left_anti").select(*nodes.columns), edges.select(*schema.columns(schema.EDGES)), hashes.join(paths, "file_path", "left_anti")


def raw_without_file(nodes: DataFrame, raw: DataFrame, paths: DataFrame) -> DataFrame:
    """The raw edges that don't start in ``paths(file_path)``."""
    gone = nodes.join(paths, "file_path", "left_semi").select(F.col("id").alias("source_id"))
    return raw.join(gone, "source_id", "left_anti").select(*raw.columns)


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change) of two tables (file_path, hash): added, modified, removed or unchanged."""
    a, b = old.select("file_path", F.col("hash").alias("was")), new.select("file_path", F.col("hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified").otherwise("unchanged")
    return a.join(b, "file_path", "full_outer").select("file_path", change.alias("change"))


@dataclass
class Store:
    """A folder of snapshots in any file system that Spark writes to."""

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        return base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        base = path(self.path)
        if not fs.exists(base):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory()]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/DONE"))]
        return sorted(int(n[1:]) for n in done)

    def save(self, nodes: DataFrame, edges: DataFrame, hashes: DataFrame | None = None, raw: DataFrame | None = None) -> dict[str, int]:
        """Write a snapshot, delete those before the last ones, and return its counts."""
        version = (self.versions() or [0])[-1] + 1
        out = f"{self.path}/v{version}"
        consistent_nodes(nodes).write.mode("overwrite").parquet(f"{out}/nodes")
        written = self.spark.read.schema(schema.NODES).parquet(f"{out}/nodes")
        spread = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)  # no head, however many its tokens, is one task's
        index = search.postings(written, search.SYMBOL_TEXT, spread=spread)
        index.sortWithinPartitions("head", "token").write.mode("overwrite").partitionBy("head").parquet(f"{out}/postings")
        search.totals(written, search.SYMBOL_TEXT).write.mode("overwrite").parquet(f"{out}/totals")
        consistent_edges(written, edges).sortWithinPartitions("kind", "source_id").write.mode("overwrite").partitionBy("kind").parquet(f"{out}/edges")
        if hashes is None:
            hashes = self.spark.createDataFrame([], schema.FILE_HASHES)
        hashes.select("file_path", "hash").write.mode("overwrite").parquet(f"{out}/file_hashes")
        if raw is None:
            raw = self.spark.createDataFrame([], schema.RAW_EDGES)
        raw.select(*schema.columns(schema.RAW_EDGES)).write.mode("overwrite").parquet(f"{out}/raw_edges")
        fs, path = self._fs()
        fs.create(path(f"{out}/DONE")).close()
        for old in self.versions()[:-KEPT]:
            fs.delete(path(f"{self.path}/v{old}"), True)
        return {"nodes": written.count(), "edges": self._edges(out).count()}

    def _edges(self, at: str) -> DataFrame:
        return self.spark.read.schema(schema.EDGES).parquet(f"{at}/edges").select(*schema.columns(schema.EDGES))

    def _last(self) -> str | None:
        have = self.versions()
        return f"{self.path}/v{have[-1]}" if have else None

    def load(self) -> Graph:
        """The last snapshot; rows of unknown kinds are dropped, an unknown visibility is Private."""
        at = self._last()
        if at is None:
            return Graph(self.spark.createDataFrame([], schema.NODES), self.spark.createDataFrame([], schema.EDGES))
        nodes = self.spark.read.schema(schema.NODES).parquet(f"{at}/nodes")
        return Graph(valid_nodes(nodes), self._edges(at).filter(F.col("kind").isin(schema.EDGE_KINDS)))

    def load_file_hashes(self) -> DataFrame:
        """Hashes of 64 hexadecimal digits only."""
        at = self._last()
        if at is None:
            return self.spark.createDataFrame([], schema.FILE_HASHES)
        return self.spark.read.schema(schema.FILE_HASHES).parquet(f"{at}/file_hashes").filter(F.col("hash").rlike("^[0-9a-f]{64}$"))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Ranked symbols, from the index of the last snapshot."""
        at, nodes = self._last(), self.load().nodes
        if at is None:
            return search.search_symbols(nodes, query, limit)
        index = self.spark.read.schema("token string, id string, col int, positions array<int>, size int, head int").parquet(f"{at}/postings")
        return search.search_indexed(index, self.spark.read.schema("n long, tokens long").parquet(f"{at}/totals"), nodes, query, limit)

    def load_raw_edges(self) -> DataFrame:
        at = self._last()
        if at is None:
            return self.spark.createDataFrame([], schema.RAW_EDGES)
        return self.spark.read.schema(schema.RAW_EDGES).parquet(f"{at}/raw_edges")

    def remove_file_nodes(self, file_path: str) -> dict[str, int]:
        g = self.load()
        gone = self.spark.createDataFrame([(file_path,)], "file_path string")
        nodes, edges, hashes = without_file(g.nodes, g.edges, self.load_file_hashes(), gone)
        return self.save(nodes, edges, hashes, raw_without_file(g.nodes, self.load_raw_edges(), gone))

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def views(self) -> None:
        """Temporary views ``nodes``, ``edges`` and ``file_hashes`` for raw queries."""
        g = self.load()
        for name, df in (("nodes", g.nodes), ("edges", g.edges), ("file_hashes", self.load_file_hashes())):
            df.createOrReplaceTempView(name)


def temporary(spark: SparkSession) -> Store:
    """A store beside the checkpoints, where all executors reach it; it goes when the JVM ends."""
    checkpoint_folder(spark)
    out = Store(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    fs, path = out._fs()
    fs.deleteOnExit(path(out.path))
    return out


def valid_nodes(nodes: DataFrame) -> DataFrame:
    ok = F.col("kind").isin(schema.SYMBOL_KINDS) & F.col("language").isin(list(schema.LANGUAGES)) & (F.col("id") != "")
    return nodes.filter(ok).withColumn("visibility", F.when(F.col("visibility").isin(schema.VISIBILITIES), F.col("visibility")).otherwise("Private"))


def raw_query(spark: SparkSession, statement: str, **frames: DataFrame) -> DataFrame:
    """A SELECT over the graph's tables, given as frames or as temporary views; other statements are refused."""
    words = statement.lstrip(" \t\r\n(").split(None, 1)
    if not words or words[0].upper() not in ("SELECT", "WITH", "VALUES", "FROM", "TABLE"):
        raise ValueError("only queries are accepted")
    return spark.sql(statement, **frames)
