"""Projects of source files: discovery, extraction, incremental updates and the scan."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.functions.text import file_route
from symgrove.operators import mro, processes, resolve
from symgrove.plans.iterate import cut, union
from symgrove.sources.derived import Graph
from symgrove.sources.extract import extract
from symgrove.sources.store import Store, detect_changes, raw_without_file, without_file

ROW = f"record string, {schema.NODES}, {schema.RAW_EDGES.replace('kind string', 'edge_kind string').replace('raw_id bigint, ', '')}"


#: Names of ignore files; in each folder the first ones come first.
IGNORE_FILES = [".gitignore", ".ignore"]


def _glob(pattern: str) -> str:
    """The regular expression of a path glob: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """(regular expression of paths, whether they are ignored) of an ignore file in ``folder``, in the order of its lines.

    A line with ``!`` takes paths back.  A slash before the end ties a pattern
    to the folder; without one it holds at any depth.
    """
    out = []
    base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        ignored = not line.startswith("!")
        line = line.removeprefix("!")
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        tied = "/" in line
        body = _glob(line.lstrip("/"))
        if body:
            out.append((f"^{base}{'' if tied else '(?:.*/)?'}{body}{'/' if only_folders else '(?:/|$)'}", ignored))
    return out


def project_rules(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """The rules of all ignore files below ``root``, outer folders first, after those of ``.git/info/exclude``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    base = path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(base).toString().rstrip("/")

    def text(at) -> str:
        stream = fs.open(at)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    exclude = path(f"{root}/.git/info/exclude")
    out = ignore_rules(text(exclude)) if fs.exists(exclude) else []
    level = ""
    while True:
        for name in IGNORE_FILES:
            for found in sorted(fs.globStatus(path(f"{root}{level}/{name}")) or [], key=lambda f: f.getPath().toString()):
                out += ignore_rules(text(found.getPath()), found.getPath().getParent().toString().removeprefix(root))
        level += "/*"
        if not any(f.isDirectory() for f in fs.globStatus(path(f"{root}{level}")) or []):
            return out


def discover_files(spark: SparkSession, root: str, ignore: str = "") -> DataFrame:
    """(file_path, language, content, hash) of the source files below ``root``.

    Paths start with the root's own name.  Hidden files and folders are
    skipped, and those that the ignore files of the project and ``ignore`` (the
    text of another) name: the last rule that a path meets decides.
    """
    root = root.rstrip("/")
    name = root.rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(schema.EXTENSIONS) + "}").load(root)
    inner = F.element_at(F.split("path", re.escape(f"/{name}/"), 2), 2)
    ext = F.lower(F.element_at(F.split(inner, r"\."), -1))
    language = F.create_map(*[F.lit(x) for kv in schema.EXTENSIONS.items() for x in kv])[ext]
    out = files.select(inner.alias("inner"), language.alias("language"), "content").filter(F.col("language").isNotNull() & ~F.col("inner").rlike(r"(^|/)\."))
    ignored = F.lit(False)
    for pattern, bad in [*project_rules(spark, root), *ignore_rules(ignore)]:
        ignored = F.when(F.col("inner").rlike(pattern), bad).otherwise(ignored)
    return out.filter(~ignored).select(F.concat(F.lit(f"{name}/"), "inner").alias("file_path"), "language", "content", F.sha2("content", 256).alias("hash"))


def _extracted(batches):
    kinds = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in ROW.split(", ")])
    for batch in batches:
        rows: list[dict] = []
        for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("file_path", "language", "content")), strict=True):
            try:
                found = extract(path, content.decode("utf-8", "replace"), language)
            except (RecursionError, IndexError, ValueError) as e:  # the file is skipped, with a record of why
                rows.append({"record": "failure", "file_path": path, "name": type(e).__name__, "signature": str(e)[:500]})
                continue
            rows += [{"record": "node", **n} for n in found.nodes]
            rows += [{"record": "edge", **{k: v for k, v in e.items() if k != "kind"}, "edge_kind": e["kind"]} for e in found.edges]
        yield pa.RecordBatch.from_pylist(rows, kinds)


@dataclass
class Parsed:
    """Symbols, raw edges, and (file_path, error, message) of the files that could not be parsed."""

    nodes: DataFrame
    raw: DataFrame
    failures: DataFrame


def parse_all(files: DataFrame, doc_comments: bool = True) -> Parsed:
    """Every one of the discovered files is read and parsed once."""
    rows = cut(files.select("file_path", "language", "content").mapInArrow(_extracted, ROW))
    nodes = rows.filter("record = 'node'").select(*schema.columns(schema.NODES))
    raw = rows.filter("record = 'edge'").select(F.xxhash64("source_id", "edge_kind", "target_name", "target_module", "source_line").alias("raw_id"), "source_id", F.col("edge_kind").alias("kind"), "target_name", "target_module", "source_line").distinct()
    if not doc_comments:
        nodes = nodes.withColumn("doc_comment", F.lit(None).cast("string"))
    return Parsed(nodes, raw, rows.filter("record = 'failure'").select("file_path", F.col("name").alias("error"), F.col("signature").alias("message")))


def parse_files(files: DataFrame, doc_comments: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, raw_edges) of discovered files."""
    p = parse_all(files, doc_comments)
    return p.nodes, p.raw


def file_based_routes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route nodes, and raw HANDLES_ROUTE edges from the first callable, of files that their path makes a route.

    Files named ``route`` have one for each exported function named like an
    HTTP method, where there is any.
    """
    files = nodes.filter("kind = 'File'").withColumn("route", file_route(F.col("file_path"))).filter("route IS NOT NULL").select("file_path", "route", "language", F.col("id").alias("file_id"))
    own = nodes.filter(F.col("kind").isin(schema.CALLABLE)).select("file_path", F.col("id").alias("handler"), F.col("name").alias("verb"), F.col("line_start").alias("line"))
    verbs = files.filter(F.col("file_path").rlike(r"/route\.(ts|tsx|js)$")).join(own.filter(F.col("verb").isin("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")), "file_path")
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("line", "handler"))).filter("n = 1")
    rest = files.join(verbs.select("file_path"), "file_path", "left_anti").join(first.select("file_path", "handler", "line"), "file_path", "left").withColumn("verb", F.lit("GET"))
    every = verbs.select("file_path", "route", "language", "file_id", "handler", "verb", "line").unionByName(rest.select("file_path", "route", "language", "file_id", "handler", "verb", "line"))
    null, name = F.lit(None).cast("string"), F.concat_ws(" ", "verb", "route")
    every = every.withColumns({"name": name, "at": F.coalesce("line", F.lit(0))}).withColumn("id", F.substring(F.sha2(F.concat_ws("\x01", "file_path", "name", F.lit("Route")), 256), 1, 16))
    made = every.select("id", "name", F.lit("Route").alias("kind"), "file_path", F.col("at").alias("line_start"), F.col("at").alias("line_end"), null.alias("signature"), null.alias("doc_comment"), F.lit("Public").alias("visibility"), "language", F.col("file_id").alias("parent_id"))
    edges = every.filter("handler IS NOT NULL").select(F.xxhash64("handler", "id").alias("raw_id"), F.col("handler").alias("source_id"), F.lit("HANDLES_ROUTE").alias("kind"), F.col("id").alias("target_name"), null.alias("target_module"), F.col("at").alias("source_line"))
    return made, edges


def build_graph(nodes: DataFrame, raw: DataFrame, aliases: list[tuple[str, str]] = ()) -> Graph:
    """Resolved edges and traced processes of extracted symbols."""
    more_nodes, more_raw = file_based_routes(nodes)
    nodes = cut(nodes.unionByName(more_nodes).groupBy("id").agg(F.max(F.struct(*[c for c in nodes.columns if c != "id"])).alias("n")).select("id", "n.*").select(*nodes.columns))
    raw = cut(raw.unionByName(more_raw).dropDuplicates(["raw_id"]))
    edges = cut(resolve.resolve_edges(raw, nodes, aliases, mro.super_targets))
    g = Graph(nodes, edges)
    steps = processes.trace(g, processes.entry_points(g).select("id", "label"))
    p_nodes, p_edges = processes.process_graph(steps, nodes)
    return Graph(nodes.unionByName(p_nodes), union([edges, p_edges]))


def scan(spark: SparkSession, root: str, store: Store, clean: bool = False, doc_comments: bool = True, ignore: str = "", aliases: list[tuple[str, str]] = ()) -> dict[str, int]:
    """Read a project and save its graph; the counts have ``failed`` where files could not be parsed."""
    if clean:
        store.clear()
    files = discover_files(spark, root, ignore)
    p = parse_all(files, doc_comments)
    g = build_graph(p.nodes, p.raw, aliases)
    counts = store.save(g.nodes, g.edges, files.select("file_path", "hash"), p.raw)
    failed = p.failures.count()
    return counts | ({"failed": failed} if failed else {})


def apply_changes(store: Store, new: DataFrame, gone: DataFrame, aliases: list[tuple[str, str]] = ()) -> dict[str, int]:
    """Save the graph with the files ``new(file_path, language, content, hash)`` in place of what they were, and without ``gone(file_path)``.

    Only new files are parsed.  All raw edges are resolved again, since a name
    that came or went can change what any file refers to; the graph is the one
    that a scan of all files would give.
    """
    touched = cut(new.select("file_path").unionByName(gone.select("file_path")).distinct())
    g, hashes = store.load(), store.load_file_hashes()
    own = g.nodes.filter("kind <> 'Process'")
    nodes, _, hashes = without_file(own, g.edges.limit(0), hashes, touched)
    raw = raw_without_file(own, store.load_raw_edges(), touched)
    p = parse_all(new)
    raw = cut(raw.unionByName(p.raw))
    fresh = build_graph(nodes.unionByName(p.nodes), raw, aliases)
    return store.save(fresh.nodes, fresh.edges, hashes.unionByName(new.select("file_path", "hash")), raw)


@dataclass
class Update:
    nodes: DataFrame
    raw: DataFrame
    hashes: DataFrame
    counts: dict[str, int]


def incremental_update(nodes: DataFrame, raw: DataFrame, hashes: DataFrame, files: DataFrame) -> Update:
    """The symbols after the changes between ``hashes`` and ``files``: only what was added or modified is parsed."""
    changes = cut(detect_changes(hashes, files.select("file_path", "hash")))
    stale = changes.filter("change IN ('modified', 'removed')").select("file_path")
    fresh = changes.filter("change IN ('added', 'modified')").select("file_path")
    as_edges = raw.select("*", F.col("source_id").alias("target_id"), F.lit(1.0).alias("confidence"))
    kept_nodes, _, kept_hashes = without_file(nodes, as_edges, hashes, stale)
    kept_raw = raw_without_file(nodes, raw, stale)
    new = files.join(fresh, "file_path", "left_semi")
    new_nodes, new_raw = parse_files(new)
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    return Update(kept_nodes.unionByName(new_nodes), kept_raw.unionByName(new_raw), kept_hashes.unionByName(new.select("file_path", "hash")), {c: counts.get(c, 0) for c in ("added", "modified", "removed", "unchanged")})
