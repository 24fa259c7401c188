"""Command line: scan a project and ask about its graph.

    python -m symgrove.cli --db DIR scan PATH [--clean] [--no-doc-comments]
    python -m symgrove.cli --db DIR blast-radius NAME --depth 2
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.operators import export, ranges, rank, resolve, traverse
from symgrove.sources import files
from symgrove.sources.derived import Graph
from symgrove.sources.store import Store, raw_query

DB = ".symgrove/graph"
TARGETS = [*schema.CALLABLE, "Class", "Interface", "Struct", "Trait"]


def session() -> SparkSession:
    spark = SparkSession.builder.appName("symgrove").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows(df: DataFrame) -> list[dict]:
    """The rows of a bounded answer, as plain values."""
    return [json.loads(x) for x in df.toJSON().collect()]


def diff_lines(spark: SparkSession, repo: str, base: str | None) -> DataFrame:
    """Lines of the repository's diff against ``base``, or of the work tree."""
    cmd = ["git", "-C", repo, "diff", "--unified=0", "--no-color", *([f"{base}...HEAD"] if base else ["HEAD"])]
    out = subprocess.run(cmd, capture_output=True, text=True, check=True).stdout.splitlines()
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(out)], "diff_id long, line_no long, line string")


def commits(spark: SparkSession, repo: str) -> DataFrame:
    """(file_path, ts) of the whole history, from one run of git."""
    out = subprocess.run(["git", "-C", repo, "log", "--format=%x00%ct", "--name-only"], capture_output=True, text=True, check=True).stdout
    found, ts = [], 0
    for x in out.splitlines():
        if x.startswith("\0"):
            ts = int(x[1:])
        elif x:
            found.append((x, ts))
    return spark.createDataFrame(found, "file_path string, s long").select("file_path", F.timestamp_seconds("s").alias("ts"))


def under_root(df: DataFrame, repo: str) -> DataFrame:
    """Paths of a repository as the graph has them, below the root's name."""
    return df.withColumn("file_path", F.concat(F.lit(Path(repo).resolve().name + "/"), "file_path"))


def answer(spark: SparkSession, store: Store, g: Graph, a: argparse.Namespace) -> object:
    """What a read-only command prints."""
    c = a.command
    if c == "stats":
        return {**rows(rank.stats_totals(g))[0], "languages": rows(rank.stats_by(g, "language")), "kinds": rows(rank.stats_by(g, "kind"))}
    if c == "hotspots":
        return rows(rank.hotspots(g, a.limit))
    if c == "search":
        return rows(store.search(a.query, a.limit))
    if c == "routes":
        return rows(rank.routes(g, a.limit))
    if c == "processes":
        return rows(rank.processes(g, a.limit))
    if c == "dead-code":
        return rows(rank.dead_symbols(g, a.kinds.split(","), [] if a.include_all else rank.DEAD_EXCLUDES, a.limit))
    if c == "query":
        return rows(raw_query(spark, a.sql))
    if c == "symbol":
        found = rank.symbol_detail(g, a.name, a.limit)
        parts = ["symbol", *(x for x in ("callers", "callees", "members") if getattr(a, x))]
        return {x: rows(found[x]) for x in parts} if found else None
    if c == "call-chain":
        start = rank.resolve_symbol(g.nodes, a.name, schema.CALLABLE, 5)
        return rows(traverse.call_chain(g, start, a.depth)) if start else None
    if c == "blast-radius":
        target = rank.resolve_symbol(g.nodes, a.name, TARGETS)
        if target is None:
            return None
        churn = under_root(ranges.churn(commits(spark, a.repo), a.recency_days, _now()), a.repo) if a.with_recency else None
        return {"depths": rows(traverse.blast_radius_depths(g, target, a.depth)), "files": rows(traverse.blast_radius_files(g, target, a.depth, churn))}
    if c == "changed-symbols":
        hunks = under_root(ranges.parse_hunks(diff_lines(spark, a.repo, a.base)), a.repo)
        return rows(ranges.changed_symbol_callers(g, hunks) if a.callers else ranges.changed_symbols(g.nodes, hunks))
    raise ValueError(c)


def _now():
    import datetime

    return datetime.datetime.now()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symgrove")
    p.add_argument("--db", default=DB)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple):
        s = sub.add_parser(name)
        for f, kw in flags:
            s.add_argument(f, **kw)

    limit = lambda n: ("--limit", {"type": int, "default": n})
    depth = lambda n: ("--depth", {"type": int, "default": n})
    flag = lambda f: (f, {"action": "store_true"})
    name, repo = ("name", {}), ("--repo", {"default": "."})
    add("scan", ("path", {}), flag("--clean"), flag("--no-doc-comments"))
    add("export", ("--format", {"choices": ["json", "dot", "ai-context"], "default": "json"}), ("--output", {}), ("--max-tokens", {"type": int}))
    add("stats")
    add("hotspots", limit(20))
    add("search", ("query", {}), limit(20))
    add("routes", limit(100))
    add("processes", limit(20))
    add("dead-code", limit(200), ("--kinds", {"default": ",".join(schema.CALLABLE)}), flag("--include-all"))
    add("query", ("sql", {}))
    add("symbol", name, flag("--callers"), flag("--callees"), flag("--members"), limit(10))
    add("call-chain", name, depth(3))
    add("blast-radius", name, depth(2), flag("--with-recency"), ("--recency-days", {"type": int, "default": 30}), repo)
    add("changed-symbols", ("--base", {}), flag("--callers"), repo)
    add("mcp")
    return p


def exported(g: Graph, form: str, max_tokens: int | None = None) -> DataFrame:
    """One text column, in the order to print."""
    if form == "json":
        return export.as_json(g)
    if form == "dot":
        return export.as_dot(g).orderBy("ord", "line").select("line")
    return export.ai_context(g, max_tokens).orderBy("file_path").select("section")


def main(argv: list[str] | None = None, out: Callable[[str], object] = print) -> int:
    a = parser().parse_args(argv)
    spark = session()
    store = Store(spark, a.db)
    if a.command == "scan":
        config = next((x for x in (Path(a.path, "tsconfig.json"), Path(a.path, "jsconfig.json")) if x.exists()), None)
        aliases = resolve.path_aliases(config.read_text(), Path(a.path).resolve().name) if config else []
        out(json.dumps(files.scan(spark, str(Path(a.path).resolve()), store, a.clean, not a.no_doc_comments, aliases=aliases)))
        return 0
    if a.command == "mcp":
        from symgrove import mcp

        return mcp.serve(spark, store, sys.stdin.buffer, sys.stdout.buffer)
    g = store.load()
    store.views()
    if a.command == "export":
        df = exported(g, a.format, a.max_tokens)
        if a.output:
            df.write.mode("overwrite").text(a.output)
        else:
            for r in df.toLocalIterator():
                out(r[0].rstrip("\n"))
        return 0
    got = answer(spark, store, g, a)
    out(json.dumps(got, indent=2, default=str) if got else "(no results)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
