"""Line ranges: diffs, the symbols they touch, enclosing symbols and churn.

Stored lines count from 0, those of diffs from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.functions.text import contains, forward_slashes, humanize_ago
from symgrove.sources.derived import Graph

#: Lines in a bucket of the interval join.
BUCKET = 64


def symbols_in_range(nodes: DataFrame, path_part: str, first: int, last: int) -> DataFrame:
    """Symbols of files whose path contains ``path_part`` that overlap lines ``first`` to ``last``, all counted from 0."""
    hit = contains(forward_slashes(F.col("file_path")), path_part.replace("\\", "/"))
    own = nodes.filter(hit & ~F.col("kind").isin(schema.HIDDEN) & (F.col("line_start") <= last) & (F.col("line_end") >= first))
    return own.select("id", "name", "kind", "file_path", "line_start", "line_end", "signature").orderBy("file_path", "line_start", "id")


def _bucketed(df: DataFrame, start: str, end: str) -> DataFrame:
    b = lambda c: F.floor(F.col(c) / BUCKET).cast("int")
    return df.withColumn("__lo", b(start)).withColumn("__b", F.explode(F.sequence(b(start), F.greatest(b(start), b(end)))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str) -> DataFrame:
    """Pairs of one ``key`` whose closed intervals overlap.

    An equi-join on key and bucket of lines; a pair counts in the first bucket
    that both have, so none comes twice.  Column names must differ but for the
    key.
    """
    a = _bucketed(left, l_start, l_end).withColumnRenamed("__lo", "__la")
    b = _bucketed(right, r_start, r_end).withColumnRenamed("__lo", "__lb")
    j = a.join(b, [key, "__b"]).filter((F.col(l_start) <= F.col(r_end)) & (F.col(l_end) >= F.col(r_start)) & (F.col("__b") == F.greatest("__la", "__lb")))
    return j.drop("__b", "__la", "__lb")


def enclosing_symbol(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, symbol_id): the innermost callable around each ``sites(site_id, file_path, line)``."""
    own = nodes.filter(F.col("kind").isin(schema.CALLABLE)).select("file_path", F.col("id").alias("symbol_id"), "line_start", "line_end")
    j = overlap_join(own, sites.select("site_id", "file_path", "line", F.col("line").alias("line_to")), "file_path", "line_start", "line_end", "line", "line_to")
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("width"), "symbol_id"))
    return j.groupBy("site_id").agg(best.alias("m")).select("site_id", "m.symbol_id")


def parse_hunks(lines: DataFrame) -> DataFrame:
    """(file_path, new_start, new_end) from ``lines(diff_id, line_no, line)`` of unified diffs.

    The current file is the last ``+++`` line above; deleted files and hunks
    without new lines are skipped, and a missing count is 1.
    """
    path = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.trim(F.substring("line", 5, 1 << 30)), "^b/", ""))
    above = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    got = lines.filter(F.col("line").startswith("+++ ") | F.col("line").startswith("@@ ")).withColumn("file_path", F.last(path, ignorenulls=True).over(above)).filter(F.col("line").rlike(head))
    start, count = F.regexp_extract("line", head, 1).cast("int"), F.coalesce(F.expr(r"nullif(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 2), '')").cast("int"), F.lit(1))
    got = got.select("file_path", start.alias("new_start"), count.alias("n")).filter("n > 0 AND file_path IS NOT NULL AND file_path <> '/dev/null'")
    return got.select("file_path", "new_start", (F.col("new_start") + F.col("n") - 1).alias("new_end"))


def changed_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """The distinct symbols that ``hunks(file_path, new_start, new_end)`` touch."""
    own = nodes.filter(~F.col("kind").isin(schema.HIDDEN)).withColumn("file_path", forward_slashes(F.col("file_path")))
    zero = hunks.select(forward_slashes(F.col("file_path")).alias("file_path"), (F.col("new_start") - 1).alias("h_start"), (F.col("new_end") - 1).alias("h_end"))
    hit = overlap_join(own.select("id", "name", "kind", "file_path", "line_start", "line_end"), zero, "file_path", "line_start", "line_end", "h_start", "h_end")
    return hit.select("id", "name", "kind", "file_path", "line_start", "line_end").distinct()


def changed_symbol_callers(g: Graph, hunks: DataFrame, limit: int = 10) -> DataFrame:
    """The changed symbols with up to ``limit`` direct callers each."""
    changed = changed_symbols(g.nodes, hunks)
    calls = g.calls("CALLS").select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("id"), "source_line")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("source_line", "caller_id"))
    first = calls.join(changed.select("id"), "id", "left_semi").groupBy("id", "caller_id").agg(F.min("source_line").alias("source_line")).withColumn("n", rank).filter(F.col("n") <= limit)
    return changed.join(first.drop("n"), "id", "left")


def churn(commits: DataFrame, days: int = 30, now=None) -> DataFrame:
    """(file_path, commits_in_window, last_commit_ts) of ``commits(file_path, ts)``; the window ends at ``now``, by default the last commit."""
    end = commits.agg(F.max("ts").alias("end")) if now is None else commits.sparkSession.range(1).select(F.lit(now).cast("timestamp").alias("end"))
    inside = (F.col("ts") >= F.col("end") - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= F.col("end"))
    each = commits.crossJoin(F.broadcast(end)).groupBy("file_path").agg(F.count(F.when(inside, 1)).alias("commits_in_window"), F.max("ts").alias("last_commit_ts"), F.first("end").alias("end"))
    ago = humanize_ago(F.unix_timestamp("end") - F.unix_timestamp("last_commit_ts"))
    return each.select("file_path", "commits_in_window", "last_commit_ts", ago.alias("ago"))
