"""Names to nodes: the resolution of raw edges.

All matching is by equi-joins with an index of names.  A cascade of rules is one
join: each raw edge brings a candidate key per rule, with the rule's number,
and the least number that hit decides.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrove import schema
from symgrove.functions.text import normal_path, without_script_extension
from symgrove.plans.iterate import cut, union

#: Globals, hooks and utility functions of script runtimes, which no project defines: a call of one of them is external, not unresolved.
EXTERNAL_NAMES = """
    Boolean Number String super this
    setTimeout clearTimeout setInterval clearInterval requestAnimationFrame cancelAnimationFrame
    encodeURI decodeURI encodeURIComponent decodeURIComponent isNaN isFinite parseInt parseFloat
    useState useReducer useRef useMemo useCallback useContext useEffect useLayoutEffect useImperativeHandle useDebugValue
    cloneDeep isEqual isNil omit pick debounce throttle
""".split()
#: The same for whatever follows these objects, and for dates.
EXTERNAL_HEADS = [f"{x}." for x in "console window document Math JSON Object Array String Number Promise React Store _".split()] + ["new Date"]
SCRIPTS = ["", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts", "/index.tsx"]


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, id): each node under its name and the name's last segments."""
    colons, dots = F.element_at(F.split("name", "::"), -1), F.substring_index("name", ".", -1)
    return nodes.select("id", F.explode(F.array_distinct(F.array("name", colons, dots))).alias("key")).select("key", "id")


def _winners(raw: DataFrame, index: DataFrame, by: str, keys: list[Column]) -> DataFrame:
    """(by, key, hits): for each distinct ``by`` the first of its ``keys`` that is in the index, and how many nodes have it.

    Rules are decided by counts of one row per key, so nothing fans out here,
    and each name is decided once, however many raw edges have it.
    """
    rules = F.array(*[F.struct(F.lit(i).alias("step"), k.alias("key")) for i, k in enumerate(keys)])
    candidates = raw.select(by).filter(F.col(by).isNotNull()).distinct().select(by, F.explode(rules).alias("k")).select(by, "k.step", "k.key").filter("key IS NOT NULL AND key <> ''")
    counts = index.groupBy("key").agg(F.count("*").alias("hits"))
    return candidates.join(counts, "key").groupBy(by).agg(F.min_by(F.struct("key", "hits"), "step").alias("w")).select(by, "w.key", "w.hits")


def _hits(raw: DataFrame, index: DataFrame, by: str, keys: list[Column]) -> DataFrame:
    """The raw edges with ``hits`` and ``id`` (and what else the index has) for each node of their first key that hit."""
    return raw.join(_winners(raw, index, by, keys), by).join(index, "key").drop("key").withColumnRenamed("id", "target_id")


def _call_keys() -> list[Column]:
    """Exact; with a capital head; last dotted segment; last segment after colons."""
    t = F.col("target_name")
    head = F.substring_index(t, ".", 1)
    capital = F.when(t.contains(".") & head.rlike("^[a-z]"), F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))
    return [t, capital, F.when(t.contains("."), F.substring_index(t, ".", -1)), F.when(t.contains("::"), F.element_at(F.split(t, "::"), -1))]


def _type_keys() -> list[Column]:
    """Without type parameters: exact; last segment after colons."""
    t = F.trim(F.substring_index("target_name", "<", 1))
    return [t, F.element_at(F.split(t, "::"), -1)]


def _import_keys() -> list[Column]:
    t = F.col("target_name")
    return [t, F.element_at(F.split(t, "::"), -1)]


def file_index(nodes: DataFrame) -> DataFrame:
    """(key, id): files under their path with and without script extension; the greatest id of a key."""
    path = normal_path(F.col("file_path"))
    keys = nodes.filter("kind = 'File'").select("id", F.explode(F.array_distinct(F.array(path, without_script_extension(path)))).alias("key"))
    return keys.groupBy("key").agg(F.max("id").alias("id"))


def _path_hits(raw: DataFrame, files: DataFrame, module: str = "target_module") -> DataFrame:
    """The file of an imported module: as it stands, then with the extensions and index files of scripts."""
    base = normal_path(F.col(module))
    return _hits(raw, files, module, [F.concat(base, F.lit(x)) for x in SCRIPTS])


def path_aliases(config: str, root: str = "") -> list[tuple[str, str]]:
    """(prefix, folder) in file order from the text of a tsconfig.json or jsconfig.json."""
    no_comments = re.sub(r"(^|\s)//.*$", r"\1", config, flags=re.M)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", no_comments)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return []
    base = "/".join(x for x in (root.strip("/"), options.get("baseUrl", ".").strip("./")) if x)
    out = []
    for key, targets in (options.get("paths") or {}).items():
        if targets:
            out.append((key.removesuffix("*"), "/".join(x for x in (base, targets[0].removesuffix("*").removeprefix("./")) if x)))
    return out


def aliased(raw: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """``raw`` with ``aliased``: the target as a path by the first alias that fits."""
    t, out = F.coalesce("target_module", "target_name"), F.lit(None).cast("string")
    for prefix, folder in reversed(aliases):
        out = F.when(t.startswith(prefix), F.concat(F.lit(folder.rstrip("/") + "/"), F.substring(t, len(prefix) + 1, 1 << 30))).otherwise(out)
    return raw.withColumn("aliased", out)


def located_index(nodes: DataFrame) -> DataFrame:
    """name_index() with the file of each node, so that targets needn't be looked up again."""
    colons, dots = F.element_at(F.split("name", "::"), -1), F.substring_index("name", ".", -1)
    return nodes.select("id", F.col("file_path").alias("t_file"), F.explode(F.array_distinct(F.array("name", colons, dots))).alias("key"))


def _ranked(raw: DataFrame, nodes: DataFrame, keys: list[Column]) -> DataFrame:
    """Edges to all nodes of the first rule that hit: in the same file, else one hit, else several."""
    sources = nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("s_file"))
    at = raw.select("raw_id", "source_id", "kind", "source_line", "target_name").join(sources, "source_id", "left")
    c = F.when(F.col("s_file") == F.col("t_file"), schema.SAME_FILE).when(F.col("hits") == 1, schema.UNIQUE).otherwise(schema.AMBIGUOUS)
    return _hits(at, located_index(nodes), "target_name", keys).select("raw_id", *_edge_columns(), c.alias("confidence"))


def _edge_columns() -> list[str]:
    return ["source_id", "target_id", "kind", "source_line"]


def _certain(hits: DataFrame, confidence: Column | None = None) -> DataFrame:
    confidence = F.lit(schema.CERTAIN) if confidence is None else confidence
    return hits.select("raw_id", *_edge_columns(), confidence.alias("confidence"))


def _left(raw: DataFrame, done: DataFrame) -> DataFrame:
    return raw.join(done.select("raw_id").distinct(), "raw_id", "left_anti")


def resolve_imports(raw: DataFrame, nodes: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """A node's id; else a file by path, then by alias; else by name."""
    raw = raw.filter("kind = 'IMPORTS'")
    ids, files = nodes.select(F.col("id").alias("target_id")), file_index(nodes)
    by_id = _certain(raw.filter("target_module IS NULL").withColumn("target_id", F.col("target_name")).join(ids, "target_id", "left_semi"))
    rest = _left(raw, by_id)
    by_path = _certain(_path_hits(rest, files))
    rest = _left(rest, by_path)
    found = [by_id, by_path]
    if aliases:
        by_alias = _certain(_path_hits(aliased(rest, list(aliases)), files, "aliased"))
        rest = _left(rest, by_alias)
        found.append(by_alias)
    found.append(_certain(_hits(rest, name_index(nodes), "target_name", _import_keys()), F.when(F.col("hits") == 1, schema.UNIQUE).otherwise(schema.AMBIGUOUS)))
    return union(found)


def resolve_types(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    return _ranked(raw.filter(F.col("kind").isin("EXTENDS", "IMPLEMENTS", "REFERENCES")), nodes, _type_keys())


def resolve_by_id(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """CONTAINS and HANDLES_ROUTE, whose targets are ids."""
    raw = raw.filter(F.col("kind").isin("CONTAINS", "HANDLES_ROUTE"))
    return _certain(raw.withColumn("target_id", F.col("target_name")).join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi"))


def resolve_fetches(raw: DataFrame, routes: DataFrame) -> DataFrame:
    """Fetches to ``routes(id, name)``: of the same verb and path, else of the same path, at half the confidence."""
    raw = raw.filter("kind = 'FETCHES'")
    exact = raw.join(routes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_name").select("raw_id", *_edge_columns(), F.lit(schema.CERTAIN).alias("confidence"))
    path = lambda c: F.when(F.col(c).contains(" "), F.expr(f"substring({c}, instr({c}, ' ') + 1)")).otherwise(F.col(c))
    loose = _left(raw, exact).withColumn("path", path("target_name")).join(routes.select(F.col("id").alias("target_id"), path("name").alias("path")), "path").select("raw_id", *_edge_columns(), F.lit(schema.AMBIGUOUS).alias("confidence"))
    return exact.unionByName(loose)


def http_bridge(edges: DataFrame) -> DataFrame:
    """Calls from who fetches a route to who handles it, with the fetch's line and confidence."""
    fetches = edges.filter("kind = 'FETCHES'").select("source_id", F.col("target_id").alias("route"), "source_line", "confidence")
    handles = edges.filter("kind = 'HANDLES_ROUTE'").select(F.col("source_id").alias("target_id"), F.col("target_id").alias("route"))
    return fetches.join(handles, "route").select("source_id", "target_id", F.lit("CALLS").alias("kind"), "source_line", "confidence").distinct()


def is_external(target: Column) -> Column:
    out = target.isin(EXTERNAL_NAMES)
    for x in EXTERNAL_HEADS:
        out = out | target.startswith(x)
    return out


def classify_calls(raw: DataFrame, nodes: DataFrame, super_targets: DataFrame | None = None) -> DataFrame:
    """(target_name, status, n): the calls of each name that are resolved, external or unresolved.

    Counts of the distinct names are joined with the distinct keys of the index;
    no target is looked up to learn that there is one.
    """
    raw = raw.filter("kind = 'CALLS'")
    counts = []
    if super_targets is not None:
        counts.append(raw.join(super_targets.select("raw_id").distinct(), "raw_id", "left_semi").groupBy("target_name").agg(F.count("*").alias("n")).select("target_name", F.lit("resolved").alias("status"), "n"))
        raw = _left(raw, super_targets)
    names = raw.groupBy("target_name").agg(F.count("*").alias("n")).withColumn("head", F.when(F.col("target_name").contains("."), F.substring_index("target_name", ".", 1)))
    done = _winners(raw, name_index(nodes), "target_name", _call_keys()).select("target_name", F.lit(True).alias("done"))
    constants = nodes.filter("kind = 'Constant'").select(F.col("name").alias("head"), F.lit(True).alias("constant")).distinct()
    status = F.when(F.col("done"), "resolved").when(is_external(F.col("target_name")) | F.coalesce("constant", F.lit(False)), "external").otherwise("unresolved")
    counts.append(names.join(done, "target_name", "left").join(constants, "head", "left").select("target_name", status.alias("status"), "n"))
    return union(counts)


def resolution_stats(classified: DataFrame) -> DataFrame:
    """One row: counts and the resolved share, external calls left out of it."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0))
    return classified.agg(n("resolved").alias("resolved"), n("external").alias("external"), n("unresolved").alias("unresolved")).withColumn("percent", F.round(100.0 * F.col("resolved") / F.greatest(F.col("resolved") + F.col("unresolved"), F.lit(1)), 4))


def top_unresolved(classified: DataFrame, limit: int = 20) -> DataFrame:
    return classified.filter("status = 'unresolved'").groupBy("target_name").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "target_name").limit(limit)


def resolve_calls(raw: DataFrame, nodes: DataFrame, super_targets: DataFrame | None = None) -> DataFrame:
    """Calls of ``super()`` through ``super_targets(raw_id, target_id)`` where given, all others by name."""
    raw = raw.filter("kind = 'CALLS'")
    found = []
    if super_targets is not None:
        found.append(_certain(raw.join(super_targets.select("raw_id", "target_id"), "raw_id")))
        raw = _left(raw, super_targets)
    found.append(_ranked(raw, nodes, _call_keys()))
    return union(found)


def resolve_edges(raw: DataFrame, nodes: DataFrame, aliases: list[tuple[str, str]] = (), super_targets=None) -> DataFrame:
    """The edges table of all raw edges: structure first, then calls, then calls across HTTP.

    ``super_targets`` gets (raw edges, nodes, structural edges) and returns
    (raw_id, target_id).
    """
    structural = cut(union([resolve_by_id(raw, nodes), resolve_imports(raw, nodes, aliases), resolve_types(raw, nodes), resolve_fetches(raw, nodes.filter("kind = 'Route'").select("id", "name"))]))
    calls = cut(resolve_calls(raw, nodes, cut(super_targets(raw, nodes, structural)) if super_targets else None))
    edges = structural.unionByName(calls).drop("raw_id")
    return dedup_edges(edges.unionByName(http_bridge(edges)))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind, line), with the highest confidence."""
    return edges.groupBy("source_id", "target_id", "kind", "source_line").agg(F.max("confidence").alias("confidence"))


def resolved_names(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends."""
    a, b = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source")), nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    return edges.join(a, "source_id").join(b, "target_id")
