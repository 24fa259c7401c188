"""A query per graph operator over the derived graph, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrove.functions import text
from symgrove.operators import export, mro, processes, ranges, rank, resolve, search, traverse
from symgrove.sources import derived, files, samples, store

ANCHOR, TARGET, PART_A, PART_B = "O7", "P5", "P0", "P99"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_GRAPH = f"nodes AS ({derived.plain(derived.NODES)}), edges AS ({derived.plain(derived.EDGES)})"
_LINKS = f"links AS ({derived.plain(derived.LINKS['duckdb'])})"
_ROUTES = f"{_LINKS}, routes AS ({derived.plain(derived.ROUTES, links='links')}), handles AS ({derived.plain(derived.HANDLES, links='links')}), raw AS ({derived.plain(derived.RAW_FETCHES, links='links')})"
_PATH = "CASE WHEN contains({0}, ' ') THEN substr({0}, instr({0}, ' ') + 1) ELSE {0} END"
_FETCHES = f"""{_ROUTES}, exact AS (SELECT raw.*, routes.id AS target_id FROM raw JOIN routes ON target_name = name),
    fetches AS (SELECT source_id, target_id, source_line, 1.0::DOUBLE AS confidence FROM exact
      UNION ALL SELECT raw.source_id, r.id, raw.source_line, 0.5::DOUBLE FROM raw JOIN routes r ON {_PATH.format("raw.target_name")} = {_PATH.format("r.name")}
      WHERE NOT EXISTS (SELECT 1 FROM exact WHERE exact.source_id = raw.source_id AND exact.target_name = raw.target_name))"""


def query(sql: str | None = None, recursive: bool = False, graph: bool = True):
    """Register a query with its SQL, which may use the tables ``nodes`` and ``edges``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{_GRAPH}{',' if sql.lstrip().startswith('@') else ''} " if graph else "") + sql.lstrip().removeprefix("@")
        return f

    return add


_g = derived.graph


@query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file_path) FROM nodes) AS files")
def stats_totals(spark, sf_dir):
    return rank.stats_totals(_g(spark, sf_dir))


@query("SELECT language, count(*) AS count FROM nodes GROUP BY language")
def stats_language(spark, sf_dir):
    return rank.stats_by(_g(spark, sf_dir), "language")


@query("SELECT kind, count(*) AS count FROM nodes GROUP BY kind")
def stats_kind(spark, sf_dir):
    return rank.stats_by(_g(spark, sf_dir), "kind")


@query("SELECT count(DISTINCT file_path) AS total_files, count(*) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM nodes")
def metadata(spark, sf_dir):
    return rank.metadata(_g(spark, sf_dir)).withColumn("languages", F.array_join("languages", ","))


@query("""@o AS (SELECT source_id AS id, count(DISTINCT target_id) AS n FROM edges GROUP BY 1), i AS (SELECT target_id AS id, count(DISTINCT source_id) AS n FROM edges GROUP BY 1)
    SELECT id, name, kind, file_path, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) + coalesce(i.n, 0) AS connections
    FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id) WHERE kind NOT IN ('File', 'Import') ORDER BY connections DESC, id LIMIT 20""")
def hotspots(spark, sf_dir):
    return rank.hotspots(_g(spark, sf_dir))


@query("""SELECT id, name, kind, file_path, line_start, line_end, signature, parent_id FROM nodes WHERE contains(lower(name), 'er#00000001') AND kind NOT IN ('File', 'Import')
    ORDER BY CASE WHEN kind IN ('Class', 'Interface', 'Trait', 'Struct', 'Enum') THEN 1 WHEN kind IN ('Method', 'Function', 'Constructor') THEN 2 ELSE 3 END, length(name), name, id LIMIT 50""")
def find_symbols(spark, sf_dir):
    return rank.find_symbols(_g(spark, sf_dir).nodes, "ER#00000001", 50)


@query("SELECT id, name, language FROM nodes WHERE kind = 'Function' AND language = 'rust' AND contains(file_path, 'part/') AND contains(name, 'ring')")
def graph_query(spark, sf_dir):
    return rank.graph_query(_g(spark, sf_dir).nodes, "Function", "rust", "part/", "ring").select("id", "name", "language")


@query("SELECT id, name FROM nodes WHERE contains(name, 'Customer#0000000')")
def find_by_name(spark, sf_dir):
    return rank.find_by_name(_g(spark, sf_dir).nodes, "Customer#0000000").select("id", "name")


@query(f"SELECT source_id, target_id, kind, source_line, confidence FROM edges WHERE source_id = '{TARGET}' UNION ALL SELECT * FROM edges WHERE target_id = '{TARGET}'")
def adjacency(spark, sf_dir):
    g = _g(spark, sf_dir)
    return rank.outgoing(g, TARGET).unionByName(rank.incoming(g, TARGET))


@query(f"SELECT n.id, n.name, n.kind, n.file_path, n.line_start AS line, e.source_line AS call_site_line FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.target_id = '{TARGET}' AND e.kind = 'CALLS'")
def symbol_callers(spark, sf_dir):
    return rank.symbol_callers(_g(spark, sf_dir), TARGET)


@query(f"SELECT n.id, n.name, n.kind, n.file_path, n.line_start AS line, e.source_line AS call_site_line FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.source_id = '{TARGET}' AND e.kind = 'CALLS'")
def symbol_callees(spark, sf_dir):
    return rank.symbol_callees(_g(spark, sf_dir), TARGET)


@query("SELECT id, name, kind, line_start, line_end, signature, visibility FROM nodes WHERE parent_id = 'C1' AND kind <> 'Import'")
def symbol_members(spark, sf_dir):
    return rank.symbol_members(_g(spark, sf_dir).nodes, "C1")


_KEPT = " AND ".join(f"NOT contains(lower(file_path), '{x}')" for x in rank.DEAD_EXCLUDES)


@query(f"""SELECT id, name, kind, file_path, line_start, line_end, signature, visibility, language FROM nodes n WHERE kind IN ('Function', 'Method', 'Constructor') AND {_KEPT}
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id AND e.kind = 'CALLS')""")
def dead_code(spark, sf_dir):
    return rank.dead_symbols(_g(spark, sf_dir), limit=None)


_WALK = """@w AS (SELECT n.id, n.name, n.kind, n.file_path, n.line_start, 0 AS depth, n.name AS path, CAST(NULL AS INT) AS call_line, [n.name] AS names, CAST([] AS INT[]) AS lines FROM nodes n WHERE n.id = '{start}'
    UNION ALL SELECT n.id, n.name, n.kind, n.file_path, n.line_start, w.depth + 1, {path}, e.source_line, list_append(w.names, n.name), list_append(w.lines, e.source_line)
    FROM w JOIN edges e ON e.{here} = w.id AND e.kind IN ('CALLS', 'FETCHES', 'HANDLES_ROUTE') JOIN nodes n ON n.id = e.{there} WHERE w.depth < {depth})"""
_FORWARD = _WALK.format(start=ANCHOR, path="w.path || ' -> ' || n.name", here="source_id", there="target_id", depth=3)
_BACKWARD = _WALK.format(start=TARGET, path="n.name || ' -> ' || w.path", here="target_id", there="source_id", depth=2)


@query(f"{_FORWARD} SELECT DISTINCT id, name, kind, depth, path, call_line FROM w WHERE depth > 0", recursive=True)
def call_chain(spark, sf_dir):
    return traverse.call_chain(_g(spark, sf_dir), ANCHOR, 3)


@query(f"{_FORWARD} SELECT DISTINCT id, depth, array_to_string(names, '|') AS names, array_to_string(lines, '|') AS lines FROM w WHERE depth > 0", recursive=True)
def chain_arrays(spark, sf_dir):
    out = traverse.chain_arrays(_g(spark, sf_dir), ANCHOR, 3)
    return out.select("id", "depth", F.array_join("names", "|").alias("names"), F.array_join(F.col("lines").cast("array<string>"), "|").alias("lines"))


@query(f"{_BACKWARD} SELECT DISTINCT id, name, kind, file_path, line_start, depth, path, call_line FROM w WHERE depth > 0", recursive=True)
def blast_radius(spark, sf_dir):
    return traverse.reverse_call_chain(_g(spark, sf_dir), TARGET, 2)


_CHURN = """SELECT concat('cust/n', user_id % 25, '.src') AS file_path, ts FROM {events}"""


def _churn(spark, sf_dir):
    return ranges.churn(derived.select(spark, sf_dir, _CHURN), 7)


@query(f"""{_BACKWARD}, d AS (SELECT DISTINCT id, file_path, depth, path, call_line FROM w WHERE depth > 0),
    c AS (SELECT file_path, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS n FROM ({derived.plain(_CHURN)}) GROUP BY 1)
    SELECT file_path, count(*) AS rows, count(DISTINCT id) AS callers, coalesce(max(n), 0) AS commits_in_window FROM d LEFT JOIN c USING (file_path) GROUP BY file_path ORDER BY rows DESC, file_path LIMIT 10""", recursive=True)
def blast_radius_files(spark, sf_dir):
    return traverse.blast_radius_files(_g(spark, sf_dir), TARGET, 2, _churn(spark, sf_dir)).select("file_path", "rows", "callers", "commits_in_window")


@query(f"{_BACKWARD}, d AS (SELECT DISTINCT id, depth, path, call_line FROM w WHERE depth > 0) SELECT depth, count(DISTINCT id) AS callers, count(*) AS rows FROM d GROUP BY depth", recursive=True)
def blast_radius_depths(spark, sf_dir):
    return traverse.blast_radius_depths(_g(spark, sf_dir), TARGET, 2)


@query("""@w AS (SELECT id, 0 AS depth FROM nodes WHERE name = 'Supplier#000000000' UNION ALL SELECT e.source_id, depth + 1 FROM w JOIN edges e ON e.target_id = w.id AND e.kind = 'IMPLEMENTS' WHERE depth < 5)
    SELECT DISTINCT n.id, n.name, n.kind, n.file_path, n.line_start AS line, w.depth FROM w JOIN nodes n USING (id) WHERE depth > 0""", recursive=True)
def find_implementations(spark, sf_dir):
    return traverse.find_implementations(_g(spark, sf_dir), "Supplier#000000000")


_BOTH = "both_ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges)"


@query(f"@{_BOTH}, w AS (SELECT id, 0 AS depth FROM nodes WHERE id = '{PART_B}' UNION SELECT b, depth + 1 FROM w JOIN both_ways ON a = id WHERE depth < 2) SELECT n.id, n.name, n.kind, min(w.depth) AS depth FROM w JOIN nodes n USING (id) GROUP BY ALL", recursive=True)
def neighbors(spark, sf_dir):
    return traverse.neighbors(_g(spark, sf_dir), PART_B, 2)


_TRAILS = "t0 AS (SELECT id, id AS trail, 0 AS depth FROM nodes WHERE id = 'R0'), " + ", ".join(
    f"t{d} AS (SELECT b AS id, min(trail || ',' || b) AS trail, {d} AS depth FROM t{d - 1} JOIN both_ways ON a = t{d - 1}.id JOIN dist ON dist.id = b AND dist.depth = {d} GROUP BY b)" for d in range(1, 16)
)


@query(f"""@{_BOTH}, w AS (SELECT id, 0 AS depth FROM nodes WHERE id = 'R0' UNION SELECT b, depth + 1 FROM w JOIN both_ways ON a = id WHERE depth < 15), dist AS MATERIALIZED (SELECT id, min(depth) AS depth FROM w GROUP BY id), {_TRAILS}
    SELECT n.id, n.name, t.depth, t.trail FROM ({" UNION ALL ".join(f"SELECT * FROM t{d}" for d in range(16))}) t JOIN nodes n USING (id) WHERE n.id = 'C1'""", recursive=True)
def shortest_path(spark, sf_dir):
    return traverse.shortest_path(_g(spark, sf_dir), "R0", "C1")


@query("SELECT id, name, kind, file_path, line_start, line_end, signature FROM nodes WHERE contains(lower(file_path), 'cust/n1') AND kind NOT IN ('File', 'Import') AND line_start <= 120 AND line_end >= 40")
def symbols_in_range(spark, sf_dir):
    return ranges.symbols_in_range(_g(spark, sf_dir).nodes, "cust\\n1", 40, 120)


_HUNKS = "SELECT concat('cust/n', c_nationkey, '.src') AS file_path, CAST(o_orderkey + 1 AS INT) AS new_start, CAST(o_orderkey + 4 AS INT) AS new_end FROM {orders} JOIN {customer} ON o_custkey = c_custkey"


@query(f"SELECT DISTINCT id, name, kind, n.file_path, line_start, line_end FROM nodes n JOIN ({derived.plain(_HUNKS)}) h ON n.file_path = h.file_path AND line_start <= new_end - 1 AND line_end >= new_start - 1 WHERE kind NOT IN ('File', 'Import')")
def changed_symbols(spark, sf_dir):
    return ranges.changed_symbols(_g(spark, sf_dir).nodes, derived.select(spark, sf_dir, _HUNKS))


_SITES = "SELECT concat('L', page_id) AS site_id, 'part/ECONOMY.src' AS file_path, CAST(page_id + 3 AS INT) AS line FROM {pages}"


@query(f"SELECT site_id, arg_min(id, (line_end - line_start, id)) AS symbol_id FROM nodes n JOIN ({derived.plain(_SITES)}) s ON n.file_path = s.file_path AND line BETWEEN line_start AND line_end WHERE kind IN ('Function', 'Method', 'Constructor') GROUP BY site_id")
def enclosing_symbol(spark, sf_dir):
    return ranges.enclosing_symbol(_g(spark, sf_dir).nodes, derived.select(spark, sf_dir, _SITES))


_DIFF = """SELECT c_custkey AS diff_id, CAST(0 AS BIGINT) AS line_no, CASE WHEN c_custkey % 7 = 0 THEN '+++ /dev/null' ELSE concat('+++ b/cust/n', c_nationkey, '.src') END AS line FROM {customer}
    UNION ALL SELECT o_custkey, o_orderkey + 1, CASE WHEN o_orderkey % 3 = 0 THEN concat('@@ -1 +', o_orderkey, ' @@ x') ELSE concat('@@ -', o_orderkey, ',2 +', o_orderkey, ',', o_orderkey % 4, ' @@') END FROM {orders}"""


@query("""SELECT concat('cust/n', c_nationkey, '.src') AS file_path, CAST(o_orderkey AS INT) AS new_start, CAST(o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 4 END - 1 AS INT) AS new_end
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 > 0)""", graph=False)
def parse_hunks(spark, sf_dir):
    return ranges.parse_hunks(derived.select(spark, sf_dir, _DIFF))


@query(f"SELECT file_path, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS commits_in_window, max(ts) AS last_commit_ts FROM ({derived.plain(_CHURN)}) GROUP BY file_path", graph=False)
def churn(spark, sf_dir):
    return _churn(spark, sf_dir).select("file_path", "commits_in_window", "last_commit_ts")


def _bm25(rows: str, columns: list[str], phrases: list[str], shown: str, tail: str) -> str:
    words = lambda c: rf"list_filter(regexp_split_to_array(translate(lower(coalesce({c}, '')), '{search._ACCENTED}', '{search._PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    tf = lambda p: " + ".join(f"len(list_filter({words(c)}, lambda x: starts_with(x, '{p}')))" for c in columns)
    size = " + ".join(f"len({words(c)})" for c in columns)
    idf = lambda j: f"CASE WHEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) > 0 THEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(j)}) * t{j} * 2.2 / (t{j} + 1.2 * (0.25 + 0.75 * size / a))" for j in range(len(phrases)))
    return f"""c AS (SELECT *, {size} AS size, {", ".join(f"{tf(p)} AS t{j}" for j, p in enumerate(phrases))} FROM {rows}),
    s AS (SELECT count(*) AS n, avg(size) AS a, {", ".join(f"count(*) FILTER (WHERE t{j} > 0) AS n{j}" for j in range(len(phrases)))} FROM c)
    SELECT {shown}, round(-({score}), 6) AS score FROM c, s WHERE {" + ".join(f"t{j}" for j in range(len(phrases)))} > 0 {tail}"""


@query("WITH " + _bm25("documents", ["text"], ["thing", "eau"], "doc_id", ""), graph=False)
def search_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search.bm25(docs, "Thing éau thing", ["text"], ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@query("@" + _bm25("nodes", ["name", "signature", "doc_comment"], ["ring", "brand", "order"], "id, name, kind", "AND kind NOT IN ('File', 'Import') ORDER BY score, id LIMIT 200"))
def search_bm25(spark, sf_dir):
    hits = search.bm25(_g(spark, sf_dir).nodes, "ring brand order", search.SYMBOL_TEXT, ["id", "name", "kind"]).filter("kind NOT IN ('File', 'Import')")
    return hits.select("id", "name", "kind", F.round("score", 6).alias("score")).orderBy("score", "id").limit(200)


@query("@" + _bm25("nodes", ["name", "signature", "doc_comment"], ["ring", "brand", "order"], "id", ""))
def search_index(spark, sf_dir):
    """The same scores from the postings of an index, over all nodes."""
    nodes = _g(spark, sf_dir).nodes
    return search.bm25_indexed(search.postings(nodes, search.SYMBOL_TEXT), search.totals(nodes, search.SYMBOL_TEXT), "ring brand order").select("id", F.round("score", 6).alias("score"))


_INDEX = "idx AS (SELECT DISTINCT k AS key, id FROM (SELECT id, unnest([name, string_split(name, '::')[-1], string_split(name, '.')[-1]]) AS k FROM nodes))"
_RAW = f"raw AS ({derived.plain(derived.RAW_CALLS)})"
_CALLS = f"""@{_INDEX}, {_RAW},
    cand AS (SELECT raw_id, 0 AS step, target_name AS key FROM raw UNION ALL SELECT raw_id, 1, upper(substr(target_name, 1, 1)) || substr(target_name, 2) FROM raw WHERE contains(target_name, '.') AND regexp_matches(target_name, '^[a-z]')
      UNION ALL SELECT raw_id, 2, string_split(target_name, '.')[-1] FROM raw WHERE contains(target_name, '.') UNION ALL SELECT raw_id, 3, string_split(target_name, '::')[-1] FROM raw WHERE contains(target_name, '::')),
    hit AS (SELECT raw_id, id, min(step) AS step FROM cand JOIN idx USING (key) GROUP BY 1, 2), least AS (SELECT raw_id, min(step) AS step FROM hit GROUP BY 1),
    won AS (SELECT hit.raw_id, hit.id AS target_id, count(*) OVER (PARTITION BY hit.raw_id) AS hits FROM hit JOIN least USING (raw_id, step)),
    resolved AS (SELECT w.raw_id, r.source_id, w.target_id, 'CALLS' AS kind, r.source_line, CASE WHEN s.file_path = t.file_path THEN 0.95 WHEN hits = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
      FROM won w JOIN raw r USING (raw_id) JOIN nodes t ON t.id = w.target_id LEFT JOIN nodes s ON s.id = r.source_id)"""


def _raw_calls(spark, sf_dir):
    return derived.select(spark, sf_dir, derived.RAW_CALLS)


@query(f"@{_INDEX} SELECT key, id FROM idx")
def name_index(spark, sf_dir):
    return resolve.name_index(_g(spark, sf_dir).nodes)


@query(f"{_CALLS} SELECT * FROM resolved")
def resolve_calls(spark, sf_dir):
    return resolve.resolve_calls(_raw_calls(spark, sf_dir), _g(spark, sf_dir).nodes)


def _classified(spark, sf_dir):
    return resolve.classify_calls(_raw_calls(spark, sf_dir), _g(spark, sf_dir).nodes)


_CLASSIFIED = f"""{_CALLS}, classified AS (SELECT raw_id, target_name, CASE WHEN raw_id IN (SELECT raw_id FROM resolved) THEN 'resolved'
    WHEN starts_with(target_name, 'console.') OR (contains(target_name, '.') AND string_split(target_name, '.')[1] IN (SELECT name FROM nodes WHERE kind = 'Constant')) THEN 'external' ELSE 'unresolved' END AS status FROM raw)"""


@query(f"{_CLASSIFIED} SELECT count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'external') AS external, count(*) FILTER (WHERE status = 'unresolved') AS unresolved, round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'resolved') / greatest(count(*) FILTER (WHERE status <> 'external'), 1), 4) AS percent FROM classified")
def resolution_stats(spark, sf_dir):
    return resolve.resolution_stats(_classified(spark, sf_dir))


@query(f"{_CLASSIFIED} SELECT target_name, count(*) AS count FROM classified WHERE status = 'unresolved' GROUP BY 1 ORDER BY count DESC, target_name LIMIT 20")
def top_unresolved(spark, sf_dir):
    return resolve.top_unresolved(_classified(spark, sf_dir))


_TYPES = """SELECT o_orderkey AS raw_id, concat('O', o_orderkey) AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'EXTENDS' ELSE 'REFERENCES' END AS kind,
    CASE WHEN o_orderkey % 3 = 0 THEN concat(c_name, '<T>') WHEN o_orderkey % 3 = 1 THEN concat('ns::', c_name) ELSE concat('no', c_name) END AS target_name, CAST(NULL AS STRING) AS target_module, 4 AS source_line FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""


@query(f"""@{_INDEX}, raw AS (SELECT *, trim(string_split(target_name, '<')[1]) AS t FROM ({derived.plain(_TYPES)})),
    cand AS (SELECT raw_id, 0 AS step, t AS key FROM raw UNION ALL SELECT raw_id, 1, string_split(t, '::')[-1] FROM raw), hit AS (SELECT raw_id, id, min(step) AS step FROM cand JOIN idx USING (key) GROUP BY 1, 2),
    won AS (SELECT *, count(*) OVER (PARTITION BY raw_id) AS hits FROM (SELECT *, min(step) OVER (PARTITION BY raw_id) AS least FROM hit) WHERE step = least)
    SELECT r.raw_id, r.source_id, w.id AS target_id, r.kind, r.source_line, CASE WHEN s.file_path = t.file_path THEN 0.95 WHEN hits = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
    FROM won w JOIN raw r USING (raw_id) JOIN nodes t ON t.id = w.id JOIN nodes s ON s.id = r.source_id""")
def resolve_types(spark, sf_dir):
    return resolve.resolve_types(derived.select(spark, sf_dir, _TYPES), _g(spark, sf_dir).nodes)


_IMPORTS = """SELECT c_custkey AS raw_id, concat('C', c_custkey) AS source_id, 'IMPORTS' AS kind, CASE WHEN c_custkey % 3 = 0 THEN concat('S', c_custkey % 5) WHEN c_custkey % 3 = 1 THEN concat('x::NATION_', c_nationkey) ELSE 'nothing' END AS target_name,
    CAST(NULL AS STRING) AS target_module, 1 AS source_line FROM {customer}"""


@query(f"""@{_INDEX}, raw AS ({derived.plain(_IMPORTS)}), byid AS (SELECT raw_id, n.id AS target_id, 1.0 AS confidence FROM raw JOIN nodes n ON n.id = target_name),
    byname AS (SELECT raw_id, id AS target_id, CASE WHEN count(*) OVER (PARTITION BY raw_id) = 1 THEN 0.9 ELSE 0.5 END FROM raw JOIN idx ON key = string_split(target_name, '::')[-1] WHERE raw_id NOT IN (SELECT raw_id FROM byid))
    SELECT raw_id, source_id, target_id, kind, source_line, confidence::DOUBLE AS confidence FROM (SELECT * FROM byid UNION ALL SELECT * FROM byname) JOIN raw USING (raw_id)""")
def resolve_imports(spark, sf_dir):
    return resolve.resolve_imports(derived.select(spark, sf_dir, _IMPORTS), _g(spark, sf_dir).nodes)


def _http(spark, sf_dir):
    """The routes and the resolved fetches and handlers of the pages' links."""
    links = derived.links(spark, sf_dir)
    routes, handles, raw = (spark.sql(s, links=links) for s in (derived.ROUTES, derived.HANDLES, derived.RAW_FETCHES))
    raw = raw.select(F.concat_ws("|", "source_id", "target_name").alias("raw_id"), "source_id", F.lit("FETCHES").alias("kind"), "target_name", "source_line")
    return routes, handles, resolve.resolve_fetches(raw, routes).drop("raw_id")


@query(f"WITH {_FETCHES} SELECT source_id, target_id, source_line, confidence FROM fetches", graph=False)
def fetches(spark, sf_dir):
    return _http(spark, sf_dir)[2].drop("kind")


@query(f"WITH {_FETCHES} SELECT DISTINCT f.source_id, h.source_id AS target_id, 'CALLS' AS kind, f.source_line, f.confidence FROM fetches f JOIN handles h USING (target_id)", graph=False)
def http_bridge(spark, sf_dir):
    _, handles, fetched = _http(spark, sf_dir)
    return resolve.http_bridge(fetched.unionByName(handles))


def _web(spark, sf_dir):
    """The derived graph with the routes as nodes and their handlers as edges."""
    g, (routes, handles, _) = _g(spark, sf_dir), _http(spark, sf_dir)
    null = F.lit(None).cast("string")
    made = routes.select("id", "name", F.lit("Route").alias("kind"), F.lit("web/routes.src").alias("file_path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), null.alias("signature"), null.alias("doc_comment"), F.lit("Public").alias("visibility"), F.lit("javascript").alias("language"), null.alias("parent_id"))
    return derived.Graph(g.nodes.unionByName(made), g.edges.unionByName(handles))


@query(f"WITH {_ROUTES} SELECT r.id, r.name, 'web/routes.src' AS file_path, count(DISTINCT h.source_id) AS handlers FROM routes r LEFT JOIN handles h ON h.target_id = r.id GROUP BY ALL", graph=False)
def routes(spark, sf_dir):
    return rank.routes(_web(spark, sf_dir), None)


@query(f"@{_ROUTES} SELECT h.source_id AS id, min(r.name) AS label, 'route' AS reason FROM handles h JOIN routes r ON r.id = h.target_id JOIN nodes n ON n.id = h.source_id GROUP BY 1")
def entry_points(spark, sf_dir):
    return processes.entry_points(_web(spark, sf_dir))


def _traced(spark, sf_dir):
    g = derived.kept(_web(spark, sf_dir))
    return g, processes.trace(g, processes.entry_points(g).select("id", "label"))


_NEXT = """met{d} AS (SELECT * FROM (SELECT f.process_id, f.label, e.target_id AS id, f.step AS src, e.source_line, e.confidence, n.name, (SELECT max(step) FROM lev{p} x WHERE x.process_id = f.process_id) AS last,
      row_number() OVER (PARTITION BY f.process_id, e.target_id ORDER BY f.step, e.source_line, e.confidence DESC) AS k
      FROM lev{p} f JOIN edges e ON e.source_id = f.id AND e.kind = 'CALLS' JOIN nodes n ON n.id = e.target_id
      WHERE NOT EXISTS (SELECT 1 FROM seen{p} s WHERE s.process_id = f.process_id AND s.id = e.target_id)) WHERE k = 1),
    lev{d} AS (SELECT * FROM (SELECT process_id, label, id, last + row_number() OVER (PARTITION BY process_id ORDER BY src, source_line, name, id) AS step, {d} AS depth, confidence FROM met{d}) WHERE step <= 50),
    seen{d} AS (SELECT process_id, id FROM seen{p} UNION ALL SELECT process_id, id FROM lev{d})"""
_STEPS = f"""@{_ROUTES}, lev0 AS (SELECT concat('process:', n.id) AS process_id, concat('Process: ', min(r.name)) AS label, n.id, 1 AS step, 0 AS depth, 1.0::DOUBLE AS confidence
      FROM handles h JOIN routes r ON r.id = h.target_id JOIN nodes n ON n.id = h.source_id GROUP BY n.id), seen0 AS (SELECT process_id, id FROM lev0), """ + ", ".join(_NEXT.format(d=d, p=d - 1) for d in range(1, 7))
_ALL_STEPS = " UNION ALL ".join(f"SELECT * FROM lev{d}" for d in range(7))


@query(f"{_STEPS} SELECT process_id, label, id, step::INT AS step, depth, confidence FROM ({_ALL_STEPS})")
def processes_trace(spark, sf_dir):
    return _traced(spark, sf_dir)[1]


@query(f"{_STEPS} SELECT process_id AS id, label AS name, count(*) AS steps FROM ({_ALL_STEPS}) GROUP BY ALL")
def processes_list(spark, sf_dir):
    g, steps = _traced(spark, sf_dir)
    return rank.processes(derived.Graph(*processes.process_graph(steps, g.nodes)), None)


#: In a block of ten by ten classes the order is that of the columns from a class's own to the first, each from its row up.
@query("""SELECT concat('P', p_partkey) AS class_id, CAST((p_partkey % 10 - c) * (p_partkey % 100 // 10 + 1) + p_partkey % 100 // 10 - r AS INT) AS pos, concat('P', p_partkey - p_partkey % 100 + 10 * r + c) AS ancestor_id
    FROM part, range(10) AS x(c), range(10) AS y(r) WHERE c <= p_partkey % 10 AND r <= p_partkey % 100 // 10""", graph=False)
def c3_mro(spark, sf_dir):
    ext = _g(spark, sf_dir).calls("EXTENDS")
    return mro.c3_mro(ext.select(F.col("source_id").alias("class_id"), F.col("target_id").alias("parent_id"), (F.col("source_line") + 1).alias("ord")))


_SUPER = """SELECT concat('C', c_custkey) AS id, c_name AS name, 'Class' AS kind, CAST(NULL AS STRING) AS parent_id FROM {customer}
    UNION ALL SELECT concat('M', c_custkey), concat(c_name, '.run'), 'Method', concat('C', c_custkey) FROM {customer} WHERE c_custkey % 5 = 0
    UNION ALL SELECT concat('I', c_custkey), concat(c_name, '.__init__'), 'Constructor', concat('C', c_custkey) FROM {customer}"""


@query("""WITH RECURSIVE w AS (SELECT c_custkey AS c, c_custkey // 2 AS a, 1 AS pos FROM customer WHERE c_custkey % 5 = 0 AND c_custkey > 0 UNION ALL SELECT c, a // 2, pos + 1 FROM w WHERE a % 5 <> 0)
    SELECT c AS raw_id, concat('M', c) AS source_id, concat('M', a) AS target_id, 'CALLS' AS kind, 7 AS source_line, 1.0::DOUBLE AS confidence FROM w WHERE a % 5 = 0""", graph=False)
def super_calls(spark, sf_dir):
    """Each class has the one of half its number as its base; every fifth has a method that calls its super()'s."""
    null = F.lit(None).cast("string")
    nodes = derived.select(spark, sf_dir, _SUPER).withColumns({"language": F.lit("python"), "file_path": F.lit("m.py")})
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"))
    name = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    edges = customers.filter("c > 0").select(name("C", F.col("c")).alias("source_id"), name("C", F.expr("c div 2")).alias("target_id"), F.lit("EXTENDS").alias("kind"), F.lit(0).alias("source_line"))
    raw = customers.filter("c % 5 = 0 AND c > 0").select(F.col("c").alias("raw_id"), name("M", F.col("c")).alias("source_id"), F.lit("CALLS").alias("kind"), F.lit("super().run").alias("target_name"), null.alias("target_module"), F.lit(7).alias("source_line"))
    return resolve.resolve_calls(raw, nodes, mro.super_targets(raw, nodes, edges))


_SCRIPT_FILES = "SELECT concat('F', page_id) AS id, concat('p', page_id, '.ts') AS name, 'File' AS kind, CASE WHEN page_id % 7 = 0 THEN concat('web/p', page_id, '/index.tsx') ELSE concat('web/p', page_id, '.ts') END AS file_path FROM {pages}"
_SCRIPT_IMPORTS = """SELECT page_id AS raw_id, concat('F', page_id) AS source_id, 'IMPORTS' AS kind, CASE WHEN page_id % 5 = 4 THEN concat('F', k) ELSE 'nothing' END AS target_name, CAST(page_id % 11 AS INT) AS source_line,
    CASE page_id % 5 WHEN 0 THEN concat('web/./p', k) WHEN 1 THEN concat('web/x/../p', k) WHEN 2 THEN concat('@/p', k) WHEN 3 THEN concat('web/q', k) ELSE CAST(NULL AS STRING) END AS target_module
    FROM (SELECT page_id, CAST(floor(page_id / 2) AS BIGINT) AS k FROM {pages}) x"""


@query("SELECT page_id AS raw_id, concat('F', page_id) AS source_id, concat('F', page_id // 2) AS target_id, 'IMPORTS' AS kind, CAST(page_id % 11 AS INT) AS source_line, 1.0::DOUBLE AS confidence FROM pages WHERE page_id % 5 <> 3", graph=False)
def imports_by_path(spark, sf_dir):
    """Imports of scripts by relative path, by alias and by id; every fifth leads nowhere."""
    return resolve.resolve_imports(derived.select(spark, sf_dir, _SCRIPT_IMPORTS), derived.select(spark, sf_dir, _SCRIPT_FILES), [("@/", "web/")])


_BY_ID = "SELECT o_orderkey AS raw_id, concat('O', o_orderkey) AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CONTAINS' ELSE 'HANDLES_ROUTE' END AS kind, concat('P', o_orderkey) AS target_name, CAST(NULL AS STRING) AS target_module, 3 AS source_line FROM {orders}"


@query("SELECT o_orderkey AS raw_id, concat('O', o_orderkey) AS source_id, concat('P', p_partkey) AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CONTAINS' ELSE 'HANDLES_ROUTE' END AS kind, 3 AS source_line, 1.0::DOUBLE AS confidence FROM orders JOIN part ON o_orderkey = p_partkey", graph=False)
def resolve_by_id(spark, sf_dir):
    return resolve.resolve_by_id(derived.select(spark, sf_dir, _BY_ID), _g(spark, sf_dir).nodes)


def _scanned(spark):
    """The graph of the sample project: parsed, resolved and traced."""
    rows = [(path, language, bytearray(code.encode())) for path, (language, code) in samples.FILES.items()]
    return files.build_graph(*files.parse_files(spark.createDataFrame(rows, "file_path string, language string, content binary")))


@query(samples.values(samples.NODES, "file_path, kind, name, line_start, line_end, visibility, language"), graph=False)
def scan_nodes(spark, sf_dir):
    return _scanned(spark).nodes.select("file_path", "kind", "name", "line_start", "line_end", "visibility", "language").distinct()


@query(samples.values(samples.EDGES, "file_path, source, kind, target, source_line, confidence"), graph=False)
def scan_edges(spark, sf_dir):
    g = _scanned(spark)
    ends = resolve.resolved_names(spark, g.edges, g.nodes).join(g.nodes.select(F.col("id").alias("source_id"), "file_path"), "source_id")
    return ends.select("file_path", "source", "kind", "target", "source_line", "confidence").distinct()


@query("SELECT source_id, target_id, kind, source_line, max(confidence) AS confidence FROM edges GROUP BY ALL UNION ALL SELECT id, parent_id, name, line_start, NULL FROM nodes UNION ALL SELECT DISTINCT file_path, NULL, 'hash', 0, NULL FROM nodes")
def save_load(spark, sf_dir):
    """The graph after a save and a load: edges, nodes and file hashes, one under the other."""
    g = _g(spark, sf_dir)
    kept = store.temporary(spark)
    kept.save(g.nodes, g.edges, g.nodes.select("file_path", F.sha2("file_path", 256).alias("hash")).distinct())
    back = kept.load()
    none = F.lit(None).cast("double").alias("confidence")
    nodes = back.nodes.select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.col("name").alias("kind"), F.col("line_start").alias("source_line"), none)
    hashes = kept.load_file_hashes().filter(F.col("hash") == F.sha2("file_path", 256)).select(F.col("file_path").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.lit("hash").alias("kind"), F.lit(0).alias("source_line"), none)
    return back.edges.unionByName(nodes).unionByName(hashes)


_PATHS = """SELECT page_id AS id, CASE WHEN page_id % 6 = 0 THEN concat('/r/app/p', page_id, '/[id]/page.tsx') WHEN page_id % 6 = 1 THEN concat('/r/app/(g)/[...s]/x', page_id, '/route.ts')
    WHEN page_id % 6 = 2 THEN concat('/r/pages/u', page_id, '/index.tsx') WHEN page_id % 6 = 3 THEN concat('/r/routes/a.$b.c', page_id, '.tsx') WHEN page_id % 6 = 4 THEN concat('/r/pages/api/x', page_id, '.ts') ELSE concat('/r/routes/q', page_id, '/[...k]/+page.svelte') END AS path FROM {pages}"""


@query("""SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN concat('/p', page_id, '/:id') WHEN 1 THEN concat('/:s*/x', page_id) WHEN 2 THEN concat('/u', page_id) WHEN 3 THEN concat('/a/:b/c', page_id)
    WHEN 4 THEN NULL ELSE concat('/q', page_id, '/:k') END AS route FROM pages""", graph=False)
def file_routes(spark, sf_dir):
    return derived.select(spark, sf_dir, _PATHS).select("id", text.file_route(F.col("path")).alias("route"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'K.m' || event_id WHEN event_id % 3 = 1 THEN 'this.a.m' || event_id ELSE 'other.m' || event_id END AS call,
    CASE WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' ELSE s // 2592000 || 'mo ago' END AS ago, 'a/' || event_id || '/d' AS path
    FROM (SELECT event_id, event_id * event_id * 7 AS s FROM events)""", graph=False)
def text_functions(spark, sf_dir):
    """Calls of members under their class, times in words, and paths without detours."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
    head = F.when(F.col("id") % 6 == 0, "this.m").when(F.col("id") % 3 == 0, "self.m").when(F.col("id") % 3 == 1, "this.a.m").otherwise("other.m")
    path = F.concat(F.lit("./a//b/../"), F.col("id").cast("string"), F.lit("\\x\\..\\d"))
    return e.select("id", text.qualify_member_call(F.concat(head, F.col("id").cast("string")), F.lit("K")).alias("call"), text.humanize_ago(F.col("id") * F.col("id") * 7).alias("ago"), text.normal_path(path).alias("path"))


_V1 = "SELECT concat('d', doc_id) AS file_path, text FROM {documents} WHERE source <> 'src1'"
_V2 = "SELECT concat('d', doc_id) AS file_path, CASE WHEN lang = 'fr' THEN concat(text, '!') ELSE text END AS text FROM {documents} WHERE source <> 'src2'"


@query(f"""SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.file_path IS NULL THEN 'added' WHEN b.file_path IS NULL THEN 'removed' WHEN a.text <> b.text THEN 'modified' ELSE 'unchanged' END AS change
    FROM ({derived.plain(_V1)}) a FULL JOIN ({derived.plain(_V2)}) b USING (file_path)""", graph=False)
def detect_changes(spark, sf_dir):
    old, new = (derived.select(spark, sf_dir, q).select("file_path", F.sha2("text", 256).alias("hash")) for q in (_V1, _V2))
    return store.detect_changes(old, new)


@query("SELECT p.id AS source_id, n.id AS target_id, 'CONTAINS' AS kind, n.line_start AS source_line, 1.0::DOUBLE AS confidence FROM nodes n JOIN nodes p ON p.id = n.parent_id")
def contains_synthesis(spark, sf_dir):
    return store.contains_edges(_g(spark, sf_dir).nodes)


@query("SELECT source_id, target_id, kind, source_line, max(confidence) AS confidence FROM (SELECT * FROM edges UNION ALL SELECT source_id, target_id, kind, source_line, 0.5 FROM edges) GROUP BY ALL")
def dedup_edges(spark, sf_dir):
    edges = _g(spark, sf_dir).edges
    return resolve.dedup_edges(edges.unionByName(edges.withColumn("confidence", F.lit(0.5))))


@query("""SELECT n.id AS id FROM nodes n WHERE n.file_path <> 'cust/n3.src' UNION ALL SELECT e.source_id || '>' || e.target_id FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE a.file_path <> 'cust/n3.src' AND b.file_path <> 'cust/n3.src'""")
def remove_file(spark, sf_dir):
    g = _g(spark, sf_dir)
    gone = spark.createDataFrame([("cust/n3.src",)], "file_path string")
    hashes = g.nodes.select("file_path", F.sha2("file_path", 256).alias("hash")).distinct()
    nodes, edges, _ = store.without_file(g.nodes, g.edges, hashes, gone)
    return nodes.select("id").unionByName(edges.select(F.concat_ws(">", "source_id", "target_id").alias("id")))


_COLOR = " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN '{name}'" for name, kinds in export.COLORS.items())


@query(f"""SELECT unnest(['digraph symbols {{', '  node [shape=box fontsize=10]; rankdir=LR;', '}}']) AS line
    UNION ALL SELECT concat('  "', id, '" [label="', replace(string_split(name, '::')[-1], '"', '\\"'), '" style=filled fillcolor="', CASE {_COLOR} ELSE 'white' END, '"];') FROM nodes WHERE kind NOT IN ('File', 'Import')
    UNION ALL SELECT concat('  "', source_id, '" -> "', target_id, '" [label="', kind, '"];') FROM edges WHERE kind <> 'CONTAINS'""")
def export_dot(spark, sf_dir):
    return export.as_dot(_g(spark, sf_dir)).select("line")


@query("""@k AS (SELECT source_id AS id, string_agg(DISTINCT name, ', ' ORDER BY name) AS calls FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.kind = 'CALLS' GROUP BY 1),
    b AS (SELECT target_id AS id, string_agg(DISTINCT name, ', ' ORDER BY name) AS called_by FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.kind = 'CALLS' GROUP BY 1)
    SELECT file_path, '## ' || file_path || chr(10) || string_agg('  ' || signature || '  [L' || line_start || '-L' || line_end || ']' || chr(10) || coalesce('    calls: ' || calls || chr(10), '') || coalesce('    called_by: ' || called_by || chr(10), ''), ''
      ORDER BY CASE WHEN kind IN ('Function', 'Method') THEN 0 WHEN kind IN ('Class', 'Struct', 'Trait') THEN 1 ELSE 2 END, line_start, id) || chr(10) AS section
    FROM nodes LEFT JOIN k USING (id) LEFT JOIN b USING (id) GROUP BY file_path""")
def export_ai_context(spark, sf_dir):
    return export.ai_context(_g(spark, sf_dir))


_IDIOMS = {
    "raw_high_conf": "SELECT a.name AS caller, b.name AS callee FROM {edges} e JOIN {nodes} a ON a.id = e.source_id JOIN {nodes} b ON b.id = e.target_id WHERE e.kind = 'CALLS' AND e.confidence >= 0.9",
    "raw_conf_hist": "SELECT confidence, count(*) AS n FROM {edges} GROUP BY confidence ORDER BY confidence DESC",
    "raw_file_symbols": "SELECT id, name, kind, line_start FROM {nodes} WHERE file_path LIKE '%cust/n3.src' AND kind <> 'Import' ORDER BY line_start",
    "raw_most_called": "SELECT n.id, n.name, count(*) AS calls FROM {edges} e JOIN {nodes} n ON n.id = e.target_id WHERE e.kind = 'CALLS' GROUP BY n.id, n.name ORDER BY calls DESC, n.id LIMIT 10",
    "raw_callers": "SELECT DISTINCT n.name FROM {edges} e JOIN {nodes} n ON n.id = e.source_id WHERE e.kind = 'CALLS' AND e.target_id = (SELECT min(id) FROM {nodes} WHERE name = 'Supplier#000000003')",
}


def _idiom(sql: str):
    def run(spark, sf_dir):
        g = _g(spark, sf_dir)
        return store.raw_query(spark, sql, nodes=g.nodes, edges=g.edges)

    return run


for _name, _sql in _IDIOMS.items():
    QUERIES[_name] = _idiom(_sql)
    SQL[_name] = f"WITH {_GRAPH} " + _sql.format(nodes="nodes", edges="edges")


@query(f"""@w AS (SELECT id, name, 0 AS depth FROM nodes WHERE id = '{ANCHOR}' UNION ALL SELECT n.id, n.name, w.depth + 1 FROM w JOIN edges e ON e.source_id = w.id AND e.kind = 'CALLS' JOIN nodes n ON n.id = e.target_id WHERE w.depth < 3) SELECT DISTINCT name, depth FROM w""", recursive=True)
def raw_call_tree(spark, sf_dir):
    g = derived.kept(_g(spark, sf_dir))
    return store.raw_query(spark, f"""WITH RECURSIVE w AS (SELECT id, name, 0 AS depth FROM {{nodes}} WHERE id = '{ANCHOR}' UNION ALL
        SELECT n.id, n.name, w.depth + 1 FROM w JOIN {{edges}} e ON e.source_id = w.id AND e.kind = 'CALLS' JOIN {{nodes}} n ON n.id = e.target_id WHERE w.depth < 3) SELECT DISTINCT name, depth FROM w""", nodes=g.nodes, edges=g.edges)
