"""A property graph derived from the star schema.

The statements are plain SQL with table names in braces, so Spark and any other
engine make the same graph of the same tables.  Unions of one branch per kind
let Catalyst drop the branches that a filter on ``kind`` excludes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from symgrove import schema
from symgrove.plans.iterate import cut

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def _node(key: str, kind: str, name: str, path: str, start: str, end: str, parent: str, source: str, language: str) -> str:
    return f"""SELECT {key} AS id, {name} AS name, '{kind}' AS kind, {path} AS file_path, CAST({start} AS INT) AS line_start, CAST({end} AS INT) AS line_end,
    concat({name}, '()') AS signature, CAST(NULL AS STRING) AS doc_comment, 'Public' AS visibility, '{language}' AS language, {parent} AS parent_id FROM {source}"""


_NONE = "CAST(NULL AS STRING)"
NODES = "\nUNION ALL ".join(
    [
        _node("concat('R', r_regionkey)", "Package", "r_name", "concat('geo/', r_name, '.src')", "r_regionkey", "r_regionkey", _NONE, "{region}", "java"),
        _node("concat('N', n_nationkey)", "Module", "n_name", "concat('geo/', r_name, '.src')", "n_nationkey", "n_nationkey + 1", "concat('R', n_regionkey)", "{nation} JOIN {region} ON n_regionkey = r_regionkey", "go"),
        _node("concat('K', r_regionkey)", "Constant", "concat('settings', r_regionkey)", "concat('geo/', r_name, '.src')", "r_regionkey", "r_regionkey", "concat('R', r_regionkey)", "{region}", "java"),
        _node("concat('C', c_custkey)", "Class", "c_name", "concat('cust/n', c_nationkey, '.src')", "c_custkey", "c_custkey + 9", "concat('N', c_nationkey)", "{customer}", "python"),
        _node("concat('S', s_suppkey)", "Interface", "s_name", "concat('supp/n', s_nationkey, '.src')", "s_suppkey", "s_suppkey + 4", "concat('N', s_nationkey)", "{supplier}", "java"),
        _node("concat('P', p_partkey)", "Function", "concat(p_brand, '.', p_name)", "concat('part/', p_type, '.src')", "p_partkey", "p_partkey + p_size", _NONE, "{part}", "rust"),
        _node("concat('O', o_orderkey)", "Method", "concat(c_name, '.order_', o_orderkey)", "concat('cust/n', c_nationkey, '.src')", "o_orderkey", "o_orderkey + 2", "concat('C', o_custkey)", "{orders} JOIN {customer} ON o_custkey = c_custkey", "python"),
    ]
)


def _edge(source: str, target: str, kind: str, line: str, confidence: float, table: str, distinct: str = "") -> str:
    return f"SELECT {distinct} {source} AS source_id, {target} AS target_id, '{kind}' AS kind, CAST({line} AS INT) AS source_line, CAST({confidence} AS DOUBLE) AS confidence FROM {table}"


EDGES = "\nUNION ALL ".join(
    [
        _edge("concat('R', n_regionkey)", "concat('N', n_nationkey)", "CONTAINS", "n_nationkey", 1.0, "{nation}"),
        _edge("concat('R', r_regionkey)", "concat('K', r_regionkey)", "CONTAINS", "r_regionkey", 1.0, "{region}"),
        _edge("concat('N', c_nationkey)", "concat('C', c_custkey)", "CONTAINS", "c_custkey", 1.0, "{customer}"),
        _edge("concat('N', s_nationkey)", "concat('S', s_suppkey)", "CONTAINS", "s_suppkey", 1.0, "{supplier}"),
        _edge("concat('C', o_custkey)", "concat('O', o_orderkey)", "CONTAINS", "o_orderkey", 1.0, "{orders}"),
        _edge("concat('O', l_orderkey)", "concat('P', l_partkey)", "CALLS", "l_linenumber", 0.9, "{lineitem}", "DISTINCT"),
        _edge("concat('P', l_partkey)", "concat('S', l_suppkey)", "CALLS", "0", 0.5, "{lineitem}", "DISTINCT"),
        _edge("concat('S', p_partkey % n)", "concat('P', p_partkey)", "CALLS", "1", 0.95, "{part} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) c"),
        _edge("concat('S', s_suppkey)", "concat('S', CAST(floor(s_suppkey / 2) AS BIGINT))", "IMPLEMENTS", "0", 1.0, "{supplier} WHERE s_suppkey >= 1"),
        _edge("concat('P', p_partkey)", "concat('P', p_partkey - 10)", "EXTENDS", "0", 0.9, "{part} WHERE p_partkey % 100 >= 10"),
        _edge("concat('P', p_partkey)", "concat('P', p_partkey - 1)", "EXTENDS", "1", 0.9, "{part} WHERE p_partkey % 10 <> 0"),
    ]
)

#: Unresolved calls: exact, last segment, lower-case head, external by name and by a constant, unknown.
RAW_CALLS = """SELECT l_orderkey * 10 + l_linenumber AS raw_id, concat('O', l_orderkey) AS source_id, 'CALLS' AS kind,
    CASE WHEN l_orderkey % 8 = 7 AND p_partkey % 2 = 0 THEN concat('settings', p_partkey % 7, '.get') WHEN l_orderkey % 8 = 7 THEN concat('missing_', p_partkey % 50)
         WHEN l_orderkey % 4 = 0 THEN concat(p_brand, '.', p_name) WHEN l_orderkey % 4 = 1 THEN concat('x.', p_name)
         WHEN l_orderkey % 4 = 2 THEN concat('b', substr(p_brand, 2), '.', p_name) ELSE concat('console.log_', p_partkey) END AS target_name,
    CAST(NULL AS STRING) AS target_module, l_linenumber AS source_line
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x JOIN {part} ON l_partkey = p_partkey"""

#: Links of web pages as fetches of routes, which the first page that names them handles.
LINKS = {
    "spark": "SELECT page_id, explode(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM {pages}",
    "duckdb": "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM {pages}",
}
ROUTES = "SELECT DISTINCT concat('RT:', href) AS id, concat(CASE WHEN length(href) % 2 = 0 THEN 'GET ' ELSE 'POST ' END, href) AS name FROM {links}"
HANDLES = "SELECT concat('P', min(page_id)) AS source_id, concat('RT:', href) AS target_id, 'HANDLES_ROUTE' AS kind, 0 AS source_line, CAST(1.0 AS DOUBLE) AS confidence FROM {links} GROUP BY href"
RAW_FETCHES = "SELECT DISTINCT concat('W', page_id) AS source_id, concat('GET ', href) AS target_name, 3 AS source_line FROM {links}"


@dataclass
class Graph:
    """Two lazy tables; a direction of traversal is which side is joined."""

    nodes: DataFrame
    edges: DataFrame

    def calls(self, *kinds: str) -> DataFrame:
        return self.edges.filter(self.edges["kind"].isin(*kinds))


def kept(g: Graph) -> Graph:
    """The graph with both tables checkpointed, for plans that read them at each of many levels."""
    return Graph(cut(g.nodes), cut(g.edges))


def select(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Run one of the statements on the tables of a folder."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **named, **frames)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(select(spark, sf_dir, NODES).select(*schema.columns(schema.NODES)), select(spark, sf_dir, EDGES))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, LINKS["spark"])


def plain(sql: str, **names: str) -> str:
    """The statement with plain table names."""
    return sql.format(**{t: t for t in TABLES}, **names)
