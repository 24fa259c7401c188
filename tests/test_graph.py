"""Every graph query against its SQL, and what SQL can't say against brute force."""

import os
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from symgrove import queries, schema
from symgrove.functions import text
from symgrove.operators import export, mro, processes, ranges, rank, resolve, search, traverse
from symgrove.plans.iterate import connected
from symgrove.sources.derived import Graph, graph
from tests.oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, queries.QUERIES[name], queries.SQL[name]) == ""


def small(spark, edges, kinds=None):
    ids = sorted({x for e in edges for x in e[:2]})
    nodes = [(i, f"n{i}", (kinds or {}).get(i, "Function"), "f.py", 0, 9, None, None, "Public", "python", None) for i in ids]
    rows = [(e[0], e[1], e[2] if len(e) > 2 else "CALLS", e[3] if len(e) > 3 else 1, 0.9) for e in edges]
    return Graph(spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(rows, schema.EDGES))


def test_walks_repeat_cycles_up_to_the_depth(spark):
    g = small(spark, [("a", "b"), ("b", "a"), ("b", "c", "FETCHES")])
    got = {(r["id"], r["depth"], r["path"]) for r in traverse.call_chain(g, "a", 3).collect()}
    assert got == {("b", 1, "na -> nb"), ("a", 2, "na -> nb -> na"), ("c", 2, "na -> nb -> nc"), ("b", 3, "na -> nb -> na -> nb")}
    back = {(r["id"], r["path"]) for r in traverse.reverse_call_chain(g, "c", 1).collect()}
    assert back == {("b", "nb -> nc")}
    assert traverse.call_chain(g, "missing", 2).count() == 0


def test_forward_and_backward_walks_agree(spark):
    g = graph(spark, SF)
    forward = {r["id"] for r in traverse.call_chain(g, "O7", 2).filter("depth = 2").collect()}
    one = sorted(forward)[0]
    assert "O7" in {r["id"] for r in traverse.reverse_call_chain(g, one, 2).filter("depth = 2").collect()}


def test_shortest_path_ties_and_limits(spark):
    g = small(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y")])
    assert [tuple(r) for r in traverse.shortest_path(g, "d", "a").collect()] == [("a", "na", 2, "d,b,a")]
    assert [r["depth"] for r in traverse.shortest_path(g, "a", "a").collect()] == [0]
    assert traverse.shortest_path(g, "a", "x").count() == 0
    assert traverse.shortest_path(g, "a", "d", max_depth=1).count() == 0


def test_symbol_detail_prefers_exact_names(spark):
    g = graph(spark, SF)
    got = rank.symbol_detail(g, "customer#000000001")
    assert got["symbol"].first()["id"] == "C1"
    assert got["members"].count() == g.nodes.filter("parent_id = 'C1'").count()
    assert rank.symbol_detail(g, "no such thing") is None


def test_wildcards_are_plain_text(spark):
    g = graph(spark, SF)
    assert rank.find_symbols(g.nodes, "%").count() == 0
    assert rank.find_symbols(g.nodes, "region%", raw=True).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def python_order(parents):
    made, out = {}, {}

    def make(c):
        if c not in made:
            made[c] = None
            bases = [make(p) for p in parents.get(c, [])]
            made[c] = None if None in bases else _type(c, bases)
        return made[c]

    def _type(c, bases):
        try:
            return type(c, tuple(bases), {})
        except TypeError:
            return None

    for c in {*parents, *(p for ps in parents.values() for p in ps)}:
        t = make(c)
        if t is not None:
            out[c] = [x.__name__ for x in t.__mro__ if x is not object]
    return out


def test_method_resolution_order_is_cpythons(spark):
    parents = {str(p): [str(x) for x in dict.fromkeys([p // 2, p // 3])] for p in range(2, 120)}
    loop = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "a", 1), ("d", "e", 1)], "class_id string, parent_id string, ord int")
    for whole in (mro.WHOLE, 0):
        assert sorted(map(tuple, mro.c3_mro(loop, whole).collect())) == [("d", 0, "d"), ("d", 1, "e"), ("e", 0, "e")]
    rows = [(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "class_id string, parent_id string, ord int")
    for whole in (mro.WHOLE, 0):  # in one task, and level by level
        found = {}
        for r in sorted(mro.c3_mro(df, whole).collect(), key=lambda r: (r["class_id"], r["pos"])):
            found.setdefault(r["class_id"], []).append(r["ancestor_id"])
        assert found == python_order(parents)


def test_super_calls_find_the_first_ancestor(spark):
    n = lambda i, name, kind, parent=None: (i, name, kind, "f.py", 0, 1, None, None, "Public", "python", parent)
    nodes = spark.createDataFrame([n("A", "A", "Class"), n("B", "B", "Class"), n("C", "C", "Class"), n("am", "A.m", "Method", "A"), n("bm", "B.m", "Method", "B"), n("cm", "C.m", "Method", "C"), n("ai", "A.__init__", "Constructor", "A")], schema.NODES)
    edges = spark.createDataFrame([("C", "B", "EXTENDS", 0, 0.9), ("B", "A", "EXTENDS", 0, 0.9)], schema.EDGES)
    raw = spark.createDataFrame([(1, "cm", "CALLS", "super().m", None, 3), (2, "bm", "CALLS", "super(B, self).m", None, 4), (3, "cm", "CALLS", "super().__init__", None, 5)], schema.RAW_EDGES)
    assert {(r[0], r[1]) for r in mro.super_targets(raw, nodes, edges).collect()} == {(1, "bm"), (2, "am")}


def test_import_paths_and_aliases(spark):
    n = lambda i, path: (i, path.rsplit("/", 1)[-1], "File", path, 0, 1, None, None, "Public", "typescript", None)
    nodes = spark.createDataFrame([n("f1", "p/src/a.ts"), n("f2", "p/src/lib/index.ts"), n("f3", "p/src/b.js")], schema.NODES)
    raw = spark.createDataFrame([(1, "f1", "IMPORTS", "x", "p/src/./b", 1), (2, "f1", "IMPORTS", "y", "p/src/q/../lib", 2), (3, "f1", "IMPORTS", "z", "@/a", 3), (4, "f1", "IMPORTS", "f2", None, 4), (5, "f1", "IMPORTS", "zzz", None, 5)], schema.RAW_EDGES)
    aliases = resolve.path_aliases('{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*", "no"],}, } }', "p")
    assert aliases == [("@/", "p/src/")]
    got = {(r["raw_id"], r["target_id"], r["confidence"]) for r in resolve.resolve_imports(raw, nodes, aliases).collect()}
    assert got == {(1, "f3", 1.0), (2, "f2", 1.0), (3, "f1", 1.0), (4, "f2", 1.0)}
    assert resolve.path_aliases("not json") == []


def test_search_ranks_as_sqlite_does(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(name, signature, doc)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    rnd = random.Random(3)
    words = ["auth", "authn_check", "token", "user", "Ünit", "store", "get_user", "x1"]
    rows = [(i, *(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 6))) or None for _ in range(3))) for i in range(80)]
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [tuple(x or "" for x in r[1:]) for r in rows])
    df = spark.createDataFrame(rows, "i int, name string, signature string, doc string")
    for query in ("auth", "authn_check", "unit tok", "get_user stor x"):
        match = " OR ".join(f'"{t}"*' for t in query.split())
        want = {r[0] - 1: r[1] for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        got = {r["i"]: r["score"] for r in search.bm25(df, query, ["name", "signature", "doc"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), query
        columns = ["name", "signature", "doc"]
        got = {r["id"]: r["score"] for r in search.bm25_indexed(search.postings(df, columns, "i"), search.totals(df, columns), query).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), query
    assert search.bm25(df, "--- !", ["name"]).count() == 0


def test_process_limits(spark):
    g = small(spark, [("a", f"t{i:03}", "CALLS", i) for i in range(80)] + [("t000", "a")])
    steps = processes.trace(g, spark.createDataFrame([("a", "main")], "id string, label string")).orderBy("step").collect()
    assert [r["step"] for r in steps] == list(range(1, 51)) and steps[1]["id"] == "t000"


def test_entry_points(spark):
    g = small(spark, [("h", "r", "HANDLES_ROUTE"), ("m", "q")], {"r": "Route"})
    nodes = g.nodes.withColumn("name", F.when(F.col("id") == "m", "pkg::main").when(F.col("id") == "q", "X.test_q").otherwise(F.col("name")))
    got = {(r["id"], r["reason"]) for r in processes.entry_points(Graph(nodes, g.edges)).collect()}
    assert got == {("h", "route"), ("m", "main"), ("q", "test")}


def test_diff_text(spark):
    diff = "diff --git a/foo.rs b/foo.rs\n--- a/foo.rs\n+++ b/foo.rs\n@@ -10,0 +11,3 @@ fn x\n+a\n+b\n@@ -30 +32 @@\n+c\n@@ -40,2 +41,0 @@\n--- a/gone.rs\n+++ /dev/null\n@@ -1,2 +0,0 @@\n"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(diff.splitlines())], "diff_id long, line_no long, line string")
    assert sorted(map(tuple, ranges.parse_hunks(lines).collect())) == [("foo.rs", 11, 13), ("foo.rs", 32, 32)]


def test_file_routes(spark):
    want = {
        "/repo/app/users/[id]/page.tsx": "/users/:id", "/repo/app/page.tsx": "/", "/repo/app/(dashboard)/settings/page.tsx": "/settings",
        "/repo/pages/users/[id].tsx": "/users/:id", "/repo/pages/index.tsx": "/", "/repo/pages/_app.tsx": None, "/repo/pages/api/users.ts": None,
        "/repo/app/api/users/route.ts": "/api/users", "/repo/routes/users.$id.tsx": "/users/:id", "/repo/routes/_index.tsx": "/", "/repo/routes/users/[id]/+page.svelte": "/users/:id",
        "/repo/pages/a/index.vue": "/a", "/repo/app/[...slug]/page.js": "/:slug*", "/repo/src/x.ts": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r[0]: r[1] for r in df.select("p", text.file_route(F.col("p"))).collect()} == want


def test_text_functions(spark):
    df = spark.createDataFrame([("a/./b//../c\\d.tsx", "this.m", "super(A, self).go", 7200)], "p string, t string, s string, n long")
    r = df.select(text.normal_path(F.col("p")), text.qualify_member_call(F.col("t"), F.lit("K")), text.super_method(F.col("s")), text.humanize_ago(F.col("n"))).first()
    assert tuple(r) == ("a/c/d.tsx", "K.m", "go", "2h ago")


def test_hotspot_degrees_add_up(spark):
    g = graph(spark, SF)
    d = rank.degrees(g).agg(F.sum("outgoing"), F.sum("incoming")).first()
    assert d[0] == d[1] == g.edges.select("source_id", "target_id").distinct().count()


def test_nearest_interval_join_has_each_pair_once(spark):
    rnd = random.Random(1)
    spans = [(f"s{i}", "f" if i % 2 else "g", a, a + rnd.randrange(400)) for i in range(60) for a in [rnd.randrange(900)]]
    hunks = [("f" if i % 2 else "g", a, a + rnd.randrange(200)) for i in range(30) for a in [rnd.randrange(900)]]
    left = spark.createDataFrame(spans, "id string, file_path string, a int, b int")
    right = spark.createDataFrame(hunks, "file_path string, c int, d int")
    got = sorted((r["id"], r["c"], r["d"]) for r in ranges.overlap_join(left, right, "file_path", "a", "b", "c", "d").collect())
    assert got == sorted((i, c, d) for i, p, a, b in spans for q, c, d in hunks if p == q and a <= d and b >= c)


def _cuts(monkeypatch, module):
    """What a module checkpoints, in order."""
    made, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: made.append(cut(df)) or made[-1])
    return made


def test_shortest_path_keeps_no_copy_of_all_links(spark, monkeypatch):
    made = _cuts(monkeypatch, traverse)
    g = graph(spark, SF)
    assert traverse.shortest_path(g, "P0", "S1").first()["depth"] > 0
    assert max(df.count() for df in made) < g.edges.count() / 2


@pytest.mark.parametrize("few", [traverse.BROADCAST_IDS, 0], ids=["sent to the scans", "shuffled"])
def test_steps_from_few_nodes_are_taken_where_edges_are_read(spark, monkeypatch, few):
    monkeypatch.setattr(traverse, "BROADCAST_IDS", few)
    g = graph(spark, SF)
    near = traverse.neighbors(g, "P9", 2)
    links = {(r[0], r[1]) for r in g.edges.select("source_id", "target_id").collect()}
    links |= {(b, a) for a, b in links}
    one = {b for a, b in links if a == "P9"} - {"P9"}
    two = {b for a, b in links if a in one} - one - {"P9"}
    assert {(r["id"], r["depth"]) for r in near.collect()} == {("P9", 0), *((x, 1) for x in one), *((x, 2) for x in two)}
    assert traverse.shortest_path(g, "R0", "C1").count() == 1
    if few:  # below the aggregation that makes the edges distinct
        steps = traverse._onward(g.edges, spark.createDataFrame([("P9",)], "id string"), 1, False)
        plan = steps._jdf.queryExecution().optimizedPlan().toString()
        distinct = [x.split("Relation [")[0] for x in plan.split("Aggregate [")[1:] if "l_partkey" in x.split("Relation [")[1]]
        assert distinct and all("Join LeftSemi" in x for x in distinct)


def test_degrees_take_more_partitions_of_more_edges(spark, monkeypatch):
    g = graph(spark, SF)
    want = sorted(map(tuple, rank.degrees(g).collect()))
    monkeypatch.setattr(rank, "TASK_BYTES", 1 << 12)
    pairs = g.edges.select("source_id", "target_id")
    assert rank.partitions(pairs) > 4 == rank.partitions(pairs.limit(1))
    d = rank.degrees(g)
    assert "RepartitionByExpression [source_id" in d._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, d.collect())) == want


def test_an_index_is_read_once_for_all_words(spark):
    nodes = graph(spark, SF).nodes
    found = search.bm25_indexed(search.postings(nodes, search.SYMBOL_TEXT), search.totals(nodes, search.SYMBOL_TEXT), "ring brand order")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 4  # of columns and words, for the counts and for the scores


def test_ai_context_makes_calls_distinct_by_their_names_alone(spark):
    g = small(spark, [("a", "b"), ("a", "b", "CALLS", 2), ("a", "c"), ("c", "b")])
    out = export.ai_context(g)
    assert not re.search(r"Aggregate \[source_id#\d+, target_id#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
    body = out.first()["section"]
    assert "    calls: nb, nc\n" in body and "    called_by: na, nc\n" in body
