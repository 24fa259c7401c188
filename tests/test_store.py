import hashlib
import random

import pytest

from symgrove import schema
from symgrove.operators import search
from symgrove.sources import files, store
from symgrove.sources.derived import graph
from symgrove.sources.store import Store, raw_query
from symgrove.streaming import watch


def project(tmp_path, extra=None):
    root = tmp_path / "proj"
    for path, text in {
        "src/app.py": "import os\nclass Base:\n    def run(self):\n        pass\nclass Child(Base):\n    def run(self):\n        super().run()\ndef main():\n    Child().run()\n    helper()\ndef helper():\n    pass\n",
        "web/api.js": "function list() {}\napp.get('/users', function handler() {});\nfunction load() { fetch('/users'); }\n",
        "app/items/page.tsx": "export default function Page() { return list(); }\n",
        ".hidden/x.py": "def no(): pass\n", "node_modules/y.js": "function no2() {}\n", "notes.txt": "hi",
        **(extra or {}),
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_scan_saves_a_graph(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    counts = files.scan(spark, project(tmp_path), store, ignore="node_modules/\n# c\n")
    g = store.load()
    names = {(r["kind"], r["name"]) for r in g.nodes.collect()}
    assert {("Function", "main"), ("Method", "Child.run"), ("Route", "GET /users"), ("Route", "GET /items"), ("Process", "Process: main")} <= names
    assert not {("Function", "no"), ("Function", "no2")} & names
    assert counts == {"nodes": g.nodes.count(), "edges": g.edges.count()}
    store.views()
    link = lambda kind: {(r[0], r[1], r[2]) for r in raw_query(spark, f"SELECT a.name, b.name, confidence FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE e.kind = '{kind}'").collect()}
    assert ("Child.run", "Base.run", 1.0) in link("CALLS") and ("main", "helper", 0.95) in link("CALLS")
    assert ("Child", "Base", 0.95) in link("EXTENDS")
    assert ("load", "GET /users", 1.0) in link("FETCHES")
    assert ("Page", "GET /items", 1.0) in link("HANDLES_ROUTE")
    assert any(s == "main" and t == "Process: main" for s, t, _ in link("ENTRY_POINT_OF"))
    ids = {r["id"] for r in g.nodes.collect()}
    assert all(r["source_id"] in ids and r["target_id"] in ids for r in g.edges.collect())
    assert g.edges.count() == g.edges.select("source_id", "target_id", "kind", "source_line").distinct().count()
    assert store.load_file_hashes().count() == 3


def test_incremental_update(spark, tmp_path):
    root = project(tmp_path)
    found = files.discover_files(spark, root, "node_modules")
    nodes, raw = files.parse_files(found)
    hashes = spark.createDataFrame(found.select("file_path", "hash").collect(), schema.FILE_HASHES)
    project(tmp_path, {"src/app.py": "def changed():\n    pass\n", "src/new.py": "def fresh():\n    pass\n"})
    (tmp_path / "proj/app/items/page.tsx").unlink()
    nodes = spark.createDataFrame(nodes.collect(), schema.NODES)
    raw = spark.createDataFrame(raw.collect(), schema.RAW_EDGES)
    got = files.incremental_update(nodes, raw, hashes, files.discover_files(spark, root, "node_modules"))
    assert got.counts == {"added": 1, "modified": 1, "removed": 1, "unchanged": 1}
    names = {r["name"] for r in got.nodes.collect()}
    assert {"changed", "fresh", "list"} <= names and not {"main", "Page"} & names
    assert {r["file_path"] for r in got.hashes.collect()} == {"proj/src/app.py", "proj/src/new.py", "proj/web/api.js"}


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.load().nodes.count() == 0 and store.load_file_hashes().count() == 0
    n = lambda i, kind="Function", parent=None, path="a.py", vis="Public": (i, i, kind, path, 1, 2, None, None, vis, "python", parent)
    nodes = spark.createDataFrame([n("a"), n("b", parent="a"), n("c", parent="gone"), n("d", path="b.py", vis="Odd"), n("e", kind="Odd")], schema.NODES)
    edges = spark.createDataFrame([("a", "b", "CALLS", 1, 0.5), ("a", "b", "CALLS", 1, 0.9), ("a", "zz", "CALLS", 1, 0.9), ("d", "a", "CALLS", 1, 1.0)], schema.EDGES)
    hashes = spark.createDataFrame([("a.py", "0" * 64), ("b.py", "xyz")], schema.FILE_HASHES)
    assert store.save(nodes, edges, hashes) == {"nodes": 5, "edges": 3}
    g = store.load()
    assert {(r["id"], r["parent_id"], r["visibility"]) for r in g.nodes.collect()} == {("a", None, "Public"), ("b", "a", "Public"), ("c", None, "Public"), ("d", None, "Private")}
    assert {(r["source_id"], r["target_id"], r["kind"], r["confidence"]) for r in g.edges.collect()} == {("a", "b", "CALLS", 0.9), ("d", "a", "CALLS", 1.0), ("a", "b", "CONTAINS", 1.0)}
    assert [r["file_path"] for r in store.load_file_hashes().collect()] == ["a.py"]
    store.remove_file_nodes("b.py")
    assert {r["id"] for r in store.load().nodes.collect()} == {"a", "b", "c"} and store.versions() == [1, 2]
    store.clear()
    assert store.versions() == []


def test_only_queries_are_accepted(spark):
    with pytest.raises(ValueError):
        raw_query(spark, "DROP TABLE nodes")
    assert raw_query(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x").first()["a"] == 1


def test_ignore_files_of_all_folders(spark, tmp_path):
    root = project(tmp_path, {
        ".gitignore": "# c\n*.gen.py\n!keep.gen.py\n/top.py\nlogs/\n", "a.gen.py": "x = 1\n", "sub/b.gen.py": "x = 1\n", "sub/keep.gen.py": "x = 1\n", "top.py": "x = 1\n",
        "sub/top.py": "x = 1\n", "logs/l.py": "x = 1\n", "sub/.gitignore": "in?er/*.py\n!inner/back.py\n", "sub/inner/c.py": "x = 1\n", "sub/inner/back.py": "x = 1\n", "inner/c.py": "x = 1\n",
        ".git/info/exclude": "**/deep/x.py\n", "sub/deep/x.py": "x = 1\n",
    })
    got = {r[0].removeprefix("proj/") for r in files.discover_files(spark, root, "node_modules\n").select("file_path").collect()}
    assert got == {"src/app.py", "web/api.js", "app/items/page.tsx", "sub/keep.gen.py", "sub/top.py", "sub/inner/back.py", "inner/c.py"}


def test_failures_are_recorded(spark, monkeypatch):
    rows = [("p/a.py", "python", bytearray(b"def f(): pass\n"), "0"), ("p/b.py", "python", bytearray(b"x = " + b"(" * 5000), "1")]
    df = spark.createDataFrame(rows, "file_path string, language string, content binary, hash string")
    p = files.parse_all(df)
    assert {r["name"] for r in p.nodes.collect()} >= {"a.py", "f"}
    assert {r["file_path"] for r in p.failures.collect()} | {r["file_path"] for r in p.nodes.collect()} == {"p/a.py", "p/b.py"}


def test_old_snapshots_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    nodes, edges = spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES)
    for _ in range(4):
        store.save(nodes, edges)
    assert store.versions() == [3, 4]


def test_changes_give_the_graph_of_a_fresh_scan(spark, tmp_path):
    rnd = random.Random(3)
    store, now = Store(spark, str(tmp_path / "db")), {}
    kind = "file_path string, language string, content binary, hash string, version long"

    def text(i: int) -> str:
        calls = "".join(f"    f{rnd.randrange(5)}()\n" for _ in range(2))
        return f"from p.m{rnd.randrange(4)} import f{rnd.randrange(5)}\nclass K{i}(K{rnd.randrange(5)}):\n    def m(self):\n        super().m()\ndef f{i}():\n{calls}def main():\n    f{rnd.randrange(5)}()\n"

    def row(i: int, content: str | None, version: int):
        digest = hashlib.sha256(content.encode()).hexdigest() if content is not None else None
        return (f"p/m{i}.py", "python", content.encode() if content is not None else None, digest, version)

    def shape(g):
        return sorted(map(str, g.nodes.drop("parent_id").collect())), sorted(map(str, g.edges.collect()))

    for step in range(3):
        batch = []
        for i in rnd.sample(range(5), 5 if not step else 2):
            old, new = text(i), None if step and rnd.random() < 0.3 else text(i)
            batch += [row(i, new, 10 * step + 1), row(i, old, 10 * step)]
            now[i] = new
        rnd.shuffle(batch)
        watch.apply_batch(store, spark.createDataFrame(batch, kind))
    fresh = Store(spark, str(tmp_path / "fresh"))
    every = spark.createDataFrame([row(i, t, 0) for i, t in now.items() if t is not None], kind)
    watch.apply_batch(fresh, every)
    assert shape(store.load()) == shape(fresh.load())
    assert sorted(map(tuple, store.load_file_hashes().collect())) == sorted(map(tuple, fresh.load_file_hashes().collect()))
    kinds = {r[0] for r in store.load().edges.select("kind").distinct().collect()}
    assert {"CALLS", "EXTENDS", "CONTAINS", "STEP_IN_PROCESS"} <= kinds


def test_a_save_reads_what_it_stored_and_shuffles_postings_once(spark, tmp_path, monkeypatch):
    g = graph(spark, "/root/testdata/sf0.001")
    nodes = g.nodes.select(*schema.columns(schema.NODES))
    edges = store.consistent_edges(nodes, g.edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(struct(" not in edges
    index = search.postings(spark.createDataFrame(nodes.limit(300).collect(), schema.NODES), search.SYMBOL_TEXT, spread=3).sortWithinPartitions("head", "token")
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    index = search.postings(nodes, search.SYMBOL_TEXT, spread=3)
    plain = search.postings(nodes, search.SYMBOL_TEXT)
    assert sorted(map(str, index.collect())) == sorted(map(str, plain.select(index.columns).collect()))
    kept = store.Store(spark, f"{tmp_path}/g")
    kept.save(g.nodes, g.edges)
    heads = {}
    for f in (tmp_path / "g/v1/postings").glob("head=*/*.parquet"):
        heads[f.parent.name] = heads.get(f.parent.name, 0) + 1
    assert len(heads) > 5
    assert kept.search("ring brand", 5).count() == 5
