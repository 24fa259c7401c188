import io
import json

import pytest

from symgrove import cli, mcp
from symgrove.sources.store import Store
from symgrove.streaming import watch


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli") / "proj"
    root.mkdir()
    (root / "a.py").write_text('def main():\n    """Starts it."""\n    helper()\n\n\ndef helper():\n    pass\n')
    path = str(root.parent / "db")
    out = []
    assert cli.main(["--db", path, "scan", str(root)], out.append) == 0
    assert json.loads(out[0])["nodes"] >= 3
    return path


def run(db, *args):
    out = []
    cli.main(["--db", db, *args], out.append)
    return "\n".join(out)


def test_commands(db):
    assert json.loads(run(db, "stats"))["files"] == 1
    assert json.loads(run(db, "call-chain", "main"))[0]["path"] == "main -> helper"
    assert json.loads(run(db, "blast-radius", "helper"))["depths"] == [{"depth": 1, "callers": 1, "rows": 1}]
    assert [r["name"] for r in json.loads(run(db, "dead-code"))] == ["main"]
    assert json.loads(run(db, "search", "starts"))[0]["name"] == "main"
    assert json.loads(run(db, "symbol", "helper", "--callers"))["callers"][0]["name"] == "main"
    assert json.loads(run(db, "query", "SELECT count(*) AS n FROM edges WHERE kind = 'CALLS'")) == [{"n": 1}]
    assert run(db, "routes") == "(no results)"
    assert json.loads(run(db, "processes"))[0]["steps"] == 2
    assert "digraph" in run(db, "export", "--format", "dot") and "calls: helper" in run(db, "export", "--format", "ai-context")


def test_tools(spark, db):
    store = Store(spark, db)
    ask = lambda method, **params: mcp.handle(spark, store, {"id": 1, "method": method, "params": params})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "symgrove"
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == set(mcp.TOOLS)
    got = ask("tools/call", name="call_chain", arguments={"name": "main"})["result"]
    assert not got["isError"] and json.loads(got["content"][0]["text"])[0]["name"] == "helper"
    assert ask("tools/call", name="query", arguments={"query": "DELETE FROM nodes"})["result"]["isError"]
    assert ask("tools/call", name="search", arguments={})["result"]["isError"]
    assert ask("nothing")["error"]["code"] == -32601
    assert mcp.handle(spark, store, {"method": "notifications/initialized"}) is None
    body = b'{"id": 2, "method": "ping"}'
    sink = io.BytesIO()
    mcp.serve(spark, store, io.BytesIO(b'{"id": 1, "method": "ping"}\nContent-Length: %d\r\n\r\n%s' % (len(body), body)), sink)
    assert [json.loads(x)["id"] for x in sink.getvalue().splitlines()] == [1, 2]


def test_stream_of_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    schema = "file_path string, language string, content binary, hash string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("p/a.py", "python", b"def one(): pass\n", "1" * 64), ("p/b.py", "python", b"def two(): pass\n", "2" * 64)])

    def drain():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch.follow(stream, store, str(tmp_path / "state"), availableNow=True).awaitTermination()
        return {r["name"] for r in store.load().nodes.filter("kind = 'Function'").collect()}

    assert drain() == {"one", "two"}
    put([("p/a.py", "python", b"def three(): pass\n", "3" * 64), ("p/b.py", None, None, None)])
    assert drain() == {"three"}
