"""The tools of the command line over JSON-RPC on standard input and output."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from symgrove import cli, schema
from symgrove.operators import rank, traverse
from symgrove.sources.store import Store

VERSION = "2024-11-05"
#: By tool: what it does, and its arguments as (type, default); ... marks a required one.
TOOLS = {
    "symbol": ("Find a symbol by part of its name, with callers, callees and members on request.", {"name": ("string", ...), "callers": ("boolean", False), "callees": ("boolean", False), "members": ("boolean", False), "limit": ("integer", 10)}),
    "call_chain": ("Follow calls onward from a symbol.", {"name": ("string", ...), "depth": ("integer", 3)}),
    "blast_radius": ("Find what calls a symbol, step by step backwards.", {"name": ("string", ...), "depth": ("integer", 2)}),
    "hotspots": ("Rank symbols by their connections.", {"limit": ("integer", 20)}),
    "dead_code": ("Find callables that nothing calls.", {"limit": ("integer", 200), "kinds": ("string", ",".join(schema.CALLABLE)), "include_all": ("boolean", False)}),
    "search": ("Rank symbols by words in names, signatures and comments.", {"query": ("string", ...), "limit": ("integer", 20)}),
    "routes": ("Show HTTP routes and how many handle them.", {"limit": ("integer", 50)}),
    "processes": ("Show traced processes by size.", {"limit": ("integer", 20)}),
    "stats": ("Count nodes, edges, files, languages and kinds.", {}),
    "query": ("Run a SELECT over nodes, edges and file_hashes.", {"query": ("string", ...)}),
}
#: Folders and files whose callables the dead_code tool doesn't show; the command line has a list of its own.
DEAD_EXCLUDES = "node_modules vendor .git dist/ build/ target/ .min.js".split()


def tool_list() -> list[dict]:
    def one(name: str) -> dict:
        about, args = TOOLS[name]
        props = {k: {"type": t} | ({} if d is ... else {"default": d}) for k, (t, d) in args.items()}
        return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": props, "required": [k for k, (_, d) in args.items() if d is ...]}}

    return [one(n) for n in TOOLS]


def call(spark: SparkSession, store: Store, name: str, given: dict) -> object:
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name}")
    args = {k: given.get(k, d) for k, (_, d) in TOOLS[name][1].items()}
    if missing := [k for k, v in args.items() if v is ...]:
        raise ValueError(f"missing {', '.join(missing)}")
    g = store.load()
    if name in ("call_chain", "blast_radius"):
        start = rank.resolve_symbol(g.nodes, args["name"], candidates=1)
        if start is None:
            return []
        walk = traverse.call_chain if name == "call_chain" else traverse.reverse_call_chain
        return cli.rows(walk(g, start, args["depth"]))
    if name == "dead_code":
        return cli.rows(rank.dead_symbols(g, [k.strip() for k in args["kinds"].split(",")], [] if args["include_all"] else DEAD_EXCLUDES, args["limit"]))
    if name == "query":
        store.views()
        args = {"sql": args["query"]}
    return cli.answer(spark, store, g, argparse.Namespace(command=name.replace("_", "-"), **args))


def handle(spark: SparkSession, store: Store, message: dict) -> dict | None:
    """The reply to a message; None to a notification."""
    method, params, key = message.get("method"), message.get("params") or {}, message.get("id")
    if method is None or str(method).startswith("notifications/"):
        return None
    ok = lambda result: {"jsonrpc": "2.0", "id": key, "result": result}
    if method == "initialize":
        return ok({"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "symgrove", "version": str(schema.SCHEMA_VERSION)}})
    if method == "ping":
        return ok({})
    if method == "tools/list":
        return ok({"tools": tool_list()})
    if method in ("resources/list", "prompts/list"):
        return ok({method.split("/")[0]: []})
    if method == "tools/call":
        try:
            text, bad = json.dumps(call(spark, store, params.get("name"), params.get("arguments") or {}), default=str), False
        except Exception as e:  # a failing tool is a result, not a protocol error
            text, bad = str(e), True
        return ok({"content": [{"type": "text", "text": text}], "isError": bad})
    return {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"no method {method}"}}


def read_message(stream) -> dict | None:
    """The next message, on a line of its own or behind a Content-Length header."""
    while line := stream.readline():
        text = line.strip()
        if text.lower().startswith(b"content-length:"):
            size = int(text.split(b":")[1])
            while stream.readline().strip():
                pass
            return json.loads(stream.read(size))
        if text:
            return json.loads(text)
    return None


def serve(spark: SparkSession, store: Store, source, sink) -> int:
    while (message := read_message(source)) is not None:
        reply = handle(spark, store, message)
        if reply is not None:
            sink.write(json.dumps(reply).encode() + b"\n")
            sink.flush()
    return 0
