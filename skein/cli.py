"""python -m skein.cli COMMAND ...: scan a repository and ask its graph."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from skein.sources import scan as source
from skein.tools import Tools


def session() -> SparkSession:
    return SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def scan(spark: SparkSession, root: str, out: str, history: bool, tables: str = "") -> int:
    """Scan into a JSON document, and into Parquet tables if a folder is named; on top of the
    document that is there, if its files changed in part."""
    began = time.time()
    files = source.with_content(source.listing(spark, root), root).persist()
    old = stamps = None
    if os.path.exists(out):
        kept = json.load(open(out, encoding="utf-8")).get("fileTimestamps") or {}
        if kept:
            old, stamps = source.read_json(spark, out), spark.createDataFrame(list(kept.items()), "path string, modified string")
    result = source.scan(files, old, stamps, source.commits(spark, root) if history else None)
    problems = result["problems"].collect()
    for p in problems:
        print(f"{p['rule']}: {p['subject']}", file=sys.stderr)
    for w in result["warnings"].collect():
        print(w["warning"], file=sys.stderr)
    if problems:
        return 1
    header = {"schema": "codegraph", "schemaVersion": "1.4.0", "generatedAt": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "repository": os.path.basename(os.path.abspath(root)), **source.head(root), "scanDuration": f"{time.time() - began:.1f}s"}
    header["fileTimestamps"] = {r["path"]: r["modified"] for r in result["stamps"].collect()}
    header["questions"] = {f"{r['verb']}:{r['subject']}": r["answer"] for r in result["questions"].collect()}
    header["views"] = {r["id"]: r.asDict(recursive=True) for r in result["views"].collect()}
    source.write_json(result["graph"], out, header)
    if tables:
        source.write_parquet(result["graph"], tables)
    print(f"{result['graph'].entities.count()} entities, {result['graph'].edges.count()} relationships -> {out}")
    return 0


# The tools, by the names clients know them, and their arguments.
TOOLS = {
    "search": {"query": "string", "kind": "string", "mode": "string", "limit": "integer"}, "entity": {"id_": "string", "ids": "array", "brief": "boolean"}, "context": {"id_": "string", "depth": "integer"},
    "where": {"path": "string", "detail": "boolean"}, "stats": {}, "temporal": {"kind": "string", "name": "string", "since": "string", "author": "string", "stale": "boolean", "limit": "integer"},
    "investigate": {"id_": "string"}, "explain": {"id_": "string", "depth": "integer"}, "impact": {"id_": "string", "compact": "boolean"}, "view": {"name": "string"}, "ask": {"name": "string", "intent": "string", "detail": "boolean"},
}
PROTOCOL = "2025-06-18"


def _schema(args: dict[str, str]) -> dict:
    kinds = {k.rstrip("_"): {"type": v} | ({"items": {"type": "string"}} if v == "array" else {}) for k, v in args.items()}
    return {"type": "object", "properties": kinds}


def answer(tools: Tools, asked: dict):
    """The result of one request of the tool protocol; None for notifications."""
    method, given = asked.get("method", ""), asked.get("params") or {}
    if method == "initialize":
        return {"protocolVersion": given.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "skein", "version": "0.2.0"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": (getattr(Tools, n).__doc__ or n).strip(), "inputSchema": _schema(a)} for n, a in TOOLS.items()]}
    if method == "tools/call":
        name, args = given.get("name"), given.get("arguments") or {}
        if name not in TOOLS:
            raise LookupError(f"no tool {name!r}")
        try:
            text, failed = getattr(tools, name)(**{k if k in TOOLS[name] else k + "_": v for k, v in args.items()}), False
        except Exception as e:  # noqa: BLE001 - told to the client, the server lives on
            text, failed = f"{type(e).__name__}: {e}", True
        return {"content": [{"type": "text", "text": text}], "isError": failed}
    if method.startswith("notifications/"):
        return None
    raise LookupError(f"no method {method!r}")


def serve(tools: Tools, lines, out) -> None:
    """The tool protocol over lines: JSON-RPC 2.0 requests in, answers out."""
    for line in lines:
        if not line.strip():
            continue
        reply: dict = {"jsonrpc": "2.0", "id": None}
        try:
            asked = json.loads(line)
            reply["id"] = asked.get("id")
            result = answer(tools, asked)
            if result is None or "id" not in asked:
                continue
            reply["result"] = result
        except LookupError as e:
            reply["error"] = {"code": -32601, "message": str(e)}
        except (ValueError, AttributeError) as e:
            reply["error"] = {"code": -32700, "message": str(e)}
        print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **flags):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None, default="" if a.endswith("?") else None)
        for f, default in flags.items():
            c.add_argument(f"--{f}", **({"action": "store_true"} if default is False else {"default": default, "type": type(default)}))
        c.add_argument("--graph", default="graph.json")

    command("scan", "root", history=False, tables="")
    command("search", "query?", kind="")
    command("query", "kind", "name?")
    for name in ("investigate", "view"):
        command(name, "name")
    command("impact", "name", compact=False)
    command("explain", "name", depth=2)
    command("ask", "name", intent="", detail=False)
    command("context", "name", depth=1)
    command("where", "path", detail=False)
    command("stats")
    command("serve")
    command("review", "base", "head?", diff="", root=".")
    return p


def main(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "scan":
        return scan(spark, a.root, a.graph, a.history, a.tables)
    read = source.read_parquet if os.path.isdir(a.graph) else source.read_json
    t = Tools(read(spark, a.graph).persist())
    if a.command == "serve":
        serve(t, sys.stdin, sys.stdout)
        return 0
    if a.command == "review":
        diff = (sys.stdin.read() if a.diff == "-" else open(a.diff, encoding="utf-8").read()) if a.diff else source.git(a.root, "diff", f"{a.base}...{a.head or 'HEAD'}")
        print(t.review(diff))
        return 0
    run = {
        "search": lambda: t.search(a.query, a.kind, "post" if a.query else "lookup"), "query": lambda: t.query(a.kind, a.name), "investigate": lambda: t.investigate(t.resolve(a.name)), "view": lambda: t.view(a.name),
        "impact": lambda: t.impact(t.resolve(a.name), a.compact), "explain": lambda: t.explain(t.resolve(a.name), a.depth), "ask": lambda: t.ask(a.name, a.intent, a.detail), "context": lambda: t.context(a.name, a.depth),
        "where": lambda: t.where(a.path, a.detail), "stats": t.stats,
    }
    print(run[a.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
