"""Tools, renderers and the command line over a small graph."""

import io
import json

import pytest

from skein import cli, render
from skein.tools import Tools
from tests.test_graph import small  # noqa: F401


@pytest.fixture(scope="module")
def tools(small):  # noqa: F811
    return Tools(small)


def test_tools(tools):
    assert tools.search("cluster").split("\n")[0].startswith("controller:ops.Cluster  ops/cluster.go:5")
    assert tools.search("", "nonsense") == "No entities found." and "function:p.sync" in tools.search("s", "function")
    assert "history: 9 changes" in tools.entity("function:p.sync") and "--tested_by-->" in tools.entity("function:p.sync")
    assert tools.stats().startswith("Entities: 10\n  controller: 1") and "-> calls function:gone" in tools.context("function:p.load")
    assert tools.explain("controller:ops.Cluster", 1).split("\n")[1] == "  reconciles crd:g.cluster" and tools.explain("no") == "No entities found."
    assert "controllers (1): controller:ops.Cluster" in tools.impact("function:p.load") and tools.impact("no") == "No such entity."
    assert "reconciles: Cluster" in tools.view("clus") and tools.view("zzz") == "No view found."
    assert "Quick answer: reconciles: Cluster" in tools.ask("controller:ops.Cluster") and tools.ask("zzz") == "No entity found."
    assert "Incoming:" in tools.investigate("function:p.sync")


def test_investigation(tools):
    text = tools.investigate("function:p.sync")
    assert "Callers (2):\n  controller:ops.Cluster" in text and "Tests (1):\n  test:p.Testsync" in text and "Same file (2):" in text
    assert text.index(" calls (2):") < text.index(" tested_by (1):") and "Tests (0):\n  (none)" in tools.investigate("function:q.save")


def test_query_shows_edges(tools):
    text = tools.query("controller", "cluster")
    assert text.startswith("controller:ops.Cluster  ") and "controller:ops.Cluster --creates--> resource:job.Store" in text and tools.query("crd", "zzz") == "No entities found."


def test_context_tells_of_edges_left_out(tools, monkeypatch):
    monkeypatch.setattr("skein.tools.EDGES", 1)
    assert tools.context("function:p.load").endswith("(+3 more relationships)")


def test_review_report(tools):
    diff = "diff --git a/p/sync.go b/p/sync.go\n--- a/p/sync.go\n+++ b/p/sync.go\n@@ -3,1 +3,2 @@\n+x\ndiff --git a/p/sync_test.go b/p/sync_test.go\n@@ -1,0 +1,2 @@\n+y\ndiff --git a/new.go b/new.go\n@@ -1 +1 @@\n+z\ndiff --git a/ops/cluster.go b/ops/cluster.go\n@@ -5 +5 @@\n+w\n"
    text = tools.review(diff)
    assert "Changed functions:\n  function:p.sync ~\n    callees (2): load, q.save\n    callers (2): Cluster, save\n    tests (1): Testsync\n    controllers (1): Cluster" in text
    assert "test:p.Testsync (added)\n    test:p.Testsync -> function:p.sync (naming convention)" in text and "Not in the graph:\n  new.go" in text
    assert "Changed controllers:" in text and "    controller: Cluster" in text and "resources (2): " in text
    assert tools.review("").startswith("Review: 0 changed")


def test_server(tools):
    out = io.StringIO()
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [
        ask(1, "initialize", protocolVersion="2025-03-26"), '{"jsonrpc": "2.0", "method": "notifications/initialized"}', ask(2, "tools/list"), ask(3, "tools/call", name="where", arguments={"path": "crds/"}),
        ask(4, "tools/call", name="entity", arguments={"id": "crd:g.cluster"}), ask(5, "tools/call", name="_x"), ask(6, "tools/call", name="where", arguments={"nothing": 1}), "no json", ask(7, "odd"),
    ]
    cli.serve(tools, lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, 6, None, 7]
    assert got[0]["result"]["protocolVersion"] == "2025-03-26" and len(got[1]["result"]["tools"]) == 11 and "id" in got[1]["result"]["tools"][1]["inputSchema"]["properties"]
    assert "crd:g.cluster" in got[2]["result"]["content"][0]["text"] and "crd: Cluster" in got[3]["result"]["content"][0]["text"]
    assert got[4]["error"]["code"] == -32601 and got[5]["result"]["isError"] and got[6]["error"]["code"] == -32700 and "error" in got[7]


def test_rendering():
    assert render.cut("a" * 90, 80) == "a" * 77 + "..." and render.some(list("abc"), 2) == "a, b (+1 more)"
    assert render.receiver("function:p.T.m") == "T" and render.receiver("function:p.m") == "" and render.short("function:p.T.m") == "m" and render.label("odd") == "entities"
    assert cli.parser().parse_args(["ask", "--detail", "name"]).name == "name"
