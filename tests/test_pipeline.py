"""From files to a graph and back: scan, rescan, history, documents, tables, streams."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.operators import build
from skein.sources import scan as source
from skein.streaming import incremental

TREE = {
    "ctl/ctl.go": 'package ctl\n\nimport "lib.example/kube/api"\n\n// Thing reconciles.\ntype Thing struct{}\n\n// Reconcile runs.\nfunc (r *Thing) Reconcile(ctx Context) error {\n\treturn util.Load(ctx)\n}\n\nfunc (r *Thing) SetupWithManager(m Manager) error {\n\treturn ctrl.New(m).For(&v1.Store{}).Complete(r)\n}\n',
    "util/load.go": "package util\n\n//go:embed store.yaml\nvar files embed.FS\n\n// Load reads.\nfunc Load(ctx Context) error {\n\treturn check(ctx)\n}\n\nfunc check(ctx Context) error { return nil }\n",
    "util/load_test.go": "package util\n\nfunc TestLoad(t *testing.T) { Load(nil) }\n",
    "util/deploy/store.yaml": "kind: CustomResourceDefinition\napiVersion: apiextensions.k8s.io/v1\nmetadata:\n  name: stores.x.example\nspec:\n  group: x.example\n  names:\n    kind: Store\n",
    "README.md": "# Title\n\nSome text.\n",
    "util/bad.go": "package util\n\nfunc y() { x := := 3 }\n",
    "vendor/x/x.go": "package x\n",
    "notes.txt": "nothing\n",
}


@pytest.fixture()
def tree(tmp_path):
    for path, text in TREE.items():
        at = tmp_path / "r" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
        os.utime(at, (1_700_000_000, 1_700_000_000))
    return tmp_path / "r"


def files_of(spark, root):
    return source.with_content(source.listing(spark, str(root)), str(root))


def test_scan_and_rescan(spark, tree):
    with pytest.raises(NotADirectoryError):
        source.listing(spark, str(tree / "nowhere"))
    out = source.scan(files_of(spark, tree))
    g = out["graph"]
    ents = {r["id"]: r for r in g.entities.collect()}
    assert {"package:ctl", "controller:ctl.Thing", "function:ctl.Thing.Reconcile", "package:util", "function:util.Load", "function:util.check", "test:util.TestLoad"} <= set(ents)
    assert [r["path"] for r in out["warnings"].collect()] == ["util/bad.go"] and out["problems"].count() == 0
    assert sorted(r["ord"] for r in ents.values()) == list(range(1_000_000_001, 1_000_000_001 + len(ents)))
    edges = {(r["src"], r["type"], r["dst"]): r for r in g.edges.collect()}
    called = edges["function:util.Load", "calls", "function:util.check"]
    assert called["ev_snippet"] == "func Load(ctx Context) error {" and called["ev_line"] == 7 and ("function:util.Load", "tested_by", "test:util.TestLoad") in edges
    assert sorted(r["ord"] for r in edges.values()) == list(range(1, len(edges) + 1))
    stamps = {r["path"] for r in out["stamps"].collect()}
    assert "util/bad.go" not in stamps and {"README.md", "notes.txt"} <= stamps

    # one file changes, one goes, one is put right
    (tree / "util/load.go").write_text(TREE["util/load.go"].replace("check", "verify"))
    (tree / "README.md").unlink()
    (tree / "util/bad.go").write_text("package util\n\nfunc y() { x := 3; _ = x }\n")
    again = source.scan(files_of(spark, tree), g, out["stamps"])
    now = {r["id"] for r in again["graph"].entities.collect()}
    assert {"function:util.verify", "function:util.y", "controller:ctl.Thing"} <= now and "function:util.check" not in now
    assert not any(i.startswith("document:") for i in now) and any(i.startswith("document:") for i in ents) and again["warnings"].count() == 0


def test_history_of_a_repository(spark, tree):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=ann@x.example", "-C", str(tree), *a], check=True, capture_output=True)
    assert source.git(str(tree), "rev-parse", "HEAD") == ""
    git("init", "-q", "-b", "main")
    git("add", "-A")
    git("commit", "-q", "-m", "one")
    out = source.scan(files_of(spark, tree), commits=source.commits(spark, str(tree)))
    row = out["graph"].entities.filter("id = 'function:util.Load'").first()
    assert (row["last_author"], row["change_count"]) == ("ann@x.example", 1) and row["last_modified"].endswith("Z") and source.head(str(tree))["branch"] == "main"


def rows_of(df):
    cols = [c for c in sorted(df.columns) if c not in ("ord", "local_id")]
    return sorted((tuple(map(str, r)) for r in df.select(*cols).collect()), key=repr)


def test_documents_and_tables(spark, tree, tmp_path, capsys):
    out = str(tmp_path / "g" / "graph.json")
    assert cli.scan(spark, str(tree), out, False, str(tmp_path / "tables")) == 0
    assert "util/bad.go" in capsys.readouterr().err and "fileTimestamps" in json.load(open(out))
    g, t = source.read_json(spark, out), source.read_parquet(spark, str(tmp_path / "tables"))
    assert rows_of(g.entities.drop("local_id")) == rows_of(t.entities.drop("local_id")) and rows_of(g.edges) == rows_of(t.edges)
    source.write_json(g, out + "2")
    assert rows_of(source.read_json(spark, out + "2").edges) == rows_of(g.edges)
    scanned = t.entities.filter("kind = 'function'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,function)" in scanned
    assert cli.scan(spark, str(tree), out, False) == 0  # on top of the document that is there


def test_snippets(spark):
    made = spark.createDataFrame([("e1", "a.go", 2), ("e2", "a.go", 9), ("e3", "b.go", 1), ("e4", "a.go", 0), ("e5", "a.go", 2)], "id string, ev_file string, ev_line int")
    files = spark.createDataFrame([("a.go", "x\n\t y \nz"), ("c.go", None)], "path string, content string")
    assert {r["id"]: r["ev_snippet"] for r in build.snippets(made, files).collect()} == {"e1": "y", "e2": "", "e3": "", "e4": "", "e5": "y"}


def test_streams(spark, tmp_path):
    row = lambda i, path, text, at: (i, "r", path, 1, None, "go", text, at)
    rows = [row(1, "a.go", TREE["util/load.go"], 1), row(1, "a.go", TREE["util/load.go"], 2), row(2, "b.md", "# T\n\ntext\n", 1), row(3, "n.go", None, 1)]
    spec = incremental.FILES.replace("loaded_at timestamp", "loaded_at long").replace("modified timestamp", "modified long")
    df = spark.createDataFrame(rows, spec).withColumns({"loaded_at": F.col("loaded_at").cast("timestamp"), "modified": F.col("modified").cast("timestamp")})
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df.write.parquet(folder)
    for _ in range(2):  # the second time there is nothing new
        incremental.entity_stream(spark, folder, out, state).start().awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.filter("kind = 'function'").collect()) == ["function:util.Load", "function:util.check"]
    counted = incremental.late_counts(spark.readStream.schema(incremental.FILES).parquet(folder)).writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert sum(r["n"] for r in spark.sql("select * from late").collect()) == 4
