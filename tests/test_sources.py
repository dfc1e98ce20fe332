"""Extraction from files, logs and diffs."""

import pytest

from skein.sources import golang, text
from skein.sources.scan import parser_of

GO = '''// Package ctl does.
package ctl

import (
	"context"
	k "lib.example/kube/api"
)

//go:embed manifests/*.yaml
var files embed.FS

var _ Iface = &Thing{}
var _ Other = (*Thing)(nil)

// Thing reconciles.
type Thing struct{ a int }

// Reconcile runs.
//
//nolint:errcheck
func (r *Thing) Reconcile(ctx context.Context, x struct{ y int }) (res Result, err error) {
	v := os.Getenv("HOME_DIR") // f(1)
	r.client.Get(ctx, "a/bc").Do(v)
	f(g(1), "func fake() {")
	return
}

func (r *Thing) SetupWithManager(m Manager) error {
	r.watchAll()
	return ctrl.New(m).For(&v1.Foo{}).Owns(&Bar{}).Complete(r)
}

func (r *Thing) watchAll() { x := &apps.Deployment{}; _ = x }
func Gen[T any](in []T) int { return len(in) }
'''


def test_go():
    rows = {e["id"]: e for e in golang.parse("pkg/ctl/a.go", GO)}
    assert list(rows)[0] == "package:ctl" and rows["package:ctl"]["imports"] == ["context", "lib.example/kube/api"] and rows["package:ctl"]["embeds"] == ["manifests/*.yaml"]
    f = rows["function:ctl.Thing.Reconcile"]
    assert f["description"] == "Reconcile runs." and f["calls"] == ["os.Getenv", "Do", "Get", "f", "g"] and f["env_vars"] == ["HOME_DIR"] and f["literals"] == ["HOME_DIR", "a/bc"]
    assert f["implements"] == ["Iface"] and f["source_line"] == 21
    c = rows["controller:ctl.Thing"]
    assert c["watches"] == ["Foo", "Bar"] and c["properties"] == ["creates:Deployment"] and c["description"] == "Thing reconciles."
    assert rows["function:ctl.Gen"]["calls"] == ["len"]
    for bad in ("", "func x() {}", "package a\nfunc (", 'package a\nvar x = "open\n'):
        with pytest.raises(golang.Unparsable):
            golang.parse("x.go", bad)
    tests = golang.parse_tests("a_test.go", "package p\nfunc TestA(t *T) {}\nfunc (s S) TestB() {}\nfunc helper() {}\n")
    assert [e["id"] for e in tests] == ["test:p.TestA"]


def test_markdown():
    (d,) = text.parse_markdown("docs/a.md", "intro\n# One\n---\nprose\n```\n# not\n```\n## Two ##x\n" + "word " * 200)
    assert d["description"] == "One; Two ##x" and d["content"].startswith("prose word") and len(d["content"]) == 500 and d["content"].endswith("...")


def test_yaml():
    pytest.importorskip("yaml")
    (r,) = text.parse_yaml("a.yaml", "kind: Deployment\nmetadata:\n  name: x\n  namespace: n\n  annotations: {a: 1}\nspec:\n  a: [1, true, {b: c}]\n  z: null\n")
    assert r["id"] == "resource:deployment.x" and r["properties"] == ["kind=Deployment", "metadata.name=x", "metadata.namespace=n", "spec.a.0=1", "spec.a.1=true", "spec.a.2.b=c"]
    (c,) = text.parse_yaml("c.yaml", "kind: CustomResourceDefinition\nmetadata:\n  name: foos.x\nspec:\n  group: x.y\n  names: {kind: Foo}\n")
    assert c["id"] == "crd:x.y.foo" and text.parse_yaml("d.yaml", "a: 1\n") == [] and text.parse_yaml("e.yaml", "") == []
    with pytest.raises(golang.Unparsable):
        text.parse_yaml("f.yaml", "a: [1\n")


def test_log_and_diff():
    assert text.parse_log("ann@x 1700000000\n\na.go\nb.go\nbob@x 1600000000\n\na.go\n") == [(0, "ann@x", 1700000000, "a.go"), (0, "ann@x", 1700000000, "b.go"), (1, "bob@x", 1600000000, "a.go")]
    diff = "diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -1,2 +3 @@ func f\n-a\n+b\n+c\n@@ -9 +10,5 @@\ndiff --git a/n.go b/n.go\nnew file mode 1\n@@ -0,0 +1 @@\n+z\ndiff --git a/o.go b/p.go\nrename from o.go\nrename to p.go\n"
    files, hunks = text.parse_diff(diff)
    assert files == [(0, "x.go", "x.go", "M", 2, 1), (1, "n.go", "n.go", "A", 1, 0), (2, "p.go", "o.go", "R", 0, 0)]
    assert hunks == [(0, 0, 1, 2, 3, 1, "func f"), (0, 1, 9, 1, 10, 5, ""), (1, 0, 0, 0, 1, 1, "")] and text.parse_diff("") == ([], [])


def test_routing():
    assert parser_of("a/b.go") is golang.parse and parser_of("a/b_test.go") is golang.parse_tests and parser_of("x.yml") is text.parse_yaml
    assert parser_of("README.md") is text.parse_markdown and parser_of("a.go/x") is None and parser_of("Makefile") is None
