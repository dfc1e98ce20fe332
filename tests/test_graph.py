"""Graph operators on small graphs of our own, and against sequential walks."""

import random

import pytest
from pyspark.sql import functions as F

from skein import schema
from skein.operators import build, lookup, maintain, review, traverse, views
from skein.plans import graph as plans
from skein.store import Graph, merged, normalise


def graph(spark, ents, edges):
    cols = schema.ENTITY.fieldNames()
    base = {c: None for c in cols}
    rows = [tuple((base | {"ord": n, "source_file": "f.go", "source_line": 1} | e).get(c) for c in cols) for n, e in enumerate(ents)]
    e = normalise(spark.createDataFrame(rows, schema.ENTITY)).withColumn("local_id", F.col("id"))
    made = [(n, f"{a}--{t}--{b}", a, b, t, "proven", "graph", "f.go", 1, "", "") for n, (a, t, b) in enumerate(edges)]
    return Graph(e, spark.createDataFrame(made, schema.EDGE))


def ent(id_, **more):
    kind, _, rest = id_.partition(":")
    return {"id": id_, "kind": kind, "name": rest.rpartition(".")[2], "package": rest.partition(".")[0]} | more


@pytest.fixture(scope="module")
def small(spark):
    ents = [
        ent("controller:ops.Cluster", watches=["Cluster", "Store"], calls=["p.sync"], source_file="ops/cluster.go", source_line=5, last_author="ann@x", change_count=3, last_modified="2024-01-02", properties=["creates:Secret"]),
        ent("crd:g.cluster", name="Cluster", package="g", source_file="crds/a.yaml"), ent("resource:job.Store", name="Store", package="ns", source_file="crds/b.yaml", properties=["spec.Size=3"]),
        ent("function:p.sync", calls=["load", "fmt.Println", "q.save"], source_file="p/sync.go", source_line=3, last_author="bob@x", change_count=9, last_modified="2023-05-01", literals=["etc/Limits.yaml"], implements=["io.save"]),
        ent("function:p.load", source_file="p/sync.go", source_line=9, calls=["p.load", "dup"]), ent("function:q.save", source_file="q/save.go", calls=["sync"], imports=[]),
        ent("function:p.dup", source_file="p/dup.go"), ent("function:q.dup", source_file="q/dup.go"),
        ent("test:p.Testsync", name="Testsync", source_file="p/sync_test.go"), ent("package:p", name="p", files=["p/sync.go"], imports=["fmt", "lib.example/kube/api"], embeds=["x"], source_file="crds/p"),
    ]
    edges = [
        ("controller:ops.Cluster", "reconciles", "crd:g.cluster"), ("controller:ops.Cluster", "calls", "function:p.sync"), ("function:p.sync", "calls", "function:p.load"), ("function:p.sync", "calls", "function:q.save"),
        ("function:q.save", "calls", "function:p.sync"), ("function:p.sync", "tested_by", "test:p.Testsync"), ("controller:ops.Cluster", "creates", "resource:job.Store"), ("function:p.load", "calls", "function:p.load"), ("function:p.load", "calls", "function:gone"),
    ]
    return graph(spark, ents, edges)


def ids(df, col="id"):
    return [r[col] for r in df.collect()]


def test_lookup(small):
    assert ids(lookup.lookup(small, "FUNCTION", "S")) == ["function:p.sync", "function:q.save"]
    assert ids(lookup.lookup(small, "nonsense")) == [] and len(ids(lookup.lookup(small, None, "", 0))) == 10
    assert ids(lookup.lookup(small, None, "%")) == []  # no wildcards
    assert ids(lookup.batch(small, ["crd:g.cluster", "no", "package:p"])) == ["crd:g.cluster", "package:p"]
    assert len(ids(lookup.incident(small, "function:p.load"))) == 4  # the loop twice
    assert len(ids(lookup.incident(small, "function:p.load", "from", "calls"))) == 2 and ids(lookup.incident(small, "function:p.load", "sideways")) == []


def test_search(small):
    got = [(r["id"], r["score"]) for r in lookup.search(small, "cluster").collect()]
    assert got == [("controller:ops.Cluster", 100), ("crd:g.cluster", 100)]
    assert [(r["id"], r["score"]) for r in lookup.search(small, "LIMITS sync").collect()] == [("function:p.sync", 130)]
    assert [(r["id"], r["score"]) for r in lookup.search(small, "kube").collect()] == [("package:p", 40)]
    assert [(r["id"], r["score"]) for r in lookup.search(small, "size=3").collect()] == [("resource:job.Store", 20)]
    assert ids(lookup.search(small, "  ")) == [] and ids(lookup.search(small, "cluster nothing")) == []
    assert ids(lookup.where(small, "P/SYNC.go")) == ["function:p.load", "function:p.sync", "package:p"]


def test_history_order(small):
    assert ids(lookup.hotspots(small)) == ["function:p.sync", "controller:ops.Cluster"] and ids(lookup.hotspots(small, stale=True))[0] == "function:p.sync"
    assert ids(lookup.temporal(small, since="2024")) == ["controller:ops.Cluster"] and ids(lookup.commits(small, author="BOB")) == ["function:p.sync"]


def test_context(small):
    nodes, edges = traverse.context(small, "function:p.load", 1)
    assert ids(nodes) == ["function:p.load", "function:p.sync"]
    assert len(ids(edges)) == 4  # its loop from both ends
    assert ids(traverse.context(small, "function:p.load", 0)[0]) == ["function:p.load"]
    assert len(ids(traverse.context(small, "function:p.load", 9)[0])) == 7


def test_explain(small):
    tree, capped = traverse.explain(small, "controller:ops.Cluster", 2)
    assert [x[4] for x in tree] == ["controller:ops.Cluster", "crd:g.cluster", "resource:job.Store", "function:p.sync", "function:p.load", "function:q.save", "test:p.Testsync"]
    assert not capped and len(traverse.explain(small, "controller:ops.Cluster", 1)[0]) == 4


def test_impact(small, spark):
    chain = traverse.impact(small, spark.createDataFrame([("function:p.load",)], "id string"))
    got = [(r["id"], r["level"]) for r in chain.orderBy("pos").collect()]
    assert got == [("function:p.load", 0), ("function:p.sync", 1), ("controller:ops.Cluster", 2), ("function:q.save", 2)]
    parts = traverse.impact_parts(small, chain)
    assert ids(parts["controllers"]) == ["controller:ops.Cluster"] and ids(parts["tests"]) == ["test:p.Testsync"]
    assert sorted(ids(parts["resources"])) == ["crd:g.cluster", "resource:job.Store"] and {r[1] for r in parts["files"].collect()} == {"p/sync.go", "ops/cluster.go", "q/save.go"}


def walk(callers, root, depth=5, most=50):
    """The sequential walk, with the cap tested after each addition."""
    seen, order, frontier = {root}, [root], [root]
    for _ in range(depth):
        new = []
        for node in frontier:
            for src in callers.get(node, ()):
                if src not in seen:
                    seen.add(src)
                    order.append(src)
                    new.append(src)
                    if len(order) >= most:
                        break
            if len(order) >= most:
                break
        frontier = new
        if not new:
            break
    return order


def test_impact_against_sequential_walk(spark):
    rng = random.Random(7)
    names = [f"function:p.f{i}" for i in range(220)]
    edges = sorted({(rng.choice(names[:90] if rng.random() < 0.4 else names), "calls", rng.choice(names[:40] if rng.random() < 0.5 else names)) for _ in range(900)})
    rng.shuffle(edges)
    g = graph(spark, [ent(n) for n in names], edges)
    callers = {}
    for a, _, b in edges:
        callers.setdefault(b, []).append(a)
    roots = names[:12]
    rows = traverse.impact(g, spark.createDataFrame([(r,) for r in roots], "id string")).collect()
    sizes = set()
    for root in roots:
        got = [r["id"] for r in sorted((r for r in rows if r["root"] == root), key=lambda r: r["pos"])]
        assert got == walk(callers, root), root
        sizes.add(len(got))
    assert max(sizes) >= 50


def test_impact_queries_over_capped_roots(spark, monkeypatch):
    """Every part of every root's chain, of those with 50 or more callers too."""
    hub, far = [f"function:p.f{i:02}" for i in range(70)], "function:q.far"
    callers = {"function:p.hub": hub, "function:p.small": [far]}
    ents = [ent(n, source_file=f"{n[-3:]}.go", last_author=f"{n[-1]}@x", last_modified="2024") for n in [*hub, far, *callers]] + [ent("controller:c.A"), ent("test:p.T"), ent("crd:g.c")]
    edges = [(a, "calls", b) for b, some in callers.items() for a in some] + [(n, t, o) for n in (hub[3], far) for t, o in (("tested_by", "test:p.T"), ("creates", "crd:g.c"))]
    edges = [("controller:c.A", "calls", "function:p.hub"), *edges]
    callers["function:p.hub"] = ["controller:c.A", *hub]
    g = graph(spark, ents, edges)
    monkeypatch.setattr(plans, "_graph", lambda spark, d: g)
    for known in (plans._root, plans._all_chains):
        known.cache_clear()
    try:
        got = {n: {tuple(r) for r in plans.QUERIES[f"impact_{n}"](spark, "").collect()} for n in ("chain", "controllers", "files", "owners", "recent", "tests", "resources")}
    finally:
        for known in (plans._root, plans._all_chains):
            known.cache_clear()
    chains = {root: walk(callers, root) for root in callers}
    of = {e["id"]: e for e in ents}
    assert len(chains["function:p.hub"]) == 50
    assert [i for _, i in sorted((pos, i) for i, _, pos in got["chain"])] == chains["function:p.hub"]
    for name, field in (("files", "source_file"), ("owners", "last_author")):
        assert got[name] == {(r, of[i].get(field) or "f.go") for r, c in chains.items() for i in c if of[i].get(field) or name == "files"}, name
    assert got["recent"] == {(r, i, "2024") for r, c in chains.items() for i in c if i.startswith("function")}
    assert got["controllers"] == {("function:p.hub", "controller:c.A", "A")}
    assert got["tests"] == {(r, "test:p.T", "T") for r in chains} and got["resources"] == {(r, "crd:g.c", "c") for r in chains}


def test_call_resolution(small):
    got = {(r["src"], r["call"]): (r["dst"], r["how"]) for r in build.resolve_calls(small.entities).collect()}
    assert got == {
        ("controller:ops.Cluster", "p.sync"): ("function:p.sync", "qualified"), ("function:p.sync", "load"): ("function:p.load", "unique"), ("function:p.sync", "q.save"): ("function:q.save", "qualified"),
        ("function:p.load", "p.load"): ("function:p.load", "qualified"), ("function:p.load", "dup"): ("function:p.dup", "package"), ("function:q.save", "sync"): ("function:p.sync", "unique"),
    }


def test_edges(small):
    got = {(r["src"], r["type"], r["dst"]) for r in build.edges(small.entities).collect()}
    assert got == {
        ("controller:ops.Cluster", "reconciles", "crd:g.cluster"), ("controller:ops.Cluster", "watches", "resource:job.Store"), ("controller:ops.Cluster", "calls", "function:p.sync"),
        ("function:p.sync", "calls", "function:p.load"), ("function:p.sync", "calls", "function:q.save"), ("function:p.load", "calls", "function:p.dup"), ("function:q.save", "calls", "function:p.sync"),
        ("function:p.sync", "implements", "function:q.save"), ("package:p", "embeds", "crd:g.cluster"), ("package:p", "embeds", "resource:job.Store"), ("function:p.sync", "tested_by", "test:p.Testsync"),
    }


def test_validation(small, spark):
    got = {(r["rule"], r["subject"]) for r in maintain.validate(small).collect()}
    assert got == {("unknown target", "function:p.load--calls--function:gone")}
    bad = graph(spark, [ent("function:a.b"), ent("function:a.b", source_file="")], [("function:a.b", "calls", "function:a.b")] * 2)
    bad.edges = bad.edges.withColumns({"confidence": F.lit(None).cast("string"), "ev_file": F.lit("")})
    assert {r["rule"] for r in maintain.validate(bad).collect()} == {"duplicate entity", "missing source file", "duplicate edge", "bad confidence", "missing evidence file"}
    assert maintain.validate(graph(spark, [], [])).count() == 0


def test_merge(spark):
    g = graph(spark, [ent("package:p", files=["a"], imports=["x", "y"], calls=["1"]), ent("package:p", name="late", files=["b", "a"], imports=["z", "x"], calls=["2"])], [])
    row = merged(g.entities, ["id"], ["ord"]).first()
    assert (row["name"], row["files"], row["imports"], row["calls"]) == ("p", ["a", "b"], ["x", "y", "z"], ["1"])


def test_incremental(spark):
    new = spark.createDataFrame([("a/x.go", "1"), ("b.go", "2"), ("c.go", "3")], "path string, modified string")
    old = spark.createDataFrame([("a/x.go", "1"), ("b.go", "1"), ("d.go", "1")], "path string, modified string")
    assert {tuple(r) for r in maintain.changed_files(new, old).collect()} == {("a/x.go", "unchanged"), ("b.go", "changed"), ("c.go", "changed"), ("d.go", "deleted")}
    g = graph(spark, [ent("function:p.a", source_file="a/x.go"), ent("package:a", source_file="a"), ent("package:ab", source_file="ab"), ent("package:root", source_file="."), ent("function:p.b", source_file="b.go")], [])
    assert sorted(ids(maintain.carry_over(g.entities, spark.createDataFrame([("a/x.go",)], "path string")))) == ["function:p.a", "package:a", "package:root"]


def test_views(small):
    v = {r["id"]: r for r in views.compile_views(small).collect()}
    c = v["controller:ops.Cluster"]
    assert (c["reconciles"], c["creates"], c["calls"], c["owners"], c["test_count"]) == ("Cluster", ["Secret", "Store"], ["sync"], ["ann@x"], 0)
    assert v["crd:g.cluster"]["reconciled_by"] == "Cluster"
    q = {(r["verb"], r["subject"]): r["answer"] for r in views.questions(views.compile_views(small)).collect()}
    assert q["watches", "Cluster"] == "Cluster, Store" and q["creates", "Cluster"] == "Secret, Store" and ("tests", "Cluster") not in q
    out = views.ask(small, views.compile_views(small), views.questions(views.compile_views(small)), "controller:ops.Cluster")
    assert out["answer"] == "reconciles: Cluster" and out["view"]["id"] == "controller:ops.Cluster"
    assert views.ask(small, views.compile_views(small), views.questions(views.compile_views(small)), "zzz")["entity"] is None


def test_review(small, spark):
    files = spark.createDataFrame([("p/sync.go", "M"), ("p/dup.go", "A"), ("q/dup.go", "D"), ("z.go", "M"), ("z.txt", "M")], "path string, status string")
    hunks = spark.createDataFrame([("p/sync.go", 8, 1), ("p/sync.go", 9, 0), ("p/dup.go", 1, 1)], "path string, new_start int, new_count int")
    got = {r["id"]: (r["approximate"], len(r["hunks"])) for r in review.changed_entities(small.entities, files, hunks).collect()}
    assert got == {"function:p.sync": (True, 1), "function:p.load": (True, 1), "function:p.dup": (False, 0)}
    assert {tuple(r) for r in review.unmapped(small.entities, files).collect()} == {("z.go", "M"), ("q/dup.go", "D")}
    t = spark.createDataFrame([("t1", "TestSyncAll", "p/x_test.go", 0), ("t2", "TestOther", "p/sync_test.go", 1)], "id string, name string, path string, ord long")
    f = spark.createDataFrame([("f1", "sync", "p/sync.go", 0), ("f2", "load", "p/sync.go", 1)], "id string, name string, path string, ord long")
    assert {tuple(r) for r in review.test_targets(t, f).collect()} == {("t1", "f1", "naming convention"), ("t2", "f1", "same file"), ("t2", "f2", "same file")}


def _targets(tests, functions):
    """As test_targets by name, one test and function after the other."""
    out = set()
    for scope, test, name, _, _ in tests:
        t = name.removeprefix("Test").lower()
        met = [(o, i) for s, i, f, _, o in functions if s == scope and (f.lower() in t or t in f.lower())]
        if met:
            out.add((scope, test, min(met)[1], "naming convention"))
    named = {x[:2] for x in out}
    return out | {(s, t, f, "same file") for s, t, _, p, _ in tests if (s, t) not in named for z, f, _, q, _ in functions if z == s and q == p.replace("_test.go", ".go")}


@pytest.mark.parametrize("near", [0, 2, 64])
def test_targets_by_name(spark, monkeypatch, near):
    """Packages compared name by name, by parts, and some so and some so; names of all lengths, '', repeated, of signs beyond ASCII."""
    monkeypatch.setattr(review, "NEAR", near)
    dice = random.Random(near)
    some = lambda most: "".join(dice.choice("abÄ") for _ in range(dice.randint(0, most)))
    scopes = [f"s{n}" for n in range(5)]
    t = [(s := dice.choice(scopes), f"t{n}", dice.choice(["Test", "Test", ""]) + some(14), f"{s}/{n % 7}_test.go", n) for n in range(120)]
    f = [(s := dice.choice([*scopes, "untested"]), f"f{n}", some(dice.choice([2, 9, 14])), f"{s}/{n % 7}.go", dice.randint(0, 40)) for n in range(150)] + [("s5", "f", "b", "p.go", 1)]
    t += [("s5", "t", "TestAnother", "p_test.go", 1), ("s6", "t", "TestNone", "p_test.go", 1)]
    f = [x for x in f if x[2]] + [("s0", "void", "", "v.go", 40)]
    frame = lambda rows: spark.createDataFrame(rows, "package string, id string, name string, path string, ord long")
    got = [tuple(r) for r in review.test_targets(frame(t), frame(f), ["package"]).collect()]
    assert len(got) == len(set(got)) and set(got) == _targets(t, f)


def _broadcast_rows(spark, first=0):
    """(executions so far, most rows broadcast at once in those from ``first`` on)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    each = lambda xs: (xs.apply(n) for n in range(xs.size()))
    ids = [x.executionId() for x in each(store.executionsList())]
    for i in (i for i in ids if i >= first):
        values = store.executionMetrics(i)
        rows = (m for n in each(store.planGraph(i).allNodes()) if n.name() == "BroadcastExchange" for m in each(n.metrics()) if m.name() == "number of output rows")
        most = max([most, *(int(values.apply(m.accumulatorId()).replace(",", "")) for m in rows if values.contains(m.accumulatorId()))])
    return max(ids, default=-1) + 1, most


def test_targets_are_not_broadcast_by_estimate(spark, tmp_path):
    """The parts of names are many times the names: Spark's estimate of them is no ground for a broadcast, which the driver would hold."""
    name = lambda n: f"{n:05d}" + "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz", k=40))
    t = [("p", f"t{n}", "Test" + name(n) + "Twice", f"{n}_test.go", n) for n in range(300)]
    f = [("p", f"f{n}", name(n), f"{n}.go", n) for n in range(300)]
    for part, rows in (("t", t), ("f", f)):  # the sizes of files are known to Spark
        spark.createDataFrame(rows, "package string, id string, name string, path string, ord long").write.parquet(f"{tmp_path}/{part}")
    first, _ = _broadcast_rows(spark)
    got = {tuple(r)[1:] for r in review.test_targets(spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/f"), ["package"]).collect()}
    assert got == {(f"t{n}", f"f{n}", "naming convention") for n in range(300)}
    assert _broadcast_rows(spark, first)[1] <= 600
