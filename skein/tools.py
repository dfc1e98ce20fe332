"""The tools of an assistant: thin functions over a graph, each giving text."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import render
from skein.common import cut
from skein.operators import lookup, review, traverse, views
from skein.sources.text import parse_diff
from skein.store import Graph, numbered

#: Edges and names a text shows at most.
EDGES, NAMES = 2000, 100


class Tools:
    """Eleven tools over one graph; views and questions are compiled once."""

    def __init__(self, graph: Graph, compiled=None):
        self.g = graph
        self.views = compiled if compiled is not None else views.compile_views(graph).persist()
        self.questions = views.questions(self.views)

    def search(self, query: str = "", kind: str = "", mode: str = "lookup", limit: int = 20) -> str:
        """With a kind either a lookup by name, or (mode 'post') the ranked search filtered afterwards."""
        if kind and mode == "lookup":
            return render.entities(lookup.lookup(self.g, kind, query, limit).collect())
        rows = lookup.search(self.g, query, limit).collect()
        return render.entities([r for r in rows if not kind or r["kind"] == kind])

    def query(self, kind: str, name: str = "", limit: int = 20) -> str:
        """Entities of a kind by name, each with its edges."""
        found = lookup.lookup(self.g, kind, name, limit).collect()
        links = [render.edges(rows) for e in found if (rows := lookup.incident(self.g, e["id"]).limit(EDGES).collect())]
        return "\n".join([render.entities(found), *links])

    def entity(self, id_: str = "", ids: list[str] = (), brief: bool = False) -> str:
        if ids:
            return render.entities(lookup.batch(self.g, list(ids)).collect())
        found = lookup.get(self.g, id_).collect()
        if not found or brief:
            return render.entities(found)
        return render.entities(found, brief=False) + "\n" + render.edges(lookup.incident(self.g, id_).collect())

    def context(self, id_: str, depth: int = 1) -> str:
        nodes, links = traverse.context(self.g, id_, depth)
        shown = nodes.collect()  # at most 50
        ids = [e["id"] for e in shown]
        near = links.filter(F.col("src").isin(ids) | F.col("dst").isin(ids)).persist()
        rows, held = near.limit(EDGES).collect(), near.count()
        near.unpersist()
        return render.subgraph(shown, rows, max(0, held - EDGES))

    def where(self, path: str, detail: bool = False) -> str:
        return render.entities(lookup.where(self.g, path, 30).collect(), brief=not detail)

    def stats(self) -> str:
        kinds, types = lookup.stats(self.g)
        return render.stats(kinds.collect(), types.collect())

    def temporal(self, **filters) -> str:
        return render.entities(lookup.temporal(self.g, **filters).collect(), brief=False)

    def investigate(self, id_: str) -> str:
        e = lookup.get(self.g, id_).first()
        parts = {k: v.collect() for k, v in traverse.investigate(self.g, id_).items()} if e else {}
        return render.investigation(e, parts) if e else render.entities([])

    def explain(self, id_: str, depth: int = 2) -> str:
        return render.explanation(*traverse.explain(self.g, id_, depth)) if lookup.get(self.g, id_).first() else render.entities([])

    def impact(self, id_: str, compact: bool = False) -> str:
        chain = traverse.impact(self.g, lookup.get(self.g, id_).select("id"))
        parts = {k: v.collect() for k, v in traverse.impact_parts(self.g, chain).items()}
        return render.impact(chain.orderBy("pos").collect(), parts, compact)

    def view(self, name: str) -> str:
        v = self.views.filter(F.col("id") == name).first() or views.view_by_name(self.views, name).first()
        return render.view(v) if v else "No view found."

    def ask(self, name: str, intent: str = "", detail: bool = False) -> str:
        return render.asked(views.ask(self.g, self.views, self.questions, name, intent), detail)

    def resolve(self, name: str) -> str:
        e = views.resolve(self.g, name)
        return e["id"] if e else name

    def review(self, diff: str) -> str:
        """A unified diff against the graph."""
        files, hunks = parse_diff(diff)
        spark, paths = self.g.spark, {f[0]: f[1] for f in files}
        if not files:
            return render.review([], [], [])
        f = spark.createDataFrame([(x[1], x[3]) for x in files], "path string, status string")
        h = spark.createDataFrame([(paths[x[0]], x[4], x[5], x[3]) for x in hunks], "path string, new_start int, new_count int, old_count int")
        own = self.g.entities.select("id", "name", "source_file", "ord")
        changed = cut(review.changed_entities(self.g.entities, f, h).join(own, "id"))
        rows = changed.orderBy("ord").collect()  # as many as a diff touches
        part = lambda kind: changed.filter(F.col("kind") == kind).select("id", "name", "path", "ord")
        targets: dict[str, list] = {}
        for r in review.test_targets(part("test"), changed.filter("kind <> 'test'").select("id", "name", "path", "ord")).orderBy("test", "target").collect():
            targets.setdefault(r["test"], []).append((r["target"], r["reason"]))
        added = {r["id"]: r["added"] for r in changed.filter("kind = 'test'").select("id", review.added_test(F.col("hunks")).alias("added")).collect()}
        links = [(r["id"], added[r["id"]], targets.get(r["id"], [])) for r in rows if r["kind"] == "test"]
        return render.review(rows, review.unmapped(self.g.entities, f).orderBy("path").collect(), links, self._touched(changed))

    def _touched(self, changed) -> dict[str, dict]:
        """What the changed entities touch, by part and entity; the first names of each."""
        out: dict[str, dict] = {}
        for name, df in review.analyze(self.g, changed).items():
            df = df.filter(~review.is_noise("call")).select("id", F.col("call").alias("name")) if name == "callees" else df.select("id", "name")
            held = numbered(df.distinct(), ["id"], "name").filter(F.col("n") <= NAMES).select("id", "name", "n").collect()
            out[name] = {}
            for r in sorted(held, key=lambda r: r["n"]):
                out[name].setdefault(r["id"], []).append(r["name"])
        out["views"] = {v["id"]: v for v in self.views.join(changed.select("id"), "id", "left_semi").collect()}
        return out
