"""Point and filtered lookups, ranked search, path search, counts, change history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schema
from skein.functions.text import any_has, has, term_score, terms
from skein.store import Graph, top


def get(g: Graph, entity_id: str) -> DataFrame:
    return g.nodes(entity_id)


def batch(g: Graph, ids: list[str]) -> DataFrame:
    """Entities in the order asked for; ids that don't exist are left out."""
    asked = g.spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, pos long")
    return g.nodes(*ids).join(F.broadcast(asked), "id").orderBy("pos")  # the caller's list


def of_kind(kind: str | None):
    """The filter of a kind: none if it isn't asked for, nothing if it isn't one."""
    if not kind:
        return F.lit(True)
    return F.col("kind") == kind.lower() if kind.lower() in schema.KINDS else F.lit(False)


def lookup(g: Graph, kind: str | None, name: str = "", limit: int = 20) -> DataFrame:
    return top(g.entities.filter(of_kind(kind) & has("name", name)), limit, "id")


def incident(g: Graph, entity_id: str, direction: str = "both", edge_type: str = "") -> DataFrame:
    """Edges of an entity by id; under 'both' a loop is there twice. Other directions give none."""
    out, into = g.links("src", entity_id), g.links("dst", entity_id)
    found = {"from": out, "to": into, "both": out.unionAll(into), "": out.unionAll(into)}.get(direction)
    found = out.filter("false") if found is None else found
    return (found.filter(F.col("type") == edge_type) if edge_type else found).orderBy("id")


def search(g: Graph, query: str, limit: int = 20) -> DataFrame:
    """Entities that hold every term, by the sum of the terms' tiers, then id; with ``score``."""
    scores = [term_score(t) for t in terms(query)]
    if not scores:
        return g.entities.filter("false").withColumn("score", F.lit(0))
    hits = g.entities.withColumns({f"_s{i}": s for i, s in enumerate(scores)})
    hits = hits.filter(reduce(lambda a, b: a & b, [F.col(f"_s{i}") > 0 for i in range(len(scores))]))
    hits = hits.withColumn("score", reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i in range(len(scores))])).drop(*[f"_s{i}" for i in range(len(scores))])
    return top(hits, limit, F.desc("score"), "id")


def where(g: Graph, path: str, limit: int = 30) -> DataFrame:
    return top(g.entities.filter(has("source_file", path) | any_has("files", path)), limit, "id")


def stats(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(counts by kind, counts by edge type)"""
    return g.entities.groupBy("kind").count(), g.edges.groupBy("type").count()


def callers(g: Graph, entity_id: str) -> DataFrame:
    to = g.links("dst", entity_id).filter(F.col("type") == "calls").select(F.col("src").alias("id"))
    return g.entities.join(to, "id").orderBy("id")


def hotspots(g: Graph, kind: str | None = None, stale: bool = False, limit: int = 20) -> DataFrame:
    """Entities with changes, the most changed or the least recently changed first; ties by id."""
    rows = g.entities.filter(of_kind(kind) & (F.col("change_count") != 0))
    return top(rows, limit, F.asc("last_modified") if stale else F.desc("change_count"), "id")


def temporal(g: Graph, kind: str | None = None, name: str = "", since: str = "", author: str = "", stale: bool = False, limit: int = 20) -> DataFrame:
    """Entities with history, filtered; times compare as text. Ties by id."""
    rows = g.entities.filter(of_kind(kind) & has("name", name) & has("last_author", author) & ((F.col("change_count") != 0) | (F.col("last_modified") != "")))
    if since:
        rows = rows.filter(F.col("last_modified") >= since)
    order = F.asc("last_modified") if stale else F.desc("last_modified") if since or author else F.desc("change_count")
    return top(rows, limit, order, "id")


def commits(g: Graph, name: str = "", since: str = "", author: str = "", limit: int = 20) -> DataFrame:
    rows = g.entities.filter(has("name", name) & has("last_author", author) & (F.col("last_modified") != ""))
    if since:
        rows = rows.filter(F.col("last_modified") >= since)
    return top(rows, limit, F.desc("last_modified"), "id")
