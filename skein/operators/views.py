"""Pre-computed views of controllers and crds, the question index, and the intent router."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import lookup, traverse
from skein.store import Graph, numbered

VIEW_CALLS = 10
VERBS = ["reconciles", "reconciled-by", "creates", "created-by", "tests", "owns", "files", "watches"]
QUICK = ["reconciles", "creates", "tests", "watches"]


def _names(g: Graph, edge_type: str, here: str, there: str, name: str, how: str = "all") -> DataFrame:
    """One row an entity: names at the other ends of its edges of a type, sorted; the last
    one by edge order, or the first ten by it, sorted."""
    ends = g.edges.filter(F.col("type") == edge_type).join(g.entities.select(F.col("id").alias(there), F.col("name").alias("_n")), there)
    rows = ends.select(F.col(here).alias("id"), "_n", "ord", F.col("id").alias("_e"))
    if how == "last":
        return rows.groupBy("id").agg(F.max_by("_n", F.struct("ord", "_e")).alias(name))
    if how == "ten":
        rows = numbered(rows, ["id"], "ord", "_e").filter(F.col("n") <= VIEW_CALLS)
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("_n")).alias(name))


_BASE = ["id", "name", "kind", "package", "source_file", "description", "files", "last_author", "last_modified", "change_count"]


def compile_views(g: Graph) -> DataFrame:
    """One row for each controller and crd: own fields and the names around them."""
    owners = F.when(F.col("last_author") != "", F.array("last_author")).otherwise(F.array().cast("array<string>"))
    rows = g.entities.filter(F.col("kind").isin("controller", "crd")).select(*_BASE, "watches", "properties", owners.alias("owners"))
    for part in (
        _names(g, "reconciles", "src", "dst", "reconciles", "last"), _names(g, "creates", "src", "dst", "created"), _names(g, "calls", "src", "dst", "calls", "ten"),
        _names(g, "tested_by", "src", "dst", "tests"), _names(g, "calls", "dst", "src", "called_by"), _names(g, "reconciles", "dst", "src", "reconciled_by", "last"), _names(g, "creates", "dst", "src", "created_by"),
    ):
        rows = rows.join(part, "id", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("created", "calls", "tests", "called_by", "created_by")}
    rows = rows.withColumns(lists | {c: F.coalesce(c, F.lit("")) for c in ("reconciles", "reconciled_by")})
    is_ctl = F.col("kind") == "controller"
    said = F.transform(F.filter("properties", lambda p: p.startswith("creates:")), lambda p: F.substring(p, 9, 1_000_000))
    creates = F.array_sort(F.concat("created", F.array_except(said, "created")))
    only = lambda c, when: F.when(when, F.col(c)).otherwise(none if c not in ("reconciles", "reconciled_by") else F.lit(""))
    return rows.select(
        *_BASE, "owners", only("reconciles", is_ctl).alias("reconciles"), only("watches", is_ctl).alias("watches"), F.when(is_ctl, creates).otherwise(none).alias("creates"), only("calls", is_ctl).alias("calls"),
        "tests", F.size("tests").alias("test_count"), only("called_by", is_ctl).alias("called_by"), only("reconciled_by", ~is_ctl).alias("reconciled_by"), only("created_by", ~is_ctl).alias("created_by"),
    )


def questions(views: DataFrame) -> DataFrame:
    """(verb, subject, answer): lists joined by commas, empty answers left out; of entities of
    one name the last by id stands."""
    said = [F.col("reconciles"), F.col("reconciled_by"), *[F.array_join(c, ", ") for c in ("creates", "created_by", "tests", "owners", "files", "watches")]]
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, VERBS)).alias("verb"), F.array(*said).alias("answer")))
    rows = views.select("id", F.col("name").alias("subject"), pairs.alias("q")).select("q.verb", "subject", "q.answer", "id").filter("answer <> ''")
    return rows.groupBy("verb", "subject").agg(F.max_by("answer", "id").alias("answer"))


def view_by_name(views: DataFrame, name: str) -> DataFrame:
    """The view of exactly that name in any case, else the first that holds it, by name and id."""
    low = F.lower("name")
    return views.filter(F.contains(low, F.lit(name.lower()))).orderBy((low != name.lower()), low, "id").limit(1)


def resolve(g: Graph, name: str):
    """The entity of an id, else the best match of a search; None if there is none."""
    return lookup.get(g, name).first() or lookup.search(g, name, 1).first()


def ask(g: Graph, views: DataFrame, index: DataFrame, name: str, intent: str = "") -> dict:
    """An entity, its view, and what the intent asks for."""
    entity = resolve(g, name)
    if entity is None:
        return {"entity": None}
    out = {"entity": entity, "view": views.filter(F.col("id") == entity["id"]).first() or view_by_name(views, entity["name"]).first()}
    answers = {r["verb"]: r["answer"] for r in index.filter(F.col("subject") == entity["name"]).collect()}
    if intent == "understand":
        out |= {"answer": answers.get("reconciles", ""), "explanation": traverse.explain(g, entity["id"], 2)}
    elif intent == "impact":
        out["impact"] = traverse.impact(g, g.entities.filter(F.col("id") == entity["id"]))
    elif intent == "debug":
        out["investigation"] = traverse.investigate(g, entity["id"])
    else:
        out["answer"] = next((f"{v}: {answers[v]}" for v in QUICK if v in answers), "")
    return out
