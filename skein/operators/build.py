"""Edges from entities: the joins that make a graph, with deduplication and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.common import broadcast_if_small, cut
from skein.functions.text import after_last, directory
from skein.store import first_by

# Names too common to resolve a call by.
SKIPPED = (
    "Error String Get Set Errorf Sprintf Printf Fprintf New Close Read Write Wrap Wrapf Log Info Debug Warn Fatal Panic Format "
    "Unmarshal Marshal Decode Encode Len Less Swap Sort append make len cap delete copy close panic recover print println"
).split()
# The reasons edges give.
REASONS = {
    "reconciles": "first watched type of the controller", "watches": "further watched type of the controller", "calls": "function body names the callee",
    "implements": "interface assertion", "embeds": "go:embed directive of the package", "tested_by": "test named after the function",
}


def resolve_calls(entities: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(scope.., src, kind, call, pos, dst, how): the function each call string of a function
    or controller means; calls that mean none are left out.

    By priority: the qualified id, a bare name that is unique, a bare name that is unique in
    the caller's package. Three equi-joins; the names that are not unique never meet the
    calls. ``scope``: columns within which names count, such as the repository.
    """
    scope = list(scope)
    funcs = entities.filter(F.col("kind") == "function").select(*scope, "id", "name", "package", "local_id")
    by_id = funcs.select(*scope, F.regexp_replace("local_id", "^function:", "").alias("call"), F.col("id").alias("q"))
    once = lambda keys, name: funcs.groupBy(*scope, *keys).agg(F.count("*").alias("c"), F.min("id").alias(name)).filter("c = 1").drop("c")
    unique = once(["name"], "u").withColumnRenamed("name", "bare")
    many = funcs.groupBy(*scope, "name").agg(F.count("*").alias("c")).filter("c > 1").select(*scope, F.col("name").alias("bare"), F.lit(True).alias("many"))
    packaged = once(["package", "name"], "p").withColumnRenamed("name", "bare").filter("package <> ''")
    sites = entities.filter(F.col("kind").isin("function", "controller")).select(*scope, F.col("id").alias("src"), "kind", "package", F.posexplode("calls").alias("pos", "call"))
    sites = sites.withColumn("bare", after_last("call", ".")).filter(~F.col("bare").isin(SKIPPED) & (F.col("bare") != ""))
    found = sites.join(by_id, [*scope, "call"], "left").join(unique, [*scope, "bare"], "left").join(many, [*scope, "bare"], "left").join(packaged, [*scope, "package", "bare"], "left")
    exact = F.when(F.contains("call", F.lit(".")), F.col("q"))
    local = F.when(F.col("many"), F.col("p"))
    how = F.when(exact.isNotNull(), "qualified").when(F.col("u").isNotNull(), "unique").otherwise("package")
    return found.select(*scope, "src", "kind", "call", "pos", F.coalesce(exact, F.col("u"), local).alias("dst"), how.alias("how")).filter("dst is not null")


def _last_target(entities: DataFrame, scope: list[str]) -> DataFrame:
    targets = entities.filter(F.col("kind").isin("crd", "resource"))
    return targets.groupBy(*scope, F.col("name").alias("watch")).agg(F.max_by("id", F.struct("ord", "id")).alias("dst"))


def watch_edges(entities: DataFrame, scope: list[str] = ()) -> DataFrame:
    """reconciles (the first watched name) and watches (the others) of controllers; of several
    targets of a name the last stands."""
    seen = entities.filter(F.col("kind") == "controller").select(*scope, F.col("id").alias("src"), F.posexplode("watches").alias("pos", "watch"))
    found = seen.join(_last_target(entities, list(scope)), [*scope, "watch"])
    kind = F.when(F.col("pos") == 0, "reconciles").otherwise("watches")
    return found.select(*scope, "src", "dst", kind.alias("type"), "pos")


def call_edges(entities: DataFrame, scope: list[str] = ()) -> DataFrame:
    found = resolve_calls(entities, scope).filter((F.col("src") != F.col("dst")) | (F.col("kind") != "function"))
    return found.select(*scope, "src", "dst", F.lit("calls").alias("type"), "pos")


def implement_edges(entities: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Functions to the first function that bears the name of what they implement."""
    scope = list(scope)
    first = entities.filter(F.col("kind") == "function").groupBy(*scope, F.col("name").alias("bare")).agg(F.min_by("id", F.struct("ord", "id")).alias("dst"))
    says = entities.filter("size(implements) > 0").select(*scope, F.col("id").alias("src"), F.posexplode("implements").alias("pos", "what"))
    found = says.withColumn("bare", after_last("what", ".")).join(first, [*scope, "bare"])
    return found.select(*scope, "src", "dst", F.lit("implements").alias("type"), "pos")


def embed_edges(entities: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Packages with embeds to the resources and crds whose directory begins with the parent
    of the package's; a raw prefix, so ``pkg/a`` takes ``pkg/ab``.

    The prefix condition is turned into an equi-join: every directory is met at each of its
    prefixes that some package's parent has the length of.
    """
    scope = list(scope)
    packages = entities.filter((F.col("kind") == "package") & (F.size("embeds") > 0)).select(*scope, F.col("id").alias("src"), directory("source_file").alias("parent"))
    lengths = packages.select(F.length("parent").alias("size")).distinct()
    held = entities.filter(F.col("kind").isin("crd", "resource")).select(*scope, F.col("id").alias("dst"), directory("source_file").alias("dir"), "ord")
    prefixes = held.join(broadcast_if_small(cut(lengths)), F.expr("size <= length(dir)")).withColumn("parent", F.expr("substring(dir, 1, size)"))
    found = packages.join(prefixes, [*scope, "parent"])
    return found.select(*scope, "src", "dst", F.lit("embeds").alias("type"), F.col("ord").alias("pos"))


def test_edges(entities: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Functions to the tests named Test<function> in their package; the last function of a name stands."""
    scope = list(scope)
    last = entities.filter(F.col("kind") == "function").groupBy(*scope, "package", F.col("name").alias("bare")).agg(F.max_by("id", F.struct("ord", "id")).alias("src"))
    tests = entities.filter(F.col("kind") == "test").select(*scope, F.col("id").alias("dst"), "package", F.regexp_replace("name", "^Test", "").alias("bare"), "ord")
    return tests.join(last, [*scope, "package", "bare"]).select(*scope, "src", "dst", F.lit("tested_by").alias("type"), F.col("ord").alias("pos"))


def edges(entities: DataFrame, scope: list[str] = ()) -> DataFrame:
    """All edges in the order they are made, each id once, with evidence but for the snippet."""
    stages = [watch_edges, call_edges, implement_edges, embed_edges, test_edges]
    made = None
    for n, stage in enumerate(stages):
        part = stage(entities, scope).withColumn("stage", F.lit(n))
        made = part if made is None else made.unionByName(part)
    source = entities.select(F.col("id").alias("src"), F.col("ord").alias("_ord"), F.col("source_file").alias("ev_file"), F.col("source_line").alias("ev_line"))
    made = made.join(source, "src").withColumn("id", F.concat("src", F.lit("--"), "type", F.lit("--"), "dst"))
    made = first_by(made, ["id"], ["stage", "_ord", "pos", "src", "dst"])
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    sure = F.when(F.col("type") == "reconciles", "proven").otherwise("inferred")
    line = F.when(F.col("type") == "embeds", 1).otherwise(F.col("ev_line"))
    return made.select("id", "src", "dst", "type", sure.alias("confidence"), F.lit("graph").alias("ev_parser"), "ev_file", line.alias("ev_line"), reasons[F.col("type")].alias("ev_reason"), F.struct("stage", "_ord", "pos").alias("made_at"))


def snippets(made: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with the trimmed source line they point at, '' where there is none.

    ``files``: (path, content). A file meets the lines asked of it once, is split once, and
    only those lines leave it; lines of one path are at most as many as the file has.
    """
    asked = made.filter("ev_line > 0").groupBy(F.col("ev_file").alias("path")).agg(F.collect_set("ev_line").alias("asked"))
    numbered = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("ev_line"), x.alias("text")))
    told = files.join(asked, "path").select(F.col("path").alias("ev_file"), F.explode(F.filter(numbered, lambda r: F.array_contains("asked", r["ev_line"]))).alias("r"))
    lines = told.select("ev_file", "r.ev_line", F.regexp_replace("r.text", r"^\s+|\s+$", "").alias("ev_snippet"))
    return made.join(lines, ["ev_file", "ev_line"], "left").withColumn("ev_snippet", F.coalesce("ev_snippet", F.lit("")))
