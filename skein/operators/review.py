"""Diff review: changed lines to entities, tests to their targets, callees worth a mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.common import cut, is_small
from skein.functions.text import after_last
from skein.operators.traverse import impact, impact_parts
from skein.store import Graph, first_by

#: Signs of a name by which names meet.
KEY = 6
#: Comparisons a name up to which all names of a scope are compared with each other.
NEAR = 64
# Callees of no interest in a review.
NOISE_PACKAGES = "fmt errors strings log context os io bytes strconv sort sync time reflect math regexp".split()
NOISE_METHODS = "DeepCopy DeepCopyObject DeepCopyInto Patch Status Get List Create Update Delete MergeFrom StrategicMergeFrom String Error".split()


def changed_entities(entities: DataFrame, files: DataFrame, hunks: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(scope.., path, id, kind, approximate, hunks): entities a diff touches.

    ``files``: (path, status A, M, D or R), ``hunks``: (path, new_start, new_count). An entity
    reaches to the line before the next one in its file. The interval join has equality on
    the file, so it is a hash join with a range filter. Entities of added files are all there.
    """
    scope = list(scope)
    w = Window.partitionBy(*scope, "source_file").orderBy("source_line", "id")
    e = entities.select(*scope, F.col("source_file").alias("path"), "id", "kind", F.col("source_line").alias("first"), F.lead("source_line").over(w).alias("next"))
    e = e.withColumn("last", F.when(F.col("next").isNull(), 2_147_483_647).otherwise(F.greatest("first", F.col("next") - 1))).drop("next")
    modified = files.filter(F.col("status").isin("M", "R")).select(*scope, "path")
    h = hunks.join(modified, [*scope, "path"], "left_semi").withColumn("end", F.greatest("new_start", F.expr("new_start + new_count - 1")))
    hit = e.join(h, [*scope, "path"]).filter("new_start <= last and end >= first")
    near = hit.groupBy(*scope, "path", "id", "kind").agg(F.array_sort(F.collect_set(F.struct(*[c for c in ("new_start", "new_count", "old_count") if c in h.columns]))).alias("hunks")).withColumn("approximate", F.lit(True))
    added = e.join(files.filter(F.col("status") == "A").select(*scope, "path"), [*scope, "path"], "left_semi")
    added = added.select(*scope, "path", "id", "kind", F.array().cast(near.schema["hunks"].dataType).alias("hunks"), F.lit(False).alias("approximate"))
    return near.unionByName(added)


def unmapped(entities: DataFrame, files: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(scope.., path, status): source files of a diff that lead to no entity; deleted ones always."""
    scope = list(scope)
    code = files.filter(F.col("path").endswith(".go")).select(*scope, "path", "status")
    known = entities.select(*scope, F.col("source_file").alias("path")).distinct()
    return code.filter("status <> 'D'").join(known, [*scope, "path"], "left_anti").unionByName(code.filter("status = 'D'"))


def test_targets(tests: DataFrame, functions: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(scope.., test, target, reason): changed tests to changed functions.

    By name: the first function, in order, whose lower-case name holds the test's (without
    Test) or is held by it. Else all functions of the file the test file is named after.
    Both: (scope.., id, name, path, ord). Functions of scopes without tests are left out at
    once. Only sides measured to be small are broadcast, see :func:`_by_merge`.
    """
    keys = list(scope) or ["_all"]
    of = lambda df: df if scope else df.withColumn("_all", F.lit(0))
    t = cut(of(tests).select(*keys, F.col("id").alias("test"), F.lower(F.regexp_replace("name", "^Test", "")).alias("t"), F.regexp_replace("path", r"_test\.go$", "").alias("stem")))
    f = of(functions).select(*keys, F.col("id").alias("target"), F.lower("name").alias("f"), F.regexp_replace("path", r"\.go$", "").alias("stem"), "ord")
    f = cut(f.join(_measured(t.select(*keys).distinct()), keys, "left_semi"))
    best = _first_targets(t, f, keys)
    named = t.join(_by_merge(best), [*keys, "t"]).select(*keys, "test", "first.ord", "first.target")
    named = cut(first_by(named, [*keys, "test"], ["ord", "target"]).select(*keys, "test", "target"))
    same = t.join(_by_merge(named), [*keys, "test"], "left_anti").join(_by_merge(f), [*keys, "stem"])
    said = lambda df, reason: df.select(*scope, "test", "target", F.lit(reason).alias("reason"))
    return said(named, "naming convention").unionByName(said(same, "same file"))


def _first_targets(t: DataFrame, f: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., t, first (ord, target)): each test name's first function of those whose name
    holds it or is held by it.

    Distinct names meet. In a scope of few names, where that takes at most ``NEAR``
    comparisons a name, all are compared with all, inside one join on the scope. In the
    others, which are few, of two names one of which holds the other the beginning of the
    shorter is a part of the longer: names meet by equality of that, and are compared whole.
    """
    tn = t.select(*keys, "t").distinct()
    fn = f.groupBy(*keys, "f").agg(F.min(F.struct("ord", "target")).alias("first"))
    size = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(f"{c}_n"), F.collect_set(F.least(F.length(c), F.lit(KEY))).alias(f"{c}_lengths"))
    wide = cut(size(fn, "f").join(_by_merge(size(tn, "t")), keys).filter(f"t_n * f_n > {NEAR} * (t_n + f_n)").select(*keys, "t_lengths", "f_lengths"))
    few = _measured(wide)
    near = lambda df: df.join(few, keys, "left_anti")
    begin = lambda df, c: df.join(few.select(*keys), keys, "left_semi").withColumn("key", F.substring(c, 1, KEY))
    parts = lambda df, c, lengths: df.join(few, keys).select(*df.columns, F.explode(F.array_distinct(_parts(c, lengths))).alias("key"))
    some = near(fn).join(_by_merge(near(tn)), keys).filter("contains(t, f) or contains(f, t)").select(*keys, "t", "first")
    if not wide.isEmpty():
        held = begin(fn, "f").join(_by_merge(parts(tn, "t", "f_lengths")), [*keys, "key"]).filter("contains(t, f)")
        holds = parts(fn, "f", "t_lengths").join(_by_merge(begin(tn, "t")), [*keys, "key"]).filter("contains(f, t)")
        some = some.unionByName(held.select(*keys, "t", "first")).unionByName(holds.select(*keys, "t", "first"))
    return some.groupBy(*keys, "t").agg(F.min("first").alias("first"))


def _by_merge(df: DataFrame) -> DataFrame:
    """A side of a merge join, so that its join is never a broadcast by Spark's estimate: that
    counts an exploded row as one row and Parquet as long as its files, and the driver would
    hold what is many times the broadcast threshold."""
    return df.hint("merge")


def _measured(df: DataFrame) -> DataFrame:
    """A side that is broadcast if it is measured to be small, else one of a merge join."""
    return F.broadcast(df) if is_small(df) else _by_merge(df)


def _parts(name: str, lengths: str) -> F.Column:
    """The parts of a name that have one of some lengths; 0 stands for ''."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda a: F.substring(F.col(name), a, k))
    return F.flatten(F.transform(F.filter(lengths, lambda k: k <= F.length(name)), of))


def analyze(g: Graph, changed: DataFrame) -> dict[str, DataFrame]:
    """What the changed entities but tests touch, one row each: callees (id, pos, call) as
    written, callers, tests, controllers and resources (id, other, name).

    Tests are those tied to the entity, else those its blast radius reaches; controllers and
    resources are the blast radius's. All entities are walked at once. ``changed``: (id, kind).
    """
    subject = cut(changed.filter("kind <> 'test'").select("id").distinct())
    known = g.names.select(F.col("id").alias("other"), "name")
    calls = g.edges.filter("type = 'calls'").select(F.col("dst").alias("id"), F.col("src").alias("other"))
    tied = g.edges.filter("type = 'tested_by'").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    met = lambda ends: ends.join(subject, "id", "left_semi").distinct().join(known, "other").select("id", "other", "name")
    parts = impact_parts(g, impact(g, subject))
    reach = lambda name: parts[name].select(F.col("root").alias("id"), F.col("id").alias("other"), "name")
    tests = met(tied)
    return {
        "callees": g.entities.join(subject, "id", "left_semi").select("id", F.posexplode("calls").alias("pos", "call")),
        "callers": met(calls), "tests": tests.unionByName(reach("tests").join(tests.select("id"), "id", "left_anti")),
        "controllers": reach("controllers"), "resources": reach("resources"),
    }


def added_test(hunks) -> F.Column:
    """Whether all hunks add only; true without any."""
    return F.forall(hunks, lambda h: h["old_count"] == 0)


def is_noise(call: str) -> F.Column:
    """A call by a standard package, or of a method of no interest."""
    c = F.col(call)
    return (F.contains(c, F.lit(".")) & F.substring_index(c, ".", 1).isin(NOISE_PACKAGES)) | after_last(c, ".").isin(NOISE_METHODS)
