"""Incremental scans, git history on entities, and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schema
from skein.store import Graph


def second(col) -> F.Column:
    """A timestamp as RFC 3339 text in UTC, to the second."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def changed_files(new: DataFrame, old: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(scope.., path, status): changed, unchanged or deleted, of listings (scope.., path, modified)."""
    scope = list(scope)
    a, b = new.select(*scope, "path", F.col("modified").alias("now")), old.select(*scope, "path", F.col("modified").alias("was"))
    status = F.when(F.col("_n").isNull(), "deleted").when(F.col("was").isNull() | (F.col("now") != F.col("was")), "changed").otherwise("unchanged")
    both = a.withColumn("_n", F.lit(1)).join(b, [*scope, "path"], "full_outer")
    return both.select(*scope, "path", status.alias("status"))


def carry_over(entities: DataFrame, unchanged: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Old entities that stand: of an unchanged file, or of a directory that holds one.

    ``unchanged``: (scope.., path). Directories are met by equality with the ancestors of
    unchanged paths; '.' holds all.
    """
    scope, parts = list(scope), F.split("path", "/")
    above = unchanged.select(*scope, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("source_file"))
    places = above.unionByName(unchanged.select(*scope, F.lit(".").alias("source_file"))).distinct()
    return entities.join(places, [*scope, "source_file"], "left_semi")


def history(commits: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(scope.., path, last_author, last_modified, change_count) of commits (scope.., seq,
    author, ts, path), newest first by seq."""
    return commits.groupBy(*scope, "path").agg(
        F.min_by("author", "seq").alias("last_author"), second(F.timestamp_seconds(F.min_by("ts", "seq"))).alias("last_modified"), F.count("*").cast("int").alias("change_count")
    )


def enrich(entities: DataFrame, past: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Entities with the history of their source file, where it has one."""
    cols = ["last_author", "last_modified", "change_count"]
    h = past.select(*scope, F.col("path").alias("source_file"), *[F.col(c).alias(f"_{c}") for c in cols])
    out = entities.join(h, [*scope, "source_file"], "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).drop(*[f"_{c}" for c in cols])


def validate(g: Graph) -> DataFrame:
    """(rule, subject): all problems of a graph, none if it is valid."""
    e, r = g.entities, g.edges
    ids = e.select("id").distinct()

    def rule(name: str, df: DataFrame, col: str) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), F.col(col).alias("subject"))

    twice = lambda df: df.groupBy("id").count().filter("count > 1")
    parts = [
        rule("duplicate entity", twice(e), "id"), rule("missing source file", e.filter(F.coalesce("source_file", F.lit("")) == ""), "id"),
        rule("unknown source", r.join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "id"), rule("unknown target", r.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), "id"),
        rule("duplicate edge", twice(r), "id"), rule("bad confidence", r.filter(~F.coalesce(F.col("confidence").isin(schema.CONFIDENCES), F.lit(False))), "id"),
        rule("missing evidence file", r.filter(F.coalesce("ev_file", F.lit("")) == ""), "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
