"""From files to a graph: listing, extraction on executors, and the pipeline around it."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schema
from skein.common import cut, ranked
from skein.operators import build, maintain, views
from skein.sources import golang, text
from skein.store import Graph, merged

# Folders a walk leaves out.
PRUNED = frozenset([".git", "vendor", "node_modules", "testdata"])
FILES = "path string, size long, modified timestamp, content string"
ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("warning", T.StringType()), *schema.ENTITY.fields[1:]])


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(f.name, _KINDS[f.dataType.simpleString()]) for f in ROWS.fields])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of a repository's files, dotfiles and all extensions included."""
    if not root or not os.path.isdir(root):
        raise NotADirectoryError(root or "empty path")
    rows = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in PRUNED)
        for f in sorted(files):
            at = os.path.join(folder, f)
            info = os.stat(at)
            rows.append((os.path.relpath(at, root).replace(os.sep, "/"), info.st_size, datetime.fromtimestamp(info.st_mtime, UTC)))
    return spark.createDataFrame(rows, "path string, size long, modified timestamp")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Files with their text, read on the executors (a folder all of them see)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[Path(root, p).read_text(encoding="utf-8", errors="replace") for p in b["path"]])

    return files.mapInPandas(read, FILES)


def parser_of(path: str):
    """The parser of a path by its extension, None if there is none."""
    if path.endswith("_test.go"):
        return golang.parse_tests
    suffix = path[path.rfind(".") :] if "." in path.rpartition("/")[2] else ""
    return {".go": golang.parse, ".yaml": text.parse_yaml, ".yml": text.parse_yaml, ".md": text.parse_markdown}.get(suffix)


def extract(files: DataFrame) -> DataFrame:
    """Entity rows of files (path, content), in ``path`` order by ``ord``; a file that doesn't
    parse gives one row with a warning and no id. Null contents are read as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                parser = parser_of(path)
                if parser is None:
                    continue
                try:
                    rows += [{"path": path, **e} for e in parser(path, content.as_py() or "")]
                except golang.Unparsable as e:
                    rows.append({"path": path, "warning": f"warning: failed to parse {path}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "content").mapInArrow(run, ROWS)


def scan(files: DataFrame, old: Graph | None = None, stamps: DataFrame | None = None, commits: DataFrame | None = None) -> dict:
    """A graph of files (path, size, modified, content), on top of an older scan if there is one.

    Only changed files are parsed; entities of unchanged ones, and of folders that hold some,
    are carried over. The graph is validated: ``problems`` are empty if it may be stored.
    """
    now = cut(files.select("path", maintain.second("modified").alias("modified")))  # the files may change afterwards
    fresh, kept = files, None
    if old is not None and stamps is not None:
        status = maintain.changed_files(now, stamps)
        same = status.filter("status = 'unchanged'").select("path")
        if same.limit(1).count():
            fresh = files.join(status.filter("status = 'changed'").select("path"), "path", "left_semi")
            kept = maintain.carry_over(old.entities, same)
    rows = extract(fresh).persist()
    cols = [f.name for f in schema.ENTITY.fields[1:]]
    # the order is the graph's own: function files, tests, manifests, documents
    stage = F.when(F.col("source_parser") == "go", 0).when(F.col("source_parser") == "test", 1).when(F.col("source_parser") == "yaml", 2).otherwise(3)
    made = ranked(rows.filter("id is not null").withColumn("_stage", stage), "_stage", "path", "source_line", "kind", "id", name="ord")
    made = made.withColumn("ord", F.col("ord") + 1_000_000_000).select("ord", *cols)
    every = made if kept is None else kept.select("ord", *cols).unionByName(made)
    entities = merged(every, ["id"], ["ord"]).withColumn("local_id", F.col("id"))
    if commits is not None:
        entities = maintain.enrich(entities, maintain.history(commits))
    entities = cut(entities)  # read by every edge and view
    edges = build.snippets(cut(build.edges(entities)), files)
    edges = ranked(edges.select("*", "made_at.*").drop("made_at"), "stage", "_ord", "pos", "id", name="ord").drop("stage", "_ord", "pos")
    edges = cut(edges)
    graph = Graph(entities, edges)
    warned = cut(rows.filter("warning is not null").select("path", "warning"))
    rows.unpersist()
    seen = cut(views.compile_views(graph))
    return {
        "graph": graph, "warnings": warned, "stamps": now.join(warned, "path", "left_anti"),
        "problems": maintain.validate(graph), "views": seen, "questions": views.questions(seen),
    }


def git(root: str, *args: str) -> str:
    """Output of a git command, '' if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else ""


def head(root: str) -> dict:
    return {"commit": git(root, "rev-parse", "HEAD").strip(), "branch": git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()}


def commits(spark: SparkSession, root: str) -> DataFrame:
    rows = text.parse_log(git(root, "log", "--format=%ae %at", "--name-only", "HEAD"))
    return spark.createDataFrame(rows, "seq long, author string, ts long, path string")


def read_json(spark: SparkSession, path: str) -> Graph:
    """A graph from its JSON document, with the places in its arrays as ``ord``."""
    source = "struct<parser:string,file:string,line:int>"
    lists = "files imports literals properties embeds watches calls implements".split()
    e = f"struct<id:string,name:string,kind:string,description:string,package:string,content:string,{','.join(f'{c}:array<string>' for c in lists)},env_vars:array<string>,lastAuthor:string,lastModified:string,changeCount:int,source:{source}>"
    r = "struct<id:string,`from`:string,`to`:string,type:string,confidence:string,evidence:struct<parser:string,file:string,line:int,snippet:string,reason:string>>"
    doc = spark.read.option("multiLine", True).schema(f"entities array<{e}>, relationship array<{r}>").json(path)
    from skein.store import normalise

    ents = doc.select(F.posexplode("entities").alias("ord", "e")).select(
        F.col("ord").cast("long").alias("ord"), *[F.col(f"e.{c}").alias(c) for c in ("id", "name", "kind", "description", "package", "content", *lists, "env_vars")],
        F.col("e.lastAuthor").alias("last_author"), F.col("e.lastModified").alias("last_modified"), F.col("e.changeCount").alias("change_count"),
        F.col("e.source.parser").alias("source_parser"), F.col("e.source.file").alias("source_file"), F.col("e.source.line").alias("source_line"),
    )
    edges = doc.select(F.posexplode("relationship").alias("ord", "r")).select(
        F.col("ord").cast("long").alias("ord"), "r.id", F.col("r.from").alias("src"), F.col("r.to").alias("dst"), "r.type", "r.confidence",
        *[F.col(f"r.evidence.{c}").alias(f"ev_{c}") for c in ("parser", "file", "line", "snippet", "reason")],
    )
    kind = F.when(F.col("kind").isin(schema.KINDS), F.col("kind")).otherwise("unknown")
    return Graph(normalise(ents).withColumns({"kind": kind, "local_id": F.col("id")}), normalise(edges))


def write_json(graph: Graph, path: str, header: dict | None = None) -> None:
    """The interchange document of one repository's graph, written by the driver row by row."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    names = {"last_author": "lastAuthor", "last_modified": "lastModified", "change_count": "changeCount"}

    def entity(r) -> dict:
        row = {names.get(c, c): r[c] for c in ("id", "name", "kind", *schema.TEXT[:3], *schema.ARRAYS, *names) if r[c] or c in ("id", "name", "kind")}
        return row | {"source": {"parser": r["source_parser"], "file": r["source_file"], "line": r["source_line"]}}

    def edge(r) -> dict:
        return {"id": r["id"], "from": r["src"], "to": r["dst"], "type": r["type"], "confidence": r["confidence"], "evidence": {c: r[f"ev_{c}"] for c in ("parser", "file", "line", "snippet", "reason")}}

    with open(path, "w", encoding="utf-8") as f:
        f.write("{\n" + "".join(f"\t{json.dumps(k)}: {json.dumps(v)},\n" for k, v in (header or {}).items()))
        for key, df, row, last in (("entities", graph.entities, entity, ",\n"), ("relationship", graph.edges, edge, "\n")):
            f.write(f'\t"{key}": [')
            for i, r in enumerate(df.orderBy("ord", "id").toLocalIterator()):
                f.write(("," if i else "") + "\n\t\t" + json.dumps(row(r), ensure_ascii=False))
            f.write("\n\t]" + last)
        f.write("}\n")


def write_parquet(graph: Graph, path: str) -> None:
    """A graph as two Parquet tables below a folder, written by the executors; entities lie
    together by kind, edges by type, so that readers skip what they don't ask for."""
    for name, df, by in (("entities", graph.entities, "kind"), ("relationships", graph.edges, "type")):
        df.repartitionByRange(by, "id").sortWithinPartitions(by, "id").write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str) -> Graph:
    """A graph written by :func:`write_parquet`."""
    return Graph(*(spark.read.parquet(f"{path}/{name}.parquet") for name in ("entities", "relationships")))
