"""The graph's data model: entities, evidenced relationships, and their enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())

# Kinds of entities, types of edges, confidences.
KINDS = ["operator", "controller", "crd", "function", "package", "test", "document", "resource"]
EDGE_TYPES = ["reconciles", "creates", "owns", "watches", "calls", "tested_by", "documented_in", "depends_on", "imports", "implements", "emits", "contains", "part_of", "embeds"]
CONFIDENCES = ["proven", "inferred"]

TEXT = ["description", "package", "content", "last_author", "last_modified", "source_parser", "source_file"]
MERGED = ["files", "imports", "literals", "properties", "embeds"]  # united when one id occurs again
FIRST = ["watches", "calls", "implements", "env_vars"]  # the first row's stand
ARRAYS = MERGED + FIRST

ENTITY = T.StructType(
    [T.StructField("ord", T.LongType()), *[T.StructField(c, _S) for c in ("id", "name", "kind", "description", "package", "content")], *[T.StructField(c, _A) for c in ARRAYS],
     T.StructField("last_author", _S), T.StructField("last_modified", _S), T.StructField("change_count", T.IntegerType()),
     T.StructField("source_parser", _S), T.StructField("source_file", _S), T.StructField("source_line", T.IntegerType())]
)
EDGE = T.StructType(
    [T.StructField("ord", T.LongType()), *[T.StructField(c, _S) for c in ("id", "src", "dst", "type", "confidence", "ev_parser", "ev_file")], T.StructField("ev_line", T.IntegerType()), T.StructField("ev_snippet", _S), T.StructField("ev_reason", _S)]
)
