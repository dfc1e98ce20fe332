"""Source files that are no valid text of the language their name claims.

Each file's tokens are parsed with memoised derivatives (:mod:`skein.sources.derive`):
the token whose derivative is the empty language is where the file fails; a language without
the empty word at the end tells of a truncated file.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.syntax import javascript, jsonlang, python, yamllang
from skein.sources import gogrammar as golang
from skein.sources.tokens import Tokens

#: The extensions that are checked, and their languages.
LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "yaml": "yaml", "json": "json"}


def parsed(language: str, text: str):
    """(tokens, failing token): the number of tokens if truncated, None if the text is valid."""
    if language == "javascript":
        return javascript.lex(text)
    lexer = {"go": golang, "python": python, "yaml": yamllang, "json": jsonlang}[language]
    tokens = lexer.lex(text)
    return tokens, lexer.failure(tokens)


class Finding(NamedTuple):
    """What was found out about a text. ``fault``: None if it is valid, else (kind 'token' or
    'end', 1-based line, failing text), or ('unchecked', 0, '') of a text nested too deep for
    the parser. ``tree``: Python's own syntax tree where its parser could make one."""

    fault: tuple[str, int, str] | None
    tokens: Tokens | None
    tree: ast.AST | None = None


def _python(text: str) -> tuple[ast.AST | None, SyntaxError | None, bool]:
    """(tree, error, whether the parser told at all) of Python's own parser."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text), None, True
    except SyntaxError as e:
        limit = (e.msg or "").startswith("too many")  # of that parser, not of the language
        return None, None if limit else e, not limit
    except (ValueError, RecursionError, MemoryError):
        return None, None, False


def _json(text: str) -> bool:
    """Whether the standard library reads a text that the grammar rejects."""
    try:
        json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        return True
    except (ValueError, RecursionError):
        return False


def examine(language: str, text: str) -> Finding:
    """Parse a text with derivatives; where the language has a parser here, it confirms."""
    tree = error = None
    told = False
    if language == "python":
        tree, error, told = _python(text)
    try:
        tokens, at = parsed(language, text)
    except RecursionError:
        fine = tree is not None or language == "json" and _json(text)
        return Finding(None if fine else ("unchecked", 0, ""), None, tree)
    if at is None and error is not None:  # the grammar is looser than Python's own
        line, lines = error.lineno or 1, text.split("\n")
        near = lines[line - 1][max(0, (error.offset or 1) - 1) :] if line <= len(lines) else ""
        return Finding(("token", line, near[:20]), tokens)
    if at is None or told and tree is not None or language == "json" and _json(text):
        return Finding(None, tokens, tree)
    if at >= len(tokens.kinds):
        return Finding(("end", text.count("\n") + 1, ""), tokens)
    place = tokens.starts[at]
    return Finding(("token", text.count("\n", 0, place) + 1, text[place : place + 20]), tokens)


def check(language: str, text: str) -> tuple[str, int, str] | None:
    """The fault of a text, None of a valid one; see :class:`Finding`."""
    return examine(language, text).fault


def language_of(path) -> F.Column:
    """The language of a path's extension; null if it isn't one that is checked."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.regexp_extract(F.lower(path), r"\.([a-z]+)$", 1))


_SCHEMA = "file_id long, repo string, language string, broken boolean, fails_at string, line long, near string"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, repos, languages = batch.column(0), batch.column(1), batch.column(2)
        found = [check(g, t) for g, t in zip(languages.to_pylist(), (x.as_py() for x in batch.column(3)))]
        yield pa.RecordBatch.from_arrays(
            [keys, repos, languages, pa.array([None if f and f[0] == "unchecked" else f is not None for f in found], pa.bool_()),
             pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.int64()), pa.array([f and f[2] for f in found], pa.string())],
            names=["file_id", "repo", "language", "broken", "fails_at", "line", "near"],
        )


def checked(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, broken, fails_at, line, near), one row a file and content.

    Files of other extensions and files without content (null) are left out; an empty file
    is valid or not as its language has it. Whole files are parsed; one nested too deep to
    be parsed has no ``broken`` (null) and fails_at 'unchecked'. Rows delivered again
    give one row.
    """
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), "repo", language_of("path").alias("language"), "content").filter("language is not null and content is not null")
    return rows.mapInArrow(_check, _SCHEMA).distinct()


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_broken, rate): broken files by repository and language, of
    those that could be checked."""
    once = checked(files).filter("broken is not null").groupBy("file_id", "repo", "language").agg(F.max("broken").alias("broken"))
    out = once.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.sum(F.col("broken").cast("long")).alias("n_broken"))
    return out.withColumn("rate", F.col("n_broken") / F.col("n_files"))
