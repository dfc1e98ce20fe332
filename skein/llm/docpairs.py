"""Functions with their documentation: code-description pairs from source files.

Files that parse (:mod:`skein.llm.broken`) become syntax trees: Python's own for Python, a
tree of brackets over the tokens for Go and JavaScript, in which function nodes are visited
with their exact source ranges. Documentation is the comment that ends right above, or the
docstring; pairs whose documentation says nothing are dropped.
"""

from __future__ import annotations

import ast
import bisect
import inspect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import broken
from skein.llm.broken import language_of
from skein.llm.syntax import javascript
from skein.sources.tokens import Tokens

LEAST_WORDS = 4


class Function(NamedTuple):
    name: str
    line: int  # of the keyword, or of the name where there is none
    start: int  # character range of the whole function
    end: int
    doc: str  # raw comment or docstring, '' if there is none


class Tree:
    """Bracket structure of a token stream: the partner of every bracket, lines of places."""

    def __init__(self, tokens: Tokens):
        self.t = tokens
        self.partner: dict[int, int] = {}
        stack = []
        for i, k in enumerate(tokens.kinds):
            if k in ("(", "[", "{"):
                stack.append(i)
            elif k in (")", "]", "}") and stack:
                j = stack.pop()
                self.partner[i], self.partner[j] = j, i
        self.breaks = [m.start() for m in re.finditer("\n", tokens.text)]
        # a comment is a lead comment if nothing but blanks stands before it on its line
        self.by_end: dict[int, tuple[int, int, int]] = {}
        for a, b in tokens.comments:
            first = self.line(a)
            begin = self.breaks[first - 2] + 1 if first > 1 else 0
            if not tokens.text[begin:a].strip("﻿ \t\r\v\f"):
                self.by_end[self.line(max(a, b - 1))] = (first, a, b)

    def line(self, place: int) -> int:
        return bisect.bisect_left(self.breaks, place) + 1

    def doc_above(self, line: int) -> str:
        """The comments that end on the line above, and those right above them."""
        parts = []
        while (found := self.by_end.get(line - 1)) is not None:
            line = found[0]
            parts.append(self.t.text[found[1] : found[2]])
        return "\n".join(reversed(parts))


def go_functions(tree: Tree) -> Iterator[Function]:
    t, kinds = tree.t, tree.t.kinds
    i, n = 0, len(kinds)
    while i < n:
        k = kinds[i]
        if k in ("(", "[", "{"):
            i = tree.partner.get(i, n) + 1
            continue
        if k == "func" and (i == 0 or kinds[i - 1] == ";"):
            j = i + 1
            if j < n and kinds[j] == "(":  # the receiver
                j = tree.partner[j] + 1
            name = j
            j += 1
            while j < n and kinds[j] != ";":
                if kinds[j] in ("(", "[") or kinds[j] == "{" and kinds[j - 1] in ("struct", "interface"):
                    j = tree.partner[j] + 1
                elif kinds[j] == "{":
                    end = tree.partner[j]
                    line = tree.line(t.starts[i])
                    yield Function(t.word(name), line, t.starts[i], t.ends[end], tree.doc_above(line))
                    j = end
                    break
                else:
                    j += 1
            i = j
        i += 1


_LEADING = frozenset(["export", "default", "async", "static", "const", "let", "var", "get", "set", "*"])
_WORDS = javascript.RESERVED | javascript.CONTEXTUAL | {"NAME", "PRIVATE", "STR"}
_CONTROL = frozenset(["if", "for", "while", "switch", "catch", "with", "function", "return", "super", "this", "import", "new", "typeof", "await", "yield", "delete", "void", "do", "else"])


def js_functions(tree: Tree) -> Iterator[Function]:
    t, kinds = tree.t, tree.t.kinds
    n = len(kinds)
    classes = set()  # opening braces of class bodies
    for i, k in enumerate(kinds):
        if k == "class" and (i == 0 or kinds[i - 1] not in (".", "?.")) and not (i + 1 < n and kinds[i + 1] in (":", "=", ",", "(")):
            j = i + 1
            while j < n and kinds[j] != "{":
                j = tree.partner[j] + 1 if kinds[j] in ("(", "[") else j + 1
            classes.add(j)
    inside: list[int] = []

    def found(name: int, keyword: int, body: int) -> Function:
        first = min(name, keyword)
        line = tree.line(t.starts[keyword])
        while first > 0 and kinds[first - 1] in _LEADING and tree.line(t.starts[first - 1]) == tree.line(t.starts[first]):
            first -= 1
        return Function(t.word(name).strip("\"'"), line, t.starts[first], t.ends[tree.partner[body]], tree.doc_above(tree.line(t.starts[first])))

    def body_after(params: int) -> int | None:
        close = tree.partner.get(params)
        return close + 1 if close is not None and close + 1 < n and kinds[close + 1] == "{" else None

    for i, k in enumerate(kinds):
        if k in ("(", "[", "{"):
            inside.append(i)
        elif k in (")", "]", "}") and inside:
            inside.pop()
        if k == "function" and (i == 0 or kinds[i - 1] not in (".", "?.")):
            j = i + 1 + (i + 1 < n and kinds[i + 1] == "*")
            if j + 1 < n and kinds[j] in _WORDS and kinds[j + 1] == "(":
                if (body := body_after(j + 1)) is not None:
                    yield found(j, i, body)
            elif j < n and kinds[j] == "(" and (name := _assigned(kinds, i)) is not None:
                if (body := body_after(j)) is not None:
                    yield found(name, i, body)
        elif k == "=>":
            body = i + 1
            start = tree.partner[i - 1] if kinds[i - 1] == ")" else i - 1
            if (name := _assigned(kinds, start)) is not None and body < n and kinds[body] == "{":
                yield found(name, name, body)
        elif k in _WORDS and k not in _CONTROL and i + 1 < n and kinds[i + 1] == "(" and inside and kinds[inside[-1]] == "{":
            if i > 0 and kinds[i - 1] in (".", "?.", "function", "new", "*") and not (kinds[i - 1] == "*" and (i < 2 or kinds[i - 2] in ("{", "}", ",", ";", "static", "async"))):
                continue
            body = body_after(i + 1)
            if body is not None and (inside[-1] in classes or kinds[i - 1] in ("{", ",", "get", "set", "async", "*")):
                yield found(i, i, body)


def _assigned(kinds: list[str], start: int) -> int | None:
    """The name a function expression that starts there is given: ``name =`` or ``name:``."""
    j = start - 1
    if j >= 0 and kinds[j] == "async":
        j -= 1
    if j >= 1 and kinds[j] in ("=", ":") and kinds[j - 1] in _WORDS:
        return j - 1
    return None


def python_functions(tree: ast.AST, text: str) -> Iterator[Function]:
    lines = re.split(r"(?<=\n)", text)
    offsets = [0]
    for row in lines:
        offsets.append(offsets[-1] + len(row))
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            start = _place(lines, offsets, node.lineno, node.col_offset)
            end = _place(lines, offsets, node.end_lineno, node.end_col_offset)
            yield Function(node.name, node.lineno, start, end, ast.get_docstring(node, clean=True) or "")


def python_functions_by_tokens(tokens: Tokens) -> Iterator[Function]:
    """Functions of a valid file that is beyond the limits of Python's own parser."""
    t, kinds, tree = tokens, tokens.kinds, Tree(tokens)
    for i, k in enumerate(kinds):
        if k != "def":
            continue
        j = i + 2
        while kinds[j] != ":":
            j = tree.partner[j] + 1 if kinds[j] in ("(", "[", "{") else j + 1
        body, depth, end = j + 1, 0, j + 1
        if kinds[body] == "NEWLINE":
            body, end = body + 2, body + 1
            while True:
                depth += (kinds[end] == "INDENT") - (kinds[end] == "DEDENT")
                if not depth:
                    break
                end += 1
        else:
            while kinds[end] != "NEWLINE":
                end += 1
        last, doc = body, ""
        while kinds[last] == "STR":
            last += 1
        if last > body and kinds[last] in ("NEWLINE", ";"):
            value = ast.literal_eval("(" + " ".join(map(t.word, range(body, last))) + ")")
            doc = inspect.cleandoc(value) if isinstance(value, str) else ""
        while t.starts[end - 1] == t.ends[end - 1] or kinds[end - 1] == "NEWLINE":
            end -= 1
        first = i - (i > 0 and kinds[i - 1] == "async")
        yield Function(t.word(i + 1), tree.line(t.starts[first]), t.starts[first], t.ends[end - 1], doc)


def _place(lines: list[str], offsets: list[int], line: int, column: int) -> int:
    """Character offset of a line and a column in bytes."""
    return offsets[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))


def unified(text: str) -> str:
    """The text with line feeds for all line ends, as Python's places count."""
    return text.replace("\r\n", "\n").replace("\r", "\n")


def functions(language: str, text: str) -> list[Function]:
    """All named functions and methods with a body; none of a file that is no valid text of
    its language, as :func:`skein.llm.broken.examine` has it."""
    found = broken.examine(language, text)
    if found.fault is not None:
        return []
    if language != "python":
        return list((go_functions if language == "go" else js_functions)(Tree(found.tokens)))
    plain = unified(text)
    if plain != text:
        found = broken.examine(language, plain)  # places are told of this text
    if found.tree is not None:
        return list(python_functions(found.tree, plain))
    return list(python_functions_by_tokens(found.tokens)) if found.fault is None else []


# What is no prose in documentation.
_TODO = re.compile(r"(?:to-?do|fixme|xxx|hack|tbd|wip)\b", re.I)
_TAG = re.compile(r"@\w+|[:\\](?:param|type|returns?|rtype|raises?|arg|see|since)\b|(?:args?|arguments|params?|parameters|returns?|yields?|raises?|throws|see|since|author|version|examples?|notes?)\s*:\s*$|-{3,}", re.I)
_DIRECTIVE = re.compile(
    r"(?:go:\w|nolint\b|lint:|\+build\b|export \w+$|line \S+:\d|eslint\b|eslint-|jshint\b|jslint\b|tslint:|prettier-|istanbul\b|c8 ignore|@ts-|ts-|biome-|webpack\w*:|noqa\b|pylint:|type:\s*ignore|mypy:|pyright:|flake8\b|fmt:\s*(?:on|off)|isort:|pragma\b|coding[:=]|-\*-|nosec\b|nosonar\b|region\b|endregion\b|#__|sourceMappingURL|spell-?checker|cspell|global \w|\w+-(?:disable|enable|ignore)\b)",
    re.I,
)
_CODE = re.compile(
    r"^(?://|#\s|/\*)|:=|[;{}]\s*$|^[)\]}]+[,;]?$|^>>>|^\.\.\.|=>|===?|!=|&&|\|\||\+=|-=|->"
    r"|^(?:func|def|class|return|import|package|const|let|var|if|for|while|switch|case|else|elif|except|try|async|await|export|function|type|defer|go|raise|from)\b(?=.*[()\[\]{}=:;]\s*$|.*\w\()"
    r"|^return(?:\s+[\w.()\"']+)?;?$|^\w[\w.\[\]\"']*\s*=\s*\S|^[\w.]+\([^)]*\);?$|^(?:import|package)\s+[\w.\"/]+;?$|^(?:else|try|pass|break|continue):?;?$"
)
_SECTION = re.compile(r"(?:args|arguments|parameters|params|returns?|yields?|raises|attributes|keyword args)\s*:", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_QUALIFIED = re.compile(r"(?<![\w.])(?:\w{1,60}\.){1,3}\w+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def prose(doc: str, name: str, docstring: bool = False) -> list[str]:
    """The lines of a documentation that are prose, without comment marks."""
    out, fenced, section = [], False, False
    for raw, inner in (((x, True) for x in doc.split("\n")) if docstring else _uncommented(doc)):
        line = raw.strip()
        if docstring and _SECTION.fullmatch(line):
            section = True
            continue
        if section and (not line or not raw.startswith((" ", "\t"))):
            section = section and not line
        if section and re.match(r"[*\w]+(?:\s*\([^)]*\))?:", line):
            continue
        if line.startswith("```"):
            fenced = not fenced
            continue
        if fenced or not line or not re.search(r"[^\W\d_]", line):
            continue
        if _TODO.match(line) or _TAG.match(line) or _DIRECTIVE.match(line) or _CODE.search(line):
            continue
        if not docstring and (raw.startswith("\t") or raw.startswith("    ")) and re.search(r"[=(){};]", line):
            continue  # an indented example
        out.append(line)
    return out


def _uncommented(doc: str) -> Iterator[tuple[str, bool]]:
    """The lines of comments without their marks, and whether each stood inside a block."""
    block = False
    for line in doc.replace("\r", "").split("\n"):
        s = line.strip()
        if not block and s.startswith("//"):
            yield s[2:].removeprefix("/").removeprefix("!") if s.startswith(("///", "//!")) else s[2:], False
            continue
        if not block and s.startswith("/*"):
            block, line, s = True, s[2:].lstrip("*!"), s[2:].lstrip("*!")
        if block:
            if s.rstrip().endswith("*/"):
                block, s = False, s.rstrip()[:-2].rstrip("*")
                line = s
            star = re.match(r"\s*\*(?!\w)\s?", line)
            yield (line[star.end() :] if star else line), True


def words(lines: list[str], name: str) -> list[str]:
    """Words of prose, without the function's own name; of scripts without spaces, the signs."""
    own = {name.lower(), name.lower() + "s"}
    text = " ".join(lines)
    if name and name in text:
        if name.isidentifier():  # with what qualifies it; alone it is left out below
            text = _QUALIFIED.sub(lambda m: " " + m[0].rpartition("." + name)[2] if name in m[0].split(".")[1:4] else m[0], text)
        else:
            text = re.sub(r"(?<![\w.])(?:\w{1,60}\.){0,3}" + re.escape(name) + r"\b(?:\(\))?", " ", text)
    wide = _WIDE.findall(text)
    return [w for w in _WORD.findall(_WIDE.sub(" ", text)) if w.lower() not in own] + wide


def is_real(doc: str, name: str, docstring: bool = False) -> bool:
    return bool(doc) and len(words(prose(doc, name, docstring), name)) >= LEAST_WORDS


_SCHEMA = "file_id long, name string, line long, language string, description string, source string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, language, content in zip(*(batch.column(i) for i in range(3))):
            text, language = content.as_py(), language.as_py()
            found = functions(language, text)
            text = unified(text) if language == "python" else text
            for f in found:
                if is_real(f.doc, f.name, language == "python"):
                    rows.append((key.as_py(), f.name, f.line, language, "\n".join(prose(f.doc, f.name, language == "python")), text[f.start : f.end]))
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file_id", "name", "line", "language", "description", "source"])


def pairs(files: DataFrame) -> DataFrame:
    """(file_id, name, line, language, description, source) of documented functions.

    Go, Python and JavaScript files by extension; files without content (null) and those
    that don't parse give none. Rows delivered again give one row.
    """
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), language_of("path").alias("language"), "content").filter("language in ('go', 'python', 'javascript') and content is not null")
    return rows.mapInArrow(_extract, _SCHEMA).dropDuplicates(["file_id", "name", "line"])
