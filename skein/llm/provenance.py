"""Generated, minified, vendored and data files among source files.

Re-Pair grammars over token sequences (:mod:`skein.llm.repair`) decide. In a file's own
grammar, over kinds of tokens, a rule that covers most of the file and a grammar far smaller
than the file show the regularity of a tool's output; literals that are nearly incompressible
for their alphabet show a data table. Files of different repositories that share a long run
of tokens get one joint grammar over exact tokens; a file covered by long rules that stand in
several repositories is a copy of third-party code, patched or not.

Header comments, third-party folders and keys of lock files only nominate: a file that says it
was generated needs less regularity, a package below a third-party folder or a file that says
whom it comes from needs fewer and shorter shared rules. Only minified files are told by the
shape of their lines.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.common import broadcast_if_small, cut
from skein.llm import repair
from skein.llm.broken import language_of
from skein.llm.syntax import javascript, jsonlang, python, yamllang
from skein.sources import gogrammar as golang
from skein.sources.tokens import Tokens

#: A tool's output: share of the file under one rule, grammar size to the root of the length.
COVER, SIZE, LEAST_TOKENS = 0.6, 5.7, 60
#: With a header or a key that says so, less regularity will do.
MARKED_COVER, MARKED_SIZE, LEAST_SAID = 0.45, 7.0, 12
#: Data: share of the text in literals, their bits a sign to those of random signs.
DATA_SHARE, DATA_BITS, DATA_LEAST = 0.55, 0.86, 150
#: Copies: tokens of a shared run, of a rule that counts, share of the file under such rules.
RUN, WINNOW, LONG, COPIED = 48, 12, 40, 0.5
SMALLEST_COPY = 22
#: The same of what is nominated as third-party code, a package's files together.
FINE, FINE_WINNOW, FINE_LONG, FINE_COPIED = 24, 8, 20, 0.2
#: Files too short for such runs: tokens of their runs, part (one in so many) of the runs a
#: candidate has, share of the file. Half a short file may be idioms, so nearly all must be there.
SHORT, SHORT_WINNOW, SHORT_SHARED, SHORT_COPIED = 8, 4, 3, 0.8
#: Files that share one joint grammar.
BLOCK = 48

# What headers of tools and of third parties say, in the languages of the corpus.
_TOOL = re.compile(
    r"\b(?:auto|code|machine)?-?(?:generated|erzeugt|generiert|généré|generado|gerado|gegenereerd)\b|@generated\b|\b(?:produced|emitted|written|created) (?:automatically|by)\b|\bautomatically (?:created|produced|written)\b"
    r"|\bdo(?: not|n't) (?:edit|modify|change)\b|\bchanges will be (?:lost|overwritten)\b",
    re.I,
)
_COPIED = re.compile(r"\b(?:copied|imported|vendored|forked|adapted|ported|taken) from \S+|\b(?:local )?fork of \S+|\bupstream (?:changes|version|source)\b|\bsee LICENSE\.\w+", re.I)
_HOLDER = re.compile(r"\bcopyright\b[\s:]*(?:\(c\)|©)?\s*(?:\d{4}(?:\s*[-,–]\s*\d{4})*,?\s*)?(?:by\s+)?(?:the\s+)?(.{2,60}?)(?:\s+(?:authors|contributors|maintainers|developers|project)\b|[.,;]|\s*$)", re.I)
_THIRD = frozenset(["third_party", "thirdparty", "3rdparty", "node_modules", "vendor", "external", "deps", "bower_components", "pods", "_vendor", "vendored"])
_STAMP = re.compile(r"^\s*[\w.-]*-?gen[\w.]*(?:\.[\w.-]+)?/version\s*:", re.M)
_ENCODED = re.compile(r"(?=.*[0-9+/=\\])[A-Za-z0-9+/=_\\-]{16,}")
_LOCK = re.compile(r'"(?:lockVersion|lockfileVersion)"\s*:')

_LEX = {"go": golang.lex, "python": python.lex, "yaml": yamllang.lex, "json": jsonlang.lex, "javascript": lambda t: javascript.lex(t)[0]}
_LITERAL = frozenset(["STR", "NUM", "CHR", "TFULL", "SCALAR"])


def header(language: str, text: str) -> list[str]:
    """The comment lines before the first line of code."""
    out, mark, block = [], "#" if language in ("python", "yaml") else "//", False
    for line in text.replace("\r", "").split("\n"):
        s = line.strip().lstrip("﻿")
        if block or s.startswith("/*"):
            out.append(s.strip("/* "))
            block = not s.endswith("*/")
        elif s.startswith(mark) or s.startswith("#!"):
            out.append(s.lstrip("/#!; "))
        elif s:
            break
    return out


def _comment_lines(tokens: Tokens) -> list[str]:
    return [tokens.text[a:b].strip("/#* \r\n") for a, b in tokens.comments]


def regularity(kinds: list[str], most: float = math.inf) -> tuple[float, float]:
    """(share of the sequence under the rule that covers most, grammar size to its root); (0,
    infinity) as soon as it is certain that the size is above ``most``."""
    ids: dict[str, int] = {}
    g = repair.infer([ids.setdefault(k, len(ids)) for k in kinds], limit=most * math.sqrt(max(1, len(kinds))))
    if g is None:
        return 0.0, math.inf
    n = len(kinds)
    cover = max((g.uses[r] * g.lengths[r] for r in g.rules), default=0) / max(1, n)
    return cover, (len(g.sequence) + 2 * len(g.rules)) / math.sqrt(max(1, n))


def randomness(literals: list[str]) -> float:
    """Bits a sign of the literals, compressed, to those of random signs of their alphabet."""
    text = "".join(literals)
    signs = set(text)
    if len(text) < DATA_LEAST or len(signs) < 4:
        return 0.0
    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    size = len(packed.compress(text.encode()) + packed.flush())
    return 8 * (size - 20) / (len(text) * math.log2(len(signs)))


def _data_literals(tokens: Tokens) -> list[str]:
    out = []
    for k, a, b in zip(tokens.kinds, tokens.starts, tokens.ends):
        if k in _LITERAL:
            s = tokens.text[a:b].strip("\"'`")
            if k == "NUM":
                s = s[2:] if s[:2].lower() == "0x" else s
            elif not _ENCODED.fullmatch(s):
                continue  # prose, names and paths
            out.append(s)
    return out


def package_of(path: str) -> str | None:
    """The folder of the third-party package a path lies in: the one below a third-party folder."""
    parts = path.split("/")
    at = next((i for i, p in enumerate(parts[:-2]) if p.lower() in _THIRD), None)
    return None if at is None else "/".join(parts[: at + 2])


def holder_of(head: list[str]) -> str | None:
    """Who holds the copyright, as a header has it."""
    found = next((m for x in head if (m := _HOLDER.search(x))), None)
    return found[1].strip().lower() if found else None


def verdict(language: str, text: str) -> tuple[str | None, Tokens, list[str]]:
    """(kind of a file that is not hand-written by its own evidence, its tokens, its header)."""
    tokens = _LEX[language](text)
    kinds, head = tokens.kinds, header(language, text)
    n, size = len(kinds), max(1, len(text))
    said = any(map(_TOOL.search, head)) or language == "yaml" and bool(_STAMP.search(text)) or language == "json" and bool(_LOCK.search(text))
    if not said:  # hashes fill lock files
        literals = _data_literals(tokens)
        held = sum(map(len, literals)) / size
        spread = sum(4 if k == "NUM" else 2 for k in kinds if k in _LITERAL) / size  # marks around and between them
        if held + spread >= DATA_SHARE and randomness(literals) >= DATA_BITS:
            return "data", tokens, head
    if language == "javascript" and n >= LEAST_TOKENS:
        lines = text.count("\n") + 1
        blanks = sum(map(text.count, " \n\t\r")) / size
        if n / lines > 30 and blanks < 0.15 or n / lines > 60:
            return "minified", tokens, head
    if n >= LEAST_SAID if said else n >= LEAST_TOKENS and language not in ("yaml", "json"):  # lists and tables are regular by hand too
        most = MARKED_SIZE if said else SIZE
        cover, grammar = regularity(kinds, most)
        if cover >= (MARKED_COVER if said else COVER) and grammar <= most:
            return "generated", tokens, head
    return None, tokens, head


def _exact(tokens: Tokens) -> np.ndarray:
    """Hashes of the tokens as they are written; line ends and comments aside."""
    t, h = tokens.text, xxhash.xxh64_intdigest
    return np.fromiter((h(t[a:b]) if b > a else h(k) for k, a, b in zip(tokens.kinds, tokens.starts, tokens.ends) if k not in (";", "NEWLINE", "INDENT", "DEDENT")), np.uint64)


def fingerprints(exact: np.ndarray) -> np.ndarray:
    """Hashes of runs of ``RUN`` tokens, a winnowed choice; of the whole of a shorter file."""
    n = len(exact)
    if n < SMALLEST_COPY:
        return np.empty(0, np.int64)
    if n <= RUN + WINNOW:
        return np.array([xxhash.xxh64_intdigest(exact.tobytes())], np.uint64).view(np.int64)
    return _winnowed(exact, RUN, WINNOW)


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _winnowed(exact: np.ndarray, run: int, window: int) -> np.ndarray:
    """Of every ``window`` neighbouring runs the one of the least hash; all runs of a shorter text."""
    n = len(exact)
    if n < run:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        # a run's polynomial is a difference of prefix sums, brought back to its first place
        power, back = np.full(n, _BASE, np.uint64), np.full(n, _UNBASE, np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(exact * power, dtype=np.uint64)])
        h = (sums[run:] - sums[:-run]) * back[: n - run + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    if len(h) > window:
        h = h[np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1) + np.arange(len(h) - window + 1)]
    return np.unique(h).view(np.int64)


_FIRST = "file_id long, repo string, kind string, package string, holder string, says boolean, prints array<long>, whole long, fine array<long>, short array<long>, size long"
_FIRST_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.empty(0, np.int64)
    for batch in batches:
        out = [[] for _ in _FIRST_KINDS]
        for key, repo, path, language, content in zip(*(batch.column(i) for i in range(5))):
            language, text = language.as_py(), content.as_py()
            kind, tokens, head = verdict(language, text)
            package, says, holder = package_of(path.as_py() or ""), any(map(_COPIED.search, head)), holder_of(head)
            prints, whole, fine, short, size = none, 0, none, none, 0
            # a text that is no code of its language is compared only if something nominates it
            code = "BAD" not in tokens.kinds and text.lstrip()[:1] != "<"
            if kind is None and language in ("go", "python", "javascript") and (code or says or package):
                exact = _exact(tokens)
                whole, size = xxhash.xxh64_intdigest(exact.tobytes()) - (1 << 63), len(exact)
                if size >= SMALLEST_COPY:
                    prints, fine = fingerprints(exact), _winnowed(exact, FINE, FINE_WINNOW)
                    if size <= RUN + WINNOW or package or says or holder:  # short files, and what may be nominated
                        short = _winnowed(exact, SHORT, SHORT_WINNOW)
            for column, x in zip(out, (key.as_py(), repo.as_py() or "", kind, package, holder, says, prints, whole, fine, short, size)):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _FIRST_KINDS)], names=[f.split()[0] for f in _FIRST.split(", ")])


def copied(sequences: list[list[int]], repos: list[set[str]], long: int = LONG) -> list[list[tuple[int, int]]]:
    """Spans of each sequence under rules of a joint grammar that are long and stand in
    sequences of several repositories. A sequence of several repositories is a copy itself."""
    words: dict[int, int] = {}
    joint, owners = [], []
    for s in sequences:
        joint += [words.setdefault(x, len(words)) for x in s]
        owners.append(len(s))
    border = len(words)
    text, at = [], 0
    for k, n in enumerate(owners):
        text += joint[at : at + n]
        text.append(border + k)  # stands once, so no rule crosses it
        at += n
    g = repair.infer(text)
    parts: list[list[int]] = [[]]
    for s in g.sequence:
        if border <= s < border + len(owners) and s not in g.rules:
            parts.append([])
        else:
            parts[-1].append(s)
    stands: dict[int, set[str]] = defaultdict(set)
    for symbols, names in zip(parts, repos):
        stack, seen = list(symbols), set()
        while stack:
            s = stack.pop()
            if s in g.rules and s not in seen:
                seen.add(s)
                stands[s] |= names
                stack += g.rules[s]
    out = []
    for symbols, n, names in zip(parts, owners, repos):
        if len(names) > 1:
            out.append([(0, n)])
            continue
        spans, at, stack = [], 0, symbols[::-1]
        while stack:
            s = stack.pop()
            if s in g.rules and g.lengths[s] > long and len(stands[s]) == 1:
                stack += g.rules[s][::-1]
                continue
            size = g.lengths.get(s, 1)
            if s in g.rules and size >= min(long, n) and len(stands[s]) > 1:
                if spans and spans[-1][1] == at:
                    at, size = spans[-1][0], size + at - spans.pop()[0]
                spans.append((at, at + size))
            at += size
        out.append(spans)
    return out


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        exact = [_exact(_LEX[g](t.as_py())).view(np.int64) for g, t in zip(batch.column(1).to_pylist(), batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.list_(pa.int64()))], names=["whole", "exact"])


def _joint(rows: pd.DataFrame) -> pd.DataFrame:
    # one sequence for each content; copies within a block count by their repositories
    rows = rows.drop_duplicates("whole").sort_values("whole", kind="stable")
    sequences = [x.tolist() for x in rows["exact"]]
    fine = bool(rows["fine"].iloc[0])
    spans = copied(sequences, [{low, high} for low, high in zip(rows["low"], rows["high"])], FINE_LONG if fine else LONG)
    out = [(w, fine, *span) for w, some in zip(rows["whole"], spans) for span in some]
    return pd.DataFrame(out, columns=["whole", "fine", "start", "stop"])


def _beside(rows: pd.DataFrame) -> pd.DataFrame:
    # a short content beside each of its candidates: one source must hold it, not idioms of many
    itself = rows["other"] == rows["whole"]
    own, whole = rows["exact"][itself].iloc[0].tolist(), rows["whole"].iloc[0]
    out = []
    for other, exact in zip(rows["other"][~itself], rows["exact"][~itself]):
        mine, theirs = copied([own, exact.tolist()], [{"a"}, {"b"}], SHORT)
        if sum(b - a for a, b in mine) >= SHORT_COPIED * len(own):
            out += [(whole, True, a, b) for a, b in mine] + [(other, False, a, b) for a, b in theirs]
    return pd.DataFrame(out, columns=["whole", "held", "start", "stop"])


def candidates(contents: DataFrame) -> DataFrame:
    """(whole, other): short contents and the contents nominated as third-party code, of
    another repository, that have at least a third of their short runs.

    Short hand-written files of two repositories are often alike, so likeness alone is no
    evidence for them; to what its folder or header nominates it is. Whoever has a third of k
    runs has one of the k - ceil(k / 3) + 1 rarest; only these are joined.
    """
    runs = contents.filter("nominated").select(F.col("whole").alias("other"), F.explode("short").alias("print"))
    mine = contents.filter(f"size <= {RUN + WINNOW}").select("whole", F.size("short").alias("k"), F.explode("short").alias("print"))
    runs = cut(runs.join(mine.select("print").distinct(), "print", "left_semi"))
    counts = runs.groupBy("print").count()
    rare = Window.partitionBy("whole").orderBy("count", "print")
    first = mine.join(counts, "print").withColumn("i", F.row_number().over(rare)).filter(f"i <= k - ceil(k / {SHORT_SHARED}) + 1")
    pairs = first.join(runs, "print").select("whole", "other").distinct()
    both = pairs.join(contents.select("whole", "short", "low", "high"), "whole").join(contents.select(F.col("whole").alias("other"), F.col("short").alias("theirs"), F.col("low").alias("low2"), F.col("high").alias("high2")), "other")
    apart = "whole <> other and not (low = high and low2 = high2 and low = low2)"
    return both.filter(apart).filter(f"{SHORT_SHARED} * size(array_intersect(short, theirs)) >= size(short)").select("whole", "other")


def blocks_of(placed: DataFrame) -> DataFrame:
    """(block, fine, whole): the contents that get one joint grammar. ``placed``: whole, low,
    high, print, fine.

    A block holds the contents of a print. Those of many contents are spread by their hash,
    and every part also gets the contents of the least and of the greatest repository, so
    what stands in another repository does so in each part. Equal blocks are one.
    """
    key = ["fine", "print"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("low", "whole"))["whole"].alias("first"), F.max(F.struct("high", "whole"))["whole"].alias("last"))
    spread = placed.select("whole", *key).join(sizes, key).withColumn("part", F.expr(f"pmod(xxhash64(whole), cast(ceil(n / {BLOCK}) as int))"))
    parts = spread.groupBy(*key, "part").agg(F.collect_set("whole").alias("inside"), F.first("first").alias("first"), F.first("last").alias("last"))
    members = parts.select("fine", F.array_sort(F.array_union("inside", F.array("first", "last"))).alias("members")).distinct()
    return members.select(F.xxhash64("fine", "members").alias("block"), "fine", F.explode("members").alias("whole"))


#: Length of the union of spans sorted by their start.
_UNION = "aggregate(array_sort({}), named_struct('sum', 0L, 'end', 0L), (a, x) -> named_struct('sum', a.sum + greatest(0L, x.stop - greatest(x.start, a.end)), 'end', greatest(a.end, x.stop)), a -> a.sum)"


def nominated(judged: DataFrame) -> DataFrame:
    """(file_id, package) of what may be third-party code: the files of a package below a
    third-party folder, and alone those whose header names a source or another holder of the
    copyright than most of their repository's files do."""
    held = judged.filter("holder is not null").groupBy("repo", "holder").count()
    own = held.groupBy("repo").agg(F.max_by("holder", F.struct("count", "holder")).alias("own"))
    said = judged.join(broadcast_if_small(cut(own)), "repo", "left").select("file_id", "repo", "package", (F.col("says") | F.coalesce(F.col("holder") != F.col("own"), F.lit(False))).alias("says"))
    named = F.when(F.col("package").isNotNull(), F.concat_ws("\x01", "repo", "package")).when(F.col("says"), F.concat(F.lit("\x02"), F.coalesce(F.col("file_id").cast("string"), F.lit(""))))
    return said.select("file_id", named.alias("package")).filter("package is not null").distinct()


def classify(files: DataFrame) -> DataFrame:
    """(file_id, kind) of the files that are not hand-written.

    ``kind``: generated (by a tool, lock files and compiled modules included), minified,
    data or vendored. Go, Python, JavaScript, YAML and JSON files by extension, whole; files
    without content (null or empty) have no row. Rows delivered again give one row. Nothing
    is vendored that shares no rule with another repository.
    """
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", language_of("path").alias("language"), "content").filter("language is not null and length(content) > 0")
    judged = cut(rows.mapInArrow(_judge, _FIRST))
    own = judged.filter("kind is not null").select("file_id", "kind")
    packages = cut(nominated(judged))

    # one row a content, with two of its repositories; its runs stay where they were written
    open_ = judged.filter("size(prints) > 0").join(broadcast_if_small(packages.select("file_id", F.lit(True).alias("nominated"))), "file_id", "left")
    contents = open_.groupBy("whole").agg(
        F.min("repo").alias("low"), F.max("repo").alias("high"), F.min("file_id").alias("one"), F.coalesce(F.max("nominated"), F.lit(False)).alias("nominated"), F.first("size").alias("size"),
    )
    contents = cut(contents)

    def shared(runs: DataFrame) -> DataFrame:
        """(whole, low, high, print) of the runs that stand in several repositories."""
        runs = runs.withColumn("in", F.xxhash64("repo"))
        several = runs.groupBy("print").agg(F.min("in").alias("a"), F.max("in").alias("b")).filter("a <> b").select("print")
        return runs.select("whole", "print").join(broadcast_if_small(cut(several)), "print", "left_semi").distinct().join(contents.select("whole", "low", "high"), "whole")

    # a content joins the others at every shared run; what the blocks cover is put together
    wide = open_.select("whole", "repo", F.explode("prints").alias("print"))
    known = cut(open_.filter("nominated").select(F.explode("fine").alias("print")).distinct())
    fine = open_.select("whole", "repo", F.explode("fine").alias("print")).join(broadcast_if_small(known), "print", "left_semi")
    placed = cut(shared(wide).withColumn("fine", F.lit(False)).unionByName(shared(fine).withColumn("fine", F.lit(True))))
    blocks = cut(blocks_of(placed))
    some = contents.join(open_.filter("size(short) > 0").select(F.col("file_id").alias("one"), "short").dropDuplicates(["one"]), "one")
    pairs = cut(candidates(cut(some)))
    near = pairs.unionByName(pairs.select("whole", F.col("whole").alias("other")).distinct())
    one = contents.join(blocks.select("whole").unionAll(near.select("other")).distinct(), "whole", "left_semi").select("whole", "low", "high", "one")
    texts = rows.select(F.col("file_id").alias("one"), "language", "content").dropDuplicates(["one"])
    exact = cut(one.join(texts, "one").select("whole", "language", "content").mapInArrow(_lexed, "whole long, exact array<long>"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # grammars cost more than their bytes tell
    spans = blocks.join(one.drop("one"), "whole").join(exact, "whole").repartition(tasks, "block").groupBy("block").applyInPandas(_joint, "whole long, fine boolean, start long, stop long")
    beside = near.join(exact.withColumnRenamed("whole", "other"), "other").repartition(tasks, "whole").groupBy("whole").applyInPandas(_beside, "whole long, held boolean, start long, stop long")
    beside = cut(beside)
    spans = spans.unionByName(beside.drop("held").withColumn("fine", F.lit(True)))
    span = F.struct("start", "stop")
    share = spans.groupBy("whole").agg(F.collect_set(F.when(~F.col("fine"), span)).alias("wide"), F.collect_set(span).alias("every"))
    share = cut(share.select("whole", F.expr(_UNION.format("wide")).alias("wide"), F.expr(_UNION.format("every")).alias("every")))

    # what is nominated is judged by its package's files together
    files_of = judged.filter("kind is null").select("file_id", "whole", "size").join(packages, "file_id").join(share.select("whole", "every"), "whole", "left")
    files_of = cut(files_of.distinct())
    whole_packages = files_of.groupBy("package").agg(F.sum(F.coalesce("every", F.lit(0))).alias("c"), F.sum("size").alias("n")).filter(f"c > 0 and c >= {FINE_COPIED} * n").select("package")
    third = files_of.join(broadcast_if_small(cut(whole_packages)), "package", "left_semi").select("file_id", "whole")

    sizes = contents.select("whole", "size")
    copies = share.join(sizes, "whole").filter(F.col("wide") >= COPIED * F.col("size")).select("whole")
    short = beside.filter("held").select("whole")
    other = open_.filter("kind is null").select("file_id", "whole").join(copies.unionByName(short).distinct(), "whole").select("file_id")
    return own.unionByName(other.unionByName(third.select("file_id")).withColumn("kind", F.lit("vendored"))).groupBy("file_id").agg(F.min("kind").alias("kind"))
