"""Evaluation items standing in corpus documents, whole or in part.

A prefix-filtered set join over word shingles. The items are the stated query set: their
shingles go to all tasks in blocks of a fixed size, and every document is read whole, twice.
The first pass only counts in how many documents each shingle of the items stands, which
orders them by rarity; nothing of a document is written. Of every item-sized window that a
leak must fill, only the rarest shingles have to be joined, since a leak that misses them all
would have more faults than allowed. The second pass looks these up in every document; pairs
that share one are held against the bounds on number, length and position, and those left are
aligned word by word, exactly.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, fewer where an item is so short that a leak may have no longer run.
WIDTH = 5
#: At most one word in so many is replaced or missing; the least part of an item.
FAULT = 8
PART = 3
#: An opening that so many different items share is an instruction.
SHARED = 3
#: Words of items joined at once.
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+").findall
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--|-->")
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿]")


def words_of(text: str | None) -> list[str]:
    """The words of a text, without case, punctuation, markup and invisible characters."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return _WORD(text.lower())


#: Where an opening may end: after a sentence or a line.
_STOP = re.compile(r"[.:!?][\"')\]]*(?=\s|$)|[。！？]|\n")


def openings(text: str | None) -> list[tuple[str, ...]]:
    """The words of a text up to the end of each of its sentences and lines."""
    out = [tuple(words_of(text[: m.end()])) for m in _STOP.finditer(text or "")]
    return [w for w in dict.fromkeys(out) if w]


def bodies(items: list[tuple[int, str | None]]) -> dict[tuple[str, ...], list[int]]:
    """Items by their words, without the instructions that open several items.

    An instruction is an opening of whole sentences or lines, of any length, that the openings
    of ``SHARED`` items with different words begin with. Items without words, or with nothing
    but such an instruction, are left out. Items of the same words are one, with all their ids.
    """
    lists = {i: tuple(words_of(t)) for i, t in items}
    begin = {}  # by words: openings, of any of the texts with these words
    for i, t in items:
        begin.setdefault(lists[i], set()).update(openings(t))
    shared = Counter(o for some in begin.values() for o in some)
    out = defaultdict(list)
    for i, w in lists.items():
        k = max((len(o) for o in begin[w] if shared[o] >= SHARED), default=0)
        if w[k:]:
            out[w[k:]].append(i)
    return dict(out)


def sizes(need: int, n: int) -> list[int]:
    """The window sizes of an item of ``n`` words that must be looked at.

    Of a longer passage with few enough faults a part is one of these: one of twice the least
    size has a half that will do, and between two multiples of ``FAULT`` a word can be cut off.
    """
    return [need, *range((need // FAULT + 1) * FAULT, min(2 * need, n + 1), FAULT)] if need <= n else []


class Items:
    """A block of items as arrays: words, shingles, and where the shingles stand."""

    def __init__(self, block: list[tuple[tuple[str, ...], list[int]]]):
        self.ids = [i for _, i in block]
        self.word_id: dict[str, int] = {}
        self.words = [np.array([self.word_id.setdefault(w, len(self.word_id) + 1) for w in b], np.int64) for b, _ in block]
        self.need = [math.ceil(len(w) / PART) for w in self.words]
        self.sizes = [sizes(need, len(w)) for need, w in zip(self.need, self.words)]
        # a window of w words with f faults has an equal run of (w - f) / (f + 1) words
        self.width = [min(WIDTH, *(math.ceil((w - w // FAULT) / (w // FAULT + 1)) for w in some)) for some in self.sizes]
        base = len(self.word_id) + 1
        if base**WIDTH >= 1 << 62:
            raise ValueError("too many different words in a block of items")
        self.base = base
        places = [(int(c) * (WIDTH + 1) + k, n, at) for n, (w, k) in enumerate(zip(self.words, self.width)) for at, c in enumerate(codes(w, k, base))]
        places.sort()
        self.code = np.unique(np.array([p[0] for p in places], np.int64))
        self.of = [[] for _ in self.code]  # shingle: its (item, place)
        for (c, n, at), s in zip(places, np.searchsorted(self.code, [p[0] for p in places])):
            self.of[s].append((n, at))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingle numbers, positions) of the items' shingles in a run of word ids."""
        shingles, at = [], []
        for k in sorted(set(self.width)):
            c = codes(ids, k, self.base)
            if not len(c):
                continue
            whole = np.flatnonzero(c >= 0)
            c = c[whole] * (WIDTH + 1) + k
            s = np.minimum(np.searchsorted(self.code, c), len(self.code) - 1)
            hit = self.code[s] == c
            shingles.append(s[hit])
            at.append(whole[hit])
        if not shingles:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(shingles), np.concatenate(at)

    def prefix(self, df: dict[int, int]) -> np.ndarray:
        """Which shingles must be joined: of every window a leak may fill, its necessary ones.

        A window of w words has m shingles, and a leak keeps all but those that its faults
        destroy, k at least; so it holds one of the m - k + 1 rarest.
        """
        keep = np.zeros(len(self.code), bool)
        for w, some, k in zip(self.words, self.sizes, self.width):
            s = np.searchsorted(self.code, codes(w, k, self.base) * (WIDTH + 1) + k).tolist()
            order = [(df.get(x, 0), x) for x in s]
            for size in some:
                m = size - k + 1
                first = min(m, k * (size // FAULT) + 1)
                for a in range(len(w) - size + 1):
                    for _, x in sorted(order[a : a + m])[:first]:
                        keep[x] = True
        return keep

    def leaks(self, ids: np.ndarray, shingles: np.ndarray, at: np.ndarray, keep: np.ndarray) -> list[int]:
        """Numbers of the items that stand in the document."""
        candidates = {n for s in np.unique(shingles[keep[shingles]]).tolist() for n, _ in self.of[s]}
        if not candidates:
            return []
        hits = defaultdict(set)
        for s, p in zip(shingles.tolist(), at.tolist()):
            for n, k in self.of[s]:
                if n in candidates:
                    hits[n].add((p, k))
        return [n for n, h in hits.items() if self._stands(n, ids, sorted(h))]

    def _stands(self, n: int, ids: np.ndarray, hits: list[tuple[int, int]]) -> bool:
        item, need, width = self.words[n], self.need[n], self.width[n]
        last: dict[int, tuple[int, int]] = {}  # diagonal: first and last place of its equal run
        for p, k in hits:
            first, end = last.get(p - k, (p, p))
            first = p if p > end + 1 else first
            last[p - k] = first, p
            if p - first + width >= need:  # a run without faults is long enough
                return True
        # fewer shingles of the item than any leak keeps
        least = min(max(1, w - width + 1 - width * (w // FAULT)) for w in self.sizes[n])
        if len({k for _, k in hits}) < least:
            return False
        # a passage with a shingle at place k of the item lies at most so far around it
        spans: list[list[int]] = []
        for a in sorted({max(0, p - k) for p, k in hits}):
            b = min(len(ids), a + len(item))
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        return any(aligned(ids[a:b], item, need) for a, b in spans)


def aligned(doc: np.ndarray, item: np.ndarray, need: int) -> bool:
    """Whether a passage of ``doc`` is a window of at least ``need`` words of the item, of which
    at most one in ``FAULT`` is replaced by another word or missing.

    Exact, over all alignments: ``first[f, p]`` is the least item word at which a window may
    begin that ends with the present item word, has f faults, and whose passage ends before p.
    """
    n, most = len(item), len(item) // FAULT
    there = np.isin(item, doc)
    told = np.concatenate([[0], np.cumsum(there)])
    if all((told[w:] - told[:-w]).max(initial=0) < w - w // FAULT for w in sizes(need, n)):
        return False
    none = n + 1
    first = np.full((most + 1, len(doc) + 1), none, np.int32)
    for k in range(n):
        equal = doc == item[k]
        after = np.full_like(first, none)
        after[:, 1:][:, equal] = first[:, :-1][:, equal]
        after[0, 1:][equal] = np.minimum(after[0, 1:][equal], k)
        np.minimum(after[1:], first[:-1], out=after[1:])  # a word missing
        np.minimum(after[1:, 1:], first[:-1, :-1], out=after[1:, 1:])  # a word replaced
        first = after
        size = k + 1 - first.min(axis=1)  # longest window by faults
        edge = np.maximum(0, need - size)  # words at its ends that may be faults themselves
        faults = np.arange(most + 1)
        if ((size > 0) & (FAULT * (faults + edge) <= size + edge)).any():
            return True
    return False


def codes(ids: np.ndarray, width: int, base: int) -> np.ndarray:
    """Codes of all runs of ``width`` word ids; negative where a word is none of the items'."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out, none = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(width):
        part = ids[k : k + n]
        out = out * base + part
        none |= part == 0
    out[none] = -1
    return out


def _met(items: Items, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, word ids, shingles, their places) of the texts that hold shingles of items."""
    get = items.word_id.get
    lists = [words_of(t) for t in texts]
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.cumsum(lens + 1)  # a border between documents: no shingle crosses it
    ids = np.fromiter((g for t in lists for g in (*(get(w, 0) for w in t), 0)), np.int64, int(ends[-1]))
    s, at = items.find(ids)
    doc = np.searchsorted(ends, at, "right")
    order = np.lexsort((at, doc))
    s, at, doc = s[order], at[order], doc[order]
    for d in np.unique(doc).tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        start = int(ends[d] - lens[d] - 1)
        yield d, ids[start : ends[d] - 1], s[a:b], at[a:b] - start


def _runs(column: pa.Array, size: int = 256) -> Iterator[tuple[int, list]]:
    for i in range(0, len(column), size):
        yield i, column.slice(i, size).to_pylist()


def _counts(block):
    """Partial counts of documents by shingle, one batch a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        df = np.zeros(len(items.code), np.int64)
        for batch in batches:
            for _, texts in _runs(batch.column(0)):
                for _, _, shingles, _ in _met(items, texts):
                    df[np.unique(shingles)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], names=["s", "n"])

    return run


def _verify(block, keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, wanted = block.value, keep.value
        for batch in batches:
            docs, found = [], []
            keys = batch.column(0)
            for i, texts in _runs(batch.column(1)):
                for d, ids, shingles, at in _met(items, texts):
                    for n in items.leaks(ids, shingles, at, wanted):
                        found += items.ids[n]
                        docs += [keys[i + d].as_py()] * len(items.ids[n])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return run


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that contain at least a third of an item's words as
    one passage, with at most one word in eight of the passage replaced or missing.

    Null and blank texts and items hold no words and are in no row. Items of the same words
    are all reported. Items are taken in blocks of ``BLOCK_WORDS`` words, each one broadcast.
    """
    spark = docs.sparkSession
    listed = [(r[0], r[1]) for r in items.select("item_id", "text").distinct().toLocalIterator()]
    blocks, size = [[]], 0
    for body, ids in sorted(bodies(listed).items(), key=lambda x: x[1]):
        if size + len(body) > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((body, ids))
        size += len(body)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks:
        if not block:
            continue
        data = Items(block)
        block = spark.sparkContext.broadcast(data)
        counted = texts.select("text").mapInArrow(_counts(block), "s long, n long").groupBy("s").agg(F.sum("n"))
        df = {r[0]: r[1] for r in counted.toLocalIterator()}  # at most the shingles of a block
        keep = spark.sparkContext.broadcast(data.prefix(df))
        part = texts.mapInArrow(_verify(block, keep), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out.distinct()
