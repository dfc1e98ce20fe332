"""Encoding of texts with a byte-level BPE vocabulary: speculate and verify.

A text is cut into words by the vocabulary's pattern. For words not met before, greedy
longest match proposes tokens; a proposal is the BPE result exactly if every two neighbours
are compatible, that is if no merge across their border comes before the merges that make
the two tokens. This is tested for all neighbours of all new words at once in numpy, walking
down the merge trees on both sides of the border. Only words that fail go through the exact
merging. Encodings of words are kept, so a frequent word is resolved once for each worker.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the vocabulary's family (a run of letters first: no
#: other alternative begins with a letter, so the order of the first two doesn't matter).
PATTERN = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: The same for the standard library's faster engine, right for texts of characters on whose
#: class both engines agree.
_PLAIN = r" ?[^\W\d_]++|'(?:[sdmt]|ll|ve|re)| ?\d++| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+"
#: Words a worker keeps, and characters it encodes at once.
KEPT_WORDS = 400_000
AT_ONCE = 400_000


def _byte_names() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Agreed(dict):
    """Whether both engines put a character into the same class."""

    _CLASSES = [(regex.compile(a).match, re.compile(b).match) for a, b in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))]

    def __missing__(self, c: str) -> bool:
        self[c] = found = all(bool(a(c)) == bool(b(c)) for a, b in self._CLASSES)
        return found


class Bpe:
    """A vocabulary, read from a tokenizer's JSON file with its list of merges."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        names = _byte_names()
        vocab = {bytes(names[c] for c in t): i for t, i in model["vocab"].items() if all(c in names for c in t)}
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([model["vocab"][a] for a, _ in pairs], np.int64)
        right = np.array([model["vocab"][b] for _, b in pairs], np.int64)
        made = np.array([model["vocab"][a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], rank[order]
        self.rank_of = dict(zip(keys.tolist(), rank.tolist()))
        self.made = made.tolist()
        # how a token was made: its parts, and the rank of the merge (-1 for single bytes)
        self.left, self.right, self.rank = np.arange(self.size), np.arange(self.size), np.full(self.size, -1, np.int64)
        for table, values in ((self.left, left), (self.right, right), (self.rank, rank)):
            table[made[::-1]] = values[::-1]  # the first merge that makes a token counts
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        sound = np.ones(self.size, bool)  # tokens that their own bytes merge to
        tokens = np.flatnonzero(self.rank >= 0)
        sound[tokens] = self._compatible(self.left[tokens], self.right[tokens], self.rank[tokens])
        for t in tokens[np.argsort(self.rank[tokens])].tolist():
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self.sound = sound
        self.vocab = vocab
        self.longest = max(map(len, vocab))
        self.lengths = sorted({len(t) for t in vocab}, reverse=True)
        self.full, self.plain, self.agreed = regex.compile(PATTERN).findall, re.compile(_PLAIN).findall, _Agreed()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lens, self.pool, self.filled = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of token a and token b, side by side, gives just a and b.

        Undoing the later of the two inner merges step by step, a merge across the border
        that comes before the merge undone last would have happened first. ``limit``: the
        rank that ends the life of the pair, for tokens made of two parts.
        """
        a, b, ok = a.astype(np.int64), b.astype(np.int64), np.ones(len(a), bool)
        limit = np.full(len(a), len(self.key_rank), np.int64) if limit is None else limit.astype(np.int64)
        # of two merges of one rank on both sides the left one is done first, so on a tie
        # the right token is the one undone first and its border merge must be earlier
        live = np.arange(len(a))
        while len(live):
            key = a[live] * self.size + b[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            clash = (self.keys[at] == key) & (self.key_rank[at] < limit[live])
            ok[live[clash]] = False
            live = live[~clash]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            live = live[(ra >= 0) | (rb >= 0)]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            undo_a = ra > rb
            x, y = live[undo_a], live[~undo_a]
            limit[x], a[x] = self.rank[a[x]], self.right[a[x]]
            limit[y], b[y] = self.rank[b[y]] + 1, self.left[b[y]]
        return ok

    def _greedy(self, word: bytes) -> list[int]:
        out, i, n, vocab = [], 0, len(word), self.vocab
        while i < n:
            for k in self.lengths:
                if i + k <= n:
                    t = vocab.get(word[i : i + k])
                    if t is not None:
                        out.append(t)
                        i += k
                        break
        return out

    def exact(self, word: bytes) -> list[int]:
        """The BPE merging itself: always the merge of least rank, the leftmost first."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before, rank_of = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank_of
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get(ids[i] * self.size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank_of.get(ids[i] * self.size + ids[k])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (q := rank_of.get(ids[h] * self.size + ids[i])) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def split(self, text: str) -> list[str]:
        return (self.plain if all(map(self.agreed.__getitem__, set(text))) else self.full)(text)

    def words(self, words: list[str]) -> list[list[int]]:
        """The token ids of each word."""
        raw = [w.encode() for w in words]
        proposed = [[t] if (t := self.vocab.get(w)) is not None else self._greedy(w) for w in raw]
        lens = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lens.sum()))
        owner = np.repeat(np.arange(len(raw)), lens)
        fine = np.ones(len(raw), bool)
        fine[owner[~self.sound[flat]]] = False
        near = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.empty(0, np.int64)
        pair, back = np.unique(flat[near] * self.size + flat[near + 1], return_inverse=True)
        good = self._compatible(pair // self.size, pair % self.size)
        fine[owner[near[~good[back]]]] = False
        for i in np.flatnonzero(~fine).tolist():
            proposed[i] = self.exact(raw[i])
        return proposed

    def _learn(self, new: list[str]) -> None:
        base = len(self.known)
        found = self.words(new)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for p in found for t in p), np.int32, int(lens.sum()))
        while base + len(new) > len(self.lens):
            self.starts, self.lens = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.lens, self.lens * 0])
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool * 0])
        self.starts[base : base + len(new)] = self.filled + np.cumsum(lens) - lens
        self.lens[base : base + len(new)] = lens
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        self.known.update(zip(new, range(base, base + len(new))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them)."""
        cut = [self.split(t) if t else () for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        words = [w for c in cut for w in c]
        if len(self.known) > KEPT_WORDS:
            self._forget()
        new = list(dict.fromkeys(w for w in words if w not in self.known)) if words else []
        if new:
            self._learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lens = self.lens[index]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[index] - (ends - lens), lens)
        at_text = np.concatenate([[0], ends])[np.cumsum(sizes)]
        return self.pool[at], at_text


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(lengths) // AT_ONCE
            borders = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(borders, borders[1:]):
                if a == b:
                    continue
                ids, ends = bpe.encode(column.slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every text, one row per row, no special tokens.

    Null and empty texts give the empty list; strings of special tokens are ordinary text.
    Nothing is shuffled: every row is encoded where it is read, whole.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(path), "doc_id long, ids array<int>")
