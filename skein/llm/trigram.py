"""Trigram index of text chunks, and the trigrams a regular expression requires.

A block of chunks is indexed in one pass over its bytes; only postings of trigrams that
some rule requires are kept. A rule's regular expression is analysed once: its parse tree
gives a query of ANDs and ORs over literal strings that every match must hold. The query is
answered by intersecting postings, and only the candidates are given to the expression.
"""

from __future__ import annotations

from re import _constants as sre  # the parser's node names
from re import _parser

import numpy as np

_MOST = 48  # exact strings followed at once


def required(pattern: str, flags: int = 0):
    """The query of a regular expression: None (no requirement), str, ('and' | 'or', [queries]).

    Strings are lower case, as the index is.
    """
    return _sequence(_parser.parse(pattern, flags).data)[1]


def _and(parts):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _or(parts):
    parts = list(parts)
    if any(p is None for p in parts):
        return None
    return parts[0] if len(parts) == 1 else ("or", parts)


def _literal_or(strings):
    return _or(s if len(s) >= 3 else None for s in sorted(strings))


def _sequence(nodes):
    """(exact strings or None, query) of a sequence of parse nodes."""
    run, queries, exact = {""}, [], True
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        queries.append(_literal_or(run))
        if strings is not None:
            run = set(strings)
        else:
            queries.append(query)
            run = {""}
    if exact:
        return run, _literal_or(run)
    queries.append(_literal_or(run))
    return None, _and(queries)


def _node(op, arg):
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return {""}, None
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(arg[3].data)
    if op is sre.BRANCH:
        parts = [_sequence(p.data) for p in arg[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*(s for s, _ in parts))
            if len(strings) <= _MOST:
                return strings, None
        return None, _or(q for _, q in parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = arg
        strings, query = _sequence(body.data)
        if strings is not None and least == most == 1:
            return strings, None
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, None
        return None, (query if least >= 1 else None)
    if op is sre.ATOMIC_GROUP:
        return _sequence(arg.data)
    return None, None


def _codes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def _all_codes(query):
    if isinstance(query, str):
        return set(_codes(query).tolist())
    return set().union(*map(_all_codes, query[1])) if query else set()


class Matcher:
    """Finds, in blocks of chunks, the candidates of several expressions."""

    def __init__(self, patterns: dict[str, tuple[str, int]]):
        self.queries = {name: required(p, f) for name, (p, f) in patterns.items()}
        open_ = [n for n, q in self.queries.items() if q is None]
        if open_:
            raise ValueError(f"expressions that require no trigram: {open_}")
        self.wanted = np.array(sorted(set().union(*map(_all_codes, self.queries.values()))), np.int64)
        self.table = np.zeros(1 << 24, bool)
        self.table[self.wanted] = True

    def candidates(self, data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Chunk numbers by expression. ``data``: the chunks' bytes, ``starts``: where each begins, and the end."""
        lower = data.astype(np.int32)
        lower[(data >= 65) & (data <= 90)] += 32
        if len(lower) < 3:
            return {n: np.empty(0, np.int64) for n in self.queries}
        code = lower[:-2] << 16 | lower[1:-1] << 8 | lower[2:]
        at = np.flatnonzero(self.table[code])
        chunk = np.searchsorted(starts, at, "right") - 1
        inside = at + 3 <= starts[chunk + 1]
        at, chunk = at[inside], chunk[inside]
        code = code[at].astype(np.int64)
        order = np.argsort(code, kind="stable")
        code, chunk = code[order], chunk[order]
        left, right = np.searchsorted(code, self.wanted, "left"), np.searchsorted(code, self.wanted, "right")
        postings = {c: np.unique(chunk[a:b]) for c, a, b in zip(self.wanted.tolist(), left, right)}
        return {name: self._answer(q, postings) for name, q in self.queries.items()}

    def _answer(self, query, postings) -> np.ndarray:
        if isinstance(query, str):
            lists = sorted((postings[c] for c in set(_codes(query).tolist())), key=len)
            out = lists[0]
            for x in lists[1:]:
                if not len(out):
                    break
                out = np.intersect1d(out, x, assume_unique=True)
            return out
        parts = [self._answer(q, postings) for q in query[1]]
        out = parts[0]
        for x in parts[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


