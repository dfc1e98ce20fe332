"""Parsing with derivatives over token streams, memoised.

A language is what may still follow: grammar nodes, each with the language that follows it
in turn. Its derivative by a token is the language of what may follow after that token.
Languages that begin with the same node are merged into one, what follows them likewise (a
shared stack graph), so a language has at most as many parts as the grammar has nodes, however
deep and ambiguous the text. Every derivative is kept, so the languages met while parsing
become the states of a growing automaton and a token costs one look-up. The empty language
marks the token at which the text fails; a language at the end that does not hold the empty
word marks a truncated text.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s+|#[^\n]*|'([^']+)'|([A-Za-z_][A-Za-z_0-9]*)|([()|?*+=;%])")
#: Languages kept before all are forgotten.
MOST_STATES = 150_000


class State:
    """A language: the pairs of a node and the language after it, and whether the empty word
    ends it here (``eps``); the derivatives known so far."""

    __slots__ = ("items", "eps", "next", "nullable")

    def __init__(self, items, eps, nullable):
        self.items, self.eps, self.nullable, self.next = items, eps, nullable, {}


class Grammar:
    """A grammar in EBNF: ``Name = a 'b' (c | d)* ;`` with ``x % y`` for x's between y's.

    Lower- and upper-case names that have no rule are kinds of tokens. No left recursion.
    """

    def __init__(self, text: str, start: str):
        self.rules, self.start_rule = {}, start
        self._tokens, pos = [], 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos:pos + 40]!r}")
            pos = m.end()
            if m.lastindex:
                self._tokens.append((m.lastindex, m[m.lastindex]))
        self._at = 0
        while self._at < len(self._tokens):
            name = self._take()[1]
            self._expect("=")
            self.rules[name] = self._alternatives()
            self._expect(";")
        self._ids: dict = {}
        self._kinds: list = []
        self._args: list = []
        names = {n: self._number(("n", n)) for n in self.rules}
        for n, body in self.rules.items():
            self._args[names[n]] = self._number(body)
        self._nullables()
        self.reset()

    def _number(self, node) -> int:
        """The number of a node; equal nodes have one."""
        kind, arg = node
        if kind == "n" and arg not in self.rules:
            node = kind, arg = "t", arg
        found = self._ids.get(node)
        if found is None:
            parts = tuple(map(self._number, arg)) if kind in ("seq", "alt") else self._number(arg) if kind == "star" else arg
            found = self._ids[node] = len(self._kinds)
            self._kinds.append(kind)
            self._args.append(parts)
        return found

    def _take(self):
        self._at += 1
        return self._tokens[self._at - 1]

    def _peek(self):
        return self._tokens[self._at] if self._at < len(self._tokens) else (3, ";")

    def _expect(self, sign):
        if self._take() != (3, sign):
            raise ValueError(f"grammar: {sign} missing near {self._tokens[max(0, self._at - 6):self._at]}")

    def _alternatives(self):
        parts = [self._sequence()]
        while self._peek() == (3, "|"):
            self._take()
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", tuple(parts))

    def _sequence(self):
        parts = []
        while self._peek() not in ((3, "|"), (3, ")"), (3, ";")):
            kind, value = self._take()
            if (kind, value) == (3, "("):
                node = self._alternatives()
                self._expect(")")
            else:
                node = ("t", value) if kind == 1 else ("n", value)
            while self._peek() in ((3, "?"), (3, "*"), (3, "+"), (3, "%")):
                sign = self._take()[1]
                if sign == "%":
                    kind, value = self._take()
                    between = ("t", value) if kind == 1 else ("n", value)
                    node = ("seq", (node, ("star", ("seq", (between, node)))))
                else:
                    node = {"?": ("alt", (node, ("seq", ()))), "*": ("star", node), "+": ("seq", (node, ("star", node)))}[sign]
            parts.append(node)
        return parts[0] if len(parts) == 1 else ("seq", tuple(parts))

    def _nullables(self) -> None:
        """Which nodes hold the empty word."""
        null = self._null = [kind == "star" for kind in self._kinds]
        changed = True
        while changed:
            changed = False
            for i, (kind, arg) in enumerate(zip(self._kinds, self._args)):
                if not null[i] and (kind == "n" and null[arg] or kind == "seq" and all(null[x] for x in arg) or kind == "alt" and any(null[x] for x in arg)):
                    null[i] = changed = True

    def reset(self) -> None:
        """Forget all derivatives of languages."""
        self._nodes: dict = {}
        self._states: dict = {}
        self._unions: dict = {}
        self.empty = self._state(frozenset(), False)
        self._end = self._state(frozenset(), True)
        self.first = self._push((self._ids["n", self.start_rule],), self._end)

    def _node(self, node: int, token: str) -> frozenset:
        """The derivative of a node: the sequences of nodes that may remain of it after the token."""
        key = node, token
        found = self._nodes.get(key)
        if found is not None:
            return found
        kind, arg = self._kinds[node], self._args[node]
        if kind == "t":
            out = frozenset([()]) if arg == token else frozenset()
        elif kind == "n":
            out = self._node(arg, token)
        elif kind == "alt":
            out = frozenset().union(*(self._node(x, token) for x in arg))
        elif kind == "star":
            out = frozenset(r + (node,) for r in self._node(arg, token))
        else:
            out = set()
            for i, x in enumerate(arg):
                out |= {r + arg[i + 1 :] for r in self._node(x, token)}
                if not self._null[x]:
                    break
            out = frozenset(out)
        self._nodes[key] = out
        return out

    def _state(self, items: frozenset, eps: bool) -> State:
        key = items, eps
        state = self._states.get(key)
        if state is None:
            nullable = eps or any(self._null[n] and rest.nullable for n, rest in items)
            state = self._states[key] = State(items, eps, nullable)
        return state

    def _push(self, nodes: tuple, rest: State) -> State:
        for n in reversed(nodes):
            rest = self._state(frozenset([(n, rest)]), False)
        return rest

    def _union(self, parts: frozenset) -> State:
        """One language of several; those that begin with the same node share it."""
        parts = parts - {self.empty}
        if len(parts) < 2:
            return next(iter(parts), self.empty)
        found = self._unions.get(parts)
        if found is None:
            after: dict[int, set] = {}
            for p in parts:
                for n, rest in p.items:
                    after.setdefault(n, set()).add(rest)
            items = frozenset((n, self._union(frozenset(rests))) for n, rests in after.items())
            found = self._unions[parts] = self._state(items, any(p.eps for p in parts))
        return found

    def derive(self, state: State, token: str) -> State:
        """The derivative of a language; the empty one is ``self.empty``."""
        null, waiting = self._null, [state]
        while waiting:  # what follows a nullable node comes first; a loop, for it may be far
            now = waiting[-1]
            if token in now.next:
                waiting.pop()
                continue
            before = [rest for n, rest in now.items if null[n] and token not in rest.next]
            if before:
                waiting += before
                continue
            parts = {self._push(r, rest) for n, rest in now.items for r in self._node(n, token)}
            parts.update(rest.next[token] for n, rest in now.items if null[n])
            now.next[token] = self._union(frozenset(parts))
            waiting.pop()
        return state.next[token]

    def begin(self) -> State:
        if len(self._states) > MOST_STATES:
            self.reset()
        return self.first

    def failure(self, tokens: list[str]) -> int | None:
        """Number of the failing token, the length where the text is truncated, None if it parses."""
        state, empty = self.begin(), self.empty
        for i, token in enumerate(tokens):
            after = state.next.get(token) or self.derive(state, token)
            if after is empty:
                return i
            state = after
        return None if state.nullable else len(tokens)
