"""Lexer and grammar of YAML 1.1 / 1.2 streams."""

from __future__ import annotations

import re

from skein.sources.derive import Grammar
from skein.sources.tokens import Tokens

GRAMMAR = Grammar(
    """
Stream = (Block DOCEND*)? (DIRECTIVE* DOCSTART Block? DOCEND*)* ;
Block = ALIAS | Props Content? | Content ;
Open = ALIAS | Props (Content | Entries)? | Content | Entries ;
Props = TAG ANCHOR? | ANCHOR TAG? ;
Content = BSEQ ('-' Block?)* BEND | BMAP (KEY Open? (':' Open?)?)* BEND | Flow | SCALAR ;
Entries = ('-' Block?)+ ;
Flow = '[' (Entry % ',' ','?)? ']' | '{' (Entry % ',' ','?)? '}' ;
Entry = Node | KEY Node? (':' Node?)? ;
Node = ALIAS | Props (Flow | SCALAR)? | Flow | SCALAR ;
""",
    "Stream",
)
_UNPRINTABLE = re.compile("[^\t\n\r\x20-\x7e\x85\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_NAME = re.compile(r"[^\s\[\]{},]+")
_DOUBLE = re.compile(r'"((?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|\r?\n))*)"', re.S)
_SINGLE = re.compile(r"'((?:[^']|'')*)'", re.S)
_MARK = re.compile(r"^(?:---|\.\.\.)(?=\s|$)", re.M)
_BLOCK_HEAD = re.compile(r"[|>](?:[+-]?[1-9]|[1-9]?[+-]|)?[ \t]*(?:[ \t]#[^\n]*)?(?=\r?\n|$)")
_BLANKS = " \t"


class _Scanner:
    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.out = Tokens(text)
        self.pos, self.line_start, self.line = 0, 0, 0
        self.flow: list[str] = []
        self.indent, self.indents = -1, []
        self.key_allowed = True
        self.keys: dict[int, tuple] = {}  # flow depth: (token number, place, line, column, required)

    class Bad(Exception):
        pass

    def bad(self):
        raise self.Bad

    def add(self, kind: str, a: int, b: int) -> None:
        self.out.kinds.append(kind)
        self.out.starts.append(a)
        self.out.ends.append(b)

    def insert(self, at: int, kind: str) -> None:
        place = self.out.starts[at] if at < len(self.out.starts) else self.pos
        self.out.kinds.insert(at, kind)
        self.out.starts.insert(at, place)
        self.out.ends.insert(at, place)

    @property
    def column(self) -> int:
        return self.pos - self.line_start

    def moved(self, end: int) -> None:
        """Go on behind a token that may hold line ends."""
        last = self.text.rfind("\n", self.pos, end)
        if last >= 0:
            self.line += self.text.count("\n", self.pos, end)
            self.line_start = last + 1
        self.pos = end

    def skip(self) -> None:
        """Blanks, comments and line ends before the next token."""
        t = self.text
        while self.pos < self.n:
            c = t[self.pos]
            if c == " " or c == "\r" or c == "\t" and (self.flow or not self.key_allowed):
                self.pos += 1
            elif c == "\n":
                self.pos += 1
                self.line += 1
                self.line_start = self.pos
                if not self.flow:
                    self.key_allowed = True
            elif c == "#":
                end = t.find("\n", self.pos)
                end = self.n if end < 0 else end
                self.out.comments.append((self.pos, end))
                self.pos = end
            elif c == "\t" and not t[self.pos : (t.find("\n", self.pos) % (self.n + 1))].strip():
                self.pos += 1
            else:
                return

    def stale(self) -> None:
        """Keys must end on the line they begin."""
        for depth, (_, place, line, _, required) in list(self.keys.items()):
            if line != self.line or self.pos - place > 1024:
                if required:
                    self.bad()
                del self.keys[depth]

    def unwind(self, column: int) -> None:
        if self.flow:
            return
        while self.indent > column:
            self.add("BEND", self.pos, self.pos)
            self.indent = self.indents.pop()

    def deepen(self, column: int) -> bool:
        if self.indent < column:
            self.indents.append(self.indent)
            self.indent = column
            return True
        return False

    def save_key(self) -> None:
        required = not self.flow and self.indent == self.column
        if self.key_allowed:
            self.drop_key()
            self.keys[len(self.flow)] = (len(self.out.kinds), self.pos, self.line, self.column, required)

    def drop_key(self) -> None:
        old = self.keys.pop(len(self.flow), None)
        if old and old[4]:
            self.bad()

    def blank(self, at: int) -> bool:
        return at >= self.n or self.text[at] in " \t\r\n"

    def run(self) -> Tokens:
        m = _UNPRINTABLE.search(self.text, 1 if self.text.startswith("\ufeff") else 0)
        if m:
            self.n = m.start()
        if self.text.startswith("\ufeff"):
            self.pos = self.line_start = 1
        try:
            while self.token():
                pass
            if m:
                self.bad()
        except self.Bad:
            self.add("BAD", self.pos, min(self.n, self.pos + 1))
        return self.out

    def token(self) -> bool:
        self.skip()
        self.stale()
        self.unwind(self.column if self.pos < self.n else -1)
        t, p = self.text, self.pos
        if p >= self.n:
            self.unwind(-1)
            self.drop_key()
            if self.flow:
                self.bad()
            return False
        c, column = t[p], self.column
        if column == 0 and (t.startswith(("---", "..."), p)) and self.blank(p + 3):
            self.unwind(-1)
            self.drop_key()
            if self.flow:
                self.bad()
            self.key_allowed = False
            self.add("DOCSTART" if c == "-" else "DOCEND", p, p + 3)
            self.pos = p + 3
        elif column == 0 and c == "%":
            self.unwind(-1)
            self.drop_key()
            self.key_allowed = False
            end = t.find("\n", p)
            self.add("DIRECTIVE", p, self.n if end < 0 else end)
            self.pos = self.out.ends[-1]
        elif c in "[{":
            self.save_key()
            self.flow.append(c)
            self.key_allowed = True
            self.single(c)
        elif c in "]}":
            self.drop_key()
            if self.flow:
                self.flow.pop()
            self.key_allowed = False
            self.single(c)
        elif c == ",":
            self.key_allowed = True
            self.drop_key()
            self.single(c)
        elif c == "-" and self.blank(p + 1):
            if not self.flow:
                if not self.key_allowed:
                    self.bad()
                if self.deepen(column):
                    self.add("BSEQ", p, p)
            self.key_allowed = True
            self.drop_key()
            self.single("-")
        elif c == "?" and (self.blank(p + 1)):
            if not self.flow:
                if not self.key_allowed:
                    self.bad()
                if self.deepen(column):
                    self.add("BMAP", p, p)
            self.key_allowed = not self.flow
            self.drop_key()
            self.add("KEY", p, p + 1)
            self.pos += 1
        elif c == ":" and (self.blank(p + 1) or self.flow and (t[p + 1] in ",[]{}" or p > 0 and t[p - 1] in "\"'}]")):
            key = self.keys.pop(len(self.flow), None)
            if key:
                self.insert(key[0], "KEY")
                if not self.flow and self.deepen(key[3]):
                    self.insert(key[0], "BMAP")
                self.key_allowed = False
            else:
                if not self.flow:
                    if not self.key_allowed:
                        self.bad()
                    if self.deepen(column):
                        self.add("BMAP", p, p)
                self.key_allowed = not self.flow
                self.drop_key()
            self.single(":")
        elif c in "*&":
            self.save_key()
            self.key_allowed = False
            m = _NAME.match(t, p + 1)
            if not m:
                self.bad()
            self.add("ALIAS" if c == "*" else "ANCHOR", p, m.end())
            self.pos = m.end()
        elif c == "!":
            self.save_key()
            self.key_allowed = False
            end = p + 1
            if t.startswith("!<", p):
                end = t.find(">", p) + 1
                if not end:
                    self.bad()
            while end < self.n and not (t[end] in " \t\r\n" or self.flow and t[end] in ",[]{}"):
                end += 1
            self.add("TAG", p, end)
            self.pos = end
        elif c in "|>" and not self.flow:
            self.block_scalar()
        elif c in "\"'":
            self.save_key()
            self.key_allowed = False
            m = (_DOUBLE if c == '"' else _SINGLE).match(t, p, self.n)
            if not m or _MARK.search(m[1], len(m[1].split("\n", 1)[0])):
                self.bad()
            self.add("SCALAR", p, m.end())
            self.moved(m.end())
        elif c not in " \t\r\n-?:,[]{}#&*!|>'\"%@`" or c in "-?:" and not self.blank(p + 1) and not (self.flow and t[p + 1] in ",[]{}"):
            self.plain()
        else:
            self.bad()
        return True

    def single(self, c: str) -> None:
        self.add(c, self.pos, self.pos + 1)
        self.pos += 1

    def block_scalar(self) -> None:
        self.key_allowed = True
        self.drop_key()
        t, m = self.text, _BLOCK_HEAD.match(self.text, self.pos, self.n)
        if not m:
            self.bad()
        start, end = self.pos, m.end()
        least = max(1, self.indent + 1)
        fixed = re.search(r"[1-9]", m[0].split("#")[0])
        width = max(0, self.indent) + int(fixed[0]) if fixed else None
        at, widest = t.find("\n", end) + 1 or self.n, 0
        while at < self.n:
            stop = t.find("\n", at)
            stop = self.n if stop < 0 else stop
            row = t[at:stop]
            lead = len(row) - len(row.lstrip(" "))
            if row.strip(" \r"):
                if width is None:
                    width = max(least, lead)
                    if widest > width and lead >= least:
                        self.bad()
                if lead < width:
                    break
            else:
                widest = max(widest, lead)
            at = stop + 1
        at = min(at, self.n)
        self.add("SCALAR", start, at)
        self.moved(at)

    def plain(self) -> None:
        self.save_key()
        self.key_allowed = False
        t, start, end, least = self.text, self.pos, self.pos, self.indent + 1
        while True:
            if self.pos < self.n and t[self.pos] == "#":
                break
            at = self.pos
            while at < self.n:
                c = t[at]
                if c in " \t\r\n" or c == ":" and (self.blank(at + 1) or self.flow and t[at + 1] in ",[]{}") or self.flow and c in ",[]{}":
                    break
                at += 1
            if at == self.pos:
                break
            self.key_allowed = False
            self.pos = end = at
            while self.pos < self.n and t[self.pos] in " \t\r":
                self.pos += 1
            if self.pos < self.n and t[self.pos] == "\n":
                self.key_allowed = True
                while self.pos < self.n and t[self.pos] in " \r\n":
                    if t[self.pos] == "\n":
                        self.line += 1
                        self.line_start = self.pos + 1
                    self.pos += 1
                if self.column == 0 and t.startswith(("---", "..."), self.pos) and self.blank(self.pos + 3):
                    break
            if self.pos >= self.n or t[self.pos] == "#" or not self.flow and self.column < least:
                break
        self.add("SCALAR", start, end)


def lex(text: str) -> Tokens:
    return _Scanner(text).run()


def failure(tokens: Tokens) -> int | None:
    return GRAMMAR.failure(tokens.kinds)
