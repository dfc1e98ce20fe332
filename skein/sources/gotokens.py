"""Lexer of Go."""

from __future__ import annotations

import re

from skein.sources.tokens import Tokens

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset(["ID", "NUM", "CHR", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_ESCAPE = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_LEX = re.compile(
    rf"""(?P<s>[ \t\r]+)|(?P<nl>\n)|(?P<c>//[^\n\0]*(?!\0)|/\*[^\0]*?\*/)|(?P<ID>[^\W\d]\w*)|(?P<STR>"(?:[^"\\\n\0]|{_ESCAPE})*"|`[^`\0]*`)
    |(?P<NUM>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)i?)(?!\w)
    |(?P<CHR>'(?:[^'\\\n]|{_ESCAPE})')
    |(?P<OP><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{{}},;.:~])""",
    re.S | re.X,
)
_SPACE = {"s", "c", "nl"}


def lex(text: str) -> Tokens:
    """Kinds and places of the tokens, with the semicolons that line ends stand for."""
    out = Tokens(text)
    kinds, starts, ends, match = out.kinds, out.starts, out.ends, _LEX.match
    pos, n, last = 1 if text.startswith("﻿") else 0, len(text), ""
    while pos < n:
        m = match(text, pos)
        if m is None:
            kinds.append("BAD")
            starts.append(pos)
            ends.append(pos + 1)
            return out
        kind, end = m.lastgroup, m.end()
        if kind in _SPACE:
            if kind == "c":
                out.comments.append((pos, end))
            if last in _ENDS and (kind == "nl" or kind == "c" and text.find("\n", pos, end) >= 0):
                kinds.append(";")
                starts.append(pos)
                ends.append(pos)
                last = ";"
            pos = end
            continue
        if kind == "OP":
            last = m[0]
        elif kind == "ID":
            word = m[0]
            last = word if word in KEYWORDS else "ID"
        else:
            last = kind
        kinds.append(last)
        starts.append(pos)
        ends.append(end)
        pos = end
    if last in _ENDS:
        kinds.append(";")
        starts.append(n)
        ends.append(n)
    return out
