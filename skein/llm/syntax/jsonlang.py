"""Lexer and grammar of strict JSON."""

from __future__ import annotations

import re

from skein.sources.derive import Grammar
from skein.sources.tokens import Tokens

_LEX = re.compile(
    r"""(?P<s>[ \t\r\n]+)|(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<WORD>(?:true|false|null)(?!\w))|(?P<OP>[{}\[\],:])"""
)
GRAMMAR = Grammar(
    """
Value = STR | NUM | WORD | '{' (Pair % ',')? '}' | '[' (Value % ',')? ']' ;
Pair = STR ':' Value ;
""",
    "Value",
)


def lex(text: str) -> Tokens:
    out, pos, n = Tokens(text), 0, len(text)
    while pos < n:
        m = _LEX.match(text, pos)
        kind = m.lastgroup if m else "BAD"
        end = m.end() if m else pos + 1
        if kind != "s":
            out.kinds.append(m[0] if kind == "OP" else kind)
            out.starts.append(pos)
            out.ends.append(end)
            if kind == "BAD":
                break
        pos = end
    return out


def failure(tokens: Tokens) -> int | None:
    return GRAMMAR.failure(tokens.kinds)
