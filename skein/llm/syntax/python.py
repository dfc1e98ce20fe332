"""Lexer and grammar of Python 3."""

from __future__ import annotations

import re

from skein.sources.derive import Grammar
from skein.sources.tokens import Tokens

KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
_LEX = re.compile(
    r"""(?P<s>[ \t\f]+|\\\r?\n)|(?P<c>\#[^\n\r]*)|(?P<nl>\r?\n|\r)
    |(?P<STR>(?:[rR][bB]?|[bB][rR]?|[uU]|[fFtT][rR]?|[rR][fFtT])?(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"{3}(?:[^\\"]|\\.|"(?!""))*\"{3}|'(?:[^\\'\n\r]|\\(?:\r\n|.))*'|"(?:[^\\"\n\r]|\\(?:\r\n|.))*"))
    |(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*))(?:(?!\w)|(?=(?:and|else|for|if|in|is|or|not)\b))
    |(?P<NAME>[^\W\d]\w*)
    |(?P<OP>\*\*=|//=|>>=|<<=|\.\.\.|!=|==|<=|>=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])""",
    re.S | re.X,
)
_INDENT = re.compile(r"[ \t\f]*")


def lex(text: str) -> Tokens:
    """Kinds and places of the tokens, with line ends and changes of indentation."""
    out = Tokens(text)
    kinds, starts, ends, match = out.kinds, out.starts, out.ends, _LEX.match
    nul = text.find("\0")  # nowhere allowed, not in strings and comments either
    if nul >= 0:
        out = lex(text[:nul])
        if not out.kinds or out.kinds[-1] != "BAD":
            out.kinds.append("BAD")
            out.starts.append(nul)
            out.ends.append(nul + 1)
        out.text = text
        return out
    pos, n, depth, indents, fresh = 1 if text.startswith("﻿") else 0, len(text), 0, [(0, 0)], True

    def add(kind, a, b):
        kinds.append(kind)
        starts.append(a)
        ends.append(b)

    while pos < n:
        if fresh and not depth:
            m = _INDENT.match(text, pos)
            at = m.end()
            if at >= n:
                break
            if text[at] not in "\r\n#":
                width = short = 0  # with tabs of eight columns and of one; both must tell the same
                for c in m[0]:
                    width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
                    short = 0 if c == "\f" else short + 1
                if width > indents[-1][0] and short > indents[-1][1]:
                    indents.append((width, short))
                    add("INDENT", at, at)
                while width < indents[-1][0]:
                    indents.pop()
                    add("DEDENT", at, at)
                if (width, short) != indents[-1]:
                    add("BAD", at, at + 1)
                    return out
                fresh = False
            pos = at
        m = match(text, pos)
        if m is None:
            add("BAD", pos, pos + 1)
            return out
        kind, end = m.lastgroup, m.end()
        if kind == "nl":
            if not depth and not fresh:
                add("NEWLINE", pos, end)
                fresh = True
        elif kind == "c":
            out.comments.append((pos, end))
        elif kind != "s":
            if kind == "OP":
                kind = m[0]
                if kind in "([{":
                    depth += 1
                elif kind in ")]}":
                    depth = max(0, depth - 1)
            elif kind == "NAME" and m[0] in KEYWORDS:
                kind = m[0]
            add(kind, pos, end)
        pos = end
    if not fresh and not depth:
        add("NEWLINE", n, n)
    if not depth:
        for _ in indents[1:]:
            add("DEDENT", n, n)
    return out


GRAMMAR = Grammar(
    """
File = Stmt* ;
Stmt = Line | Compound ;
Line = Small % ';' ';'? NEWLINE ;
Small = Assignment | 'del' Plain | 'pass' | 'break' | 'continue' | 'return' Plain? | 'raise' (Test ('from' Test)?)? | ('global' | 'nonlocal') Name % ',' | 'import' Dotted % ',' | From | 'assert' Test (',' Test)? | 'type' Name TypeParams? '=' Test ;
Name = NAME | 'match' | 'case' | 'type' ;
Assignment = Plain (':' Test ('=' Value)? | AugOp Value | ('=' Value)*) | Yield ;
Value = Plain | Yield ;
Plain = ('*' Or5 | Test) % ',' ','? ;
Yield = 'yield' ('from' Test | Plain)? ;
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
Path = Name ('.' Name)* ;
Dotted = Path ('as' Name)? ;
From = 'from' (('.' | '...')* Path | ('.' | '...')+) 'import' ('*' | Alias % ',' | '(' Alias % ',' ','? ')') ;
Alias = Name ('as' Name)? ;
Compound = If | 'while' Named ':' Suite Else? | For | Try | With | Def | Class | ('@' Named NEWLINE)+ ('async'? Def | Class) | 'async' (For | With | Def) | Match ;
Suite = Line | NEWLINE INDENT Stmt+ DEDENT ;
Else = 'else' ':' Suite ;
If = 'if' Named ':' Suite ('elif' Named ':' Suite)* Else? ;
For = 'for' Plain 'in' Plain ':' Suite Else? ;
Try = 'try' ':' Suite (('except' '*'? (Test (',' Test)* ('as' Name)?)? ':' Suite)+ Else? ('finally' ':' Suite)? | 'finally' ':' Suite) ;
With = 'with' (WithItem % ',' | '(' WithItem % ',' ','? ')') ':' Suite ;
WithItem = Test ('as' StarItem)? ;
Def = 'def' Name TypeParams? '(' Params? ')' ('->' Test)? ':' Suite ;
TypeParams = '[' TypeParam % ',' ','? ']' ;
TypeParam = ('*' | '**')? Name (':' Test)? ('=' Test)? ;
Params = Param % ',' ','? ;
Param = Name (':' Test)? ('=' Test)? | '*' (Name (':' StarItem)?)? | '**' Name (':' Test)? | '/' ;
Class = 'class' Name TypeParams? ('(' Args? ')')? ':' Suite ;
Match = 'match' Star ':' NEWLINE INDENT ('case' Patterns ('if' Named)? ':' Suite)+ DEDENT ;
Patterns = Pattern (',' Pattern)* ','? ;
Pattern = '*' Name | OrPattern ('as' Name)? ;
OrPattern = Closed % '|' ;
Closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Path ('(' (KeyPattern % ',' ','?)? ')')? | '(' Patterns? ')' | '[' Patterns? ']' | '{' (MapPattern % ',' ','?)? '}' ;
KeyPattern = (Name '=')? Pattern ;
MapPattern = '**' Name | ('-'? NUM | STR+ | Path | 'None' | 'True' | 'False') ':' Pattern ;
Star = StarItem % ',' ','? ;
StarItem = '*' Or5 | Named ;
Named = Name ':=' Test | Test ;
Test = Or ('if' Or 'else' Test)? | 'lambda' LambdaParams? ':' Test ;
LambdaParams = LambdaParam % ',' ','? ;
LambdaParam = Name ('=' Test)? | '*' Name? | '**' Name | '/' ;
Or = Not (('and' | 'or') Not)* ;
Not = 'not'* Compare ;
Compare = Or5 (('<' | '>' | '==' | '>=' | '<=' | '!=' | 'not'? 'in' | 'is' 'not'?) Or5)* ;
Or5 = Factor (('|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@') Factor)* ;
Factor = ('+' | '-' | '~')* Power ;
Power = 'await'? Atom Trailer* ('**' Factor)? ;
Atom = Name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (Yield | Star | StarItem Comp)? ')' | '[' (Star | StarItem Comp)? ']' | '{' (DictItem % ',' ','? | Test ':' Test Comp | Star | StarItem Comp)? '}' ;
DictItem = Test ':' Test | '**' Or5 ;
Trailer = '(' Args? ')' | '[' Slice % ',' ','? ']' | '.' Name ;
Args = Arg % ',' ','? ;
Arg = Named Comp? | Name '=' Test | '*' Test | '**' Test ;
Slice = StarItem | Test? ':' Test? (':' Test?)? ;
Comp = ('async'? 'for' Targets 'in' Or CompIf*)+ ;
Targets = TargetItem % ',' ','? ;
TargetItem = '*'? Or5 ;
CompIf = 'if' (Or | Name ':=' Test | 'lambda' LambdaParams? ':' Test) ;
""",
    "File",
)


def failure(tokens: Tokens) -> int | None:
    return GRAMMAR.failure(tokens.kinds)
