"""Lexer and grammar of JavaScript modules.

Lexing and parsing go together: whether a slash begins a regular expression, and where a
semicolon is left out, is asked of the derivative at that place.
"""

from __future__ import annotations

import re

from skein.sources.derive import Grammar
from skein.sources.tokens import Tokens

RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield".split()
)
CONTEXTUAL = frozenset("as async from get let of set static target meta".split())
_PLAIN = RESERVED | CONTEXTUAL
_ESC = r"\\(?:\r\n|[^0-9xu]|0(?![0-9])|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\})"
_LEX = re.compile(
    rf"""(?P<nl>[\n\r\u2028\u2029]+)|(?P<s>[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<c>//[^\n\r\u2028\u2029]*|/\*.*?\*/)
    |(?P<NAME>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{{4}})(?:\w|\$|\\u[0-9a-fA-F]{{4}}|\u200c|\u200d)*)|(?P<PRIVATE>\#[^\W\d][\w$]*)
    |(?P<STR>"(?:[^"\\\n\r]|{_ESC})*"|'(?:[^'\\\n\r]|{_ESC})*')
    |(?P<NUM>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*)n?(?![\w$])|(?:0|[1-9](?:_?\d)*)n(?![\w$])|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?(?![\w$]))
    |(?P<OP>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*%&|^!~?:=.,;<>()\[\]])""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(rf"(?:[^`\\$]|\$(?!\{{)|{_ESC})*(?P<end>`|\$\{{)", re.S)
_NO_BREAK_AFTER = frozenset(["return", "break", "continue", "throw"])

_CHAIN = """
Assign{s} = Cond{s} (AssignOp Assign)? | Arrow | 'yield' ('*'? Assign)? ;
Cond{s} = Binary{s} ('?' Assign ':' Assign)? ;
Binary{s} = Unary{s} (BinOp (Unary | PRIVATE))* ;
Unary{s} = PreOp Unary | Postfix{s} ;
Postfix{s} = Left{s} ('++' | '--')? ;
Left{s} = 'new'+ (Left | '.' 'target' Suffix*) | Primary{s} Suffix* ;
"""
GRAMMAR = Grammar(
    """
Module = Item* ;
Item = Import | Export | Stmt ;
Semi = ';' | ASI ;
Import = 'import' (STR | Clause 'from' STR) ('with' Object)? Semi ;
Clause = Id (',' (Space | Named))? | Space | Named ;
Space = '*' 'as' Id ;
Named = '{' (Spec % ',' ','?)? '}' ;
Spec = Key ('as' Key)? ;
Export = 'export' ('*' ('as' Key)? 'from' STR Semi | Named ('from' STR)? Semi | 'default' (Function | 'async' Function | Class | AssignD Semi) | VarStmt | Function | 'async' Function | Class) ;
Id = NAME | 'as' | 'async' | 'from' | 'get' | 'let' | 'of' | 'set' | 'static' | 'target' | 'meta' ;
Reserved = 'await' | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'yield' ;
Word = Id | Reserved ;
Key = Word | STR | NUM | '[' Assign ']' | PRIVATE ;
Block = '{' Stmt* '}' ;
Stmt = Block | VarStmt | ';' | ExprS Semi | If | Loop | ('continue' | 'break') Id? Semi | 'return' Expr? Semi | 'throw' Expr Semi | Switch | Id ':' Stmt | Try | 'debugger' Semi | Function | 'async' Function | Class ;
VarStmt = ('var' | 'const' | 'let') Declarator % ',' Semi ;
Declarator = Target ('=' Assign)? ;
Target = Id | '{' (TargetProp % ',' ','?)? '}' | '[' (TargetElem? % ',') ']' ;
TargetProp = '...' Target | Key ':' Target ('=' Assign)? | Id ('=' Assign)? ;
TargetElem = '...' Target | Target ('=' Assign)? ;
If = 'if' '(' Expr ')' Stmt ('else' Stmt)? ;
Loop = 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' Semi? | 'for' 'await'? '(' ForHead ')' Stmt ;
ForHead = (('var' | 'const' | 'let') Declarator % ',' | Expr)? ';' Expr? ';' Expr? | (('var' | 'const' | 'let') Target | Left) ('in' Expr | 'of' Assign) ;
Switch = 'switch' '(' Expr ')' '{' (('case' Expr | 'default') ':' Stmt*)* '}' ;
Try = 'try' Block ('catch' ('(' Target ')')? Block ('finally' Block)? | 'finally' Block) ;
Function = 'function' '*'? Id? Params Block ;
Params = '(' (TargetElem % ',' ','?)? ')' ;
Class = 'class' Id? ('extends' Left)? '{' Member* '}' ;
Member = ';' | 'static' Block | 'static'? (Method | Key ('=' Assign)? Semi) ;
Method = ('get' | 'set' | 'async' '*'? | '*')? Key Params Block ;
Arrow = ('async'? Id | 'async'? Params) '=>' (Block | AssignS | Function | Class) ;
Expr = Assign % ',' ;
ExprS = AssignS (',' Assign)* ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '^=' | '|=' | '&&=' | '||=' | '??=' ;
BinOp = '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>>' | '>>>' | '+' | '-' | '*' | '/' | '%' | '**' ;
PreOp = 'delete' | 'void' | 'typeof' | 'await' | '+' | '-' | '~' | '!' | '++' | '--' ;
Suffix = '.' (Word | PRIVATE) | '?.' (Word | PRIVATE | '[' Expr ']' | Args | Template) | '[' Expr ']' | Args | Template ;
Args = '(' (('...'? Assign) % ',' ','?)? ')' ;
Basic = 'this' | 'super' | 'null' | 'true' | 'false' | Id | NUM | STR | REGEX | Template | '[' (('...'? Assign)? % ',') ']' | '(' Expr ')' | 'import' ('(' Assign (',' Assign)? ','? ')' | '.' 'meta') ;
Template = TFULL | THEAD Expr (TMID Expr)* TTAIL ;
Object = '{' (Prop % ',' ','?)? '}' ;
Prop = '...' Assign | Key ':' Assign | Id ('=' Assign)? | Method ;
PrimaryS = Basic ;
PrimaryD = Basic | Object ;
Primary = Basic | Object | Function | 'async' Function | Class ;
"""
    + _CHAIN.replace("{s}", "")
    + _CHAIN.replace("{s}", "S")
    + _CHAIN.replace("{s}", "D"),
    "Module",
)


def lex(text: str) -> tuple[Tokens, int | None]:
    """Tokens up to the failing one, and its number; the number of tokens where the text is
    truncated; None if it parses."""
    out = Tokens(text)
    kinds, starts, ends = out.kinds, out.starts, out.ends
    g, match = GRAMMAR, _LEX.match
    derive, empty = g.derive, g.empty
    state = g.begin()
    empty = g.empty
    pos, n, broken, before, depth = 0, len(text), False, "", []
    if text.startswith("#!"):
        pos = text.find("\n") % (n + 1)

    def step(state, kind):
        return state.next.get(kind) or derive(state, kind)

    while pos < n:
        c = text[pos]
        if c == "/" and not text.startswith(("//", "/*"), pos):
            as_regex = step(state, "REGEX")
            if as_regex is empty and broken and step(state, "/") is empty and step(state, "/=") is empty:
                as_regex = step(step(state, "ASI"), "REGEX")
            m = _REGEX.match(text, pos) if as_regex is not empty else None
            kind, end = ("REGEX", m.end()) if m else ("/=", pos + 2) if text.startswith("/=", pos) else ("/", pos + 1)
        elif c == "`" or c == "}" and depth and depth[-1] == "`":
            m = _TEMPLATE.match(text, pos + 1)
            if m is None:
                kind, end = "BAD", n
            else:
                more, end = m["end"] != "`", m.end()
                kind = ("THEAD" if more else "TFULL") if c == "`" else ("TMID" if more else "TTAIL")
                if kind == "THEAD":
                    depth.append("`")
                elif kind == "TTAIL":
                    depth.pop()
        elif c in "{}":
            kind, end = c, pos + 1
            if c == "{":
                depth.append("{")
            elif depth:
                depth.pop()
        else:
            m = match(text, pos)
            if m is None:
                kind, end = "BAD", pos + 1
            else:
                kind, end = m.lastgroup, m.end()
                if kind == "s":
                    pos = end
                    continue
                if kind == "nl" or kind == "c":
                    if kind == "c":
                        out.comments.append((pos, end))
                    if kind == "nl" or "\n" in m[0] or "\r" in m[0]:
                        broken = True
                        if before in _NO_BREAK_AFTER:
                            after = step(state, "ASI")
                            if after is not empty:
                                state, before = after, ""
                    pos = end
                    continue
                if kind == "OP":
                    kind = m[0]
                elif kind == "NAME" and m[0] in _PLAIN:
                    kind = m[0]
        kinds.append(kind)
        starts.append(pos)
        ends.append(end)
        after = empty
        if broken and kind in ("++", "--"):  # not after a line end
            after = step(step(state, "ASI"), kind)
        if after is empty:
            after = step(state, kind)
        if after is empty and (broken or kind == "}"):
            after = step(step(state, "ASI"), kind)
        if after is empty:
            return out, len(kinds) - 1
        state, broken, before, pos = after, False, kind, end
    if state.nullable or step(state, "ASI").nullable:
        return out, None
    return out, len(kinds)
