"""Grammar of Go."""

from __future__ import annotations

from skein.sources.derive import Grammar
from skein.sources.gotokens import lex  # noqa: F401
from skein.sources.tokens import Tokens

_EXPR = """
Expr{n} = Unary{n} (BinOp Unary{n})* ;
Unary{n} = UnOp* Primary{n} ;
Primary{n} = Operand Suffix{n}* ;
ExprList{n} = Expr{n} % ',' ;
Simple{n} = ExprList{n} (AssignOp ExprList{n} | '++' | '--' | ':=' ExprList{n} | '<-' Expr{n})? ;
"""
GRAMMAR = Grammar(
    """
File = 'package' ID ';' (Import ';')* (Top ';')* ;
Import = 'import' (ImportSpec | '(' (ImportSpec ';')* ImportSpec? ')') ;
ImportSpec = ('.' | ID)? STR ;
Top = Decl | Func ;
Decl = 'const' (ConstSpec | '(' (ConstSpec ';')* ConstSpec? ')') | 'type' (TypeSpec | '(' (TypeSpec ';')* TypeSpec? ')') | 'var' (VarSpec | '(' (VarSpec ';')* VarSpec? ')') ;
IdList = ID % ',' ;
ConstSpec = IdList (Type? '=' ExprList)? ;
VarSpec = IdList (Type ('=' ExprList)? | '=' ExprList) ;
TypeSpec = ID TypeParams? '='? Type ;
TypeParams = '[' TypeParam % ',' ','? ']' ;
TypeParam = IdList Constraint ;
Constraint = ('~'? Type) % '|' ;
Func = 'func' Params? ID TypeParams? Signature Block? ;
Signature = Params (Params | Type)? ;
Params = '(' (Param % ',' ','?)? ')' ;
Param = ID? '...'? Type ;
Type = TypeName TypeArgs? | OtherType ;
OtherType = '*' Type | Shape | '(' Type ')' ;
Shape = '[' (Expr | '...')? ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Signature | 'struct' '{' (Field ';')* Field? '}' | 'interface' '{' (Method ';')* Method? '}' ;
TypeName = ID ('.' ID)? ;
TypeArgs = '[' Type % ',' ','? ']' ;
Field = (IdList Type | '*'? TypeName TypeArgs?) STR? ;
Method = ID Signature | Constraint ;
Block = '{' Stmts '}' ;
Stmts = Stmt? (';' Stmt?)* ;
Stmt = Decl | Simple | ('go' | 'defer') Expr | 'return' ExprList? | ('break' | 'continue') ID? | 'goto' ID | 'fallthrough' | Block | If | Switch | Select | For | ID ':' Stmt? ;
If = 'if' (SimpleN? ';')? ExprN Block ('else' (If | Block))? ;
Switch = 'switch' (SimpleN? ';')? SimpleN? '{' (('case' (ExprOrType % ',') | 'default') ':' Stmts)* '}' ;
Select = 'select' '{' (('case' Simple | 'default') ':' Stmts)* '}' ;
For = 'for' (ExprN | SimpleN? ';' ExprN? ';' SimpleN? | (ExprListN (':=' | '='))? 'range' ExprN)? Block ;
BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
UnOp = '+' | '-' | '!' | '^' | '*' | '&' | '<-' ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
Operand = NUM | CHR | STR | ID | '(' ExprOrType ')' | 'func' Signature Block | Shape (Lit | '(' (Args)? ')') ;
ExprOrType = Expr | Type ;
BasicSuffix = '.' (ID | '(' (Type | 'type') ')') | '[' (ExprOrType % ',' ','? | Expr? ':' Expr? (':' Expr)?) ']' | '(' Args? ')' ;
Suffix = BasicSuffix | Lit ;
SuffixN = BasicSuffix ;
Args = ExprOrType % ',' '...'? ','? ;
Lit = '{' (Element % ',' ','?)? '}' ;
Element = Value (':' Value)? ;
Value = Expr | Lit ;
"""
    + _EXPR.replace("{n}", "")
    + _EXPR.replace("{n}", "N"),
    "File",
)


def failure(tokens: Tokens) -> int | None:
    return GRAMMAR.failure(tokens.kinds)
