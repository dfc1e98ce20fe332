"""Syntax of source files: lexers, grammars and parsing with derivatives."""
