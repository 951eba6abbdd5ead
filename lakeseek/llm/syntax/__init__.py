"""Syntax of source files: lexers, grammars, a generalised LL recogniser and the operator on files."""
