import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeseek.functions import text
from lakeseek.plans import dsl, planner


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_tokens(spark):
    got = one(spark, text.tokens(F.lit("getUserData XMLParser snake_case if the a naïve été x1")))[0]
    assert got == ["get", "user", "data", "xml", "parser", "snake", "case", "if", "naïve", "été", "x1"]


@pytest.mark.parametrize("body,query,hit", [
    ("the account is open", "account", True), ("accounts", "account", False), ("my_account", "account", False), ("ACCOUNT!", "account", True),
    ("étion", "tion", False), ("foo.bar()", ".bar(", True), ("xfoo.bar(y", ".bar(", True), ("a\\E b", "\\E", True), ("a\\Eb", "\\E", False), ("anything", "  ", False), (None, "x", False), ("", "x", False)])
def test_edge_match(spark, body, query, hit):
    assert one(spark, text.edge_match(F.lit(body).cast("string"), query))[0] is hit


def test_long_text_is_matched_as_substring(spark):
    body = F.concat(F.repeat(F.lit("x "), 30_000), F.lit("accounts"))
    assert one(spark, text.edge_match(body, "account"))[0] is True


@pytest.mark.parametrize("path,prefix,hit", [
    ("src/a.py", "src", True), ("src/a.py", "src/", True), ("a.py", "src", False), ("lib/src.py", "src", False), ("my/src/a.py", "src", True),
    ("src/main.py", "src/ma", True), ("src/abcx/a.py", "src/abc", True), ("a/b.py", "/", True), ("b.py", "/", False), ("lib/xsrc/ma.py", "src/ma", False)])
def test_path_prefix(spark, path, prefix, hit):
    assert one(spark, text.in_path(F.lit(path), prefix))[0] is hit


@pytest.mark.parametrize("path,glob,hit", [
    ("src/Test_A.py", "test_*.py", True), ("src/a.py", "a.py", True), ("src/ba.py", "a.py", False), ("x/a1.js", "a[0-9].js", True), ("x/ab.js", "a[!b].js", False), ("x/a[.js", "a[*", True)])
def test_glob(spark, path, glob, hit):
    assert one(spark, text.glob_match(F.lit(path), glob))[0] is hit


@pytest.mark.parametrize("path,name,hit", [
    ("tests/a.py", None, True), ("src/latest.py", None, False), ("src/user_test.go", None, True), ("src/a.py", "TestUser", True), ("src/contest.py", "attest", False), ("spec/x.rb", None, True)])
def test_test_scope(spark, path, name, hit):
    assert one(spark, text.is_test(F.lit(path), F.lit(name).cast("string")))[0] is hit


def test_imports(spark):
    py = "import os.path\nfrom a.b import c\nfrom .x import y\nimport os\n"
    js = "import {a} from './b';\nconst x = require('fs');\n"
    go = 'import (\n\t"fmt"\n\t"net/http"\n)\n'
    for body, language, want in ((py, "python", ["os", "a", ""]), (js, "javascript", ["./b", "fs"]), (go, "go", ["fmt", "http"]), (py, "ruby", [])):
        assert one(spark, text.imports_of(F.lit(body), F.lit(language)))[0] == want


def test_docstrings(spark):
    cases = [('#!/bin/x\n"""Hello\nthere"""\nx=1', "python", "Hello\nthere"), ("'''Hi'''", "python", "Hi"), ("/**\n * One.\n * Two.\n */\nlet x", "javascript", "One. Two."),
             ("//! Top\n//! more\nuse x;", "rust", "Top more"), ("// Says\n// it\npackage a\n", "go", "Says it"), ("x = 1", "python", None), (None, "python", None)]
    for body, language, want in cases:
        assert one(spark, text.module_docstring(F.lit(body).cast("string"), F.lit(language)))[0] == want


def test_boost_is_capped(spark):
    got = one(spark, *[text.path_boost(F.lit(p)) for p in ("src/lib/core/app/x.py", "vendor/generated/x.pb.go", "docs/x.md", "latest/x")])
    assert got == (pytest.approx(0.3), pytest.approx(-0.3), 0.0, pytest.approx(-0.1))


@pytest.mark.parametrize("query,want", [
    ("fn:handle error path:src -path:test -path:x", dict(text="error", function_name="handle", path_prefix="src", exclude_paths=("test", "x"))),
    ("Class:Foo scope:METHOD", dict(text="", class_name="Foo", scope="function")), ('"fn:foo bar"', dict(text='" bar"', function_name="foo")),
    ("fn:a fn:b", dict(text="fn:b", function_name="a")), ("file:*.py", dict(text="", file_pattern="*.py")), ("plain words", dict(text="plain words"))])
def test_parse(query, want):
    assert dsl.parse(query) == dsl.Parsed(**want)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_parse_and_expansion_never_fail(query):
    parsed = dsl.parse(query)
    planner.plan(query, parsed)
    dsl.search_text(parsed)
    dsl.pushdown_tokens(query)


def test_plans():
    kind = lambda q: planner.plan(q, dsl.parse(q)).kind
    assert [kind(q) for q in ('"a b"', "fn:x", "fn:x do it", "do it")] == ["exact_phrase", "name_only", "name_semantic", "semantic"]


def test_expansions():
    assert dsl.expand_synonyms("fn(err) => msg") == "fn function(err error exception) => msg message"
    assert dsl.expand_synonyms("err err err err err err").count("exception") == 5
    assert dsl.expand_camel("getUserData") == "getUserData get user data"
    assert dsl.infer_language("def x(self, y)") == "python" and dsl.infer_language("nothing") is None
    assert dsl.pushdown_tokens("test_*.py") == ["test", "py"] and dsl.pushdown_tokens("*a*") is None


def test_chunk_types(spark):
    names = ["method_declaration", "trait_item", "class_x_function", "zzz"]
    assert one(spark, *[text.chunk_type_of(F.lit(n)) for n in names]) == ("function", "interface", "function", "block")


def test_glob_regex_matches_fnmatch():
    import fnmatch
    for glob in ("a*b", "?x", "[ab]c", "[!a]b", "x.y", "a+b", "*"):
        for name in ("ab", "axb", "ax", "ac", "bc", "cb", "x.y", "xzy", "a+b", ""):
            assert bool(re.match(text.glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob), (glob, name)
