import ast
import json
import random
import re
import sys
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeseek.llm.syntax import validity
from lakeseek.llm.syntax.gll import Grammar

GOOD = {
    "python": ["", "\ufeffx = 1\r\n", "def f(a, *, b=1, **k) -> int:\n    '''d'''\n    return [x for x in a if x]\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "x = {1: 2, **y}\nz = lambda a, b=1: a\n",
               "class A(B, m=C):\n    @p\n    async def f(self):\n        async with a as b, c:\n            yield await x\n", "match x:\n    case [1, *r] if r:\n        pass\n    case {'a': b}:\n        pass\n", "if a: b; c\nelif d:\n    e\n", "x = (1,\n  2)\ny = '''a\n b'''\n", "print('a', file=f)\n", "while 1:\n\tx[1:2, ::3] += y\n"],
    "javascript": ["const {a, b: [c]} = d;\nexport default class extends X { #p = 1; static async *m() { yield* x } get a() { return 1 } }", "let r = a / b / c\nlet q = /[/]\\/x/g.test(s) ? `a${b + `c`}` : 0", "for (const x of y) { if (x) continue\n else break }\nlabel: for (;;) {}", "import a, {b as c} from 'x';\nexport {a as default, b};\nexport * from 'y'", "x = async (a, {b}) => ({...a, [k]: 1})\n", "!function(a){a.b=1}(this);var z=void 0", "a\n++b\n", "switch (x) { case 1: f(); break; default: }"],
    "typescript": ["interface A<T> extends B { x?: number; readonly y: T[]; (a: string): void; [k: string]: any }", "type U = 'a' | { b: C } & D<E>;\nenum X { A = 1, B }\nconst f = <T,>(x: T): x is string => x as any;", "abstract class A<T> implements B { constructor(private readonly x: number) { super() }\n  abstract m(): void;\n  p!: string }", "declare module 'x' { export function f(a?: number): Promise<void>; }\nlet x = y!.z as unknown as string;"],
    "go": ["package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\ntype T[K comparable] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn\n\t} else if x == 'a' {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range ch {\n\t}\n\tswitch y := z.(type) {\n\tcase int, string:\n\t\tgo func() {}()\n\tdefault:\n\t}\n\tx := []T{{1, 2}, {A: 3}}\n\tselect {\n\tcase <-c:\n\t}\n\treturn x[1:], nil\n}\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@A(x = 1)\npublic final class X<T extends Y & Z> extends W<T> implements V {\n  private static final int[] A = {1, 2};\n  public <R> List<? super R> m(final T t, int... n) throws E { for (var x : t) { if (x instanceof String s && !s.isEmpty()) continue; }\n    try (var r = f()) { g(a -> a + 1, Foo::bar, (int) 'c'); } catch (A | B e) { throw e; } finally { }\n    return switch (n) { case 1, 2 -> null; default -> { yield x; } }; }\n  enum E { A, B(1) { }; void f() {} }\n  record P(int x) { P { } }\n}\n", "void main() { println(1); }\n"],
    "rust": ["use a::{b, c::*};\n#[derive(X)]\npub struct S<'a, T: B + 'a>(pub T, &'a str);\nimpl<'a, T> I for S<'a, T> where T: Fn(u8) -> u8 {\n    type O = Vec<Vec<T>>;\n    fn f(&mut self, x: [u8; 3]) -> Result<(), E> {\n        let Some(y) = x else { return Err(E::A { b: 1 }) };\n        match y { 0 => a()?, 1..=9 | 20 if z => b, _ => {} }\n        for i in 0..n { v.push(i as u64 >> 2); }\n        let c = move |a: u8, _| a + 1;\n        println!(\"{}\", r#\"x\"y\"#);\n        if let A(b) = c { b } else { 'l: loop { break 'l; } }\n        Ok(())\n    }\n}\n"],
    "c": ["#include <x.h>\n#define A(x) \\\n  (x)\ntypedef struct s { int a : 3; struct s *n; } t;\nstatic int (*f)(int, ...) = 0;\nint main(int argc, char **argv) {\n  int a[3] = {1, [2] = 3}, *p = &a[0];\n  for (int i = 0; i < 3; i++) switch (i) { case 1: case 2: break; default: goto end; }\n  do { p = (char *)x + sizeof(int); } while (*p++ ? 1 : 0);\nend:\n  return L'x' == \"a\" \"b\"[0];\n}\n"],
    "ruby": ["# c\nmodule A\n  class B < C::D\n    attr_reader :x, :y\n    def self.f(a, b = 1, *c, d:, **e, &g)\n      return nil unless a\n      x = { id: 1, 'k' => :v, **e }\n      a.each do |i, (j, k)|\n        puts \"#{i} #{j}\" if i > 1 && !k\n      end\n      b.map { |z| z * 2 }.select(&:ok?)\n    rescue E => e\n      raise\n    ensure\n      z\n    end\n  end\nend\n", "case x\nwhen 1, 2 then a\nelse b\nend\nwhile a do b end\ny = if a then b else c end\nz ||= [1,\n  2]\nw = <<~X\n  any ( text\nX\n"],
    "bash": ["#!/bin/sh\nset -e\nf() {\n  local x=\"$1\" y=$(g \"a)b\")\n  if [ \"$x\" -gt 3 ] && [[ $y == z* ]]; then\n    return 1\n  elif ! h; then :; else echo \"${x:-a}\" >&2; fi\n  for i in a b; do echo $i; done | sort > \"$o\"\n  case \"$1\" in\n    a|b) x=1 ;;\n    *) shift ;;\n  esac\n  while read -r l; do n=$((n + 1)); done < f\n}\nfunction g {\n  cat <<EOF\nany ( thing\nEOF\n}\n"],
    "sql": ["-- c\nCREATE TABLE IF NOT EXISTS a.b (id INTEGER PRIMARY KEY, n VARCHAR(10) NOT NULL DEFAULT 'x''y', CONSTRAINT c FOREIGN KEY (id) REFERENCES d (e) ON DELETE CASCADE);\nINSERT INTO t (a, b) VALUES (1, 'x'), (2, NULL);\nWITH q AS (SELECT a.*, COUNT(*) OVER (PARTITION BY b ORDER BY c DESC) n FROM a LEFT JOIN d ON a.i = d.i WHERE x BETWEEN 1 AND 2 OR y NOT IN (SELECT z FROM w)) SELECT CASE WHEN n > 1 THEN 'a' ELSE b END AS k FROM q GROUP BY k HAVING SUM(n) > 1 ORDER BY 1 LIMIT 5;\nUPDATE t SET a = a + 1 WHERE b IS NOT NULL; DELETE FROM t; DROP TABLE IF EXISTS t;\n"],
    "json": ["{\"a\": [1, -2.5e3, true, null, {\"b\": \"x\\u00e9\\n\"}]}", " 3 "],
    "yaml": ["a: 1\nb:\n  - x: y # c\n    z: 'q: r'\n  - \"s\"\n  -\n    - 1\nc: |\n  any: [ text\nd: [1, {e: f},\n  2]\ng: &h\n  i: *h\n---\nj: http://x:1/\nk:\n- l\n- m\n", "{\"a\": [1, 2]}\n", "plain words\n"],
}
BAD = {
    "python": ["def f(:\n", "print 'x'\n", "if a\n    b\n", "x = [1, 2\n", "try:\n    pass\nexcept A, e:\n    pass\n", "<<<<<<< HEAD\nx = 1\n=======\n", "  x = 1\n y = 2\n", "x = 'a\n", "x = \u201ca\u201d\n", "a = = 1\n", "package main\n", "1x = 2\n", "def f():\nreturn 1\n"],
    "javascript": ["let x = ;", "function f( {", "interface A { b: c }", "const x: number = 1;", "a b c", "x = {a: 1", "import os\nfrom a import b\n", "if (x {}", "<<<<<<< HEAD\n", "let s = 'a\n'"],
    "typescript": ["type A = ;", "let x: = 1;", "interface { a }", "class A { constructor( }", "package main\nfunc f() {}\n"],
    "go": ["package a\nfunc f() {", "func f() {}\n", "package a\nx := 1\n", "package a\nfunc f() { if x { }\n else { } }\n", "package a\nfunc f() { a b }\n", "package a\nimport x\n"],
    "java": ["class A { int x }", "class A { void f( { } }", "public class A { } }", "class A { void f() { int = 3; } }", "def f(): pass\n", "class A { String s = \"a; }"],
    "rust": ["fn f() { let = 1; }", "fn f( {", "struct A { b c }", "fn f() { a b }", "def f():\n    pass\n", "fn f() -> { }"],
    "c": ["int f() { return 1 }", "int f( {", "int x = ;", "#foo\n", "#if A\nint x;\n", "def f():\n    pass\n", "int main() { \"a; }"],
    "ruby": ["def f\n", "def f(a\nend\n", "end\n", "x = (1\n", "class a.b {\n", "def f\nend\nend\n", "public class A { }\n", "if x then y\n"],
    "bash": ["if x; then y\n", "f() {\n", "for x in a; do\n", "case x in\n a) b ;;\n", "echo \"a\n", "fi\n", "a | | b\n", "<<<<<<< HEAD\n", "def f(x):\n    return (x)\n"],
    "sql": ["CREAT TABLE a (b INT);", "SELECT FROM a;", "SELECT a FROM b WHERE;", "INSERT INTO a VALUES (1, ;", "SELECT a b c d FROM x;", "import a\n", "SELECT 'a"],
    "json": ["{\"a\": 1,}", "{a: 1}", "[1 2]", "{\"a\": 01}", "{\"a\"", "\"a\nb\"", "{} {}", "'a'", "NaN"],
    "yaml": ["a: b: c\n", "a: \"b\n", "a: [1, 2\n", "a:\n\t- b\n", "- a\nb: c\n", "a: @b\n", "<<<<<<< HEAD\na: 1\n", "a: 1\n  b: 2\n", "a: 'b' c\n"],
}


@pytest.mark.parametrize("lang,body", [(k, b) for k, bs in GOOD.items() for b in bs])
def test_accepts(lang, body):
    assert validity.parses(body, lang)


@pytest.mark.parametrize("lang,body", [(k, b) for k, bs in BAD.items() for b in bs])
def test_rejects(lang, body):
    assert not validity.parses(body, lang)


def test_python_agrees_with_its_own_parser_on_damaged_files():
    for body in GOOD["python"]:
        body = body.lstrip("\ufeff").replace("\r\n", "\n")
        for cut in range(len(body)):
            try:
                ast.parse(body[:cut])
                want = True
            except (SyntaxError, ValueError):
                want = False
            assert validity.parses(body[:cut], "python") == want, body[:cut]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:01tf.- \n\\', max_size=12))
def test_json_agrees_with_the_library(body):
    try:
        json.loads(body, parse_constant=lambda c: 1 / 0)
        want = True
    except (ValueError, ZeroDivisionError):
        want = False
    assert validity.parses(body, "json") == (want or not body.strip())


def test_left_recursion_and_ambiguity():
    g = Grammar("E: E '+' E | E P[E] | ID", {"ID": "I"})
    plus = g.tokens["+"]
    assert g.accepts("E", plus.join("I" * 30)) and g.accepts("E", "I" + g.fold("(I)") + plus + "I") and not g.accepts("E", "I" + plus)


def test_deep_and_long_files():
    assert validity.parses("[" * 3000 + "]" * 3000, "json") and not validity.parses("[" * 3000, "json")
    assert validity.parses("x = [" + "1, " * 100_000 + "]\n", "python")
    assert validity.parses("f(1);\n" * 20_000, "javascript")


PROBES = {
    "python": (["1 = x", "f() = 1", "a + b = c", "f(a)=b=c", "del f()", "x = yield = 1", "for 1 in x: pass", "with a as 1: pass", "(a, b): int = 1", "f(**a, *b)", "f(a=1, b)", "def f(a=1, b): pass", "def f(*): pass",
                "def f(a, /, b, /): pass", "f'{'", "f'{a b}'", "f'}'", "f'{}'", "f'{a!z}'", "0777", "'\\x'", "ur'a'", "1__0", "f(x for x in y, 1)", "'a' b'b'", "b'\u00e9'", "a == not b", "from import x"],
               ["f'{a!r:>{w}}'", "f'{x[\"a\"]}'", "f\"{x[\"a\"]}\"", "f'{{}}'", "f'{a=}'", "f'{a:%Y-%m-%d}'", "f(*a, x, k=1, *b, **c, d=2)", "def f(a, /, b=1, *, c, d=2, **e): pass", "(a, *b), [c, d.e] = x", "(x): int = 1", "00", "1_000",
                "with (a as b, c as (d, e)): pass", "del (a, [b]), c[0]", "a = b = yield x", "f(a, (b for b in c))", "f'{x:{y}.{z}}'", "1if x else y"]),
    "javascript": (["`${1 +}`", "import type {A} from 'b'", "if (x) { export let a = 1 }"], ["`a${b + `c${d}`}`", "`${a.b({c: 1})}`", "`\\${1 +}`", "return 1", "`${x ? `y` : ''}`"]),
    "ruby": (['"#{1 +}"', 'x = "a #{if}"'], ['"#{x + 1} #{y}"', '"#{a.map { |z| z }.join(", ")}"', '"\\#{1 +}"', '"#{}"']),
    "bash": (["(( 1 + ))", "[[ a == ]]", "x=$(if)", 'echo "$(a | | b)"', "[[ && a ]]"], ["(( i++ ))", "x=$((1 + 2))", "[[ $x =~ ^[a-z]+(b|c)$ ]]", "for ((i=0;i<3;i++)); do x; done", "echo '$(if)' \"$(a \"b c\")\"", "echo '\ufffd'"]),
    "yaml": (["a: &", "a: *"], ["a: '\ufffd'", "a: &x 1\nb: *x"]),
}


@pytest.mark.parametrize("lang,body,want", [(k, b, n == 1) for k, both in PROBES.items() for n in (0, 1) for b in both[n]])
def test_insides_and_forms(lang, body, want):
    assert validity.parses(body + "\n", lang) == want


def damaged(body, rng):
    """A text with one of its tokens left out, said twice or changed with the next."""
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", body)]
    k = rng.randrange(len(tokens) - 1)
    (a, b), (c, d) = tokens[k:k + 2]
    return rng.choice([body[:a] + body[b:], body[:b] + " " + body[a:b] + body[b:], body[:a] + body[c:d] + body[b:c] + body[a:b] + body[d:]])


def test_python_agrees_with_its_own_parser_on_mutated_code():
    rng, agree = random.Random(3), []
    sources = [open(random.__file__).read(), open(json.__file__).read(), *(b for b in GOOD["python"] if len(b) > 8)]
    for n in range(240):
        body = damaged(sources[n % len(sources)], rng).replace("\ufeff", "").replace("\r", "")
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(body)
            want = True
        except (SyntaxError, ValueError):
            want = False
        agree.append(validity.parses(body, "python") == want)
    assert sum(agree) / len(agree) >= 0.99


def test_long_lists_equal_the_whole_parse():
    g = Grammar("L: (E (',' E)* ','?)?\nE: ID | ID '=' ID", {"ID": "I"})
    comma, equals = g.tokens[","], g.tokens["="]
    assert g.lists["L"] and g.accepts("L", comma.join(["I", f"I{equals}I"] * 4000)) and g.accepts("L", "I" + comma) and g.accepts("L", "")
    assert not g.accepts("L", comma + "I") and not g.accepts("L", "I" + comma + comma) and not g.accepts("L", comma.join(["I"] * 50 + ["II"]))


def test_dialects_are_roots_of_one_run():
    g = Grammar("A: 'x' R\nB: 'y' R\nC: 'x' R 'z'\nR: ID*", {"ID": "I"})
    x, y, z = (g.tokens[t] for t in "xyz")
    rules = [g.rules[n] for n in "ABC"]
    assert [r.name for r in g.deriving(rules, x + "II")] == ["A"] and [r.name for r in g.deriving(rules, x + "I" + z)] == ["C"] and g.accepts(["A", "B"], y) and not g.accepts(["A", "B"], z)


def steps(run) -> int:
    """The lines that the parser itself executes: a measure of work that no machine changes."""
    count = 0

    def local(frame, event, arg):
        nonlocal count
        count += event == "line"
        return local
    before = sys.gettrace()
    sys.settrace(lambda frame, event, arg: local if frame.f_code.co_name == "_parse" else None)
    try:
        run()
    finally:
        sys.settrace(before)
    return count


def test_repetitions_take_work_in_proportion():
    def work(n):
        g = Grammar("A: (X Y?)* END\nX: ID ('+' ID)*\nY: NUM*", {"ID": "I", "NUM": "N"})
        text = (f"I{g.tokens['+']}INN" * n)
        return steps(lambda: g.accepts("A", text)), g.accepts("A", text), g.accepts("A", text + g.tokens["+"])
    (small, *_), (large, good, bad) = work(100), work(400)
    assert good and not bad and large < 4.5 * small

    def body(n, last="2"):
        return "int f() { x = " + "a + " * n + last + "; " + "}"
    few, many = (steps(lambda n=n: validity.parses(body(n), "c")) for n in (100, 400))
    assert validity.parses(body(400), "c") and not validity.parses(body(400, ""), "c") and many < 6 * few


def test_repetitions_of_what_may_be_empty_or_left_recursive():
    g = Grammar("A: (B? C*)* ID\nB: NUM END | NUM | B NUM\nC: '+'? | END\nD: A D | END | NL*", {"ID": "I", "NUM": "N", "NL": "\n"})
    plus = g.tokens["+"]
    for text, want in (("I", "AD"), ("NNI", "AD"), (f"N{plus}{plus}NI", "AD"), ("II", "D"), ("", "D"), ("\n\n", "D"), ("I\n", "D"), ("N", ""), (f"I{plus}", "")):
        assert "".join(r.name for r in g.deriving([g.rules["A"], g.rules["D"]], text)) == want, text


SCHEMA = "file_id long, collection string, rel_path string, language string, content string, parsed int"


def test_operator(spark):
    rows = [(1, "c", "a.py", "go", "x = 1\n", 0), (2, "c", "b.PY", None, "x = =\n", 0), (2, "c", "b.PY", None, "x = =\n", 0), (3, None, "c.md", "python", "x = =", 0), (4, "c", "d.json", "json", None, 0),
            (5, "c", None, "python", "x = =", 0), (6, "d", "e.yml", "yaml", "", 0), (None, "d", "f.h", "c", "int x", 0), (7, "d", "g.js", "js", "(" * 200_000, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.file_id for r in validity.unparsed_files(df).collect()} == {2, None, 7}
    rates = {(r.collection, r.language): (r.files, r.checked, r.unparsed, r.share) for r in validity.rates(df).collect()}
    assert rates["c", "python"] == (2, 2, 1, 0.5) and rates["d", "yaml"] == (1, 1, 0, 0.0)
    assert rates[None, "md"] == (1, 0, 0, None) and rates["c", None] == (1, 0, 0, None)
    assert validity.check(df.limit(0)).count() == 0
