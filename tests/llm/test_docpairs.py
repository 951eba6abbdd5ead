import pytest

from lakeseek.llm import docpairs

CHUNK = "chunk_id long, collection string, path string, language string, start_line int, content string, kind string, line int, depth int"
FILE = "collection string, path string, summary string, chunk_id long"


def found(spark, chunks, files=()):
    c = spark.createDataFrame([(i, "c", p, None, s, t, "x", 1, 2) for i, p, s, t in chunks], CHUNK)
    f = spark.createDataFrame([("c", p, s, 0) for p, s in files], FILE)
    return c, f


def pairs(spark, chunks, files=()):
    return {(r.chunk_id, r.function_name): (r.doc, r.code) for r in docpairs.function_pairs(*found(spark, chunks, files)).collect()}


PY = '''class A:
    """Holds things."""
    @dec
    def m(self, x=(1,
                   2)):
        """Adds one to x."""
        def inner():
            """Counts the rest."""
            return "def fake(): pass"
        return x

    # Says what it is for.
    @property
    def p(self):
        return 1

    def none(self):
        """TODO"""
        return 1
'''


def test_python(spark):
    got = pairs(spark, [(1, "a.py", 1, PY), (1, "a.py", 1, PY), (2, "b.py", 1, None), (3, "c.py", 1, ""), (4, "d.md", 1, "def x():\n    '''Says it all.'''\n")])
    assert set(got) == {(1, "m"), (1, "inner"), (1, "p")}
    assert got[1, "m"][1].startswith("    @dec") and got[1, "m"][1].rstrip().endswith("return x")
    assert got[1, "inner"][1].count("\n") == 2 and "purpose" not in got[1, "p"][0]


JS = '''/**
 * Reads one record { from the store.
 */
export async function readOne(a, {b}) {
  const re = /[{(]/; const s = "}"; const t = `${a}}`;
  return { x: 1 };
}

// Not next to it.

function alone() {}

class K {
  // Drops what is left.
  static drop(x) { return x; }
  /** @param x */
  tag(x) {
    if (x) { return; }
  }
  // eslint-disable-next-line
  quiet() {
  }
}
// Calls back later.
const cb = async (x) => {
  x();
};
'''


def test_braces(spark):
    got = pairs(spark, [(7, "a/x.ts", 1, JS.replace("\n", "\r\n"))])
    assert set(got) == {(7, "readOne"), (7, "drop"), (7, "cb")}
    assert got[7, "readOne"][1].endswith("}") and "alone" not in got[7, "readOne"][1]
    assert got[7, "drop"][1].strip() == "static drop(x) { return x; }"


@pytest.mark.parametrize("path,body,name", [
    ("a.go", "// Runs the thing twice.\nfunc (s *S) Run(a int) error {\n\treturn nil\n}\n", "Run"), ("a.rs", "/// Gives the total back.\n#[inline]\npub(crate) fn total(x: &'a str) -> u8 {\n    '{'\n}\n", "total"),
    ("A.java", "class A {\n    /** Keeps order. */\n    @Override\n    public List<String> keep(int[] x) throws E {\n        return null;\n    }\n}\n", "keep"), ("A.java", "class A {\n    /** Makes an empty one. */\n    public A() {\n    }\n}\n", "A"),
    ("a.h", "/* Gives the memory back. */\nstatic void *free_list(struct s *x)\n{\n    char c = '{';\n}\n", "free_list"), ("a.rb", "# Sends it off.\ndef send_it!(a)\n  a.each do |i|\n    puts i if i\n  end\nend\n", "send_it!"),
    ("a.sh", "# Moves the log away.\nfunction mv_log {\n  echo \"${x}\"\n}\n", "mv_log"), ("b.sh", "# Moves the log away.\nmv_log() {\n  :\n}\n", "mv_log")])
def test_languages(spark, path, body, name):
    got = pairs(spark, [(1, path, 1, body)])
    assert set(got) == {(1, name)} and (got[1, name][1].rstrip()[-1] in "}" or got[1, name][1].rstrip().endswith("end"))


def test_comment_in_the_chunk_before_and_file_descriptions(spark):
    chunks = [(1, "a.js", 5, "// Takes the first one.\n// And the next."), (2, "a.js", 7, "function take() {\n}"), (3, "b.js", 5, "// Takes it."), (4, "b.js", 7, "function other() {\n}"),
              (5, "c.js", 1, "/** Explains the whole file. */\nfunction first() {\n}"), (6, "d.js", 1, "/** Explains the whole file. */\nfunction first() {\n}")]
    got = pairs(spark, chunks, [("c.js", "Explains the whole file.\nDefines: fn:first"), ("d.js", None), ("a.js", None)])
    assert set(got) == {(2, "take"), (6, "first")}


@pytest.mark.parametrize("doc,name,empty", [
    ("// TODO: write", "f", True), ("/** */", "f", True), ("# ----------", "f", True), ("/// Route window.", "route_window", True), ("// routeWindow - route window", "routeWindow", True), ("// The route window function.", "routeWindow", True),
    ("/**\n * @param a\n * @returns\n */", "f", True), ("/** @param a the width */", "f", False), ('"""Args:\n    a:\n    b:\n"""', "f", True), ('"""Args:\n    a: the width\n"""', "f", False), ("// NOLINT", "f", True), ("# noqa: E501", "f", True),
    ("// let x = f(y);", "g", True), ("# <insert description>", "f", True), ("// Missing docs", "f", True), ("// Covers it.", "f", False), ("# Öffnet die Tür.", "f", False), ("// ok", "f", False), ("'''...'''", "f", True), ("// FIXME", "f", True), (None, "f", True), ("", "f", True),
    ("/** Todo lists are kept here for the user. */", "f", False)])
def test_what_says_nothing(doc, name, empty):
    assert docpairs.says_nothing(doc, name) is empty


def test_empty_and_very_long(spark):
    c, f = found(spark, [])
    assert docpairs.documented_functions(c, f).count() == 0
    body = "# Sums it all up.\ndef f():\n" + "    x = '(' + \"{\"\n" * 30_000
    assert set(pairs(spark, [(1, "a.py", 1, body), (2, None, None, "def f(): pass"), (3, "x.js", 1, "{" * 50_000), (None, "z.py", 1, "# Sums up.\ndef g(): return 1\n")])) == {(1, "f"), (None, "g")}
