import pytest

from lakeseek.llm import origin

SCHEMA = "file_id long, collection string, rel_path string, language string, content string, label string, depth int, file long"
HAND = "".join(f"def name_{w}(value, other):\n    # keeps {w}\n    if value > other:\n        return value\n    return other + len('{w}')\n\n" for w in ("apple", "brick", "cloud", "drum"))


def labels(spark, rows):
    df = spark.createDataFrame([(i, c, p, None, t, "x", 1, 2) for i, c, p, t in rows], SCHEMA)
    return {r.file_id: r.label for r in origin.origins(df).collect()}


def hand(word):
    return HAND.replace("name_", f"{word}_").replace("keeps", f"holds {word}")


def test_kinds(spark):
    rows = [(i, "c", f"src/m{i}.py", hand(f"w{i}")) for i in range(10)]
    copy = hand("lib").replace("apple", "pear")
    rows += [(20, "c", "src/a.go", "// Code generated by x. DO NOT EDIT.\npackage a\n" + "var a = 1\n" * 5), (21, "c", "src/note.py", "# this list is not generated, edit it freely\n" + hand("note")),
             (22, "c", "src/s.py", hand("str") + 'x = "// @generated, do not edit"\n'), (23, "c", "web/app.js", "var a=function(b){return b+1};" * 80), (24, "c", "src/data.py", "X = [\n" + "    1, 2, 3, 4, 55, 66,\n" * 60 + "]\n"),
             (25, "c", "a/vendor/lib/x.py", copy), (26, "d", "own/lib.py", "# Copyright (c) the lib developers. Redistribution permitted.\n# more\n" + copy), (27, "d", "src/gen.py", "".join(f"def get_{n:03}():\n    return V[{n}]\n\n" for n in range(20))),
             (28, "c", "conf/a.json", '{\n  "a": 1,\n  "b": [1, 2]\n}\n'), (29, "c", None, hand("null")), (30, None, "z.py", hand("nocoll")), (31, "c", "e.py", ""), (32, "c", "n.py", None), (20, "c", "src/a.go", "// Code generated by x. DO NOT EDIT.\npackage a\n" + "var a = 1\n" * 5)]
    got = labels(spark, rows)
    assert {i: got[i] for i in range(20, 29)} == {20: "generated", 21: "handwritten", 22: "handwritten", 23: "minified", 24: "blob", 25: "vendored", 26: "vendored", 27: "generated", 28: "handwritten"}
    assert all(got[i] == "handwritten" for i in [*range(10), 29, 30]) and 31 not in got and 32 not in got


def test_siblings_speak_for_a_weak_file(spark):
    vendored = [(i, "c", f"x/third_party/p/f{i}.c", f"/* Copyright the p authors, released under a licence */\nint v{i}(int a) {{\n    return a + {i};\n}}\n" + f"int w{i};\n" * 6) for i in range(8)]
    plain = "int helper(int a) {\n    return a * 2;\n}\n"
    got = labels(spark, [*vendored, (50, "c", "x/third_party/p/odd.c", plain), (51, "c", "x/own/odd2.c", plain.replace("helper", "other"))])
    assert got[50] == "vendored" and got[51] == "handwritten"


def brute(files):
    """Sum over all labelings of a small tree."""
    import math
    from itertools import product
    folders = sorted({"/".join(f.split("/")[:k]) for f, _ in files for k in range(len(f.split("/")))} | {""})
    parent = lambda p: p.rpartition("/")[0]
    hints = {d: [0.0] * 5 for d in folders}
    total = {n: [0.0] * 5 for n, _ in files}
    for labelling in product(range(5), repeat=len(folders)):
        at = dict(zip(folders, labelling))
        p = 1.0
        for d in folders:
            p *= math.exp(hints[d][at[d]]) * (origin.ROOT[at[d]] if d == "" else origin.FOLDER_GIVEN_PARENT[at[parent(d)]][at[d]])
        each = [[math.exp(e[l]) * origin.FILE_GIVEN_FOLDER[at[parent(n)]][l] for l in range(5)] for n, e in files]
        sums = [sum(x) for x in each]
        for k, (n, _) in enumerate(files):
            rest = p * math.prod(s for j, s in enumerate(sums) if j != k)
            for l in range(5):
                total[n][l] += rest * each[k][l]
    return {n: [x / sum(t) for x in t] for n, t in total.items()}


def test_propagation_is_exact_on_a_tree(spark):
    import math
    files = [("a/b/f", [0, 2, 0, 1, 0]), ("a/b/g", [0, -4, -7, -3, -7]), ("a/h", [0, 0, 3, 0, 0]), ("i", [0, 0, 0, 0, 1.5]), ("q/j", [0, 4, 0, 0, 0])]
    df = spark.createDataFrame([(n, "c", p.rpartition("/")[0], *map(float, e)) for n, (p, e) in enumerate(files)], "file long, collection string, folder string, e0 double, e1 double, e2 double, e3 double, e4 double")
    got = {r.file: [r[f"s{i}"] for i in range(5)] for r in origin.propagate(df).collect()}
    for n, (p, _) in enumerate(files):
        z = [math.exp(x - max(got[n])) for x in got[n]]
        assert [x / sum(z) for x in z] == pytest.approx(brute(files)[p], rel=1e-6)


def test_empty(spark):
    assert labels(spark, [(1, "c", "a.py", None)]) == {}


def test_prints():
    body = "\n".join(f"line number {i} of a text" for i in range(30))
    own = set(origin.prints(body))
    foot, middle = body + "\nand more\n", body.replace("number 15 ", "count 15 ")
    assert own & set(origin.prints("// head\n// more\n\n" + body)) and len(own & set(origin.prints(foot))) >= 0.5 * len(own) and len(own & set(origin.prints(middle))) >= 0.5 * len(own)
    assert not own & set(origin.prints(body.replace("line", "row")))
    assert origin.prints("x") == [] and origin.prints("") == [] and len(origin.prints("a line of some length\n" * 7)) == 1


def test_copies_with_edits_anywhere_and_short_ones(spark):
    lib, short = hand("lib"), "int a(int b) {\n    int c = b * 2;\n    c += b / 3;\n    c -= 4;\n    log_value(c, b);\n    check_value(c);\n    return c;\n}\n".replace("log", "trace") * 1
    rows = [(i, "c", f"src/m{i}.py", hand(f"w{i}")) for i in range(10)]
    rows += [(20, "c", "own/lib.py", lib), (21, "d", "own/lib.py", lib + "\ndef more_to_say():\n    return 1\n"), (22, "c", "own/s.c", short + "/* some more words, so that the file is no toy at all */\n"), (23, "d", "own/s.c", short + "/* some more words, so that the file is no toy at all */\n")]
    got = labels(spark, rows)
    assert all(got[i] == "vendored" for i in (20, 21, 22, 23)) and all(got[i] == "handwritten" for i in range(10))


def test_what_tools_leave_in_a_files_place():
    e = lambda p, t: max(range(5), key=lambda k: origin.evidence(p, t)[k])
    assert e("a.py", "version https://git-lfs.github.com/spec/v1\noid sha256:00ff\nsize 3\n") == origin.GEN
    assert e("a.go", "<!DOCTYPE html>\n<html><body>502</body></html>\n") == origin.GEN and e("a.html", "<!DOCTYPE html>\n<html></html>\n") == origin.HAND
    assert e("a.js", "PK\x03\x04" + "\x00\x11ab" * 40) == origin.BLOB


@pytest.mark.parametrize("mark", ["Output of the schema compiler.", "Run make to regenerate this file", "Don't edit by hand.", "This header was emitted by idlc", "Manual edits will be overwritten", "maschinell erzeugt", "<auto-generated/>", "must not be edited"])
def test_marks_of_tools(mark):
    assert origin.evidence("a.c", f"/* {mark} */\nint a;\n")[origin.GEN] == 8.0


def test_the_whole_opening_comment_is_read():
    licence = "".join(f"// line {i} of a long licence\n" for i in range(60))
    heads = [licence + "\n// Code generated by x. DO NOT EDIT.\npackage a\n", "/*\nGenerated by x\n*/\nint a;\n", "<!--\n\nGenerated by x\n-->\n<p>\n", '"""\nNames.\n\nGenerated by x\n"""\nA = 1\n',
             "=begin\nGenerated by x\n=end\na = 1\n", "/* one */ /* Generated by x */\nint a;\n"]
    assert [origin.evidence("a", h)[origin.GEN] for h in heads] == [8.0] * len(heads)
    code = ["/*\nnames\n*/ int a; // Generated by x\n", '"""Names."""\nA = "Generated by x"\n', "/**/\nint a;\n/* Generated by x */\n", "// a\nint a;\n// Generated by x\n"]
    assert [origin.evidence("a", c)[origin.GEN] for c in code] == [origin.UNMARKED[origin.GEN]] * len(code)
    assert origin.head_comment(["/**", " * A.", " */", "", "# b", "code", "# c"]) == ["", "A.", "", "b"]
    assert len(origin.head_comment(["/**/" * 100_000])) == 100_000
