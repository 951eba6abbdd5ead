import os
import subprocess
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeseek import api, render
from lakeseek.operators import catalog, changes, chunking, points, ranking, retrieve
from lakeseek.plans import planner
from lakeseek.sources import files, ignore, notebook
from lakeseek.streaming import ingest

POINT = ("collection string, point_id long, point_type string, path string, language string, summary string, line_count int, chunk_type string, name string, "
         "start_line int, end_line int, content string")


def corpus(spark, rows):
    base = dict(collection="c", point_type="chunk", language="python", summary=None, line_count=None, chunk_type="function", name=None, start_line=1, end_line=2, content=None)
    names = [f.split()[0] for f in POINT.split(", ")]
    return spark.createDataFrame([tuple((base | dict(point_id=i) | r).get(n) for n in names) for i, r in enumerate(rows)], POINT)


def test_exact_tiers_boost_and_normalisation(spark):
    p = corpus(spark, [dict(path="src/a.py", name="init"), dict(path="tests/b.py", content="call init now"), dict(path="x/c.py", summary="init it", point_type="file"),
                       dict(path="x/d.py", content="initial"), dict(path="vendor/e.py", name="init", content="init"), dict(path="z/n.py")])
    got = planner.search(p, '"init"', 10).collect()
    assert [r.point_id for r in got] == [0, 4, 2, 1]
    assert got[0].score == 1.0 and got[1].score == pytest.approx(2.75 / 3.1, abs=1e-5)
    assert planner.search(p.limit(0), '"init"', 10).count() == 0


def test_name_and_semantic_search(spark):
    p = corpus(spark, [dict(path="src/a.py", name="readQueue", content="reads the queue of accounts"), dict(path="src/b.py", name="write", content="queue queue account"), dict(path="c.py", content="other")])
    assert [r.point_id for r in planner.search(p, "fn:queue", 5).collect()] == [0]
    assert [r.point_id for r in planner.search(p, "fn:write account queue", 5).collect()] == [1]
    got = planner.search(p, "account queue", 5).collect()
    assert {r.point_id for r in got} == {0, 1} and got[0].degraded in (True, False)


def test_find_references_and_similar(spark):
    p = corpus(spark, [dict(path="a.py", name="load", content="def load(): pass"), dict(path="b.py", content="x = load()"), dict(path="c.py", content="reload()")])
    assert [r.point_id for r in api.find_references(p, "load").collect()] == [1]
    both = api.find_references(p, "load", include_definition=True).collect()
    assert [r.point_id for r in both] == [0, 1] and both[0].content.startswith("[DEFINITION] ")
    assert [r.point_id for r in api.find_similar(p, "x = load()").collect()] == [0]


def test_dense_batch_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)] + [(1000, None, 0), (1001, [0.0] * 8, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = retrieve.dense_batch(v, v.where("vec_id % 50 = 0"), 5, block=7).collect()
    m = {i: np.array(e, dtype=np.float32).astype(float) for i, e, _ in rows if e}
    for q in (i for i in m if i % 50 == 0):
        score = lambda i: round(float(m[i] @ m[q] / ((np.linalg.norm(m[i]) or 1) * (np.linalg.norm(m[q]) or 1))), 6) + 0.0  # noqa: B023, E731
        want = sorted(m, key=lambda i: (-score(i), i))[:5]
        assert [r.point_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    sliced = retrieve.dense_batch(v, v.where("vec_id % 50 = 0"), 5, max_query_mb=0).count()
    assert sliced == len(got)
    assert retrieve.dense_batch(v, v.limit(0), 5).count() == 0


def test_rrf_and_merge(spark):
    a = spark.createDataFrame([(1, .9), (2, .8)], "point_id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "point_id long, score double")
    got = {r.point_id: r.score for r in retrieve.weighted_rrf(a, b).collect()}
    assert got == {1: round(1 / 61, 8), 2: round(1 / 62 + .8 / 61, 8), 3: round(.8 / 62, 8)}
    p = corpus(spark, [dict(path="a", start_line=None, point_type="file"), dict(path="a", start_line=None), dict(path="b", start_line=3)]).withColumn("score", F.lit(1.0))
    assert [r.point_id for r in ranking.merged([p, p]).orderBy("list", "pos").collect()] == [0, 2]


@pytest.mark.parametrize("seed", range(3))
def test_merge_small_column_equals_fold(spark, seed):
    rng = np.random.default_rng(seed)
    at, rows = 1, []
    for _ in range(12):
        n = int(rng.integers(1, 12))
        rows.append(dict(chunk_type=["block", "function"][int(rng.integers(0, 4) == 0)], start_line=at, end_line=at + n - 1, name=None, content="x", context=None))
        at += n + int(rng.integers(0, 4))
    want = [(c["chunk_type"], c["start_line"], c["end_line"]) for c in chunking.merge_small(rows)]
    df = spark.createDataFrame([([(r["chunk_type"], r["start_line"], r["end_line"]) for r in rows],)], "c array<struct<chunk_type:string,start_line:int,end_line:int>>")
    assert [tuple(x) for x in df.select(chunking.merge_small_column(F.col("c")).alias("m")).first()["m"]] == want


def test_line_windows_cover_all_lines(spark):
    for n, (size, overlap) in product((0, 1, 39, 40, 41, 75, 76, 300), ((40, 5), (7, 3))):
        body = "\n".join(map(str, range(n)))
        rows = chunking.line_windows(spark.createDataFrame([(1, body), (2, None)], "id long, t string"), "id", "t", size, overlap).orderBy("ordinal").collect()
        lines = max(1, n)
        assert rows[0].start_line == 1 and rows[-1].end_line == lines
        assert all(b.start_line == a.end_line - overlap + 1 for a, b in zip(rows, rows[1:]))


def test_python_chunks():
    body = "import os\n\n@dec\ndef f(x):\n    return x\n\nclass A:\n    def m(self):\n        pass\n"
    got = [(c["chunk_type"], c["name"], c["start_line"], c["end_line"]) for c in chunking.chunk(body, "python")]
    assert got == [("function", "f", 3, 5), ("class", "A", 7, 9)]
    big = "class B:\n    'says'\n" + "".join(f"    def m{i}(self):\n        return {i}\n\n" for i in range(30))
    kinds = chunking.chunk(big, "python")
    assert kinds[0]["chunk_type"] == "class_overview" and "... and 10 more methods" in kinds[0]["content"] and kinds[1]["context"] == "class:B" and len(kinds) == 31


@pytest.mark.parametrize("language,body,names", [
    ("go", "package a\n\nfunc (s *S) Run() {\n}\n\ntype T struct {\n}\n", ["Run", "T"]), ("rust", "pub fn a() {\n}\nimpl B {\n}\n", ["a", "B"]),
    ("javascript", "export const f = (x) => {\n};\nfunction g() {\n}\n", ["f", "g"]), ("java", "package x;\npublic class C {\n  void m() {}\n}\n", ["C"]),
    ("c", "static int h(int a) {\n  return a;\n}\n", ["h"]), ("ruby", "def r(a)\n  a\nend\n", ["r"]), ("yaml", "a: 1\n", [None]), ("python", "def broken(:\n", [None])])
def test_names(language, body, names):
    assert [c["name"] for c in chunking.chunk(body, language)] == names


def test_chunks_survive_a_bad_file(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x = 1", "python"), (2, None, "python"), (3, "", None)], "file_id long, content string, language string")
    assert {r.file_id for r in chunking.chunks(df).collect()} == {1, 3}


def test_change_truth_table(spark):
    schema = "collection string, path string, hash string, mtime double, size long"
    old = [("c", p, h, t, s) for p, h, t, s in (("gone", "1", 1., 9), ("same", "1", 1., 9), ("big", "1", 1., 9), ("touched", "1", 1., 9), ("moved", "1", 1., 9), ("zero", "1", 0., 9), ("lost", "1", 1., 9), ("n.ipynb", "1", 1., 9))]
    new = [("c", p, h, t, s) for p, h, t, s in (("new", "1", 1., 9), ("same", "2", 1., 9), ("big", "1", 2., 99), ("touched", "1", 2., 9), ("moved", "2", 2., 9), ("zero", "2", 0., 9), ("lost", None, 1., 9), ("n.ipynb", "1", 2., 99))]
    got = {r.path: r.status for r in changes.changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {"gone": "deleted", "new": "added", "same": "unchanged", "big": "modified", "touched": "unchanged", "moved": "modified", "zero": "modified", "lost": "deleted", "n.ipynb": "unchanged"}


def test_vocabulary_add_then_remove_is_inverse(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1)], "token string, df long")
    rows = spark.createDataFrame([("a",), ("z",)], "token string")
    none = rows.limit(0)
    there = changes.applied(df, changes.vocabulary_delta(none, rows))
    assert {(r.token, r.df) for r in there.collect()} == {("a", 4), ("b", 1), ("z", 1)}
    back = changes.applied(there, changes.vocabulary_delta(rows, none))
    assert {(r.token, r.df) for r in back.collect()} == {("a", 3), ("b", 1)}


def test_snapshots_and_failed_writes(spark, tmp_path):
    store = catalog.SnapshotStore(spark, f"file://{tmp_path}/s")
    p = corpus(spark, [dict(path="a"), dict(path="b")])
    assert store.read() is None and store.write(p) == 1
    with pytest.raises(Exception):
        store.write(p.withColumn("x", F.raise_error(F.lit("no"))))
    assert store.version() == 1 and store.read().count() == 2
    store.upsert(p.where("path = 'a'").withColumn("name", F.lit("new")), ["path"])
    assert {(r.path, r.name) for r in store.read().collect()} == {("a", "new"), ("b", None)}
    store.delete_paths(spark.createDataFrame([("a",)], "path string"))
    assert [r.path for r in store.read().collect()] == ["b"]


def test_verdicts(spark):
    known = spark.createDataFrame([("codesearch_0123456789ab", "/a"), ("codesearch_0123456789ac", "/b"), ("codesearch_0123456789ad", None), ("other", "/a"), ("codesearch_0123456789ae", "/d")], "collection string, codebase_path string")
    there = spark.createDataFrame([("/a", True), ("/b", False), ("/d", None)], "codebase_path string, present boolean")
    got = {r.collection[-2:]: r.verdict for r in catalog.verdicts(known, there).collect()}
    assert got == {"ab": "valid", "ac": "orphan", "ad": "skip", "er": "skip", "ae": "skip"}


def test_ids(spark):
    r = spark.range(1).select(points.collection_id(F.lit("/a/b/")).alias("a"), points.collection_id(F.lit("/a/b")).alias("b"), points.point_uuid(F.lit("file:x")).alias("u")).first()
    assert r.a == r.b and len(r.u) == 36


@pytest.fixture
def tree(tmp_path):
    put = lambda name, body: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(body))
    for name, body in {"a.py": "def f():\n    return 1\n", "src/b.ts": "export const g = (x) => x;\n", "src/skip.log": "x", "node_modules/x.js": "1", ".hidden/y.py": "1", "sub/keep.py": "y = 1\n", "sub/drop.py": "z = 1\n",
                       "empty.py": "", "nb.ipynb": '{"cells": [{"cell_type": "markdown", "source": "t"}, {"cell_type": "code", "source": ["a\\n", "b"]}]}', "gen/x.py": "1\n", ".gitignore": "gen/\n*.tmp\nsub/*\n", "sub/.gitignore": "!keep.py\n"}.items():
        put(name, body)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    return tmp_path


def test_walk_and_discover(spark, tree):
    want = {"a.py", "src/b.ts", "sub/keep.py", "nb.ipynb"}
    rows = {r.rel_path: r for r in files.discover(spark, str(tree)).collect()}
    assert set(rows) == want == {r.rel_path for r in files.scan(spark, str(tree)).collect()}
    assert rows["nb.ipynb"].content == "# %% [cell 2]\na\nb" and rows["a.py"].line_count == 3
    assert [r.rel_path for r in files.read_paths(spark, str(tree), ["a.py", "../x.py", "link.py", "empty.py", "no.py"]).collect()] == ["a.py"]
    assert {"a.py", "src/b.ts"} <= {r.rel_path for r in files.discover_distributed(spark, str(tree)).collect()}


@pytest.mark.parametrize("text,path,folder,hit", [
    ("*.log", "a/b.log", False, True), ("/a", "x/a", False, False), ("/a", "a", False, True), ("b/", "x/b", True, True), ("b/", "x/b", False, False), ("a/**/c", "a/x/y/c", False, True),
    ("a/**/c", "a/c", False, True), ("**/t", "x/y/t", False, True), ("*.py\n!k.py", "k.py", False, False), ("a?c", "abc", False, True), ("[ab].x", "b.x", False, True), ("# c\n\\#d", "#d", False, True), ("docs/*.md", "docs/x/y.md", False, False)])
def test_ignore_rules(text, path, folder, hit):
    assert ignore.ignored({"": ignore.rules(text)}, path, folder) is hit


@pytest.mark.parametrize("raw", ["", "{", "[]", '{"cells": 3}', '{"cells": [1, {"cell_type": "code"}]}', '{"worksheets": [{"cells": []}]}'])
def test_malformed_notebooks(raw):
    assert notebook.code(raw) == ""


def test_old_notebooks():
    assert notebook.code('{"worksheets": [{"cells": [{"cell_type": "code", "input": "x"}]}]}') == "# %% [cell 1]\nx"


@pytest.mark.parametrize("since", ["--output=x", "a..b", "3.days.agoo", "5.ago", "x;y", ""])
def test_refused_since(since):
    with pytest.raises(ValueError):
        files.valid_since(since)


def test_changed_since(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("1")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "b.py").write_text("1")
    git("add", ".")
    git("commit", "-qm", "two")
    (tmp_path / "a.py").write_text("2")
    assert files.changed_since(str(tmp_path), "HEAD~1") == ["a.py", "b.py"]
    assert files.changed_since(str(tmp_path), "1.days.ago") == ["a.py", "b.py"]


def test_engine_indexes_incrementally(spark, tree, tmp_path_factory):
    engine = api.Engine(spark, f"file://{tmp_path_factory.mktemp('e')}")
    assert engine.index(str(tree))["added"] == 4
    assert engine.index(str(tree)) == {"added": 0, "modified": 0, "deleted": 0}
    first = engine.search('"f"', str(tree))
    assert "a.py" in first and engine.search('"f"', str(tree)) == first
    (tree / "a.py").write_text("def other():\n    return 2\n")
    (tree / "src/b.ts").unlink()
    assert engine.index(str(tree)) == {"added": 0, "modified": 1, "deleted": 1}
    assert engine.search('"f"', str(tree)) == "No results found."
    assert engine.status(str(tree))["files"] == 3 and engine.preview(str(tree))["files"] == 3
    with pytest.raises(ValueError):
        engine.delete("a", "b")
    assert engine.delete(str(tree)) and engine.status(str(tree))["files"] == 0


def test_stream_ingest_repeats_nothing(spark, tree, tmp_path):
    root = str(tmp_path / "out")
    for _ in range(2):
        query = ingest.ingest(ingest.file_stream(spark, f"{tree}/src", 1), root, "c")
        query.awaitTermination(120)
    rows = catalog.SnapshotStore(spark, f"{root}/points").read().collect()
    assert [os.path.basename(r.path) for r in rows] == ["b.ts"]


def test_search_multiple_and_render(spark):
    p = corpus(spark, [dict(path="src/a.py", name="init"), dict(path="src/b.py", name="init", collection="d"), dict(path="lib/c.py", content="init", collection="d")])
    grouped = api.search_multiple(p, '"init"', ["c", "d"])
    assert [len(df.collect()) for df in grouped.values()] == [1, 2]
    fused = api.search_multiple(p, '"init"', ["c", "d"], global_ranking=True).collect()
    assert [r.point_id for r in fused] == [0, 1, 2]
    rows = [r.asDict() for r in grouped["c"].collect()]
    assert "src/a.py" in render.results(rows) and "```" in render.results(rows, "markdown") and '"score": 1.0' in render.results(rows, "json")
    assert render.results([]) == "No results found." and render.results([], "json") == "[]"


def test_plans_stay_in_the_jvm_and_push_down(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    from lakeseek.queries import retrieval
    plan = retrieval.corpus(spark, d).where(F.col("point_type") == "chunk").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    top = retrieval.exact_phrase_topk(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "Python" not in top and "CartesianProduct" not in top
    assert "WindowGroupLimit" in retrieval.exact_per_collection(spark, d)._jdf.queryExecution().executedPlan().toString()
