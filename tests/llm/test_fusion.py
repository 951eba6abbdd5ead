import random
from collections import defaultdict

from lakeseek.llm import fusion

SCHEMA = "query_id long, branch string, point_id long, point_type string, score double, rank int, fused double, query string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, "q") for r in rows], SCHEMA)


def brute(rows, k=60):
    best = {}
    for q, b, p, t, s in rows:
        if s is not None:
            best[q, b, p, t] = max(s, best.get((q, b, p, t), s))
    groups, out = defaultdict(list), defaultdict(float)
    for (q, b, p, t), s in best.items():
        groups[q, b, t].append(s)
    for (q, b, p, t), s in best.items():
        out[q, p] += 1 / (k + 1 + sum(x > s for x in groups[q, b, t]))
    return out


def test_fusion_equals_brute_force_with_a_hot_query(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < .6 else rng.randrange(2, 6), rng.choice(["dense", "sparse", "exact", None]), rng.randrange(60), rng.choice(["file", "chunk"]),
             rng.choice([None, round(rng.random(), 2), rng.gauss(0, 1e6)])) for _ in range(900)]
    rows += rows[:50]
    got = {(r.query, r.point): r.fused for r in fusion.fuse(table(spark, rows), "query_id", "point_id", "branch", "point_type", "score").collect()}
    want = brute(rows)
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    first = {r.query: r.point for r in fusion.first_of_each(fusion.fuse(table(spark, rows), "query_id", "point_id", "branch", "point_type", "score")).collect()}
    assert first == {q: min((p for (x, p) in want if x == q), key=lambda p: (-round(want[q, p], 12), p)) for q in {q for q, _ in want}}


def test_range_of_a_branch_does_not_matter(spark):
    rows = [(1, "a", 1, "file", .9), (1, "a", 2, "file", .1), (1, "b", 2, "file", 1e9), (1, "b", 1, "file", 2e9), (1, "c", 3, "chunk", float("nan"))]
    got = fusion.first_of_each(fusion.fuse(table(spark, rows), "query_id", "point_id", "branch", "point_type", "score")).collect()
    assert [(r.query, r.point) for r in got] == [(1, 1)]


def test_ties_and_empty(spark):
    rows = [(1, "a", 9, "file", 1.0), (1, "a", 4, "file", 1.0), (None, "a", 4, "file", 1.0), (2, "a", None, "file", 1.0)]
    got = fusion.first_of_each(fusion.fuse(table(spark, rows), "query_id", "point_id", "branch", "point_type", "score")).collect()
    assert [(r.query, r.point) for r in got] == [(1, 4)]
    assert fusion.fuse(table(spark, []), "query_id", "point_id", "branch", "point_type", "score").count() == 0
