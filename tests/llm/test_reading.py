import random

from lakeseek.llm import reading

DOC = "doc_id long, text string, words int, doc string"
LABEL = "doc_id long, reading_level int, rater string, labelled_at string"
EASY, MID, HARD = ("cat dog ball sun red big run see".split(), "server update table report network build team record".split(), "asymptotic idempotence heterogeneous canonicalisation orthogonality presupposes commutative transitivity".split())


def text(level, rng, n=60):
    pools = (EASY, MID, HARD)
    return " ".join(rng.choice(pools[level - 1] if rng.random() < .8 else rng.choice(pools)) for _ in range(n)) + "."


def test_held_out_accuracy_with_wrong_raters(spark):
    rng = random.Random(5)
    levels = {i: rng.choice((1, 2, 3)) for i in range(240)}
    docs = spark.createDataFrame([(i, text(v, rng), 0, "x") for i, v in levels.items()], DOC)
    labels = [(i, levels[i] if rng.random() < .95 else rng.choice((1, 2, 3)), f"good{i % 3}", "") for i in range(120)] + [(i, rng.choice((1, 2, 3)), "wrong", "") for i in range(0, 120, 2)]
    labels += labels[:10] + [(None, 1, "a", ""), (3, None, "a", ""), (4, 9, "a", ""), (5, 2, None, "")]
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, spark.createDataFrame(labels, LABEL)).collect()}
    held = [i for i in levels if i >= 120]
    assert sum(got[i] == levels[i] for i in held) / len(held) > .95


def test_what_is_prose():
    assert reading.prose_words("# Title here\n\nGo and see `code here` at https://a.b/c now, user_name getName().\n\n```\nx = 1\n```\n| a | b |\n2025-01-01 10:00:00 INFO x\n") == "go and see at now".split()
    assert reading.prose_words("def f(x):\n    return x\n\nfor a in b:\n    print(a)\n") == []
    assert reading.prose_words(None) == reading.prose_words("") == reading.prose_words(" \n\r\n ") == []
    assert reading.prose_words("Über cafe\u0301 nai\u200bve") == ["über", "café", "naive"]
    assert len(reading.prose_words("a_b" * 100_000)) == 0 and len(reading.prose_words("word " * 200_000)) == 200_000


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(1, text(1, rng), 0, ""), (1, text(1, rng), 0, ""), (2, None, 0, ""), (3, "", 0, ""), (4, "only a few words", 0, ""), (None, text(3, rng), 0, "")]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(1, 1, "a", "")], LABEL)
    got = [(r.doc_id, r.reading_level) for r in reading.reading_levels(docs, labels).collect()]
    assert len(got) == 6 and {d for d, v in got if v is None} == {2, 3, 4}
    assert reading.reading_levels(docs.limit(0), labels).count() == 0
    assert reading.reading_levels(docs, labels.limit(0)).count() == 6


def test_code_lines_are_left_out_one_by_one():
    prose = "the network report moves on " * 30
    assert len(reading.prose_words(f"{prose}\n\nx = compute(1)\ny = compute(2)\n\n{prose}")) == 300
    assert len(reading.prose_words(f"{prose}\n" * 7 + "total = compute(first, second)\n")) == 7 * 150
    wrapped = "the worker writes a new report and waits\nfrom the server comes an answer to it\nformally, this constitutes a report;\nand all of it is kept\n"
    assert len(reading.prose_words(wrapped)) == 8 + 8 + 5 + 6
    assert reading.prose_words("import a from b\nfrom lib import name\nassert x is not None, \"no x here\"\nreturn all of it\n") == []
    assert len(reading.prose_words("import " + "a') " * 18 + "=\n" + prose)) == 150
