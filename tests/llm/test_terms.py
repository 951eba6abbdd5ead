import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeseek.llm import terms

SCHEMA = "chunk_id long, content string, name string, term string, record int, n int"
CUT = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def brute(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isalpha() or c.isdecimal():
            run += c
        else:
            out += CUT.split(run)
            run = ""
    return [p for p in (x.lower() for x in out) if len(p) > 1 and not all(c.isdecimal() for c in p)]


def table(spark, rows):
    return spark.createDataFrame([(i, c, n, "x", 1, 2) for i, c, n in rows], SCHEMA)


ROWS = [(1, "getUserData XMLParser x1 12 12ab", "getUser"), (2, None, None), (3, "", ""), (4, "user user USER été Été", None), (5, "data_data", "data"), (6, "userData " * 3000, None), (6, "userData " * 3000, None)]


def test_frequencies_equal_brute_force(spark):
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(table(spark, ROWS), "chunk_id", "content").collect()}
    counts = [Counter(brute(c)) for c in {i: c for i, c, _ in ROWS}.values()]
    total = len(counts)
    for t in set().union(*counts):
        n = sum(c[t] for c in counts)
        held = sum(t in c for c in counts)
        assert got.pop(t) == (n, held, "rare" if held < 3 else "common" if held > .22 * total else None)
    assert not got


def test_distinctive_terms_equal_brute_force(spark):
    got = {(r.record, r.term): (r.n, r.records, r.score) for r in terms.distinctive_terms(table(spark, ROWS), "chunk_id", ["content", "name"]).collect()}
    counts = {i: Counter(brute(c) + brute(n)) for i, c, n in ROWS}
    total = len(counts)
    for i, c in counts.items():
        for t, n in c.items():
            held, cf = sum(t in x for x in counts.values()), sum(x[t] for x in counts.values())
            want = n * (-math.log2(held / total) + math.log2(1 - math.exp(-cf / total)))
            assert got[i, t][:2] == (n, held) and got[i, t][2] == pytest.approx(want)
    assert len(got) == sum(map(len, counts.values()))


def test_empty_and_null_keys(spark):
    assert terms.term_frequencies(table(spark, []), "chunk_id", "content").count() == 0
    assert terms.distinctive_terms(table(spark, []), "chunk_id", ["content", "name"]).count() == 0
    got = terms.distinctive_terms(table(spark, [(None, "alpha", None), (None, "alpha", None), (1, "alpha", None)]), "chunk_id", ["content"]).collect()
    assert {(r.record, r.records) for r in got} == {(None, 2), (1, 2)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abAB12_ .éß", max_size=30), min_size=1, max_size=4))
def test_cutting(spark, texts):
    got = {r.term: r.occurrences for r in terms.term_frequencies(table(spark, [(i, t, None) for i, t in enumerate(texts)]), "chunk_id", "content").collect()}
    assert got == Counter(t for x in texts for t in brute(x))
