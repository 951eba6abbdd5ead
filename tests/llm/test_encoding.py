import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeseek.llm import encoding, packing

pytestmark = pytest.mark.skipif(not os.path.isdir(encoding.FOLDER), reason="no tokenizers")
SCHEMA = "doc_id long, text string, ids string, key string, source string"
HARD = ["", None, " ", "\n\n\n", "Hello  world's 3rd café\t\n", "<|endoftext|> <s>", "a" * 5000, "あ" * 700, "é\u0301x", "\r\n mixed\rends\n", "x" * 90 + " " * 300 + "12 34", "'s'll don't'", "🙂👩‍👩‍👧", "1" * 999 + "a" * 999]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", s) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(os.path.join(encoding.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (64, 16), (7, 3)])
def test_ids_equal_another_library(spark, whole, chunk, overlap):
    rows = [(i, t, "s") for i, t in enumerate(HARD)] + [(99, " ".join(t for t in HARD if t) * 3, "s"), (99, " ".join(t for t in HARD if t) * 3, "s"), (None, "null key, long " * 9, "s"), (None, "other null key " * 9, "s")]
    got = sorted(((r.key, tuple(r.ids)) for r in encoding.encode_corpus(table(spark, rows), chunk=chunk, overlap=overlap).collect()), key=str)
    assert got == sorted(((i, tuple(whole(t))) for i, t, _ in rows), key=str)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab 1'\n.é", min_size=1, max_size=120), min_size=1, max_size=3))
def test_stitching(spark, whole, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.key: r.ids for r in encoding.encode_corpus(table(spark, rows), chunk=9, overlap=4).collect()}
    assert got == {i: whole(t) for i, t, _ in rows}


def test_round_trip():
    for t in HARD:
        assert encoding.decode(encoding.encode_all([t or ""], "byte_bpe_50k")[0]) == (t or "")


def test_empty_table(spark):
    assert encoding.encode_corpus(table(spark, [])).count() == 0


# ---- packing ----------------------------------------------------------------

BUDGETS = "budget string, tokenizer string, capacity int"


def test_best_fit_keeps_to_capacity():
    sizes = [5, 3, 8, 1, 0, 7, 2, 8, 4]
    place = packing.best_fit(sizes, 8)
    loads = [sum(s for s, p in zip(sizes, place) if p == c) for c in set(place)]
    assert max(loads) <= 8 and len(loads) == 5


def test_every_document_is_packed(spark, whole):
    rows = [(i, "word " * ((i * 37) % 90), ["a", "b", None][i % 3] if i % 2 else "hot") for i in range(400)] + [(1000, None, "a"), (1001, "", "b"), (1002, "long text " * 2000, "c")]
    budgets = spark.createDataFrame([("s", "byte_bpe_50k", 64), ("l", "byte_bpe_50k", 500), ("s", "byte_bpe_50k", 64), ("none", "byte_bpe_50k", None)], BUDGETS)
    got = packing.pack_corpus(table(spark, rows), budgets, containers=8).collect()
    sizes = {i: len(whole(t)) for i, t, _ in rows}
    for budget, capacity in (("s", 64), ("l", 500)):
        own = [r for r in got if r.budget == budget]
        by_doc, by_box = {}, {}
        for r in own:
            by_doc.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
            by_box[r.container_id] = by_box.get(r.container_id, 0) + r.n_tokens
        assert set(by_doc) == set(sizes) and max(by_box.values()) <= capacity
        for doc, parts in by_doc.items():
            parts.sort()
            assert sum(n for _, n in parts) == sizes[doc] and all(b[0] == a[0] + a[1] for a, b in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-sizes[doc] // capacity))
        assert sum(sizes.values()) / (len(by_box) * capacity) > .85
    assert packing.pack_corpus(table(spark, []), budgets).count() == 0
    assert packing.pack_corpus(table(spark, rows), budgets.limit(0)).count() == 0


def test_windows_hold_the_mixture(spark):
    rows = [(i, "word " * (20 + i % 5), "big" if i % 10 else "small") for i in range(2000)]
    budgets = spark.createDataFrame([("s", "byte_bpe_50k", 128)], BUDGETS)
    got = packing.pack_corpus(table(spark, rows), budgets, containers=16).toPandas()
    got["window"] = got.container_id.str.split("-").str[0].astype(int)
    share = got[got.source == "small"].groupby("window").n_tokens.sum() / got.groupby("window").n_tokens.sum()
    assert (share.iloc[:-1] - .1).abs().max() < .03
