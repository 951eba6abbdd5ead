import pytest

from lakeseek import api
from lakeseek.operators import embedding, retrieve
from lakeseek.plans import planner


@pytest.fixture
def codebase(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def load_queue(x):\n    return x\n")
    (tmp_path / "src/b.py").write_text("def store_account(y):\n    return y\n")
    return tmp_path


def test_embedding_registry_guards_and_orphans(spark, codebase, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('engine')}"
    engine = api.Engine(spark, root, embedding.hashed_words(16), "words-16")
    message, error = engine.auto_index(str(codebase))
    assert error is None and "2 files" in message
    points, vectors = engine.store.read(), engine.vectors.read()
    assert points.count() == vectors.count() == 4
    assert "src/a.py" in engine.search("load queue", str(codebase))
    (codebase / "src/a.py").write_text("def load_all(x):\n    return x\n")
    engine.index(str(codebase))
    assert engine.vectors.read().count() == engine.store.read().count()
    row = engine.collections().first()
    assert (row.verdict, row.embedding_model) == ("valid", "words-16")
    with pytest.raises(embedding.ModelMismatch):
        api.Engine(spark, root, embedding.hashed_words(16), "other").index(str(codebase))
    with pytest.raises(embedding.DimensionMismatch):
        api.Engine(spark, root, embedding.hashed_words(8), "words-16").index(str(codebase))
    assert engine.cleanup_orphans() == {}
    codebase.rename(codebase.with_name("moved"))
    assert list(engine.cleanup_orphans().values()) == ["deleted"]
    assert engine.collections().count() == 0 and engine.store.read().count() == 0
    assert engine.auto_index("/no/such/place")[1] is None


def test_model_is_filled_in_only_where_missing():
    assert embedding.check_model(None, "a") and not embedding.check_model("a", "a") and not embedding.check_model("a", None)


def test_errors_name_their_causes():
    try:
        try:
            raise KeyError("inner")
        except KeyError as e:
            raise ValueError() from e
    except ValueError as e:
        assert api.described(e) == "ValueError <- KeyError: 'inner'"


def test_fuzzy_words(spark):
    schema = "collection string, point_id long, point_type string, path string, summary string, content string"
    points = spark.createDataFrame([("c", 1, "chunk", "a", None, "account queue"), ("c", 2, "chunk", "b", None, "other words")], schema)
    assert planner.known_tokens(points, ["acount", "queue", "zzzzzz"]) == ["account", "queue"]
    assert planner.known_tokens(points, []) == []


def test_a_long_chunk_is_indexed_to_its_end(spark, codebase, tmp_path_factory):
    lines = "".join(f"    int field{i} = {i};\n" for i in range(2_000))
    (codebase / "src/Big.java").write_text(f"class Big {{\n{lines}    // the zyzzyva marker\n}}\n")
    embedder = embedding.hashed_words(16)
    engine = api.Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}", embedder, "words-16")
    engine.index(str(codebase))
    points = engine.store.read()
    big = points.where("path = 'src/Big.java' and point_type = 'chunk'").collect()
    assert len(big) == 1 and 30_000 < len(big[0].content) < 50_000 and "zyzzyva" in big[0].content
    assert "Big.java" in engine.search('"the zyzzyva marker"', str(codebase))
    assert retrieve.document_frequency(points).where("token = 'zyzzyva'").first().df == 1
    vector = engine.vectors.read().where(f"vec_id = '{big[0].point_id}'").first().embedding
    assert vector == pytest.approx(embedder([big[0].content])[0], abs=1e-6)
