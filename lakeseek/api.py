"""The operations of the engine as functions and one class."""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections import OrderedDict
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek import render
from lakeseek.functions import text
from lakeseek.operators import catalog, changes, embedding, filters, indexing, ranking, retrieve
from lakeseek.plans import dsl, planner
from lakeseek.session import ship
from lakeseek.sources import files as sources

SEARCH_LIMIT, REFERENCE_LIMIT, MAX_PUSHED_PATHS = 10, 20, 500


def checked_limit(limit: int | None, default: int = SEARCH_LIMIT) -> int:
    return limit if limit and limit > 0 else default


def find_similar(points: DataFrame, code: str, limit: int = SEARCH_LIMIT, language: str | None = None, exclude_self: bool = True,
                 vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """Chunks like a snippet; the snippet itself is left out."""
    pool = filters.pushed(points, "chunk", language)
    found, _ = planner.hybrid(pool, code, vectors, query_vector, checked_limit(limit) + 5)
    if exclude_self:
        own = F.regexp_replace(F.lower("content"), r"^\s+|\s+$", "")
        found = found.where(~own.eqNullSafe(F.lit(code.strip().lower())))
    return ranking.top(found, checked_limit(limit))


def find_references(points: DataFrame, symbol: str, limit: int = REFERENCE_LIMIT, include_definition: bool = False) -> DataFrame:
    """Chunks that mention a symbol, in order of id; its definitions only on request, marked."""
    hits = retrieve.exact(points.where(F.col("point_type") == "chunk"), symbol, None, ranked=False)
    defines = F.coalesce(F.lower("name") == symbol.lower(), F.lit(False))
    mentions = F.coalesce(F.col("content").contains(symbol), F.lit(False)) | F.coalesce(F.col("name").contains(symbol), F.lit(False))
    kept = hits.where(mentions) if include_definition else hits.where(mentions & ~defines)
    marked = kept.withColumn("content", F.when(defines, F.concat(F.lit("[DEFINITION] "), F.coalesce("content", F.lit("")))).otherwise(F.col("content")))
    return marked.orderBy("point_id").limit(checked_limit(limit, REFERENCE_LIMIT))


def search_changed(points: DataFrame, query: str, changed: list[str] | DataFrame, limit: int = SEARCH_LIMIT, **options) -> DataFrame:
    """A search among changed paths only."""
    return planner.search(points, query, checked_limit(limit), paths=changed, **options)


def search_multiple(points: DataFrame, query: str, collections: list[str], limit: int = SEARCH_LIMIT, global_ranking: bool = False, **options):
    """Results by collection in the order asked for, or one fused ranking of all."""
    each = {c: planner.search(points.where(F.col("collection") == c), query, checked_limit(limit), **options) for c in collections}
    if not global_ranking:
        return each
    lists = [ranking.merged([df]).withColumn("source", F.lit(c)).withColumn("number", F.lit(n)).withColumnRenamed("pos", "rank") for n, (c, df) in enumerate(each.items())]
    whole = lists[0]
    for df in lists[1:]:
        whole = whole.unionByName(df)
    return ranking.fused_across(whole, "number", F.col("source"), checked_limit(limit))


def described(error: BaseException, most: int = 4) -> str:
    """An error and what caused it, never empty."""
    out, seen = [], error
    while seen is not None and len(out) < most:
        out.append(f"{type(seen).__name__}: {seen}".rstrip(": "))
        seen = seen.__cause__ or seen.__context__
    return " <- ".join(out)


class Engine:
    """Corpora under one folder: index, search, inspect and remove them.

    With an ``embedder`` (texts to vectors) and its ``model`` name, points get
    dense vectors and searches are hybrid; without, they are sparse and exact.
    """

    REGISTRY = "collection string, codebase_path string, embedding_model string, embedding_dim int, updated_at timestamp"

    def __init__(self, spark: SparkSession, root: str, embedder: embedding.Embedder | None = None, model: str | None = None, ttl: float = 300.0, cache_size: int = 100):
        self.spark, self.root, self.embedder, self.model = spark, root, embedder, model
        self.store = catalog.SnapshotStore(spark, f"{root}/points")
        self.vectors = catalog.SnapshotStore(spark, f"{root}/vectors")
        self.registry = catalog.SnapshotStore(spark, f"{root}/collections")
        self.ttl, self.cache_size, self.cache = ttl, cache_size, OrderedDict()

    def collection(self, path: str) -> str:
        return "codesearch_" + hashlib.sha256(str(Path(path).resolve()).encode()).hexdigest()[:12]

    def index(self, path: str, force: bool = False) -> dict[str, int]:
        """Bring a corpus up to date: only new or changed files are chunked."""
        own = self.collection(path)
        self._guard(own)
        disk = sources.discover(self.spark, path).withColumn("collection", F.lit(own)).withColumn("file_id", F.xxhash64("rel_path")).persist()
        try:
            old = self.store.read()
            if old is None or force:
                fresh, gone, counts = disk, None, {"added": disk.count(), "modified": 0, "deleted": 0}
            else:
                indexed = old.where((F.col("collection") == own) & (F.col("point_type") == "file")).select(
                    "collection", "path", F.col("file_hash").alias("hash"), F.lit(0.0).alias("mtime"), F.lit(0).alias("size"))
                now = disk.select("collection", F.col("rel_path").alias("path"), F.col("content_hash").alias("hash"), "mtime", F.col("size_bytes").alias("size"))
                status = changes.changes(indexed, now.withColumn("mtime", F.lit(0.0)).withColumn("size", F.lit(0))).persist()
                counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
                gone = status.where(F.col("status").isin("modified", "deleted")).select("collection", "path")
                fresh = disk.join(status.where(F.col("status").isin("added", "modified")).select("collection", F.col("path").alias("rel_path")), ["collection", "rel_path"], "left_semi")
            if any(counts.get(s) for s in ("added", "modified", "deleted")):
                made = indexing.build(fresh)
                kept = old if old is None or not force else old.where(F.col("collection") != own)
                if kept is not None and gone is not None:
                    kept = kept.join(gone, ["collection", "path"], "left_anti")
                self.store.write(made if kept is None else kept.select(*made.columns).unionByName(made))
                self._embed(own)
                self._register(own, path)
                self.invalidate(path)
            return {s: counts.get(s, 0) for s in ("added", "modified", "deleted")}
        finally:
            disk.unpersist()

    def _guard(self, own: str) -> None:
        """Refuse another embedding model or dimension than the collection has."""
        known = self.registry.read()
        row = None if known is None else known.where(F.col("collection") == own).first()
        if row is None or self.embedder is None:
            return
        embedding.check_model(row["embedding_model"], self.model)
        stored = self.vectors.read()
        if stored is not None:
            embedding.check_dimension(stored.where(F.col("collection") == own), len(self.embedder(["a"])[0]))

    def _embed(self, own: str) -> None:
        """Vectors for the points of a collection that have none yet; those of gone points go."""
        if self.embedder is None:
            return
        ship(self.spark)
        points = self.store.read().where(F.col("collection") == own)
        old = self.vectors.read()
        if old is None:
            self.vectors.write(embedding.embed(points, self.embedder))
            return
        ids = points.select(F.col("point_id").alias("vec_id"))
        fresh = embedding.embed(points.join(old.select(F.col("vec_id").alias("point_id")), "point_id", "left_anti"), self.embedder)
        others = old.where(F.col("collection") != own)
        self.vectors.write(others.unionByName(old.where(F.col("collection") == own).join(ids, "vec_id", "left_semi").select(*others.columns)).unionByName(fresh.select(*others.columns)))

    def _register(self, own: str, path: str) -> None:
        dim = len(self.embedder(["a"])[0]) if self.embedder else None
        row = [(own, str(Path(path).resolve()), self.model, dim, datetime.now(timezone.utc))]
        self.registry.upsert(self.spark.createDataFrame(row, self.REGISTRY), ["collection"])

    def auto_index(self, path: str) -> tuple[str, str | None]:
        """(message, error) of bringing a corpus up to date; one of them is empty."""
        try:
            counts = self.index(path)
        except Exception as e:  # noqa: BLE001 - the caller shows the message
            return "", f"indexing failed: {described(e)}"
        return render.index_message({"files": counts["added"] + counts["modified"], "deleted": counts["deleted"]}, {}), None

    def collections(self) -> DataFrame:
        """collection, codebase_path, embedding_model, verdict: whether each codebase still exists on this host."""
        known = self.registry.read()
        if known is None:
            return self.spark.createDataFrame([], "collection string, codebase_path string, embedding_model string, verdict string")
        paths = [r["codebase_path"] for r in known.select("codebase_path").distinct().collect()]
        seen = self.spark.createDataFrame([(p, _present(p)) for p in paths if p], "codebase_path string, present boolean")
        return known.select("collection", "codebase_path", "embedding_model").join(catalog.verdicts(known, seen), "collection")

    def cleanup_orphans(self) -> dict[str, str]:
        """Remove the collections whose codebase is confirmed gone; goes on after a failure."""
        out = {}
        for r in self.collections().where(F.col("verdict") == "orphan").collect():
            try:
                self.delete(collection_id=r["collection"])
                out[r["collection"]] = "deleted"
            except Exception as e:  # noqa: BLE001 - the others still have to go
                out[r["collection"]] = described(e)
        return out

    def points(self, path: str) -> DataFrame | None:
        whole = self.store.read()
        return None if whole is None else whole.where(F.col("collection") == self.collection(path))

    def search(self, query: str, path: str, limit: int = SEARCH_LIMIT, form: str = "text", **options) -> str:
        """Rendered results, from the cache while they are fresh."""
        if not query.strip().strip('"').strip():
            raise ValueError("the query is empty")
        key = (str(Path(path).resolve()), query, checked_limit(limit), form, repr(sorted(options.items(), key=str)))
        kept = self.cache.get(key)
        if kept and time.monotonic() - kept[0] < self.ttl:
            return kept[1]
        points = self.points(path)
        if self.embedder and points is not None and "query_vector" not in options:
            options |= {"vectors": self.vectors.read(), "query_vector": self.embedder([query])[0]}
        rows = [] if points is None else [r.asDict() for r in planner.search(points, query, checked_limit(limit), **options).collect()]
        hint = dsl.infer_language(query)
        out = (f"(language hint: {hint})\n" if hint and form == "text" else "") + render.results(rows, form)
        while len(self.cache) >= self.cache_size:
            self.cache.popitem(last=False)
        self.cache[key] = (time.monotonic(), out)
        return out

    def invalidate(self, path: str) -> None:
        own = str(Path(path).resolve())
        for key in [k for k in self.cache if k[0] == own]:
            del self.cache[key]

    def status(self, path: str) -> dict:
        points = self.points(path)
        return {"files": 0, "chunks": 0} if points is None else points.agg(
            F.count_if(F.col("point_type") == "file").alias("files"), F.count_if(F.col("point_type") == "chunk").alias("chunks")).first().asDict()

    def preview(self, path: str, show: int = 50) -> dict:
        found = sources.scan(self.spark, path)
        each = found.groupBy(text.language_of(F.col("rel_path")).alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")).collect()
        total = sum(r["n"] for r in each)
        shown = [r["rel_path"] for r in found.orderBy("rel_path").limit(show).collect()]
        return {"files": total, "bytes": sum(r["bytes"] for r in each), "languages": {r["language"]: r["n"] for r in sorted(each, key=lambda r: (-r["n"], r["language"]))},
                "paths": shown, "more": max(0, total - len(shown))}

    def delete(self, path: str = "", collection_id: str = "") -> bool:
        """Remove one corpus, named by exactly one of path and id."""
        if bool(path) == bool(collection_id):
            raise ValueError("give either a path or a collection id")
        own = collection_id or self.collection(path)
        if not re.match(catalog.COLLECTION_ID, own):
            raise ValueError(f"not a collection id: {own!r}")
        if self.store.read() is None:
            return False
        for store in (self.registry, self.vectors, self.store):
            if store.read() is not None:
                store.delete_collection(own)
        return True


def _present(path: str) -> bool | None:
    """Whether a path exists; null if that can't be told."""
    try:
        os.stat(path)
        return True
    except FileNotFoundError:
        return False
    except OSError:
        return None
