"""From a parsed query to the kind of retrieval it needs, and on to a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.functions import text, values
from lakeseek.operators import filters, ranking, retrieve
from lakeseek.plans import dsl


@dataclass(frozen=True)
class Plan:
    """``kind`` is exact_phrase, name_only, name_semantic or semantic."""

    kind: str
    text: str
    name: str | None = None
    fallback: str | None = None


def plan(query: str, parsed: dsl.Parsed) -> Plan:
    q, name = query.strip(), parsed.function_name or parsed.class_name
    if len(q) > 1 and q[0] == q[-1] == '"':
        return Plan("exact_phrase", q.strip('" '))
    if name and not parsed.text:
        return Plan("name_only", name, name)
    if name:
        return Plan("name_semantic", dsl.search_text(parsed), name)
    return Plan("semantic", dsl.search_text(parsed), None, parsed.text or query)


def fetch_limit(parsed: dsl.Parsed, limit: int) -> int:
    """Candidates to fetch: more where later filters may drop some."""
    narrowed = parsed.function_name or parsed.class_name or parsed.path_prefix or parsed.exclude_paths or parsed.file_pattern or parsed.scope
    return limit * (10 if narrowed else 2)


def query_tokens(session_points: DataFrame, query: str) -> list[str]:
    """The tokens of a query, by the same expression as those of the points."""
    one = session_points.sparkSession.range(1).select(text.tokens(F.lit(query)).alias("t"))
    return list(one.first()["t"])


def known_tokens(points: DataFrame, tokens: list[str]) -> list[str]:
    """The tokens with those that no point holds replaced by the closest of the
    vocabulary, or dropped. Only the few tokens of the query come to the driver."""
    known = {r["token"] for r in retrieve.document_frequency(points).where(F.col("token").isin(*tokens)).select("token").collect()} if tokens else set()
    unknown = [t for t in tokens if t not in known]
    near = {r["term"]: r["token"] for r in retrieve.nearest_terms(points, unknown).collect()} if unknown else {}
    return [t if t in known else near[t] for t in tokens if t in known or t in near]


def hybrid(points: DataFrame, query: str, vectors: DataFrame | None, query_vector: list[float] | None, limit: int, fuzzy: bool = False) -> tuple[DataFrame, bool]:
    """Fused dense and sparse retrieval; sparse alone (degraded) without a query vector.
    Scores are scaled by the largest a point could reach. ``fuzzy`` also looks
    for the closest words of those that no point holds."""
    tokens = query_tokens(points, query)
    tokens = known_tokens(points, tokens) if fuzzy else tokens
    sparse = retrieve.sparse(points, tokens)
    if vectors is None or query_vector is None:
        scored, degraded = sparse, True
    else:
        own = vectors.join(points.select(F.col("point_id").alias("vec_id")), "vec_id", "left_semi")
        most = (values.DENSE_WEIGHT + values.SPARSE_WEIGHT) / (values.RRF_K + 1)
        fused = retrieve.weighted_rrf(retrieve.dense(own, query_vector), sparse)
        scored, degraded = fused.withColumn("score", F.round(F.col("score") / most, 6)), False
    best = scored.orderBy(F.col("score").desc(), "point_id").limit(limit)
    return points.join(best, "point_id").withColumn("degraded", F.lit(degraded)), degraded


def search(points: DataFrame, query: str, limit: int = 10, mode: str = "both", language: str | None = None, paths=None,
           vectors: DataFrame | None = None, query_vector: list[float] | None = None, path_prefix: str | None = None, exclude_paths: list[str] | None = None,
           fuzzy: bool = False) -> DataFrame:
    """The ranked results of one query: retrieve, boost by path, filter, cut, normalise."""
    parsed = dsl.parse(query)
    if path_prefix is not None or exclude_paths:
        parsed = dsl.Parsed(**(parsed.__dict__ | {"path_prefix": path_prefix if path_prefix is not None else parsed.path_prefix,
                                                  "exclude_paths": (*parsed.exclude_paths, *(exclude_paths or ()))}))
    steps = plan(query, parsed)
    pool = filters.pushed(points, mode, language, paths)
    keep = filters.structured(parsed)
    want = fetch_limit(parsed, limit)
    exact = lambda q: ranking.boosted(retrieve.exact(pool.where(keep), q, None)).withColumn("degraded", F.lit(False))
    if steps.kind in ("exact_phrase", "name_only"):
        found = exact(steps.text)
    else:
        fused, _ = hybrid(pool, steps.text, vectors, query_vector, want, fuzzy)
        found = ranking.boosted(fused).where(keep)
        lookup = steps.name if steps.kind == "name_semantic" else None
        if steps.kind == "semantic":
            best = fused.agg(F.max("score")).first()[0]
            lookup = steps.fallback if best is None or best < values.FALLBACK_SCORE else None
        if lookup:
            first = ranking.top(exact(lookup), want)
            columns = found.columns
            found = ranking.merged([first.select(*columns), ranking.top(found, want)])
            return ranking.normalized(found.orderBy("list", "pos").limit(limit).drop("list", "pos"))
    return ranking.normalized(ranking.top(found, limit))
