"""Retrieval: exact, sparse, dense and hybrid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions import text, values



def ties() -> list[Column]:
    """Ties are broken alike everywhere."""
    return [F.col("path").asc(), F.col("start_line").asc_nulls_first(), F.col("point_id").asc()]


def exact(points: DataFrame, query: str, limit: int | None, ranked: bool = True) -> DataFrame:
    """Points that hold the query at word edges in name (3), summary (2) or
    content (1), the best tier only; top ``limit`` by tier, or by id unranked."""
    tiers = [(c, s) for c, s in values.TIERS.items()]
    score = F.lit(0.0)
    for column, tier in reversed(tiers):
        score = F.when(text.edge_match(F.col(column), query), F.lit(tier)).otherwise(score)
    found = points.withColumn("score", score).where(F.col("score") > 0)
    if limit is None:
        return found
    return found.orderBy(*([F.col("score").desc(), *ties()] if ranked else [F.col("point_id").asc()])).limit(limit)


def vocabulary_text() -> Column:
    """What a point is indexed by."""
    return F.coalesce(F.col("content"), F.col("summary"), F.lit(""))


def postings(points: DataFrame, source: Column | None = None) -> DataFrame:
    """point_id, collection, token, tf."""
    each = points.select("collection", "point_id", F.explode(text.tokens(vocabulary_text() if source is None else source)).alias("token"))
    return each.groupBy("collection", "point_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(points: DataFrame) -> DataFrame:
    """token, df: in how many points each token occurs. Tokens are made a set
    within the row, so the count needs one shuffle of partial sums."""
    return points.select(F.explode(F.array_distinct(text.tokens(vocabulary_text()))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def sparse(points: DataFrame, query_tokens: list[str], limit: int | None = values.PREFETCH) -> DataFrame:
    """point_id and score of the points that share tokens with the query:
    the sum of term frequency times inverse document frequency.

    Only postings of query tokens leave the scan, so nothing is shuffled but
    partial sums of matching rows; document frequencies are counted over all points.
    """
    wanted = sorted(set(query_tokens))
    if not wanted:
        return points.select("point_id", F.lit(0.0).alias("score")).where(F.lit(False))
    hits = points.select("point_id", F.explode(F.filter(text.tokens(vocabulary_text()), lambda t: t.isin(*wanted))).alias("token"))
    tf = hits.groupBy("point_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    total = points.agg(F.count(F.lit(1))).scalar()
    weights = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select("token", idf(F.col("df"), total).alias("w"))
    times = {t: query_tokens.count(t) for t in wanted}
    qtf = F.element_at(F.create_map(*[F.lit(x) for kv in times.items() for x in kv]), F.col("token"))
    scored = tf.join(weights, "token").groupBy("point_id").agg(F.round(F.sum(F.col("tf") * F.col("w") * qtf), 6).alias("score"))
    return scored if limit is None else scored.orderBy(F.col("score").desc(), "point_id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(vectors: DataFrame, query: list[float], limit: int = values.PREFETCH, id_column: str = "vec_id") -> DataFrame:
    """point_id and cosine of the nearest vectors: exact, one pass, no shuffle but the top rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col("embedding").isNotNull()).select(F.col(id_column).alias("point_id"), F.round(cosine(F.col("embedding"), q), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "point_id").limit(limit)


def dense_batch(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", block: int = 256, max_query_mb: int = 64) -> DataFrame:
    """query_id, point_id, score, rank: the ``k`` nearest vectors of each of a
    stated set of queries.

    The query matrix is sent to the workers after its size is checked; a larger
    set is worked off in slices of that size. Each task compares its rows in
    blocks and keeps its own best ``k`` a query, so only queries x tasks x k
    rows are shuffled.
    """
    rows = queries.select(id_column, "embedding").where(F.col("embedding").isNotNull())
    width = rows.select(F.max(F.size("embedding"))).first()[0] or 0
    per_slice = max(1, max_query_mb * 2**20 // (8 * max(1, width)))
    count = rows.count()
    slices = -(-count // per_slice) or 1
    parts = []
    for n in range(slices):
        own = rows if slices == 1 else rows.where(F.pmod(F.xxhash64(id_column), F.lit(slices)) == n)
        parts.append(_nearest(vectors, own.collect(), k, id_column, block))
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "point_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(vectors: DataFrame, own: list, k: int, id_column: str, block: int) -> DataFrame:
    ids = np.array([r[0] for r in own], dtype=np.int64)
    matrix = np.array([r[1] for r in own], dtype=np.float64).reshape(len(own), -1 if own else 0)
    norms = np.linalg.norm(matrix, axis=1)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix / np.where(norms == 0, 1, norms)[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        best_s = np.full((len(ids), k), -np.inf)
        best_p = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values_ = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(len(points), -1)
            size = np.linalg.norm(values_, axis=1)
            values_ /= np.where(size == 0, 1, size)[:, None]
            for at in range(0, len(points), block):
                s = np.round(matrix @ values_[at:at + block].T, 6)
                all_s = np.hstack([best_s, s])
                all_p = np.hstack([best_p, np.broadcast_to(points[at:at + block], s.shape)])
                order = np.lexsort((all_p, -all_s), axis=1)[:, :k]
                best_s, best_p = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_p, order, 1)
        keep = np.isfinite(best_s)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], keep.shape)[keep]), pa.array(best_p[keep]), pa.array(best_s[keep])],
                                         ["query_id", "point_id", "score"])
    return vectors.where(F.col("embedding").isNotNull()).select(id_column, "embedding").mapInArrow(run, "query_id long, point_id long, score double")


def rank_list(found: DataFrame) -> DataFrame:
    """Positions from 1 in a list that is already cut to its prefetch size."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "point_id")))


def weighted_rrf(first: DataFrame, second: DataFrame, first_weight: float = values.DENSE_WEIGHT, second_weight: float = values.SPARSE_WEIGHT,
                 k: int = values.RRF_K) -> DataFrame:
    """point_id and the weighted sum of 1 / (k + rank) over two prefetched lists."""
    a = rank_list(first).select("point_id", (F.lit(first_weight) / (k + F.col("rank"))).alias("a"))
    b = rank_list(second).select("point_id", (F.lit(second_weight) / (k + F.col("rank"))).alias("b"))
    zero = F.lit(0.0)
    return a.join(b, "point_id", "full_outer").select("point_id", F.round(F.coalesce("a", zero) + F.coalesce("b", zero), 8).alias("score"))


def nearest_terms(points: DataFrame, unknown: list[str]) -> DataFrame:
    """term, token: for each query token the closest token of the vocabulary by
    edit distance, at most 2 and a quarter of its length; ties by df, then token.

    The few query tokens stand in the plan as literals, so the vocabulary is passed once."""
    vocabulary = document_frequency(points)
    each = F.explode(F.array(*[F.lit(t) for t in sorted(set(unknown))])).alias("term")
    pairs = vocabulary.select("token", "df", each).where(F.abs(F.length("token") - F.length("term")) <= 2)
    close = pairs.withColumn("distance", F.levenshtein("term", "token")).where((F.col("distance") <= 2) & (F.col("distance") <= F.length("term") * 0.25))
    return close.groupBy("term").agg(F.min_by("token", F.struct("distance", -F.col("df"), "token")).alias("token"))
