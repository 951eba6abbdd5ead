"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.session import cut, partitions

#: Fixed value: the published constant of reciprocal rank fusion.
RRF_K = 60


def group_ranks(df: DataFrame, group: list[str], score: str, rank: str = "rank") -> DataFrame:
    """Add 1 + the number of rows of the group with a higher score (ties share a
    rank), without ever gathering a group in one task.

    Rows are range-partitioned by (group, score descending), so a group that
    holds a third of all rows spreads over many partitions. Within a slice the
    rank is a window; the rows of the group in earlier slices are added from a
    small table of counts. Equal scores fall into one slice, as ranges are cut
    between distinct values.
    """
    n = partitions(df.sparkSession)
    # Written once: another pass would sample other ranges, and the slices of both uses have to agree.
    sliced = cut(df.repartitionByRange(n, *group, F.col(score).desc()).withColumn("_slice", F.spark_partition_id()))
    inside = sliced.withColumn(
        "_inside", F.rank().over(Window.partitionBy("_slice", *group).orderBy(F.col(score).desc())))
    sizes = sliced.groupBy("_slice", *group).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    joined = inside.alias("a").join(offsets.alias("b"), [F.col("a._slice") == F.col("b._slice"), *on])
    return joined.select("a.*", F.col("b._before")).withColumn(
        rank, F.col("_inside") + F.col("_before")).drop("_slice", "_inside", "_before")


def fuse(df: DataFrame, query: str, point: str, branch: str, kind: str, score: str, k: int = RRF_K) -> DataFrame:
    """query, point, fused: the sum over branches of 1 / (k + rank).

    Points are ranked separately per query, branch and kind, so neither the
    range of a branch's scores nor that of a kind's matters. Rows without a
    score are left out; repeated rows count once; equal scores share the better
    rank; a null branch or kind is a value of its own. A point with several
    scores in one branch counts with the best. Only the five named columns are
    read.
    """
    rows = (df.where(F.col(score).isNotNull() & ~F.isnan(score))
            .groupBy(F.col(query).alias("query"), F.col(point).alias("point"),
                     F.col(branch).alias("branch"), F.col(kind).alias("kind"))
            .agg(F.max(score).alias("score")))
    ranked = group_ranks(rows, ["query", "branch", "kind"], "score")
    return ranked.groupBy("query", "point").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused"))


def first_of_each(fused: DataFrame) -> DataFrame:
    """query, point of the highest fused score (to 12 digits; equal scores go to
    the smaller point): an aggregate with map-side combine, no sort of a whole query."""
    best = F.max_by("point", F.struct(F.round("fused", 12), -F.col("point")))
    return fused.where(F.col("query").isNotNull() & F.col("point").isNotNull()).groupBy("query").agg(best.alias("point"))
