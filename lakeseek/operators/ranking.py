"""Ranking after retrieval: boosts, normalisation, merging and fusion across corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions import text, values
from lakeseek.operators.retrieve import ties


def boosted(found: DataFrame) -> DataFrame:
    """Scores adjusted by path, never below zero."""
    return found.withColumn("score", F.round(F.greatest(F.lit(0.0), F.col("score") + text.path_boost(F.col("path"))), 6))


def top(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.col("score").desc(), *ties()).limit(limit)


def normalized(found: DataFrame) -> DataFrame:
    """Scores divided by the largest of a list that is already cut to its limit; unchanged if that is not above zero."""
    most = F.max("score").over(Window.partitionBy())
    return found.withColumn("score", F.when(most > 0, F.round(F.col("score") / most, 6)).otherwise(F.col("score")))


def merged(lists: list[DataFrame]) -> DataFrame:
    """Lists one after the other, each place (path, start_line) kept where it stands first. Adds ``list`` and ``pos``."""
    tagged = [df.withColumn("list", F.lit(i)).withColumn("pos", F.row_number().over(Window.orderBy(F.col("score").desc(), *ties())))
              for i, df in enumerate(lists)]
    w = Window.partitionBy("path", "start_line").orderBy("list", "pos")
    return reduce(DataFrame.unionByName, tagged).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def place_key(root: Column) -> list[Column]:
    """What makes two results of different corpora the same: file, type and lines."""
    line = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(-1))
    return [F.concat_ws("/", root, F.col("path")).alias("file"), F.col("point_type"), line("start_line").alias("first"), line("end_line").alias("last")]


def fused_across(ranked: DataFrame, list_column: str, root: Column, limit: int, k: int = values.RRF_K) -> DataFrame:
    """One ranking over several corpora: the sum of 1 / (k + rank) by place; the item of the first list stays.
    ``ranked`` has one short list per corpus, with ``rank``."""
    keyed = ranked.select(*place_key(root), list_column, "point_id", "rank")
    fused = keyed.groupBy("file", "point_type", "first", "last").agg(
        F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 8).alias("rrf"), F.min_by("point_id", F.struct(list_column, "rank")).alias("point_id"))
    return fused.orderBy(F.col("rrf").desc(), "file", "first", "last", "point_id").limit(limit)


def top_per(found: DataFrame, group: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of every group, with their rank: a WindowGroupLimit
    cuts each group within the tasks before anything is shuffled."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), *ties())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
