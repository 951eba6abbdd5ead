"""Index against disk: what was added, modified or deleted, and what that does to the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["collection", "path"]
#: A size that moved by more than this counts as a change without a look at the hash.
CLEAR_BYTES = 10


def changes(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """collection, path, status for every path on either side.

    Both have collection, path, hash, mtime, size. A path is ``deleted`` if it
    is gone or cannot be read (null or empty hash), ``modified`` if time and size
    moved clearly (not in notebooks), else if anything moved, or the stored time
    is 0, and the hash differs; else ``unchanged``.
    """
    a = indexed.select(*KEYS, *[F.col(c).alias(f"i_{c}") for c in ("hash", "mtime", "size")], F.lit(True).alias("i"))
    b = disk.select(*KEYS, *[F.col(c).alias(f"d_{c}") for c in ("hash", "mtime", "size")], F.lit(True).alias("d"))
    time, size = ~F.col("i_mtime").eqNullSafe(F.col("d_mtime")), ~F.col("i_size").eqNullSafe(F.col("d_size"))
    unread = F.col("d").isNull() | F.col("d_hash").isNull()
    clear = time & size & (F.abs(F.col("i_size") - F.col("d_size")) > CLEAR_BYTES) & ~F.lower("path").endswith(".ipynb")
    status = (F.when(F.col("i").isNull() & F.col("d_hash").isNotNull(), "added").when(F.col("i").isNull(), "unreadable").when(unread, "deleted")
              .when(F.coalesce(clear, F.lit(False)), "modified")
              .when((time | size | (F.col("i_mtime") == 0)) & ~F.col("i_hash").eqNullSafe(F.col("d_hash")), "modified").otherwise("unchanged"))
    return a.join(b, KEYS, "full_outer").select(*KEYS, status.alias("status"))


def deleted(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    return indexed.select(*KEYS).distinct().join(disk.select(*KEYS), KEYS, "left_anti")


def status_counts(changed: DataFrame) -> DataFrame:
    """collection and the number of paths of each status."""
    return changed.groupBy("collection").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted", "unchanged")])


def vocabulary_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """token, delta: the change of document frequency between two sets of
    (document, token) rows, as one signed union; tokens without change are left out."""
    signed = before.select("token", F.lit(-1).alias("n")).unionByName(after.select("token", F.lit(1).alias("n")))
    return signed.groupBy("token").agg(F.sum("n").alias("delta")).where(F.col("delta") != 0)


def applied(frequencies: DataFrame, delta: DataFrame) -> DataFrame:
    """Document frequencies after a delta; never below 0, tokens at 0 are gone."""
    both = frequencies.select("token", F.col("df").cast("long").alias("n")).unionByName(delta.select("token", F.col("delta").cast("long").alias("n")))
    return both.groupBy("token").agg(F.greatest(F.lit(0), F.sum("n")).alias("df")).where(F.col("df") > 0)
