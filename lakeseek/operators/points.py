"""The points of a corpus: files and chunks in one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.session import cut

COLUMNS = ["collection", "point_id", "point_type", "path", "language", "summary", "line_count", "chunk_type", "name", "start_line", "end_line", "content"]


#: Repeated keys up to the first number are held as literals of the plan, up to the second broadcast (8 MB at most, as 64-bit keys); more are joined.
FEW_REPEATED, MAX_REPEATED = 5_000, 500_000


def once(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and ``columns``, one row per key (of unlike rows the smallest; a null key is a key).

    Which keys repeat is learnt from the key column alone. All other rows go
    through as they are, so their texts are never shuffled, and filters on them
    still reach the scan; only rows of repeated keys are gathered, with map-side
    combine.
    """
    rows = df.select(key, *[c for c in columns if c != key])
    repeated = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_k")
    few = repeated.limit(FEW_REPEATED + 1).collect()
    if not few:
        return rows
    if len(few) <= FEW_REPEATED:
        side = F.broadcast(df.sparkSession.createDataFrame(few, repeated.schema))
    else:
        repeated = cut(repeated)
        side = F.broadcast(repeated) if repeated.count() <= MAX_REPEATED else repeated
    same = F.col(key).eqNullSafe(F.col("_k"))
    some = rows.join(side, same, "left_semi").groupBy(key).agg(F.min(F.struct(*rows.columns[1:])).alias("_v")).select(key, "_v.*")
    return rows.join(side, same, "left_anti").unionByName(some)


def from_tables(file_points: DataFrame, chunk_points: DataFrame) -> DataFrame:
    """Points from the two stored tables; repeated rows count once, rows without a path are dropped."""
    none = lambda t: F.lit(None).cast(t)
    files = once(file_points, "file_id", ["collection", "path", "language", "summary", "line_count"]).select(
        "collection", F.col("file_id").alias("point_id"), F.lit("file").alias("point_type"), "path", "language", "summary", "line_count",
        none("string").alias("chunk_type"), none("string").alias("name"), none("int").alias("start_line"), none("int").alias("end_line"), none("string").alias("content"))
    chunks = once(chunk_points, "chunk_id", ["collection", "path", "language", "chunk_type", "name", "start_line", "end_line", "content"]).select(
        "collection", F.col("chunk_id").alias("point_id"), F.lit("chunk").alias("point_type"), "path", "language", none("string").alias("summary"), none("int").alias("line_count"),
        "chunk_type", "name", "start_line", "end_line", "content")
    return files.unionByName(chunks).where(F.col("path").isNotNull())


def file_key(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def chunk_key(path: Column, start_line: Column, ordinal: Column) -> Column:
    """Several chunks can begin on one line, so the ordinal belongs to the key."""
    return F.concat(F.lit("chunk:"), path, F.lit(":"), start_line.cast("string"), F.lit("#"), ordinal.cast("string"))


def point_uuid(key: Column) -> Column:
    """A key's digest in the form of a UUID."""
    h = F.sha2(key, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def collection_id(path: Column, prefix: str = "codesearch_") -> Column:
    """The collection of a codebase path; a trailing slash does not matter."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.regexp_replace(path, "(?<=.)/+$", ""), 256), 1, 12))
