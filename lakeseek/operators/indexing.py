"""Files to points, vocabulary and statistics: one plan for a full and an incremental run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions import text, values
from lakeseek.operators import chunking, points

KEY = ["collection", "path"]


def chunk_rows(files: DataFrame) -> DataFrame:
    """The chunk points of files (file_id, collection, rel_path, language, content), in the stored schema, with their whole text."""
    made = chunking.chunks(files).where(F.col("error").isNull()).drop("error")
    own = files.select("file_id", "collection", F.col("rel_path").alias("path"), "language", "content_hash",
                       text.imports_of(F.col("content"), F.col("language")).alias("imports"))
    joined = made.join(own, "file_id")
    return joined.select("collection", points.point_uuid(points.chunk_key(F.col("path"), F.col("start_line"), F.col("ordinal"))).alias("point_id"),
                         F.lit("chunk").alias("point_type"), "path", "language", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("int").alias("line_count"),
                         "chunk_type", "name", "start_line", "end_line", "content", "imports",
                         F.col("content_hash").alias("file_hash"))


def first_definitions(chunks: DataFrame, order: list[str]) -> DataFrame:
    """collection, path and the labels of the first named chunks of each file. Ranks
    cut every file to its first few before anything is gathered."""
    label = chunking.definition_label(F.col("chunk_type"), F.col("name"))
    ranked = chunks.where(F.col("name").isNotNull()).select(*KEY, *order, label.alias("label")).withColumn(
        "n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order, "label"))).where(F.col("n") <= values.MAX_DEFINITIONS)
    in_order = F.array_sort(F.collect_list(F.struct("n", "label")))
    return ranked.groupBy(*KEY).agg(F.transform(in_order, lambda s: s["label"]).alias("defines"))


def file_rows(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The file points: a summary of description, imports and top-level definitions."""
    joined = files.withColumn("path", F.col("rel_path")).drop("rel_path").join(first_definitions(chunks, ["start_line"]), KEY, "left")
    content, language = F.col("content"), F.col("language")
    none: Column = F.array().cast("array<string>")
    summary = chunking.file_summary(text.module_docstring(content, language), text.imports_of(content, language), F.coalesce("defines", none), content)
    return joined.select("collection", points.point_uuid(points.file_key(F.col("path"))).alias("point_id"), F.lit("file").alias("point_type"), "path", "language",
                         summary.alias("summary"), text.line_count(content).alias("line_count"), *[F.lit(None).cast(t).alias(c) for c, t in (
                             ("chunk_type", "string"), ("name", "string"), ("start_line", "int"), ("end_line", "int"), ("content", "string"))],
                         text.imports_of(content, language).alias("imports"), F.col("content_hash").alias("file_hash"))


def build(files: DataFrame) -> DataFrame:
    """All points of the given files."""
    kept = files.where(F.col("content").isNotNull() & (F.col("content") != ""))
    chunks = chunk_rows(kept)
    return file_rows(kept, chunks).unionByName(chunks)


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def preview(files: DataFrame) -> DataFrame:
    """language, files, bytes, in the order a preview shows them."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
