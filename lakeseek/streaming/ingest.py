"""Files that arrive in a folder, ingested as a stream of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeseek.functions import text
from lakeseek.operators.catalog import SnapshotStore

#: Files per micro-batch.
BATCH_FILES = 50


def file_stream(spark: SparkSession, folder: str, per_batch: int = BATCH_FILES) -> DataFrame:
    """path, language, content, content_hash, line_count of files as they appear."""
    raw = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
           .option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder))
    content = F.decode("content", "UTF-8")
    kept = raw.where((F.col("length") > 0) & text.language_of(F.col("path")).isNotNull())
    return kept.select("path", text.language_of(F.col("path")).alias("language"), content.alias("content"), F.sha2(content, 256).alias("content_hash"),
                       text.line_count(content).alias("line_count"))


def ingest(files: DataFrame, root: str, collection: str) -> StreamingQuery:
    """Upsert every batch by path into the snapshots under ``root``. A batch that
    comes again after a failure replaces its own rows, so nothing counts twice."""
    store = SnapshotStore(files.sparkSession, f"{root}/points")

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            store.upsert(df.withColumn("collection", F.lit(collection)), ["collection", "path"])
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and type of a stream (or table) of events; rows later than ``late`` are dropped by the stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
