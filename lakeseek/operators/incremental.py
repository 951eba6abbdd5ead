"""Processing only new or changed records.

A manifest holds, for every processed input file, its collection, path, size
and checksum. A run anti-joins its listing against the manifest, writes its
output under a folder named by the batch identifier (so that a repeated attempt
replaces its own output instead of adding to it) and commits the next manifest
last, by one atomic rename. A run that fails before the rename leaves the old
manifest in force and its records come again with the next run.

Two entry points share these rules:

* :func:`replay_runs` takes a whole history of listings at once and returns
  what each successful run had to process: the manifest as it stood before each
  run is built as rows, and one anti-join serves all runs.
* :class:`Manifest` is the stored form for live runs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["collection", "rel_path"]


def last_recorded(scans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys``: the one recorded last; equal times fall to the
    larger scan_id. An aggregate with map-side combine, so that a path scanned
    any number of times in one run never gathers in one task."""
    order = F.struct(F.col("recorded_at"), F.col("scan_id"))
    best = F.max(F.struct(order.alias("o"), F.struct("size_bytes", "mtime", "content_hash").alias("v")))
    return scans.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.v.size_bytes", "b.v.mtime", "b.v.content_hash")


def successful_runs(runs: DataFrame, ok_status: str = "ok") -> DataFrame:
    """run_id, collection and the position of each successful run among those
    of its collection, by run_no (then run_id)."""
    ok = runs.where(F.col("status") == ok_status).select("run_id", "collection", "run_no").distinct()
    w = Window.partitionBy("collection").orderBy("run_no", "run_id")
    return ok.select("run_id", F.col("collection").alias("run_collection"), F.row_number().over(w).alias("step"))


def replay_runs(runs: DataFrame, scans: DataFrame, ok_status: str = "ok") -> DataFrame:
    """run_id, rel_path, size_bytes, mtime, content_hash of every record to process.

    Rules: runs of another status change nothing; a path that an ok run does not
    hold is forgotten; a path held with a null checksum is never a case and
    keeps what was known; a path is a case if its checksum differs from what is
    known or nothing is. Rows with null run_id or rel_path name no file and are
    left out; extra columns are ignored; repeated rows count once; empty tables
    give an empty result.
    """
    cols = ["run_id", "rel_path", "size_bytes", "mtime", "content_hash", "recorded_at", "scan_id"]
    held = last_recorded(scans.select(*cols).where(F.col("rel_path").isNotNull()), ["run_id", "rel_path"])
    listing = held.join(successful_runs(runs, ok_status), "run_id").withColumnRenamed("run_collection", "collection")

    # The manifest before step s+1: the last known checksum of every path that step s holds.
    # Steps without a gap form an island; within one, a null checksum keeps the earlier one.
    by_path = Window.partitionBy("collection", "rel_path").orderBy("step")
    island = listing.withColumn("island", F.col("step") - F.row_number().over(by_path))
    carried = Window.partitionBy("collection", "rel_path", "island").orderBy("step")
    manifest = island.select(
        "collection", "rel_path", (F.col("step") + 1).alias("step"),
        F.last("content_hash", ignorenulls=True).over(carried.rowsBetween(Window.unboundedPreceding, 0)).alias("content_hash"),
    ).where(F.col("content_hash").isNotNull())

    pending = listing.where(F.col("content_hash").isNotNull()).join(
        manifest, ["collection", "rel_path", "step", "content_hash"], "left_anti")
    return pending.select("run_id", "rel_path", "size_bytes", "mtime", "content_hash")


class Manifest:
    """The stored manifest under ``root``: ``manifest-<n>/`` tables, output
    batches under ``batches/batch_id=<id>/`` and one small file
    ``commits/<n>.json`` a commit, put in place by rename once everything else
    is written. The highest number is in force."""

    SCHEMA = "collection string, rel_path string, size_bytes long, content_hash string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _commit_in_force(self) -> dict:
        folder = self._path("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        done = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not done:
            return {"version": 0, "batches": []}
        java_io = self._jvm.java.io
        reader = java_io.BufferedReader(java_io.InputStreamReader(self._fs.open(self._path(f"commits/{max(done)}.json"))))
        try:
            return json.loads(reader.readLine())
        finally:
            reader.close()

    def current(self) -> DataFrame:
        version = self._commit_in_force()["version"]
        if not version:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/manifest-{version}")

    def pending(self, listing: DataFrame) -> DataFrame:
        """The records of ``listing`` (KEYS, size_bytes, content_hash, ...) that
        are new or changed against the manifest."""
        known = self.current().select(*KEYS, "content_hash")
        return listing.where(F.col("content_hash").isNotNull() & F.col("rel_path").isNotNull()).join(
            known, [*KEYS, "content_hash"], "left_anti")

    def run(self, batch_id: str, listing: DataFrame, process) -> bool:
        """Process what is pending and commit. False if the batch was committed before.

        ``process`` maps the pending records to the rows to write. The output
        folder is named by the batch and overwritten, so an attempt that died
        half-way leaves nothing twice. Collections that the listing does not
        hold keep their entries.
        """
        before = self._commit_in_force()
        if batch_id in before["batches"]:
            return False
        process(self.pending(listing)).write.mode("overwrite").parquet(f"{self.root}/batches/batch_id={batch_id}")
        seen = listing.where(F.col("rel_path").isNotNull()).select(*KEYS, "size_bytes", "content_hash").distinct()
        known = self.current().select(*KEYS, F.col("content_hash").alias("known_hash"))
        after = seen.join(known, KEYS, "left").select(
            *KEYS, "size_bytes", F.coalesce("content_hash", "known_hash").alias("content_hash"))
        others = self.current().join(seen.select("collection").distinct(), "collection", "left_anti")
        version = before["version"] + 1
        after.unionByName(others).write.mode("overwrite").parquet(f"{self.root}/manifest-{version}")
        self._commit({"version": version, "batches": [*before["batches"], batch_id]})
        return True

    def _commit(self, state: dict) -> None:
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"commits/{state['version']}.json")
        out = self._fs.create(draft, True)
        out.write((json.dumps(state) + "\n").encode())
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another run committed version {state['version']} first")

    def output(self) -> DataFrame | None:
        """The rows of all committed batches."""
        done = [f"{self.root}/batches/batch_id={b}" for b in self._commit_in_force()["batches"]]
        return self.spark.read.option("basePath", f"{self.root}/batches").parquet(*done) if done else None
