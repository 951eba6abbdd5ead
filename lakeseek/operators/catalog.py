"""Stored points by snapshot, and the catalogue of collections."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: the form of a collection's id.
COLLECTION_ID = r"^codesearch_[a-f0-9]{12}$"


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Last writer wins by key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def without_paths(points: DataFrame, paths: DataFrame) -> DataFrame:
    return points.join(paths.select("path").distinct(), "path", "left_anti")


def verdicts(collections: DataFrame, existing: DataFrame) -> DataFrame:
    """collection, verdict: ``valid`` if the codebase's path exists, ``orphan``
    only if the path is known and confirmed absent, ``skip`` on any doubt.
    ``existing`` has codebase_path and present (null: could not be checked)."""
    joined = collections.select("collection", "codebase_path").distinct().join(existing, "codebase_path", "left")
    verdict = (F.when(F.col("codebase_path").isNull() | ~F.col("collection").rlike(COLLECTION_ID), "skip")
               .when(F.col("present"), "valid").when(~F.col("present"), "orphan").otherwise("skip"))
    return joined.select("collection", verdict.alias("verdict"))


def inferred_path(points: DataFrame) -> DataFrame:
    """collection and its root, by taking the path off the end of an absolute path."""
    rooted = points.where(F.col("abs_path").endswith(F.concat(F.lit("/"), F.col("path"))))
    root = F.expr("left(abs_path, length(abs_path) - length(path) - 1)")
    return rooted.groupBy("collection").agg(F.min(root).alias("codebase_path"))


class SnapshotStore:
    """Points under ``root/snapshot=<n>``; the snapshot in force is the highest
    number in ``root/commits``. A run writes the next snapshot whole and commits
    it last by rename, so a failed run changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        folder = self._path("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max([int(n) for n in names if n.isdigit()], default=0)

    def read(self) -> DataFrame | None:
        n = self.version()
        if not n:
            return None
        java_io = self._jvm.java.io
        reader = java_io.BufferedReader(java_io.InputStreamReader(self._fs.open(self._path(f"commits/{n}"))))
        try:
            schema = StructType.fromJson(json.loads(reader.readLine())["schema"])
        finally:
            reader.close()
        return self.spark.read.schema(schema).parquet(f"{self.root}/snapshot={n}")

    def write(self, points: DataFrame) -> int:
        n = self.version() + 1
        points.write.mode("overwrite").partitionBy("collection").parquet(f"{self.root}/snapshot={n}")
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"commits/{n}")
        out = self._fs.create(draft, True)
        out.write((json.dumps({"snapshot": n, "schema": points.schema.jsonValue()}) + "\n").encode())
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another run committed snapshot {n} first")
        return n

    def upsert(self, new: DataFrame, key: list[str]) -> int:
        old = self.read()
        return self.write(new if old is None else upserted(old.select(*new.columns), new, key))

    def delete_paths(self, paths: DataFrame) -> int:
        return self.write(without_paths(self.read(), paths))

    def delete_collection(self, collection: str) -> int:
        return self.write(self.read().where(F.col("collection") != collection))
