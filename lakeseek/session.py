"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_shipped: set[str] = set()
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, unless they can
    already. The archive lies in the shared folder of a cluster."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_own_folder(spark)}/code/{package.name}.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path.toString())
    _shipped.add(context.applicationId)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a folder of parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    session on one machine (``local[...]``) gets a temporary folder; any other
    session is refused, as its executors could not read each other's disks.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lakeseek-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's Python ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark).rstrip('/')}/lakeseek-{context.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, context, folder)
    return folder


def _remove(context, folder: str) -> None:
    try:
        if context._jsc is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later
    uses neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def release(*tables: DataFrame | None) -> None:
    """Remove tables that :func:`cut` made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            _remove(df.sparkSession.sparkContext, path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session is tuned for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
