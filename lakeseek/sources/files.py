"""Trees of source files as tables, by a walk on one host or by Spark's binary source on shared storage."""

from __future__ import annotations

import hashlib
import os
import re
import stat
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions import text, values
from lakeseek.sources import ignore, notebook

SCHEMA = "path string, rel_path string, language string, size_bytes long, content string, content_hash string, line_count int, mtime double"


def walk(root: str, extensions: set[str] | None = None, max_kb: int = values.MAX_FILE_KB, excludes: list[str] | None = None) -> Iterator[tuple[str, str, os.stat_result]]:
    """(absolute, relative, stat) of the files to index: no links, no hidden or
    excluded folders, ignore files honoured at every level, known extensions,
    not empty, not too large (notebooks excepted)."""
    base = Path(root).resolve()
    wanted = extensions or set(values.EXTENSIONS)
    given = ignore.rules("\n".join(excludes or []))
    by_folder: dict[str, list[ignore.Rule]] = {}
    info = base / ".git/info/exclude"
    lowest = ignore.rules(info.read_text(errors="replace")) if info.is_file() else []
    for folder, folders, names in os.walk(base, followlinks=False):
        rel = os.path.relpath(folder, base).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        own = [r for f in values.IGNORE_FILES if f in names and not os.path.islink(os.path.join(folder, f))
               for r in ignore.rules(Path(folder, f).read_text(errors="replace"))]
        by_folder[rel] = (lowest if not rel else []) + own
        at = lambda n: f"{rel}/{n}" if rel else n  # noqa: E731, B023
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in values.EXCLUDED_FOLDERS
                            and not os.path.islink(os.path.join(folder, f)) and not ignore.ignored(by_folder, at(f), True))
        for name in sorted(names):
            path = os.path.join(folder, name)
            suffix = os.path.splitext(name)[1].lower()
            if name.startswith(".") or suffix not in wanted or os.path.islink(path):
                continue
            if ignore.verdict(given, at(name), False) or ignore.ignored(by_folder, at(name)):
                continue
            try:
                st = os.lstat(path)
            except OSError:
                continue
            if stat.S_ISREG(st.st_mode) and st.st_size and (st.st_size <= max_kb * 1024 or suffix == ".ipynb"):
                yield path, at(name), st


def _row(path: str, rel: str, st: os.stat_result) -> tuple | None:
    try:
        fd = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
        with os.fdopen(fd, "rb") as f:
            content = f.read().decode("utf-8", "replace")
    except OSError:
        return None
    suffix = os.path.splitext(rel)[1].lower()
    content = notebook.code(content) if suffix == ".ipynb" else content
    if not content:
        return None
    digest = hashlib.sha256(content.encode()).hexdigest()
    return path, rel, values.EXTENSIONS.get(suffix), st.st_size, content, digest, content.count("\n") + 1, st.st_mtime


def discover(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files of a tree on this host, with content."""
    return spark.createDataFrame([r for r in (_row(*f) for f in walk(root, **options)) if r], SCHEMA)


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """rel_path, mtime, size_bytes of the same files, without reading them."""
    return spark.createDataFrame([(rel, st.st_mtime, st.st_size) for _, rel, st in walk(root, **options)], "rel_path string, mtime double, size_bytes long")


def read_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Given files of a tree; those outside it, missing, linked, of unknown language or empty are left out."""
    base = Path(root).resolve()
    rows = []
    for rel in paths:
        path = base / rel
        if not path.resolve().is_relative_to(base) or path.is_symlink() or not path.is_file() or path.suffix.lower() not in values.EXTENSIONS:
            continue
        if row := _row(str(path), rel, path.stat()):
            rows.append(row)
    return spark.createDataFrame(rows, SCHEMA)


def discover_distributed(spark: SparkSession, root: str, max_kb: int = values.MAX_FILE_KB) -> DataFrame:
    """The files of a tree on shared storage: listing, filters by path and size, and decoding run on the executors."""
    names = "*.{" + ",".join(e[1:] for e in values.EXTENSIONS if e != ".ipynb") + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + text.literal(root.rstrip("/").removeprefix("file://")) + "/", "")
    hidden = r"(^|/)(\.[^/]*|" + "|".join(re.escape(f) for f in values.EXCLUDED_FOLDERS) + r")(/|$)"
    kept = raw.withColumn("rel_path", rel).where((F.col("length") > 0) & (F.col("length") <= max_kb * 1024) & ~F.col("rel_path").rlike(hidden))
    content = F.decode(F.col("content"), "UTF-8")
    return kept.select("path", "rel_path", text.language_of(F.col("rel_path")).alias("language"), F.col("length").alias("size_bytes"), content.alias("content"),
                       F.sha2(content, 256).alias("content_hash"), text.line_count(content).alias("line_count"),
                       F.unix_micros("modificationTime").cast("double").alias("_us")).withColumn("mtime", F.col("_us") / 1e6).drop("_us")


# What a change reference may look like.
_AGO = re.compile(r"^\d{1,6}[. ](?:second|minute|hour|day|week|month|year)s?[. ]ago$")
_REVISION = re.compile(r"^(?!-)(?!.*\.\.)[A-Za-z0-9_./~^@{}-]{1,200}$")


def valid_since(since: str) -> str:
    """A revision or ``N.units.ago``; anything that git could take for an option or a range is refused."""
    if _AGO.match(since):
        return since.replace(".", " ")
    if re.search(r"\bago|[. ]ago", since) or not _REVISION.match(since):
        raise ValueError(f"not a revision or a time: {since!r}")
    return since


def changed_since(root: str, since: str = "HEAD~10") -> list[str]:
    """Paths under ``root`` that changed since a revision's merge base (uncommitted
    work included) or, for a time, in the commits after it."""
    since = valid_since(since)
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True, timeout=60).stdout
    if since.endswith(" ago"):
        names = git("log", f"--since={since}", "--name-only", "--pretty=format:", "--relative")
    else:
        base = git("merge-base", since, "HEAD").strip()
        names = git("diff", "--name-only", "--relative", base)
    return sorted({n for n in names.split("\n") if n})
