"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.syntax.gll import Rejected
from lakeseek.llm.syntax.grammars import DIALECTS, grammar
from lakeseek.llm.syntax.lexers import lexer

#: The language a file's extension stands for, where it has a grammar.
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
              "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c", "rb": "ruby", "sh": "bash", "bash": "bash", "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml"}


def extension(path: str | None) -> str | None:
    """The extension of a path in lower case; null if it has none."""
    name = (path or "").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else None


def language(path: str | None) -> str | None:
    """The language that a path's extension stands for, in any letter case; null without a grammar."""
    return EXTENSIONS.get(extension(path) or "")


def parses(text: str, lang: str) -> bool:
    """Whether at least one dialect of the language accepts the text. Empty
    texts, byte-order marks and line ends are no fault."""
    text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip():
        return True
    g = grammar(lang)
    if g.full():
        g.reset()
    try:
        folded = lexer(lang)(text)
        return folded is not None and g.accepts(DIALECTS[lang], folded)
    except Rejected:
        return False


def check(files: DataFrame) -> DataFrame:
    """file_id, collection, language, parsed: for every file whose content is not
    null, one row per file_id. Without a grammar for its extension, ``language``
    is the extension (null if there is none) and ``parsed`` null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, good = [], []
            for path, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lang = language(path)
                langs.append(lang or extension(path))
                good.append(None if lang is None else parses(text, lang))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(good, pa.bool_())],
                                             ["file_id", "collection", "language", "parsed"])
    rows = files.where(F.col("content").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), "collection", "rel_path", "content")
    checked = rows.mapInArrow(run, "file_id long, collection string, language string, parsed boolean")
    return checked.groupBy("file_id").agg(F.min(F.struct("collection", "language", "parsed")).alias("c")).select("file_id", "c.*")


def unparsed_files(files: DataFrame) -> DataFrame:
    """file_id, collection, language of the files that every dialect rejects."""
    return check(files).where(~F.col("parsed")).drop("parsed")


def rates(files: DataFrame) -> DataFrame:
    """collection, language, files, checked, unparsed, share of unparsed among
    checked files; null where no file was checked."""
    return check(files).groupBy("collection", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count("parsed").alias("checked"), F.count_if(~F.col("parsed")).alias("unparsed"),
        F.round(F.avg((~F.col("parsed")).cast("int")), 6).alias("share"))
