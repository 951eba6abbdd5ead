"""Structured filters of a search as one predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.functions import text, values

#: Paths up to this number go into the predicate; more are joined.
MAX_INLINE_PATHS = 500


def scope_predicate(scope: str) -> Column:
    if scope == "function":
        return F.col("chunk_type").isin(*values.FUNCTION_SCOPE)
    if scope == "class":
        return F.col("chunk_type").isin(*values.CLASS_SCOPE)
    test = text.is_test(F.col("path"), F.col("name"))
    return test if scope == "test" else ~test


def name_contains(name: str) -> Column:
    return F.coalesce(F.lower("name").contains(name.lower()), F.lit(False))


def outside(paths: list[str] | tuple[str, ...]) -> Column:
    """``-path:``: none of the parts stands anywhere in the path."""
    return reduce(lambda a, p: a & ~F.col("path").contains(p), paths, F.lit(True))


def structured(parsed) -> Column:
    """All filters of a parsed query."""
    keep = F.lit(True)
    if parsed.path_prefix is not None:
        keep = keep & text.in_path(F.col("path"), parsed.path_prefix)
    if parsed.exclude_paths:
        keep = keep & outside(parsed.exclude_paths)
    if parsed.file_pattern:
        keep = keep & text.glob_match(F.col("path"), parsed.file_pattern)
    for name in (parsed.function_name, parsed.class_name):
        if name:
            keep = keep & name_contains(name)
    if parsed.scope:
        keep = keep & F.coalesce(scope_predicate(parsed.scope), F.lit(False))
    return keep


def pushed(points: DataFrame, mode: str = "both", language: str | None = None, paths: DataFrame | list[str] | None = None) -> DataFrame:
    """Filters that retrieval itself applies: point type, language, a set of paths."""
    if mode in ("file", "chunk"):
        points = points.where(F.col("point_type") == mode)
    if language:
        points = points.where(F.col("language") == language)
    if isinstance(paths, DataFrame):
        points = points.join(paths.select("path").distinct(), "path", "left_semi")
    elif paths is not None:
        if len(paths) <= MAX_INLINE_PATHS:
            return points.where(F.col("path").isin(*paths)) if paths else points.where(F.lit(False))
        points = points.join(points.sparkSession.createDataFrame([(p,) for p in set(paths)], "path string"), "path", "left_semi")
    return points


def path_token_superset(path_tokens: list[str]) -> Column:
    """Every token is a whole alphanumeric token of the lower-cased path."""
    own = F.split(F.lower(F.col("path")), "[^a-z0-9]+")
    return reduce(lambda a, t: a & F.array_contains(own, t), path_tokens, F.lit(True))
