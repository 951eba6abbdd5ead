"""The query language: ``fn: class: file: path: -path: scope:``, quoted phrases and plain text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.functions import values

# The prefixes of the language; each counts where it stands first, -path wherever it stands.
PREFIXES = {"function_name": r"\b(?:function|fn|def|method):(\w+)", "class_name": r"\b(?:class|cls|type|struct):(\w+)", "file_pattern": r"\bfile:(\S+)",
            "exclude_paths": r"-path:(\S+)", "path_prefix": r"\bpath:(\S+)", "scope": r"\bscope:(function|method|class|struct|enum|interface|type|module|test|impl)\b"}
SCOPES = {"method": "function", "struct": "class", "enum": "class", "interface": "class", "type": "class", "module": "class"}


@dataclass(frozen=True)
class Parsed:
    text: str
    function_name: str | None = None
    class_name: str | None = None
    file_pattern: str | None = None
    path_prefix: str | None = None
    scope: str | None = None
    exclude_paths: tuple[str, ...] = field(default_factory=tuple)


def parse(query: str) -> Parsed:
    """Take the prefixes out of a query; what is left, trimmed, is its text."""
    found: dict = {}
    for name, pattern in PREFIXES.items():
        compiled = re.compile(pattern, re.I)
        if name == "exclude_paths":
            found[name] = tuple(compiled.findall(query))
            query = compiled.sub("", query)
        elif m := compiled.search(query):
            found[name] = m.group(1)
            query = query[:m.start()] + query[m.end():]
    if scope := found.get("scope"):
        found["scope"] = SCOPES.get(scope.lower(), scope.lower())
    return Parsed(" ".join(query.split()) if found else query.strip(), **found)


def parse_column(log: DataFrame, query: str) -> DataFrame:
    """The same for a log of queries, as native columns."""
    rest, out = F.col(query), {}
    for name, pattern in PREFIXES.items():
        java = "(?i)" + pattern.replace(r"\w", r"[\p{L}\p{N}_]")
        if name == "exclude_paths":
            out[name] = F.regexp_extract_all(rest, F.lit(java), F.lit(1))
            rest = F.regexp_replace(rest, java, "")
        else:
            out[name] = F.nullif(F.regexp_extract(rest, java, 1), F.lit(""))
            # Only the first mention is taken out.
            rest = F.when(out[name].isNotNull(), F.regexp_replace(rest, _first(java), "$1$2")).otherwise(rest)
    scopes = F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv])
    low = F.lower(out["scope"])
    out["scope"] = F.coalesce(F.element_at(scopes, low), low)
    out["text"] = F.trim(F.regexp_replace(rest, r"\s+", " "))
    return log.select("*", *[c.alias(n) for n, c in out.items()])


def _first(java: str) -> str:
    """A pattern over the whole text whose groups are what stands before and after the first match."""
    body = re.sub(r"\((?!\?)", "(?:", java.removeprefix("(?i)"))
    return f"(?is)^(.*?){body}(.*)$"


def expand_synonyms(query: str) -> str:
    """Lower-case every identifier and put up to two synonyms behind each of the first five that have any."""
    spent = 0

    def expanded(m: re.Match) -> str:
        nonlocal spent
        word = m.group().lower()
        more = values.SYNONYMS.get(word, [])[:values.MAX_SYNONYMS] if spent < values.MAX_EXPANSIONS else []
        spent += bool(more)
        return " ".join([word, *more])
    return re.sub(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", expanded, query)


def expand_camel(query: str) -> str:
    split = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", query))
    return query if split == query else f"{query} {split.lower()}"


def infer_language(query: str) -> str | None:
    return next((language for language, pattern in values.LANGUAGE_HINTS if re.search(pattern, query, re.I)), None)


def search_text(parsed: Parsed) -> str:
    """The text that retrieval uses: with names and expanded."""
    parts = [parsed.text, f"function {parsed.function_name}" if parsed.function_name else "", f"class {parsed.class_name}" if parsed.class_name else ""]
    return expand_synonyms(expand_camel(" ".join(p for p in parts if p)))


def pushdown_tokens(glob: str) -> list[str] | None:
    """Lower-cased words of a glob that no wildcard touches: every match has them as whole tokens."""
    masked = re.sub(r"\[[^\]]*\]|[*?\[]", "\0", glob)
    found = [m.group().lower() for m in re.finditer(r"[A-Za-z0-9]+", masked)
             if masked[m.start() - 1:m.start()] != "\0" and masked[m.end():m.end() + 1] != "\0" and len(m.group()) <= 64]
    return found or None
