"""Text functions as native columns: nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeseek.functions import values

#: Where a string is cut into tokens: anything that is no letter or number, and camel humps (Java regex).
CUTS = r"[^\p{L}\p{N}]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
WORD = r"[\p{L}\p{N}_]"


def literal(text: str) -> str:
    """A Java regex that matches ``text`` itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def tokens(text: Column, min_length: int = 2) -> Column:
    """Tokens in order: camel humps and snake case split, lower-cased, stop words and short pieces dropped."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), CUTS), F.lower)
    return F.filter(pieces, lambda t: (F.length(t) >= min_length) & ~t.isin(*values.STOP_WORDS))


def word_tokens(text: Column) -> Column:
    """The set of lower-cased words of an identifier or path part."""
    cuts = r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), cuts), F.lower), lambda t: t != ""))


def edge_match(text: Column, query: str) -> Column:
    """Case-insensitive match of ``query`` at word edges. An edge is asked for
    only where the query begins or ends with a word character; texts beyond the
    length limit are matched as plain substrings; a blank query never matches."""
    if not query.strip():
        return F.lit(False)
    left = f"(?<!{WORD})" if re.match(r"\w", query) else ""
    right = f"(?!{WORD})" if re.search(r"\w$", query) else ""
    exact = text.rlike(f"(?iu){left}{literal(query)}{right}")
    return F.coalesce(F.when(F.length(text) > values.MAX_REGEX_CHARS, F.lower(text).contains(query.lower())).otherwise(exact), F.lit(False))


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """The path without its last component; empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def in_path(path: Column, prefix: str) -> Column:
    """``path:``: the prefix begins within a folder component; with a slash inside it may run on into the file name."""
    p = prefix.strip("/")
    if "/" in p:
        hit = F.concat(F.lit("/"), path).contains("/" + p)
    else:
        hit = folder(path).contains(p)
    return path.contains("/") & hit


def glob_regex(pattern: str) -> str:
    """A file-name glob (``*  ?  [..]  [!..]``) as a regex over the whole lower-cased name."""
    out, i, p = "", 0, pattern.lower()
    while i < len(p):
        c = p[i]
        close = p.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inside = p[i + 1:close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def glob_match(path: Column, pattern: str) -> Column:
    name = F.lower(filename(path))
    return name.rlike(glob_regex(pattern)) if re.search(r"[*?\[]", pattern) else name == pattern.lower()


def is_test(path: Column, name: Column) -> Column:
    """Whether a folder, the file name or the name holds a test word as a whole word."""
    words = F.array_union(word_tokens(path), word_tokens(name))
    return F.arrays_overlap(words, F.array(*map(F.lit, values.TEST_WORDS)))


def language_of(path: Column) -> Column:
    """The language of a path's extension; null if unknown."""
    known = F.create_map(*[F.lit(x) for kv in values.EXTENSIONS.items() for x in kv])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def chunk_type_of(node: Column) -> Column:
    """The chunk type of a syntax node's name; 'block' if no part of it is known."""
    return reduce(lambda rest, kv: F.when(node.contains(kv[0]), kv[1]).otherwise(rest), reversed(values.CHUNK_TYPES), F.lit("block"))


def path_boost(path: Column) -> Column:
    """The sum of the adjustments of all patterns in the lower-cased path, capped on both sides."""
    low = F.lower(path)
    total = reduce(lambda a, b: a + b, [F.when(low.contains(p), F.lit(d)).otherwise(F.lit(0.0)) for p, d in values.PATH_BOOSTS.items()])
    return F.least(F.lit(values.MAX_BOOST), F.greatest(F.lit(-values.MAX_BOOST), total))


def expand_camel(query: Column) -> Column:
    """The query and, where it has camel humps, the lower-cased split form after it."""
    split = F.regexp_replace(F.regexp_replace(query, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.when(split != query, F.concat_ws(" ", query, F.lower(split))).otherwise(query)


def infer_language(query: Column) -> Column:
    """The first language hint that matches; null if none does."""
    return reduce(lambda rest, h: F.when(query.rlike("(?i)" + h[1]), h[0]).otherwise(rest), reversed(values.LANGUAGE_HINTS), F.lit(None).cast("string"))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; null if there is none."""
    return F.trim(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(1)))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def imports_of(content: Column, language: Column) -> Column:
    """Up to 15 imported modules in order of first mention."""
    def found(pattern: str, group: int = 1, within: Column = content) -> Column:
        return F.regexp_extract_all(within, F.lit(pattern), F.lit(group))
    python = found(r"(?m)^(?:from|import)[ \t]+([^\s.,;]*)")
    script = F.transform(found(r"""(?:from[ \t]+|require\([ \t]*)['"]([^'"]+)['"]"""), lambda x: x)
    go = F.transform(found(r'"([^"\n]+)"', 1, F.substring(content, 1, 1000)), lambda x: F.substring_index(x, "/", -1))
    none = F.array().cast("array<string>")
    each = F.when(language == "python", python).when(language.isin("javascript", "typescript"), script).when(language == "go", go).otherwise(none)
    return F.slice(F.array_distinct(each), 1, values.MAX_IMPORTS)


def module_docstring(content: Column, language: Column) -> Column:
    """The description at the head of a file, up to 300 characters; null if there is none."""
    head = r"(?s)\A(?:(?:#[^\n]*|[ \t]*)\n){0,5}"
    python = F.regexp_extract(content, head + '[ \\t]*(?:"""(.*?)"""|\'\'\'(.*?)\'\'\')', 1)
    other = F.regexp_extract(content, head + "[ \\t]*(?:'''(.*?)''')", 1)
    block = F.regexp_extract(content, r"(?s)\A\s*/\*\*(.*?)\*/", 1)
    block = F.array_join(F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*\s?", ""))), lambda x: x != ""), " ")
    lines = F.slice(F.split(content, "\n"), 1, 30)
    rust = F.array_join(F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*//[/!]")), lambda x: F.trim(F.regexp_replace(x, r"^\s*//[/!]", ""))), " ")
    go = F.regexp_extract(content, r"(?s)\A((?://[^\n]*\n)+)package ", 1)
    go = F.array_join(F.filter(F.transform(F.split(go, "\n"), lambda x: F.trim(F.regexp_replace(x, "^//", ""))), lambda x: x != ""), " ")
    text = (F.when(language == "python", F.coalesce(F.nullif(python, F.lit("")), other))
            .when(language.isin("javascript", "typescript", "java"), block).when(language == "rust", rust).when(language == "go", go))
    return F.nullif(F.substring(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), 1, values.DOCSTRING_CHARS), F.lit(""))
