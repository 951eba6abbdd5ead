"""Functions paired with their documentation.

Chunks are lexed into token rows: runs of comments, annotations, function
headers, docstrings, and the openings and closings of blocks (braces, Python
indentation, Ruby's ``end``), each with its line. SQL windows do the rest: a
running sum gives the depth, a lead within one depth finds where a body closes,
islands of consecutive annotation lines join their header, a lag finds the
comment right above. A comment that stands at the end of one chunk, right above
a function that begins the next, is found by a join on file and line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.session import cut

#: Languages by file extension.
EXTENSIONS = {"py": "python", "pyi": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js",
              "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c",
              "rb": "ruby", "sh": "bash", "bash": "bash"}
LANGUAGES = {"python": "python", "javascript": "js", "typescript": "js", "go": "go", "java": "java", "rust": "rust",
             "c": "c", "cpp": "c", "ruby": "ruby", "bash": "bash", "shell": "bash"}
#: Words that stand before a parenthesis and a brace without naming a function.
NOT_NAMES = frozenset("if for while switch catch function with return else do try new throw case typeof await yield "
                      "match loop unsafe synchronized sizeof defined elif using lock foreach super this".split())

_PARENS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_WORDS = r"(?:{})[ \t]+"
_JAVA_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*"
HEADERS = {k: re.compile(v, re.M) for k, v in {
    "python": r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)",
    "js": (r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<n>[\w$]+)[ \t]*(?:<[^>\n]*>)?[ \t]*"
           + _PARENS + r"(?:\s*:[^;{]*(?:\{[^{}\n]*\})?[^;{\n]*)?\s*\{"
           r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<n2>[\w$]+)[ \t]*(?::[^=\n]*(?:=>[^=\n]*)?)?=[ \t]*(?:async\b[ \t]*)?"
           r"(?:function\b|(?:<[^>\n]*>)?(?:" + _PARENS + r"(?:[ \t]*:[^=\n]*)?|[\w$]+)[ \t]*=>)"
           r"|^[ \t]*(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)[ \t]+)*[*#]?(?P<n3>[\w$]+)[ \t]*\??(?:<[^>\n]*>)?"
           + _PARENS + r"(?:[ \t]*:[^;{=\n]*)?[ \t]*\{"
           r"|^[ \t]+(?:(?:public|private|protected|static|readonly|override)[ \t]+)*(?P<n4>[\w$]+)[ \t]*(?::[^=\n]*)?=[ \t]*(?:async\b[ \t]*)?"
           r"(?:function\b|" + _PARENS + r"(?:[ \t]*:[^=\n]*)?[ \t]*=>)"),
    "go": r"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(?P<n>\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*" + _PARENS + r"[^\n]*\{",
    "rust": r"^[ \t]*(?:pub(?:[ \t]*\([^)\n]*\))?[ \t]+)?(?:(?:async|const|unsafe|default|extern(?:[ \t]*\"[^\"\n]*\")?)[ \t]+)*fn[ \t]+(?P<n>(?:r#)?\w+)[^;{]*\{",
    "java": (r"^[ \t]*(?:@\w+(?:\([^)\n]*\))?[ \t]+)*" + _JAVA_MODS + r"(?:<[^\n(){}]+>[ \t]+)?(?:(?P<t>[\w.$]+(?:[ \t]*<[^\n(){};]*>)?(?:[ \t]*\[\])*)[ \t]+)?"
             r"(?P<n>[A-Za-z_$][\w$]*)[ \t]*" + _PARENS + r"\s*(?:throws[ \t]+[\w., \t\n]+)?\{"),
    "c": r"^(?!(?:else|return|typedef|case|goto)\b)(?:[A-Za-z_]\w*(?:[ \t]*\*+[ \t]*|[ \t\n]+))+\*?(?P<n>[A-Za-z_]\w*)[ \t]*" + _PARENS + r"\s*\{",
    "ruby": r"^[ \t]*(?:(?:private|public|protected|module_function|private_class_method|memoize)[ \t]+)?def[ \t]+(?:[A-Za-z_]\w*\.)?(?P<n>[A-Za-z_]\w*[?!=]?)",
    "bash": r"^[ \t]*(?:function[ \t]+(?P<n>[\w:.-]+)[ \t]*(?:\([ \t]*\))?|(?P<n2>[\w:.-]+)[ \t]*\([ \t]*\))\s*\{",
}.items()}

_C_STRINGS = r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?'
TOKENS = {k: re.compile(v, re.S) for k, v in {
    "python": r'#[^\n]*|[rRbBuUfF]{0,2}(?:"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z))|' + _C_STRINGS + r"|\\\n|\n|[][(){}]",
    "js": (r"/\*.*?(?:\*/|\Z)|//[^\n]*|" + _C_STRINGS + r"|`(?:[^`\\]|\\.)*`?"
           r"|(?<=[=(,:;!&|?{}\[+\n])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/|\n|[{}]"),
    "go": r"/\*.*?(?:\*/|\Z)|//[^\n]*|" + _C_STRINGS + r"|`[^`]*`?|\n|[{}]",
    "rust": r"/\*.*?(?:\*/|\Z)|//[^\n]*|r(?P<h>#*)\".*?\"(?P=h)|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|\n|[{}]",
    "java": r'/\*.*?(?:\*/|\Z)|//[^\n]*|""".*?"""|' + _C_STRINGS + r"|\n|[{}]",
    "c": r"/\*.*?(?:\*/|\Z)|//[^\n]*|" + _C_STRINGS + r"|\n|[{}]",
    "ruby": r"^=begin\b.*?^=end[^\n]*|#[^\n]*|" + _C_STRINGS + r"|\n",
    "bash": r"(?<![\w$}\"'])#[^\n]*|\$\{[^}\n]*\}|\$#|\"(?:[^\"\\]|\\.)*\"?|'[^']*'?|\\.|\n|[{}]",
}.items()}
_ANNOTATION = re.compile(r"[ \t]*(?:@[\w.]+(?![\w.]*[ \t]*=[^=])[^\n]*|#!?\[[^\n]*|\[\[[^\n]*\]\][ \t]*|__attribute__[^\n]*|template[ \t]*<[^\n]*>[ \t]*)$", re.M)
_RUBY_OPEN = re.compile(r"[ \t]*(?:[\w.@\[\]]+[ \t]*(?:\|\||&&|[-+*/])?=[ \t]*)?(?:def|class|module|begin|if|unless|while|until|case|for)\b|[^\n#]*\bdo[ \t]*(?:\|[^|\n]*\|)?[ \t]*$", re.M)
_RUBY_HEAD = re.compile(r"[ \t]*(?:(?:private|public|protected|module_function|private_class_method|memoize)[ \t]+)?def\b")
_RUBY_END = re.compile(r"[ \t]*end\b")


def language(path: str | None, named: str | None) -> str | None:
    """The language of a file's extension, else the one named; null if neither is known."""
    extension = (path or "").rsplit(".", 1)[-1].lower()
    return EXTENSIONS.get(extension) or LANGUAGES.get((named or "").strip().lower())


def lex(text: str, lang: str) -> list[tuple]:
    """(kind, line, end_line, name, text) rows of one chunk, in order; lines from 1.

    Kinds: c a run of full-line comments, b a block comment, a an annotation
    line, h a header, o and e the opening and end of a block, d a docstring.
    Blocks that open and close on one line are left out.
    """
    tokens = [(m.start(), m.end(), text[m.start():m.end()]) for m in TOKENS[lang].finditer(text)]
    heads: dict[int, str] = {}
    for m in HEADERS[lang].finditer(text):
        name = next(v for v in (m.groupdict().get(k) for k in ("n", "n2", "n3", "n4")) if v)
        kind = m.groupdict().get("t")
        if name in NOT_NAMES or kind in NOT_NAMES or (lang == "java" and kind is None and not name[0].isupper()):
            continue
        heads[m.start()] = name
    if lang == "python":
        return _lex_python(text, tokens, heads)
    rows: list[tuple] = []
    line, start, opened, fresh = 1, 0, [], True

    def begin_line(at: int) -> None:
        if at in heads:
            rows.append(("h", line, line, heads[at], None))
        elif _ANNOTATION.match(text, at) and lang != "bash":
            rows.append(("a", line, line, None, None))
        if lang == "ruby":
            head, opens, ends = _RUBY_HEAD.match(text, at), _RUBY_OPEN.match(text, at), _RUBY_END.match(text, at)
            if opens or head:
                rows.append(("o", line, line, None, None))
            elif ends:
                rows.append(("e", line, line, None, None))

    begin_line(0)
    for a, b, t in tokens:
        if t == "\n":
            rows += [("o", at, at, None, None) for at in opened]
            opened = []
            line, start, fresh = line + 1, b, True
            begin_line(b)
            continue
        first = fresh and not text[start:a].strip()
        fresh = False
        c = t[0]
        if c == "{":
            opened.append(line)
        elif c == "}":
            if opened:
                opened.pop()
            else:
                rows.append(("e", line, line, None, None))
        elif t.startswith(("/*", "=begin")):
            end = line + t.count("\n")
            if first and not text[b:(text.find("\n", b) + 1 or len(text) + 1) - 1].strip():
                rows.append(("b", line, end, None, t))
            line = end
        elif c == "#" and lang in ("ruby", "bash") or t.startswith("//"):
            if first:
                last = rows[-1] if rows else None
                if last and last[0] == "c" and last[2] == line - 1:
                    rows[-1] = ("c", last[1], line, None, last[4] + "\n" + t)
                else:
                    rows.append(("c", line, line, None, t))
        else:
            line += t.count("\n")
    rows += [("o", at, at, None, None) for at in opened]
    return rows


def _lex_python(text: str, tokens: list[tuple], heads: dict[int, str]) -> list[tuple]:
    rows: list[tuple] = []
    line, start, nested, indents, logical, docs = 1, 0, 0, [], True, False
    last_code = 1
    for a, b, t in [*tokens, (len(text), len(text), "\n")]:
        if logical and t[0] != "#":
            stripped = text[start:a].strip()
            if stripped or t != "\n":
                # The first code of a logical line: indentation, header, docstring.
                width = len(text[start:]) - len(text[start:].lstrip(" \t")) if a - start > 400 else len(text[start:a + 1]) - len(text[start:a + 1].lstrip(" \t"))
                if not indents:
                    indents.append(width)
                grown = width > indents[-1]
                # Blocks end with their last code; comments after it belong to what follows.
                ended = len(rows)
                while ended and rows[ended - 1][0] == "c" and rows[ended - 1][1] > last_code:
                    ended -= 1
                while len(indents) > 1 and width < indents[-1]:
                    indents.pop()
                    rows.insert(ended, ("e", last_code, last_code, None, None))
                if grown:
                    indents.append(width)
                    rows.append(("o", line, line, None, None))
                    if docs and not stripped and t[:1] not in "\n[](){}" and t[0] != "\\":
                        rows.append(("d", line, line + t.count("\n"), None, t))
                docs = start in heads
                if docs:
                    rows.append(("h", line, line, heads[start], None))
                elif _ANNOTATION.match(text, start) and text[start:start + width + 1].lstrip()[:1] == "@":
                    rows.append(("a", line, line, None, None))
                logical = False
        if t == "\n":
            last_code = line if not logical else last_code
            line, start = line + 1, b
            logical = nested == 0
        elif t == "\\\n":
            line += 1
        elif t[0] == "#":
            if nested == 0 and not text[start:a].strip():
                last = rows[-1] if rows else None
                if last and last[0] == "c" and last[2] == line - 1:
                    rows[-1] = ("c", last[1], line, None, last[4] + "\n" + t)
                else:
                    rows.append(("c", line, line, None, t))
        elif t in "([{":
            nested += 1
        elif t in ")]}":
            nested = max(0, nested - 1)
        else:
            line += t.count("\n")
    rows += [("e", last_code, last_code, None, None)] * (len(indents) - 1)
    return rows


TOKEN_FIELDS = [("chunk_id", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()),
                ("name", pa.string()), ("text", pa.string()), ("lines", pa.int32()),
                ("collection", pa.string()), ("path", pa.string()), ("base", pa.int32())]


def token_rows(chunks: DataFrame) -> DataFrame:
    """The token rows of chunks that hold a header, a docstring or a comment at
    their end; file and line go only with rows that may need them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in TOKEN_FIELDS]
            for chunk, collection, path, named, base, content in zip(*[c.to_pylist() for c in batch.columns]):
                lang = language(path, named)
                if not lang or not content:
                    continue
                text = content.replace("\r\n", "\n").replace("\r", "\n")
                rows, lines = lex(text, lang), text.count("\n") + 1
                has_head = any(r[0] == "h" for r in rows)
                for pos, (kind, line, end, name, value) in enumerate(rows):
                    comment = kind in "cb"
                    if not has_head and not (comment and end == lines):
                        continue
                    located = kind == "h" or comment
                    for column, v in zip(out, (chunk, pos, kind, line, end, name, value, lines, collection if located else None,
                                               path if located else None, base if located else None)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, TOKEN_FIELDS)], [n for n, _ in TOKEN_FIELDS])
    schema = ("chunk_id long, pos int, kind string, line int, end_line int, name string, text string, lines int, "
              "collection string, path string, base int")
    columns = ["collection", "path", "language", "start_line", "content"]
    kept = chunks.where(F.col("content").isNotNull()).groupBy("chunk_id").agg(F.first(F.struct(*columns)).alias("c"))
    return kept.select(F.col("chunk_id").cast("long"), "c.collection", "c.path", "c.language",
                       F.coalesce(F.col("c.start_line"), F.lit(1)).cast("int").alias("base"), "c.content").mapInArrow(run, schema)


def spans(tokens: DataFrame) -> DataFrame:
    """One row per function: where its annotations begin, its header stands and
    its body ends (lines within the chunk), its docstring and the comment right
    above it within the chunk."""
    w = Window.partitionBy("chunk_id").orderBy("pos")
    kind = F.col("kind")
    step = F.when(kind == "o", 1).when(kind == "e", -1).otherwise(0)
    depth = tokens.withColumn("depth", F.sum(step).over(w))
    level = F.when(kind == "o", F.col("depth") - 1).when(kind == "e", F.col("depth")).otherwise(F.lit(-10**6))
    same = Window.partitionBy("chunk_id", "level").orderBy("pos")
    closed = depth.withColumn("level", level).withColumn("closes", F.when(kind == "o", F.lead("line").over(same)))
    joined = closed.select(
        "*",
        (F.lead("kind").over(w) == "o").alias("opens"), F.lead("closes").over(w).alias("body_end"),
        F.when(F.lead("kind", 2).over(w) == "d", F.lead("text", 2).over(w)).alias("docstring"),
        F.when(F.lag("kind").over(w).isin("c", "b") & (F.lag("end_line").over(w) == F.col("line") - 1),
               F.struct(F.lag("text").over(w).alias("text"), F.lag("line").over(w).alias("line"))).alias("above"),
        F.when((F.lag("kind").over(w) == "a") & (F.lag("end_line").over(w) == F.col("line") - 1), 0).otherwise(1).alias("starts"))
    island = joined.where(kind.isin("a", "h")).withColumn("island", F.sum("starts").over(w))
    group = Window.partitionBy("chunk_id", "island").orderBy("pos")
    grouped = island.withColumn("first_line", F.first("line").over(group)).withColumn("comment", F.first("above").over(group))
    end = F.when(F.col("opens"), F.coalesce("body_end", "lines")).otherwise(F.col("line"))
    return grouped.where(kind == "h").select(
        "chunk_id", "pos", F.col("name").alias("function_name"), "first_line", "line", end.alias("last_line"),
        F.when(F.col("opens"), F.col("docstring")).alias("docstring"), "comment", "collection", "path", "base")


def with_comments_of_other_chunks(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Fill in, for a function that begins its chunk, the comment that ends
    another chunk of the file on the line above."""
    ends = tokens.where(F.col("kind").isin("c", "b") & (F.col("end_line") == F.col("lines"))).select(
        F.col("collection").alias("c_collection"), F.col("path").alias("c_path"), (F.col("base") + F.col("end_line")).alias("next_line"),
        F.struct("text", (F.col("base") + F.col("line") - 1).alias("line")).alias("outer"))
    ends = ends.groupBy("c_collection", "c_path", "next_line").agg(F.min("outer").alias("outer"))
    wanted = F.when(F.col("comment").isNull() & F.col("docstring").isNull() & (F.col("first_line") == 1), F.col("base"))
    joined = found.withColumn("wanted", wanted).join(ends, (
        (F.col("wanted") == F.col("next_line")) & F.col("collection").eqNullSafe(F.col("c_collection")) & (F.col("path") == F.col("c_path"))), "left")
    inner = F.when(F.col("comment").isNotNull(),
                   F.struct(F.col("comment.text").alias("text"), (F.col("base") + F.col("comment.line") - 1).alias("line")))
    return joined.withColumn("comment", F.coalesce(inner, F.col("outer"))).drop("wanted", "c_collection", "c_path", "next_line", "outer")


def without_file_descriptions(found: DataFrame, files: DataFrame) -> DataFrame:
    """Drop a comment at the head of a file that says what the file's summary
    begins with: it describes the file."""
    summaries = files.select(F.col("collection").alias("f_collection"), F.col("path").alias("f_path"), "summary").where(
        F.col("summary").isNotNull()).groupBy("f_collection", "f_path").agg(F.max("summary").alias("summary"))
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    head = F.when(F.col("docstring").isNull() & (F.col("comment.line") <= 2), F.col("path"))
    joined = found.withColumn("head", head).join(summaries, (
        (F.col("head") == F.col("f_path")) & F.col("collection").eqNullSafe(F.col("f_collection"))), "left")
    told = plain(F.col("comment.text"))
    same = F.col("summary").isNotNull() & (told != "") & plain(F.col("summary")).startswith(told)
    return joined.withColumn("comment", F.when(~F.coalesce(same, F.lit(False)), F.col("comment"))).drop(
        "head", "f_collection", "f_path", "summary")


# ---- what documentation says ------------------------------------------------

_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*?/)|//[/!]*|#+!?|=begin|=end|[rRbBuUfF]{0,2}(?:\"\"\"|'''|\"|'))\s?|\s*(?:\*+/|\"\"\"|'''|[\"'])\s*$")
_TAG = re.compile(r"^(?:[@\\:](?:param|arg|argument|returns?|retval|throws?|exception|raises?|type|rtype|see|since|deprecated|author|version|"
                  r"yields?|example|todo|private|public|internal|override|async|static|class|template|typeparam|memberof|function|method|name|ivar|option|overload)\b"
                  r"|@[a-zA-Z-]+|:\w+)", re.I)
_NAMED_TAG = re.compile(r"^(?:param|arg|argument|throws?|exception|raises?|retval|template|typeparam|option|ivar|type)$", re.I)
_SECTION = re.compile(r"^#*\s*(?:args|arguments|parameters|params|returns?|raises|throws|yields|errors|examples?|panics|safety|notes?|usage|see also|attributes|keyword args)\s*:?\s*-*$", re.I)
_DIRECTIVE = re.compile(
    r"^(?:nolint\w*(?:[(:].*)?|nosonar|nosec|noqa\b.*|noinspection\b.*|no_mangle|eslint\b.*|eslint-\w.*|tslint:.*|jshint\b.*|jslint\b.*|global\s+\w+|prettier-ignore.*|@?ts-\w+.*|@ts-.*|istanbul\s+ignore.*|c8\s+ignore.*|v8\s+ignore.*"
    r"|pylint:.*|type:\s*ignore.*|mypy:.*|fmt:\s*(?:off|on|skip)|yapf:.*|isort:.*|pragma:?\b.*|pyright:.*|ruff:.*|flake8:.*|coverage:.*|lint:.*|nolintnextline.*"
    r"|clang-format\s+(?:on|off)|clang-tidy.*|cppcheck-suppress.*|gcovr?_excl\w*|lcov_excl\w*|checkstyle:.*|pmd.*|cspell:.*|spell-?checker:.*|biome-ignore.*|deno-\w+.*|webpack\w*:.*|@__pure__|@flow\b.*"
    r"|rubocop:.*|reek:.*|sorbet:.*|typed:.*|frozen_string_literal:.*|shellcheck\s.*|go:\w+.*|\+build.*|rustfmt.*|clippy::.*|cbindgen:.*|swiftlint:.*|ktlint-.*|sonar\w*:.*|suppress\w*\b.*|codecov.*|language=.*|region\b.*|endregion\b.*|@formatter:\w+|vim?:.*|-\*-.*|#?(?:end)?region.*|skipcq.*)$", re.I)
_PLACEHOLDER = re.compile(
    r"^(?:\W*(?:(?-i:TODO|FIXME|XXX|HACK|TBD|TBC|WIP|TBA)\b.*|(?:todo|fixme)\s*[:(\-–—].*|(?:todo|fixme|xxx|hack|tbd|tbc|wip|tba|n/?a|none|nothing|null|placeholder|undocumented|foo|bar|test)\b\W*)$)"
    r"|^\W*(?:(?:(?:please\s+)?(?:add|insert|write|fill\s+in|put|enter|provide|your|the|a|an|some|this|no|missing|need|needs|needed|lacks?|without)\s+)+(?:(?:the|a|an|some|your|method|function|short|brief|proper|better)\s+)*"
    r"(?:docs?|docstrings?|documentation|descriptions?|comments?|summary|text|javadoc|jsdoc)(?:\s+(?:here|yet|available|later|needed|required|missing|string|goes here))*"
    r"|(?:docs?|docstring|documentation|descriptions?|comments?|summary)\s*(?:goes here|here|missing|pending|needed|to be (?:added|written|done)|to come|tbd|todo|to do|follows|later|:?)"
    r"|missing\s+(?:docs?|docstring|documentation|description|comment)s?"
    r"|(?:function|method|auto-?generated)\s+(?:description|documentation|comment|(?:method|function)\s+stub)|auto-?generated.*stub|not (?:yet )?documented(?: yet)?|to be (?:done|documented|written)|lorem ipsum.*|write me|document me|describe me|description|document this.*|describe this.*|what does this do\??|works? in progress|coming soon|same as above|see above|self[- ]explanatory|ask \w+.*|\?+|\.+|-+)\W*$", re.I)
_FILLER = frozenset("a an the this that it its is does do will to of for and or function method func procedure routine subroutine helper "
                    "which implementation implements implement performs perform called name".split())
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:if|for|while|return|const|let|var|import|from|def|func|fn|echo)\b.*[({=;:]|^[\w.\[\]]+(?:,\s*\w+)*\s*(?::=|[-+*/]?=(?!=))\s*\S|^[\w.:]+!?\([^)]*\)\s*[;?]?$|^(?:return|puts|print|echo|end|fi|done|else|pass|break|continue)\b[^.]{0,40}$")


def _split_name(name: str) -> list[str]:
    pieces = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[\W_]+", " ", name).lower().split()
    return pieces


def _stems(words: list[str]) -> list[str]:
    """Words without the endings that a verb or noun takes in another form."""
    out = []
    for w in words:
        for ending in ("ing", "ies", "ied", "es", "ed", "s", "e", "y"):
            if w.endswith(ending) and len(w) - len(ending) >= 2:
                w = w[: len(w) - len(ending)]
                break
        if len(w) > 3 and w[-1] == w[-2]:
            w = w[:-1]
        out.append(w)
    return out


def says_nothing(doc: str | None, name: str) -> bool:
    """Whether documentation is trivial: empty, a placeholder or note to self, the
    function's name in other form or words, bare tags, tool directives, rulers or
    disabled code. Anything else counts, in any language."""
    if not doc:
        return True
    left, listing = [], False
    for raw in doc.split("\n"):
        line = raw
        for _ in range(3):
            shorter = _MARKS.sub("", line)
            if shorter == line:
                break
            line = shorter
        line = line.strip()
        if not re.search(r"\w", line) or _DIRECTIVE.match(line):
            continue
        if _SECTION.match(line):
            listing = True
            continue
        tag = _TAG.match(line)
        if tag:
            rest = re.sub(r"^\s*(?:\{[^}]*\}|\[[^\]]*\])", "", line[tag.end():]).strip()
            if _NAMED_TAG.match(tag.group().strip("@\\:")):
                rest = re.sub(r"^[\w$.\[\]=*&`']+\s*:?", "", rest).strip(" -–:")
            if not re.search(r"\w{2}", rest):
                continue
            line = rest
        elif listing and re.match(r"^[-*]?\s*`?\*{0,2}[\w$]+`?\s*(?:\([^)]*\))?\s*:?\s*-?$", line):
            continue
        left.append(line)
    if not left:
        return True
    if all(_PLACEHOLDER.match(line) for line in left):
        return True
    own = set(_stems(_split_name(name)))
    said = _stems([w for w in _split_name(" ".join(left)) if w not in _FILLER])
    if all(w in own for w in said):
        return True
    return all(_CODE.search(line) for line in left)


def trivial(doc: Column, name: Column) -> Column:
    def each(docs: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([says_nothing(d, n) for d, n in zip(docs, names)], dtype=bool)
    return F.pandas_udf(each, T.BooleanType())(doc, name)


def documented_functions(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_id, function_name, first_line, last_line, doc of every function with
    documentation that is not trivial.

    Chunks count once by chunk_id; null contents hold no functions; chunks of
    unknown language are left out. Two functions of one name in a chunk give two
    rows. A Python docstring goes before a comment, unless it says nothing and
    the comment does not. Empty tables give an empty result.
    """
    tokens = cut(token_rows(chunks))
    found = without_file_descriptions(with_comments_of_other_chunks(spans(tokens), tokens), files)
    doc = F.coalesce("docstring", "comment.text")
    kept = found.withColumn("doc", doc).where(F.col("doc").isNotNull()).where(~trivial(F.col("doc"), F.col("function_name")))
    return kept.select("chunk_id", "function_name", "first_line", "last_line", "doc")


def function_pairs(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_id, function_name, code, doc: the lines of each documented function with its documentation."""
    found = documented_functions(chunks, files)
    texts = chunks.where(F.col("content").isNotNull()).groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.first("content").alias("content"))
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1)
    code = F.array_join(F.slice(lines, F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n")
    own = texts.withColumnRenamed("chunk_id", "of")
    return found.join(own, F.col("chunk_id").eqNullSafe(F.col("of"))).select("chunk_id", "function_name", code.alias("code"), "doc")
