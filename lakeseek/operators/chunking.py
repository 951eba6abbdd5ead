"""Files to chunks: line windows as native columns; definitions by syntax in one Arrow pass."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.functions import values


def line_windows(files: DataFrame, key: str, content: str, size: int = values.WINDOW_LINES, overlap: int = values.OVERLAP_LINES) -> DataFrame:
    """key, ordinal, start_line, end_line, content: overlapping windows of lines,
    one window where the lines fit; the last one ends with the file."""
    step = size - overlap
    rows = files.where(F.col(content).isNotNull()).select(key, F.split(content, "\n", -1).alias("lines")).withColumn("n", F.size("lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0)).cast("int") * step, F.lit(step))
    each = rows.select(key, "lines", "n", F.posexplode(starts).alias("ordinal", "start"))
    return each.select(key, "ordinal", (F.col("start") + 1).alias("start_line"), F.least(F.col("start") + size, F.col("n")).alias("end_line"),
                       F.array_join(F.slice("lines", F.col("start") + 1, size), "\n").alias("content"))


def merge_small(chunks: list[dict], below: int = values.MERGE_LINES) -> list[dict]:
    """Join neighbouring blocks that are both short and at most one line apart;
    the first one's name and context stay, so the growing block decides."""
    out: list[dict] = []
    for c in chunks:
        last = out[-1] if out else None
        if (last and last["chunk_type"] == c["chunk_type"] == "block" and last["end_line"] - last["start_line"] + 1 < below
                and c["end_line"] - c["start_line"] + 1 < below and c["start_line"] <= last["end_line"] + 2):
            out[-1] = last | {"end_line": c["end_line"], "content": last["content"] + "\n" + c["content"]}
        else:
            out.append(c)
    return out


def merge_small_column(chunks: Column, below: int = values.MERGE_LINES) -> Column:
    """The same fold over an array of (chunk_type, start_line, end_line) structs."""
    kind = "array<struct<chunk_type:string,start_line:int,end_line:int>>"

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        both = ((last["chunk_type"] == "block") & (c["chunk_type"] == "block") & (last["end_line"] - last["start_line"] + 1 < below)
                & (c["end_line"] - c["start_line"] + 1 < below) & (c["start_line"] <= last["end_line"] + 2))
        grown = F.struct(last["chunk_type"].alias("chunk_type"), last["start_line"].alias("start_line"), c["end_line"].alias("end_line"))
        one = F.struct(c["chunk_type"].alias("chunk_type"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"))
        return F.when(F.coalesce(both, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(one)))
    return F.aggregate(chunks, F.array().cast(kind), step)


# ---- definitions ------------------------------------------------------------

_BRACED = {
    "javascript": [(r"^(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)", "function"), (r"^(?:export\s+(?:default\s+)?)?class\s+(?P<n>[\w$]+)", "class"),
                   (r"^(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>", "function")],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)", "function"), (r"^type\s+(?P<n>\w+)\s+struct\b", "struct"), (r"^type\s+(?P<n>\w+)\s+interface\b", "interface"), (r"^type\s+(?P<n>\w+)\b", "type")],
    "rust": [(r"^(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe)\s+)*fn\s+(?P<n>\w+)", "function"), (r"^(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)", "struct"), (r"^(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)", "enum"),
             (r"^(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)", "interface"), (r"^impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<n>\w+)", "impl"), (r"^(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)", "module")],
    "java": [(r"^(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(?P<n>\w+)", "class"), (r"^(?:(?:public|private|protected|static|abstract)\s+)*interface\s+(?P<n>\w+)", "interface"),
             (r"^(?:(?:public|private|protected|static)\s+)*enum\s+(?P<n>\w+)", "enum")],
    "c": [(r"^(?!(?:else|return|typedef|if|for|while|switch)\b)(?:[A-Za-z_]\w*[\s*]+)+(?P<n>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{", "function"), (r"^(?:typedef\s+)?struct\s+(?P<n>\w+)\s*\{", "struct"), (r"^(?:typedef\s+)?enum\s+(?P<n>\w+)\s*\{", "enum")],
    "ruby": [(r"^def\s+(?:self\.)?(?P<n>\w+[?!=]?)", "function"), (r"^class\s+(?P<n>[\w:]+)", "class"), (r"^module\s+(?P<n>[\w:]+)", "module")],
}
_BRACED["typescript"] = [*_BRACED["javascript"], (r"^(?:export\s+)?interface\s+(?P<n>[\w$]+)", "interface"), (r"^(?:export\s+)?type\s+(?P<n>[\w$]+)", "type"), (r"^(?:export\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)", "enum")]
_BRACED["cpp"] = [*_BRACED["c"], (r"^class\s+(?P<n>\w+)[^;]*\{", "class"), (r"^namespace\s+(?P<n>\w+)", "module")]
_COMPILED = {language: [(re.compile(p), kind) for p, kind in rules] for language, rules in _BRACED.items()}
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)


def context_path(parts: list[str]) -> str | None:
    return ".".join(parts) or None


def _chunk(lines: list[str], kind: str, name: str | None, first: int, last: int, context: list[str]) -> dict:
    return {"chunk_type": kind, "name": name, "start_line": first, "end_line": last, "content": "\n".join(lines[first - 1:last]), "context": context_path(context)}


def _overview(lines: list[str], node: ast.ClassDef, context: list[str]) -> dict:
    """A class in short: its first line, its docstring and its methods' signatures."""
    methods = [n for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    doc = (ast.get_docstring(node) or "")[:values.DOCSTRING_CHARS]
    shown = [lines[m.lineno - 1].strip() for m in methods[:values.MAX_METHODS]]
    more = [f"... and {len(methods) - values.MAX_METHODS} more methods"] if len(methods) > values.MAX_METHODS else []
    body = "\n".join([lines[node.lineno - 1].strip(), *([doc] if doc else []), *shown, *more])
    return _chunk(lines, "class_overview", node.name, node.lineno, node.end_lineno, context) | {"content": body}


def _python(content: str) -> list[dict] | None:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines, out = content.split("\n"), []

    def visit(body: list, context: list[str]) -> None:
        for node in body:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(_chunk(lines, "function", node.name, first, node.end_lineno, context))
            elif isinstance(node, ast.ClassDef):
                if node.end_lineno - first + 1 > values.CLASS_LINES:
                    out.append(_overview(lines, node, context))
                    visit(node.body, [*context, f"class:{node.name}"])
                else:
                    out.append(_chunk(lines, "class", node.name, first, node.end_lineno, context))
    visit(tree.body, [])
    return out


def _scanned(content: str, language: str) -> list[dict]:
    """Definitions at the outer level of a language with braces (or Ruby's ``end``), found by a scan of its lines."""
    lines, out, at = content.split("\n"), [], 0
    bare = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), content).split("\n")
    while at < len(bare):
        hit = next(((m.group("n"), kind) for rule, kind in _COMPILED[language] if (m := rule.match(bare[at] + ("\n" + bare[at + 1] if at + 1 < len(bare) else "")))), None)
        if not hit:
            at += 1
            continue
        last = at
        if language == "ruby":
            while last + 1 < len(bare) and not re.match(r"end\b", bare[last]):
                last += 1
        else:
            depth, opened = 0, False
            for last in range(at, len(bare)):
                depth += bare[last].count("{") - bare[last].count("}")
                opened = opened or "{" in bare[last]
                if opened and depth <= 0 or not opened and bare[last].rstrip().endswith(";"):
                    break
        out.append(_chunk(lines, hit[1], hit[0], at + 1, last + 1, []))
        at = last + 1
    return out


def chunk(content: str, language: str | None) -> list[dict]:
    """The chunks of one file: its definitions, else line windows; short neighbouring blocks are joined."""
    found = _python(content) if language == "python" else _scanned(content, language) if language in _COMPILED else None
    if not found:
        lines, step = content.split("\n"), values.WINDOW_LINES - values.OVERLAP_LINES
        found = []
        for start in range(0, max(1, len(lines)), step):
            end = min(start + values.WINDOW_LINES, len(lines))
            found.append(_chunk(lines, "block", None, start + 1, end, []))
            if end >= len(lines):
                break
    return merge_small(found)


CHUNK_SCHEMA = "ordinal int, chunk_type string, name string, start_line int, end_line int, content string, context string, error string"


def chunks(files: DataFrame, key: str = "file_id", content: str = "content", language: str = "language") -> DataFrame:
    """key and the chunks of every file with content. A file whose chunker fails gives one row with the error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            keys, rows = [], []
            for i, body, lang in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    made = [c | {"ordinal": n, "error": None} for n, c in enumerate(chunk(body, lang))]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    made = [dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"[:300]}]
                keys += [i] * len(made)
                rows += made
            types = {"ordinal": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names]], [key, *names])
    kept = files.where(F.col(content).isNotNull()).select(F.col(key).cast("long").alias(key), content, language)
    return kept.mapInArrow(run, f"{key} long, {CHUNK_SCHEMA}")


def file_summary(docstring: Column, imports: Column, definitions: Column, content: Column) -> Column:
    """The lines of a file's summary: description, imports, definitions; else the head of its text."""
    parts = F.concat_ws("\n", F.nullif(docstring, F.lit("")),
                        F.when(F.size(imports) > 0, F.concat(F.lit("Imports: "), F.array_join(imports, ", "))),
                        F.when(F.size(definitions) > 0, F.concat(F.lit("Defines: "), F.array_join(F.slice(definitions, 1, values.MAX_DEFINITIONS), ", "))))
    head = F.substring(content, 1, 500)
    cut = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    short = F.when((F.length(content) > 500) & (cut > 200), F.substring(head, F.lit(1), cut)).otherwise(head)
    return F.coalesce(F.nullif(parts, F.lit("")), short)


def definition_label(chunk_type: Column, name: Column) -> Column:
    short = F.create_map(*[F.lit(x) for kv in values.SHORT_TYPES.items() for x in kv])
    return F.concat(F.coalesce(F.element_at(short, chunk_type), chunk_type), F.lit(":"), name)


def vocabulary_text(content: Column, imports: Column) -> Column:
    """A chunk's text for the vocabulary: its imports before its content, bounded in length."""
    used = F.when(F.size(F.coalesce(imports, F.array())) > 0, F.concat(F.lit("Uses: "), F.array_join(imports, ", "), F.lit("\n\n"))).otherwise("")
    return F.concat(used, F.substring(content, 1, values.MAX_CONTENT_CHARS))
