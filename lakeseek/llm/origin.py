"""Generated, minified, vendored and blob files, told apart from hand-written ones.

Every file has log evidence for five labels from its path, its head comment, the
shape of its text and how much of its text also stands in other files.
Belief propagation over the directory trees adds what parents and siblings say:
a folder has a label of its own, files tend to have their folder's label and
folders their parent's. On a tree the two passes (up, then down) are exact.
Messages are summed by aggregates with map-side combine, a level of depth at a
time, so neither a folder nor a collection is ever gathered in one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.session import cut, release

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GEN, MIN, VEND, BLOB = range(5)

# Names of folders by what they commonly hold, with the weight of that hint.
FOLDERS = {GEN: (1.5, "generated gen __generated__ generated-sources autogenerated"),
           VEND: (4.0, "vendor vendors third_party third-party thirdparty 3rdparty node_modules bower_components externals "
                       "extern external deps contrib site-packages jspm_packages carthage pods godeps"),
           MIN: (1.0, "dist bundles min minified"),
           BLOB: (0.5, "fixtures data testdata")}
_VENDOR = frozenset(FOLDERS[VEND][1].split())
#: File names that tools give.
_NAMES = [(GEN, 7.0, re.compile(r"(?:_pb2(?:_grpc)?|\.pb|\.generated|\.gen|\.g|\.designer|_generated|\.pb\.gw|\.auto|_gen|\.freezed|\.pb-c)\.\w+$|(?:^|/)zz_generated[._-][^/]*$", re.I)),
          (MIN, 2.0, re.compile(r"(?:[.-]min|[.-]bundle|\.packed|\.prod|\.chunk)\.(?:js|css|mjs)$", re.I)),
          (VEND, 3.0, re.compile(r"(?:^|/)(?:jquery|bootstrap|lodash|underscore|modernizr|angular|react|vue|d3)[.-][^/]*\.(?:js|css)$", re.I))]

_COMMENT = re.compile(r"\s*(?://+!?|#+!?(?!include|define|if|pragma|\[)|/\*+!?|\*+/?|--|<!--|;+|%|\"\"\"|''')\s?(.*?)\s*(?:\*+/|-->)?\s*$")
#: What tools say of files they make, in the languages that comments are commonly written in.
_MADE = re.compile(
    r"(?:^|\W)@(?:auto-?)?generated\b|<auto-?generated\b|\bauto[- ]?generated\b(?!\?)|\bauto[- ]?gen\b"
    r"|\b(?:code|file|source|class|module|document|content|bindings?|stubs?|output|header|parser|lexer|client|types?)\s+(?:(?:was|is|has been|were|are)\s+)?(?:automatically\s+|machine[- ]|auto-?)?"
    r"(?:re)?(?:generated|created|produced|written|emitted|compiled|transpiled|rendered|derived|built)\s+(?:automatically\s+)?(?:by|from|with|using|via|automatically)\b"
    r"|\b(?:re)?generated\s+(?:automatically\s+)?(?:by|from|with|using|on|at|via)\b|\b(?:automatically|machine|mechanically)[- ](?:generated|created|written|produced|made|derived|emitted)\b"
    r"|\b(?:created|produced|written|emitted|derived)\s+automatically\b|\boutput\s+of\b.{0,60}\b(?:compiler|generator|tool|script|build|preprocessor|transpiler)\b"
    r"|\b(?:run|use|call|invoke)\b.{0,60}\bto\s+(?:re-?generate|rebuild|refresh)\b|\bto\s+re-?generate\b.{0,40}\b(?:run|use|call|invoke)\b"
    r"|\b(?:do(?:es)?\s+not|don'?t|never|please\s+do\s+not)\s+(?:hand[- ]?)?(?:edit|modify|change|alter|touch)\s*(?:[.!:;,]|$|by hand|manually|this file|directly|it\b)"
    r"|\b(?:must|should)\s+not\s+be\s+(?:hand[- ]?)?(?:edited|modified|changed|altered)\b|\b(?:manual|hand|local)\s+(?:edits|changes|modifications)\b.{0,40}\b(?:overwritten|lost|discarded|replaced|vanish|undone)\b"
    r"|\b(?:edits|changes|modifications)\b.{0,30}\b(?:overwritten|lost|discarded)\b|\bany changes\b.{0,30}\blost\b"
    r"|\b(?:automatisch|maschinell)\s+(?:erzeugt|generiert|erstellt)\b|\bnicht\s+(?:von\s+hand\s+)?(?:bearbeiten|ändern|editieren)\b|\b(?:erzeugt|generiert)\s+(?:aus|von|durch|mit)\b"
    r"|\bne\s+pas\s+(?:modifier|éditer|toucher)\b|\b(?:fichier|code)\s+(?:produit|généré)\b|\bgénéré\s+(?:par|automatiquement|à\s+partir)\b"
    r"|\bno\s+(?:editar|modificar|tocar)\b|\bgenerado\s+(?:por|automáticamente|a\s+partir)\b|\bcreado\s+automáticamente\b", re.I)
_NOT_MADE = re.compile(r"\b(?:not|never|isn't|aren't|no longer)\s+(?:auto\w*\s+)?(?:generated|produced|created)|\bedit\s+(?:it\s+)?freely|\bwhile\b|\breads?\s+this\b|\bwhen\s+(?:a|the)\b|\buntil\b|\bbefore\b", re.I)
_OTHERS = re.compile(
    r"\bcopyright\b.{0,80}|\ball rights reserved\b|\breleased\s+(?:by|under)\b|\bredistribution\b.{0,40}\bpermitted\b|\b(?:bundled|imported|copied|taken|adapted|vendored|forked|backported)\s+from\b|\bupstream\b|\blicen[cs]ed?\s+under\b|\bspdx-license-identifier\b|\bpermission is hereby granted\b", re.I)
_STRONG_OTHERS = re.compile(r"\bupstream\b|\b(?:contributors|developers|authors)\b.{0,60}\b(?:licen[cs]e|permitted)|\breleased\s+(?:by|under)\b|\b(?:bundled|copied|vendored)\s+from\b", re.I)
_BUNDLE = re.compile(r"/\*\*\*/|__webpack_require__|\(this\);|sourceMappingURL=|^/\*!\s", re.M)
_MAP = re.compile(r"//[#@]\s*sourceMappingURL=")
_BINARY = re.compile("[\x00-\x08\x0e-\x1f\ufffd]")
#: What a tool leaves in a file's place: a pointer to large-file storage, or a page that a server sent.
_POINTER = re.compile(r"version https?://\S+/spec/v\d+\n(?:ext-.*\n)*oid sha\d+:[0-9a-f]+\n")
_PAGE = re.compile(r"\s*(?:<!doctype\s+html|<html)\b", re.I)
#: Extensions of files that may hold a page.
_PAGES = frozenset("html htm xhtml shtml vue svelte php erb ejs hbs jinja j2 tmpl tpl jsp asp aspx cshtml mustache md markdown xml".split())
_BASE64 = re.compile(r"[A-Za-z0-9+/=]{50,}")
_LITERALS = re.compile(r"0[xX][0-9a-fA-F]+|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_NUMBERED = re.compile(r"(?<=[A-Za-z_])(\d{2,4})(?=\()")
_ROW = re.compile(r"^\s*(?:insert\s+into\b.*\bvalues\b|\(.*\)[,;]\s*$|-\s*\[.*\]\s*$|\[?\{.*\}[],]?\s*$|\[?\[.*\],?\s*$)", re.I)


#: Signs that open a comment of several lines, or a docstring, and what closes each.
_OPENS = re.compile(r"\s*(?:(/\*|<!--|^=begin\b)|[rRuU]?(\"\"\"|'''))")
_CLOSES = {"/*": "*/", "<!--": "-->", "=begin": "=end", '"""': '"""', "'''": "'''"}


def head_comment(lines: list[str]) -> list[str]:
    """The texts of the comment lines that open a file, before any code. Inner
    lines of a block comment or a docstring need no sign of their own."""
    out, closes = [], None
    for line in lines:
        at, end = 0, len(line.rstrip())
        while at < end:
            if closes is None:
                m = _OPENS.match(line, at)
                if not m:
                    m = _COMMENT.match(line, at)
                    if not m:
                        return out
                    out.append(m.group(1))
                    break
                closes, at = _CLOSES[m.group(1) or m.group(2)], m.end()
            stop = line.find(closes, at)
            out.append(line[at:stop if stop >= 0 else end].strip("*! \t"))
            if stop < 0:
                break
            at, closes = stop + len(closes), None
    return out


#: Log evidence of a file without any mark: tools mark most of what they make, and dense text shows.
UNMARKED = (0.0, -4.0, -7.0, -3.0, -7.0)


def evidence(path: str, text: str) -> list[float]:
    """Log evidence for each label from a file's name and text."""
    e = [0.0] * 5
    for label, weight, pattern in _NAMES:
        if pattern.search(path):
            e[label] += weight
    if any(name in _VENDOR for name in path.lower().split("/")[:-1]):
        e[VEND] += 3.0
    text = text.lstrip("﻿")
    if len(_BINARY.findall(text)) > 0.02 * len(text):
        e[BLOB] += 8.0
        return e
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if _POINTER.match(text.replace("\r\n", "\n")) or _PAGE.match(text) and path.rpartition(".")[2].lower() not in _PAGES:
        e[GEN] += 8.0
        return e
    head = head_comment(lines)
    if any(_MADE.search(x) and not _NOT_MADE.search(x) for x in head):
        e[GEN] += 8.0
    told = " ".join(head)
    if _STRONG_OTHERS.search(told):
        e[VEND] += 8.0
    elif _OTHERS.search(told):
        e[VEND] += 2.0
    full = [x for x in lines if x.strip()]
    size = sum(map(len, full)) or 1
    # Literals: the share of the text that is numbers, or base64, or rows of them. The more there is, the more it says.
    encoded = sum(len(x) for x in _BASE64.findall(text) if not x.isalpha() or len(x) > 120)
    digits = size - len(text.translate(_NO_DIGITS)) + len(lines) - 1
    numbers = sum(map(len, _LITERALS.findall(text))) if digits > 0.08 * size else 0
    rows = sum(1 for x in full if _ROW.match(x)) if digits > 0.08 * size else 0
    if encoded > 0.5 * size:
        e[BLOB] += 8.0 * min(1.0, size / 300)
    elif numbers > 0.3 * size:
        e[BLOB] += 8.0 * min(1.0, size / 400)
    elif rows > 0.7 * len(full):
        e[BLOB] += 8.0 * min(1.0, rows / 12)
    else:
        # Minified: long dense lines; a hand keeps to some width and leaves white space.
        longest = max(map(len, full), default=0)
        dense = text.count(" ") + text.count("\t") < 0.09 * size
        webpack = "/***/" in text or "__webpack_require__" in text
        if webpack and longest > 200 or longest > 400 and dense and size / max(1, len(full)) > 150:
            e[MIN] += 8.0
        elif longest > 300 and dense:
            e[MIN] += 4.0
        if _MAP.search(text):
            e[MIN] += 3.0
        # Generated without a word about it: one pattern with a running number.
        counted = [int(x) for x in _NUMBERED.findall(text)] if "0" in text else []
        steps = sum(1 for a, b in zip(counted, counted[1:]) if b == a + 1)
        if steps >= 5 and steps > 0.06 * len(full):
            e[GEN] += 8.0
    return e if any(e) else list(UNMARKED)


_NO_DIGITS = {c: None for c in map(ord, "0123456789")}


#: Lines of a window, windows of which the smallest hash is kept, and the least text of a window and of a file that can be called a copy.
WINDOW, KEPT, WINDOW_CHARS, COPY_LINES, COPY_CHARS = 4, 4, 30, 5, 120
#: Prints that two texts have to share at least, unless one has fewer; a chance line in common is no copy.
LEAST_SHARED = 3


def prints(text: str) -> list[int]:
    """Hashes of windows of lines, without white space at line ends and blank
    lines; of any ``KEPT`` windows in a row the smallest is among them, so two
    texts that share ``WINDOW + KEPT - 1`` lines anywhere have one in common,
    whatever was changed above, below or between. A short text has one print, of
    the whole."""
    import xxhash

    lines = [x for x in map(str.strip, text.lstrip("﻿").splitlines()) if x]
    if len(lines) < COPY_LINES or sum(map(len, lines)) < COPY_CHARS:
        return []
    hashes = []
    for i in range(len(lines) - WINDOW + 1):
        part = "\n".join(lines[i:i + WINDOW])
        hashes.append(xxhash.xxh64_intdigest(part) - (1 << 63) if len(part) >= WINDOW_CHARS else 1 << 63)
    kept = {min(hashes[i:i + KEPT]) for i in range(max(1, len(hashes) - KEPT + 1))} - {1 << 63}
    if len(kept) < LEAST_SHARED:
        return [xxhash.xxh64_intdigest("\n".join(lines)) - (1 << 63)]
    return sorted(kept)


_FIELDS = [("file", pa.int64()), ("collection", pa.string()), ("folder", pa.string()), *((f"e{i}", pa.float64()) for i in range(5)),
           ("prints", pa.list_(pa.int64()))]
_E = [f"e{i}" for i in range(5)]


def features(files: DataFrame) -> DataFrame:
    """file, collection, folder, evidence and prints, one row per file_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _FIELDS]
            for file, collection, path, text in zip(*[c.to_pylist() for c in batch.columns]):
                path = path or ""
                values = (file, collection, path.rpartition("/")[0], *evidence(path, text), prints(text))
                for column, v in zip(out, values):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, _FIELDS)], [n for n, _ in _FIELDS])
    rows = files.where(F.col("content").isNotNull() & (F.col("content") != "")).select(
        F.col("file_id").cast("long"), F.coalesce("collection", F.lit("")).alias("collection"), "rel_path", "content")
    made = rows.mapInArrow(run, "file long, collection string, folder string, "
                                + ", ".join(f"{e} double" for e in _E) + ", prints array<long>")
    return made.groupBy("file").agg(F.first(F.struct("collection", "folder", *_E, "prints")).alias("f")).select("file", "f.*")


def with_copies(files: DataFrame, weight: float = 8.0, share: float = 0.5) -> DataFrame:
    """Add to a file's vendored evidence if at least ``share`` of its prints are
    those of other files too. An original that lies among the files cannot be
    told from its copies by this and counts as one of them."""
    each = files.select("file", F.size("prints").alias("held"), F.explode("prints").alias("print"))
    others = each.groupBy("print").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") > 1).select("print")
    copied = each.join(others, "print").groupBy("file").agg(
        (F.count(F.lit(1)) >= F.greatest(share * F.max("held"), F.least(F.lit(LEAST_SHARED), F.max("held")))).alias("copied")).where("copied")
    more = F.when(F.col("copied") & (F.col(f"e{MIN}") < 4) & (F.col(f"e{BLOB}") < 4) & (F.col(f"e{GEN}") < 4), weight).otherwise(0.0)
    return files.join(copied, "file", "left").withColumn(f"e{VEND}", F.col(f"e{VEND}") + more).drop("copied", "prints")


# ---- belief propagation -----------------------------------------------------

#: P(file's label | folder's label) and P(folder's label | parent's label).
FILE_GIVEN_FOLDER = [[0.90, 0.03, 0.02, 0.02, 0.03], [0.20, 0.74, 0.02, 0.02, 0.02], [0.15, 0.03, 0.74, 0.04, 0.04],
                     [0.10, 0.03, 0.05, 0.78, 0.04], [0.25, 0.03, 0.03, 0.03, 0.66]]
FOLDER_GIVEN_PARENT = [[0.92, 0.02, 0.02, 0.02, 0.02], [0.12, 0.82, 0.02, 0.02, 0.02], [0.12, 0.02, 0.82, 0.02, 0.02],
                       [0.05, 0.02, 0.02, 0.89, 0.02], [0.12, 0.02, 0.02, 0.02, 0.82]]
#: The prior over the roots' labels. No message says more than the smallest of
#: these probabilities allows, so a crowd of siblings cannot silence clear evidence.
ROOT = [0.96, 0.01, 0.01, 0.01, 0.01]


def _weighed(df: DataFrame, scores: list[Column]) -> DataFrame:
    """Add p0..p4: the labels' probabilities, up to a factor, from log scores."""
    top = F.greatest(*scores)
    return df.withColumns({f"p{i}": F.exp(s - top) for i, s in enumerate(scores)})


def _to_parent(given: list[list[float]]) -> list[Column]:
    """The log message from a child with p0..p4: per label of the parent."""
    return [F.log(sum((F.col(f"p{l}") * given[d][l] for l in range(1, 5)), F.col("p0") * given[d][0])) for d in range(5)]


def _to_child(given: list[list[float]]) -> list[Column]:
    """The log message from a parent with p0..p4: per label of the child."""
    return [F.log(sum((F.col(f"p{d}") * given[d][l] for d in range(1, 5)), F.col("p0") * given[0][l])) for l in range(5)]


def _folder_hint(name: Column) -> list[Column]:
    out = [F.lit(0.0)] * 5
    for label in FOLDERS:
        weight, names = FOLDERS[label]
        out[label] = F.when(F.lower(name).isin(*names.split()), weight).otherwise(0.0)
    return out


def propagate(files: DataFrame) -> DataFrame:
    """file and a score per label (s0..s4) after both passes."""
    key = ["collection", "folder"]
    cols = [F.col(e) for e in _E]
    files = _weighed(files, cols).withColumns({f"m{i}": m for i, m in enumerate(_to_parent(FILE_GIVEN_FOLDER))})
    files = cut(files.select("file", *key, *_E, *[f"m{i}" for i in range(5)]))
    own = files.groupBy(*key).agg(*[F.sum(f"m{i}").alias(f"e{i}") for i in range(5)])
    # Every folder and its ancestors, with what the names say.
    parts = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    tree = own.select("collection", F.explode(ancestors).alias("folder")).distinct()
    hints = tree.select(*key, *[h.alias(e) for h, e in zip(_folder_hint(F.substring_index("folder", "/", -1)), _E)])
    level = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    base = cut(own.unionByName(hints).groupBy(*key).agg(*[F.sum(e).alias(e) for e in _E]).withColumn("depth", level))
    deepest = base.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.select("file", *[F.col(f"e{i}").alias(f"s{i}") for i in range(5)])
    parent = F.when(F.col("depth") <= 1, "").otherwise(F.expr("substring_index(folder, '/', depth - 1)"))
    # Up: each level's folders tell their parents.
    said = [f"u{i}" for i in range(5)]
    up = {deepest: base.where(F.col("depth") == deepest)}
    for depth in range(deepest, 0, -1):
        told = _weighed(up[depth], cols).withColumns(dict(zip(said, _to_parent(FOLDER_GIVEN_PARENT))))
        up[depth] = cut(told.select(*key, *_E, *said, parent.alias("parent")))
        messages = up[depth].groupBy("collection", F.col("parent").alias("folder")).agg(*[F.sum(f"u{i}").alias(f"e{i}") for i in range(5)])
        here = base.where(F.col("depth") == depth - 1).select(*key, *_E)
        up[depth - 1] = here.unionByName(messages).groupBy(*key).agg(*[F.sum(e).alias(e) for e in _E]).withColumn("depth", F.lit(depth - 1))
    # Down: a folder hears its parent's belief without what it said itself.
    down = cut(up[0].select(*key, *[(F.col(e) + math.log(p)).alias(e) for e, p in zip(_E, ROOT)]))
    beliefs = [down]
    for depth in range(1, deepest + 1):
        above = down.select("collection", F.col("folder").alias("parent"), *[F.col(e).alias(f"b{i}") for i, e in enumerate(_E)])
        heard = _weighed(up[depth].join(above, ["collection", "parent"]), [F.col(f"b{i}") - F.col(f"u{i}") for i in range(5)])
        down = cut(heard.select(*key, *[(F.col(e) + h).alias(e) for e, h in zip(_E, _to_child(FOLDER_GIVEN_PARENT))]))
        beliefs.append(down)
    whole = reduce(DataFrame.unionByName, beliefs)
    around = whole.select(*key, *[F.col(e).alias(f"b{i}") for i, e in enumerate(_E)])
    heard = _weighed(files.join(around, key), [F.col(f"b{i}") - F.col(f"m{i}") for i in range(5)])
    return heard.select("file", *[(F.col(e) + h).alias(f"s{i}") for i, (e, h) in enumerate(zip(_E, _to_child(FILE_GIVEN_FOLDER)))])


def origins(files: DataFrame) -> DataFrame:
    """file_id, label, confidence of every file with text.

    Files count once by file_id; null and empty contents have no row; a null
    path stands at the root. Ties go to the earlier label, hand-written first.
    """
    made = cut(features(files))
    seen = cut(with_copies(made))
    release(made)
    scores = cut(propagate(seen))
    release(seen)
    cols = [F.col(f"s{i}") for i in range(5)]
    weighed = _weighed(scores, cols)
    label = F.coalesce(*[F.when(F.col(f"p{i}") == 1.0, name) for i, name in enumerate(LABELS)])
    total = sum((F.col(f"p{i}") for i in range(1, 5)), F.col("p0"))
    return weighed.select(F.col("file").alias("file_id"), label.alias("label"), F.round(1.0 / total, 6).alias("confidence"))
