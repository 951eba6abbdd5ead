"""Reading level of each document by a Rasch-style latent difficulty model.

A document d stands at a latent demand theta, a word w has difficulties. A slot
of the document (one of its different words) holds w with log odds

    a_w + u_w * min(theta - 2, 0) + v_w * max(theta - 2, 0)

so a word has an ease of its own and a step below and a step above the middle
of the scale, as the items of a partial-credit Rasch model have a step between
neighbouring levels: a child's word has u < 0, a word of ordinary prose u > 0
and v < 0, an expert's word v > 0. (With one step for all words, theta - b_w
alone, theta could only measure length, as one word's gain in a slot is
another's loss.) Levels are thresholds on theta: a rater who can be trusted
gives level k or more with log odds STEEP * (theta - k + 1/2), one who cannot
gives any.

Estimation alternates, as distributed joins and aggregates over (document, word)
rows: the documents' beliefs over a grid of theta given words and raters, then
the words' parameters by Newton steps and the raters' trust given the beliefs,
until the likelihood of all occurrences stands still. It runs on a bounded
sample of labelled documents (``max_labels``). Then theta of every document is
estimated in one pass over its whole text; up to ``max_words`` words their
parameters are sent to the workers, beyond that they are joined.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.session import cut, release

LEVELS = (1, 2, 3)
#: Bounds of the labelled sample and of what is broadcast, and the least prose that is given a level.
MAX_LABELS, MAX_WORDS, MIN_WORDS = 100_000, 200_000, 40
#: The nodes at which beliefs over theta are held, the thresholds between levels, and how steeply labels follow them.
NODES = tuple(0.5 + 0.25 * n for n in range(13))
THRESHOLDS, STEEP = (1.5, 2.5), 6.0
#: A run of more word characters is a word only if it is nothing but letters.
RUN = 100

_FENCED = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_ADDRESS = re.compile(r"\b[a-z][a-z+.-]*://\S+|\bwww\.\S+|\S+@\S+\.\S+")
_SPAN = re.compile(r"`[^`\n]*`|<[^<>\n]+>|&[a-zA-Z#0-9]{1,31};")
_NAME = re.compile(
    r"(?<!\w)(?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]+"           # paths
    r"|\w*_\w*(?:\(\))?|\b\w*[a-z0-9][A-Z]\w*(?:\(\))?"  # identifiers
    r"|\b[A-Za-z]+\d\w*")
_ODD_STARTS = frozenset("|#[$><=0123456789")
_LINE = re.compile(
    r"^[ \t]*(?:\|.*|#{1,6} .*"                      # table rows, headings
    r"|\[?\d{4}-\d\d-\d\d[T ]\d\d:.*"                # log lines
    r"|(?:\$|>>>) .*"                                # shell and interpreter lines
    r"|(?:<{7}|={7}|>{7}).*)$", re.M)
_CODE_LINE = re.compile(
    r"(?://|/?\*|#!|#include\b|--\s|@\w+|[{}()\[\];]+[;,]?$"
    r"|(?:import|from|package|use|require|source)\s+\S+.*$"
    r"|(?:def|class|func|fn|pub|public|private|protected|static|const|let|var|function|export|async|struct|enum)\b.*[({=:]"
    r"|(?:return|elif|else|try|except|finally|end|fi|done|esac|echo|case|begin|rescue)\b[^.]*$"
    r"|(?:if|for|while|with|switch|match)\b.*[:{)]$"
    r"|assert\b.*[\w\"')]$"
    r"|[\w.\[\]]+(?:,\s*\w+)*\s*(?:[-+*/:]?=|<<)\s*\S|[\w.:]+!?\(.*\)[;,]?$|[\"']?\w+[\"']?:\s*\S*,?$)")
#: A line without any of these characters, and not begun by one of these words, is no code.
_CODE_SIGNS = re.compile(r"[(){}\[\];=@#*/:]|--")
_CODE_WORDS = frozenset("import from package use require source return elif else try except finally end fi done esac echo case begin rescue do assert".split())
#: Three words or more with no signs but those of a sentence: prose if it stands by prose, whatever it begins or ends with.
_SENTENCE = re.compile(r"""(?:(?:^| +)["'“‘(]?(?:[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*%?)(?:["'”’)][.,;:!?]?|[.,;:!?]["'”’)]?)?){3,}$""")
_HUMP = re.compile(r"[a-z][A-Z]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿\x00-\x08\x0b\x0c\x0e-\x1f]")


def _words_of(piece: str) -> list[str]:
    """The words of a piece between white space that is not plainly one word. A
    run of more than ``RUN`` word characters is data, unless it is one of letters
    without camel humps."""
    if len(piece) > RUN:
        parts = re.findall(r"[\w'’-]+", piece)
        return [w for part in parts if len(part) <= RUN or part.isalpha() and not _HUMP.search(part) for w in ([part.lower()] if len(part) > RUN else _words_of(part))]
    if _NAME.search(piece):
        piece = _NAME.sub(" ", piece)
    return _WORD.findall(piece.lower())


def _worded(line: str) -> bool:
    """Whether most pieces of a long line are plain words."""
    pieces = line.split()
    return sum(p.strip(".,;:!?()\"'*…").isalpha() for p in pieces) > 0.6 * len(pieces)


def prose_words(text: str | None) -> list[str]:
    """The words of the prose in ``text``, lower-cased and composed, in order.
    Code (fenced, inline, or lines that look like it and are no sentence beside
    prose), logs, tables, headings, markup and addresses are left out. Null and
    empty texts have none."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCED.sub("\n", text)
    kept, code = [], []
    for line in text.split("\n"):
        start = line.strip()
        if not start or (start[0] in _ODD_STARTS and _LINE.match(line)):
            continue
        if "://" in line or "@" in line or "www." in line:
            start = _ADDRESS.sub(" ", start).strip()
            if not start:
                continue
        kept.append(start)
        code.append((start[-1] in ";{}" or (
            (_CODE_SIGNS.search(start) or start.partition(" ")[0] in _CODE_WORDS) and (_CODE_LINE.match(start) or start.endswith((" do", "|")))))
            and not (start.count(" ") >= 20 and _worded(start)))
    if any(code):
        def by_prose(n: int) -> bool:
            return any(not code[k] and (kept[k].count(" ") >= 20 or _SENTENCE.match(kept[k])) for k in (n - 1, n + 1) if 0 <= k < len(kept))
        kept = [x for n, x in enumerate(kept) if not code[n] or (_SENTENCE.match(x) and by_prose(n))]
    text = "\n".join(kept)
    if "`" in text or "<" in text or "&" in text:
        text = _SPAN.sub(" ", text)
    words = []
    for piece in text.split():
        bare = piece.strip(".,;:!?()\"*…")
        if bare.isalpha() and (bare.islower() or bare[1:].islower() or len(bare) == 1):
            words.append(bare.lower())
        elif bare:
            words += _words_of(piece)
    return words


def _labelled_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, word: the different prose words of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, words = [], []
            for doc, value in zip(*[c.to_pylist() for c in batch.columns]):
                own = set(prose_words(value))
                docs += [doc] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words, pa.string())], ["doc", "word"])
    return df.select(key, text).mapInArrow(run, "doc long, word string").distinct()


def _label_odds() -> list[list[float]]:
    """P(label | theta) of a trusted rater: per level, per node."""
    above = [[1 / (1 + math.exp(-STEEP * (x - t))) for x in NODES] for t in THRESHOLDS]
    return [[1 - a for a in above[0]], [a - b for a, b in zip(*above)], above[1]]


def _design(x: float) -> tuple[float, float, float]:
    return 1.0, min(x - 2, 0.0), max(x - 2, 0.0)


_P = [f"p{g}" for g in range(len(NODES))]


class Model:
    """``words`` (word, docs, a, u, v) with the prior over the nodes, the summed
    log odds of all words' absence from a slot at each node, and the
    log-likelihood after each round."""

    def __init__(self, words: DataFrame, prior: list[float], absence: list[float], likelihoods: list[float]):
        self.words, self.prior, self.absence, self.likelihoods = words, prior, absence, likelihoods


def _newton(exposure: list[float], steps: int = 12, ridge: float = 0.5):
    """Maximum-likelihood parameters of words from their expected occurrences per
    node, given the expected slots per node; rows are worked off in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, e = np.array([_design(g) for g in NODES]), np.array(exposure)
        for batch in batches:
            r = np.stack([batch.column(2 + g).to_numpy(zero_copy_only=False) for g in range(len(NODES))], 1)
            beta = np.zeros((len(r), 3))
            beta[:, 0] = np.log((r.sum(1) + 0.1) / max(e.sum(), 1.0))
            penalty = np.array([0.0, ridge, ridge])
            for _ in range(steps):
                p = 1 / (1 + np.exp(-beta @ x.T))
                slope = (r - e * p) @ x - penalty * beta
                curve = np.einsum("wg,gi,gj->wij", e * p * (1 - p), x, x) + np.diag(penalty + 1e-3)
                beta = np.clip(beta + np.clip(np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -2, 2), -30, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(beta[:, k]) for k in range(3)]], ["word", "docs", "a", "u", "v"])
    return run


def _summed(df: DataFrame, part, width: int) -> np.ndarray:
    """The sum over all rows of ``part``, which gives a block's share as ``width`` numbers; a task sends one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(width)
        for batch in batches:
            own += part(np.stack([v.to_numpy(zero_copy_only=False).astype(float) for v in batch.columns], 1))
        yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float64()))], ["part"])
    return sum((np.array(r["part"]) for r in df.mapInArrow(run, "part array<double>").collect()), np.zeros(width))


def _posterior(prior: list[float], absence: list[float]):
    """Beliefs over the nodes and the log-likelihood of each document, from n, a, u, v and what its raters say."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.array([_design(g) for g in NODES])
        for batch in batches:
            c = np.stack([v.to_numpy(zero_copy_only=False).astype(float) for v in batch.columns[1:]], 1)
            logs = c[:, 1:4] @ x.T - c[:, :1] * np.array(absence) + np.log(prior) + c[:, 4:]
            top = logs.max(1, keepdims=True)
            p = np.exp(logs - top)
            total = p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((top + np.log(total))[:, 0]), *[pa.array(v) for v in (p / total).T]], ["doc", "n", "ll", *_P])
    return run


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rounds: int = 20, tolerance: float = 2e-4,
        max_labels: int = MAX_LABELS) -> Model:
    """The model of the labelled documents.

    ``labels`` has the key, reading_level and rater; rows with nulls or other
    levels are left out, repeated rows count once, and of more than
    ``max_labels`` rows those with the smallest hash of the key are used. Words
    of a single labelled document say nothing and are left out. Rounds end when
    the log-likelihood moves by less than ``tolerance`` of itself.
    """
    odds = _label_odds()
    votes = cut(labels.select(F.col(key).alias("doc"), F.col("reading_level").alias("level"), F.coalesce("rater", F.lit("")).alias("rater"))
                .where(F.col("doc").isNotNull() & F.col("level").isin(*LEVELS)).distinct()
                .orderBy(F.xxhash64("doc"), "rater", "level").limit(max_labels))
    whole = cut(_labelled_words(df.join(votes.select(F.col("doc").alias(key)).distinct(), key, "left_semi"), key, text))
    pairs = cut(whole.join(whole.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > 1).select("word"), "word"))
    release(whole)
    agrees = [F.when(F.col("level") == 1, odds[0][g]).when(F.col("level") == 2, odds[1][g]).otherwise(odds[2][g]) for g in range(len(NODES))]
    trust = votes.select("rater").distinct().withColumn("trust", F.lit(0.9))
    prior, absence, words, beliefs, seen = [1 / len(NODES)] * len(NODES), None, None, None, []
    for _ in range(max_rounds):
        # Documents: what the raters say, and the words once they have parameters.
        said = votes.join(trust, "rater").groupBy("doc").agg(*[
            F.sum(F.log(F.col("trust") * a + (1 - F.col("trust")) / len(LEVELS))).alias(f"s{g}") for g, a in enumerate(agrees)])
        if words is None:
            heard = pairs.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), *[F.lit(0.0).alias(c) for c in "auv"])
        else:
            heard = pairs.join(words, "word").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "auv"])
        known = said.join(heard, "doc", "left").na.fill(0)
        told = known.select("doc", "n", *"auv", *[f"s{g}" for g in range(len(NODES))])
        old, beliefs = (beliefs, words), cut(told.mapInArrow(_posterior(prior, absence or [0.0] * len(NODES)), f"doc long, n long, ll double, {', '.join(f'{p} double' for p in _P)}"))
        sums = _summed(beliefs.select("n", "ll", *_P), lambda c: np.hstack([len(c), c[:, 1].sum(), c[:, 2:].sum(0), (c[:, :1] * c[:, 2:]).sum(0)]), 2 + 2 * len(NODES))
        exposure = list(sums[2 + len(NODES):])
        prior = list((sums[2:2 + len(NODES)] + 1) / (sums[0] + len(NODES)))
        # Words: expected occurrences per node, then Newton steps. Raters: how often the beliefs agree with them.
        held = pairs.join(beliefs, "doc").groupBy("word").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(p).alias(p) for p in _P])
        words = cut(held.mapInArrow(_newton(exposure), "word string, docs long, a double, u double, v double"))
        release(*old)
        agreed = sum((a * F.col(p) for a, p in zip(agrees[1:], _P[1:])), agrees[0] * F.col("p0"))
        trust = votes.join(beliefs, "doc").groupBy("rater").agg(((F.sum(agreed) + 9) / (F.count(F.lit(1)) + 10)).alias("trust"))
        absence = list(_summed(words.select(*"auv"), lambda c: np.log1p(np.exp(c @ np.array([_design(g) for g in NODES]).T)).sum(0), len(NODES)))
        seen.append(float(sums[1]))
        if len(seen) > 2 and abs(seen[-1] - seen[-2]) <= tolerance * abs(seen[-2]):
            break
    return Model(words, prior, absence, seen)


def _scores(prior: list[float], absence: list[float]) -> list:
    """Log scores of the nodes from a, u, v (summed over a document's known words) and n, their number."""
    out = []
    for g, x in enumerate(NODES):
        _, low, high = _design(x)
        out.append(F.col("a") + F.col("u") * low + F.col("v") * high - F.col("n") * absence[g] + math.log(prior[g]))
    return out


_SCORED = "words int, theta double, reading_level int"


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """key, words, theta, reading_level for every row; ``words`` counts the prose
    words, ``theta`` is the expected demand. Both estimates are null below
    ``min_words``, and so for null and empty texts. Repeated rows come out as
    often as they come in. More than ``max_words`` words are joined instead of
    broadcast, with the same result."""
    if model.words.count() > max_words:
        return _score_joined(df, model, key, text, min_words)
    table = {r["word"]: (r["a"], r["u"], r["v"]) for r in model.words.collect()}
    sent = df.sparkSession.sparkContext.broadcast((table, model.prior, model.absence))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prior, absence = sent.value
        known, x = table.get, np.array([_design(g) for g in NODES])
        for batch in batches:
            counts, sums = [], []
            for value in batch.column(1).to_pylist():
                words = prose_words(value)
                counts.append(len(words))
                a = u = v = n = 0.0
                if len(words) >= min_words:
                    for w in map(known, set(words)):
                        if w:
                            a, u, v, n = a + w[0], u + w[1], v + w[2], n + 1
                sums.append((a, u, v, n))
            s = np.array(sums).reshape(-1, 4)
            logs = s[:, :3] @ x.T - s[:, 3:] * np.array(absence) + np.log(prior)
            p = np.exp(logs - logs.max(1, keepdims=True)) if len(s) else logs
            theta = np.round(p @ np.array(NODES) / p.sum(1), 6)
            few = np.array(counts, dtype=int) < min_words
            level = 1 + sum((theta > t).astype(int) for t in THRESHOLDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(theta, pa.float64(), mask=few), pa.array(level, pa.int32(), mask=few)],
                                             [key, "words", "theta", "reading_level"])
    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, {_SCORED}")


def _score_joined(df: DataFrame, model: Model, key: str, text: str, min_words: int) -> DataFrame:
    """The same by a join on words. Rows are told apart by key and digest of the text; equal ones are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [prose_words(value) for value in batch.column(2).to_pylist()]
            counts = [len(w) for w in each]
            own = [sorted(set(w)) if len(w) >= min_words else [] for w in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array(own, pa.list_(pa.string()))], ["doc", "digest", "words", "own"])
    rows = df.select(F.col(key).cast("long").alias("doc"), F.sha2(text, 256).alias("digest"), text)
    told = cut(rows.mapInArrow(run, "doc long, digest string, words int, own array<string>"))
    base = told.groupBy("doc", "digest").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))
    sums = told.select("doc", "digest", F.explode("own").alias("word")).distinct().join(model.words, "word").groupBy("doc", "digest").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "auv"]).select(F.col("doc").alias("of"), F.col("digest").alias("d"), "n", *"auv")
    joined = base.join(sums, F.col("doc").eqNullSafe(F.col("of")) & F.col("digest").eqNullSafe(F.col("d")), "left").na.fill(0, ["n", *"auv"])
    scores = _scores(model.prior, model.absence)
    top = F.greatest(*scores)
    weights = [F.exp(x - top) for x in scores]
    theta = F.round(sum(w * g for w, g in zip(weights, NODES)) / sum(weights[1:], weights[0]), 6)
    kept = joined.select(F.col("doc").alias(key), "words", "copies", F.when(F.col("words") >= min_words, theta).alias("theta"))
    level = sum(((F.col("theta") > t).cast("int") for t in THRESHOLDS), F.lit(1))
    return kept.withColumn("reading_level", level).select(key, "words", "theta", "reading_level", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def reading_levels(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS, max_words: int = MAX_WORDS) -> DataFrame:
    """Fit on the labelled documents and score all documents."""
    return score(df, fit(df, labels, key, text, max_labels=max_labels), key, text, max_words=max_words)
