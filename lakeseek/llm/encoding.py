"""Encoding of texts with a public byte-level BPE tokenizer.

Texts up to ``CHUNK`` characters are encoded whole. Longer ones are exploded
into overlapping chunks that are pre-tokenised in parallel; neighbouring chunks
are stitched where their pre-token boundaries resynchronise inside the overlap,
and the pieces between such stitches are encoded independently and joined in
order. The ids equal those of the whole text: pre-tokens are found from left to
right without looking back, so two runs that share a boundary share all later
ones, and only boundaries that hold whatever stands before (see ``_sure``) are
used. Where an overlap has none, the two chunks stay together in one piece.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP = 32_768, 1_024
#: Where the vocabulary files lie; a parameter of every function here.
FOLDER = "/opt/tokenizers"

#: The public pre-token pattern of the byte-level BPE vocabularies.
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = FOLDER):
    """The tiktoken encoding of a ``.tiktoken`` ranks file, one per worker."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    """The text of a list of ids: raw bytes are concatenated before they are read as UTF-8."""
    return encoder(name, folder).decode_bytes(ids).decode("utf-8")


def encode_all(texts: list[str], name: str, folder: str = FOLDER) -> list[list[int]]:
    """Ids of each text, special-looking strings as ordinary text."""
    plain = encoder(name, folder).encode_ordinary
    return [plain(t) for t in texts]


def _sure(text: str, at: int) -> bool:
    """Whether a pre-token always begins at ``at``, whatever stands further left:
    white space after something else, or a letter next to a digit."""
    a, b = text[at - 1], text[at]
    return (b.isspace() and not a.isspace()) or (a.isalpha() and b.isdecimal()) or (a.isdecimal() and b.isalpha())


def _boundaries(text: str, zones: list[tuple[int, int]]) -> list[list[int]]:
    """Pre-token starts of ``text`` within each zone that are sure."""
    import regex

    starts = [m.start() for m in _pattern(regex).finditer(text)]
    return [[s for s in starts if max(lo, 1) <= s < hi and _sure(text, s)] for lo, hi in zones]


@lru_cache(maxsize=1)
def _pattern(regex):
    return regex.compile(PRE_TOKEN)


def _mapped(df: DataFrame, schema: str, columns: dict[str, pa.DataType], make) -> DataFrame:
    """mapInArrow over columns given as Python lists; ``make`` returns lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, columns.values())], list(columns))
    return df.mapInArrow(run, schema)


def _pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, digest, copies, piece, text of long texts, cut at stitches."""
    ids = ["key", "digest", "copies"]
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))
    windows = long.select(*ids, F.posexplode(starts).alias("no", "start"), "text").select(
        *ids, "no", F.expr(f"substring(text, start + 1, {chunk + overlap})").alias("text"))

    def zones(*columns):
        both = [_boundaries(t, [(0, overlap), (chunk, chunk + overlap)]) for t in columns[-1]]
        return *columns, [h for h, _ in both], [[b - chunk for b in t] for _, t in both]

    marked = _mapped(windows, "key long, digest long, copies long, no int, text string, head array<int>, tail array<int>",
                     {"key": pa.int64(), "digest": pa.int64(), "copies": pa.int64(), "no": pa.int32(), "text": pa.string(),
                      "head": pa.list_(pa.int32()), "tail": pa.list_(pa.int32())}, zones)
    w = Window.partitionBy("key", "digest").orderBy("no")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(w)))
    cut = (marked.select(*ids, "no", "text", shared.alias("cut"))
           .withColumn("next_cut", F.lead("cut").over(w)).withColumn("last", F.lead("no").over(w).isNull()))
    # A chunk gives the characters from its cut to the next chunk's; without a cut it continues the piece before.
    begin = F.coalesce("cut", F.lit(0))
    end = F.when(F.col("last"), F.length("text")).otherwise(F.lit(chunk) + F.coalesce("next_cut", F.lit(0)))
    part = F.substring(F.col("text"), begin + 1, end - begin)
    piece = F.sum(F.when(F.col("cut").isNotNull(), 1).otherwise(0)).over(w)
    parts = cut.select(*ids, "no", piece.alias("piece"), part.alias("text"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda s: s["text"])
    return parts.groupBy(*ids, "piece").agg(F.array_join(in_order, "").alias("text"))


def _encoded(df: DataFrame, keys: list[str], name: str, folder: str) -> DataFrame:
    """Replace text by ids; the keys pass through."""
    def ids(*columns):
        return [*columns[:-1], encode_all(columns[-1], name, folder)]
    schema = ", ".join([*(f"{k} long" for k in keys), "ids array<int>"])
    return _mapped(df.select(*[F.col(k).cast("long").alias(k) for k in keys], "text"), schema,
                   {k: pa.int64() for k in keys} | {"ids": pa.list_(pa.int32())}, ids)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k",
                  folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, ids: one row per input row, repeated rows included. Null and empty
    texts give an empty list. The key is a bigint, may be null and need not be
    unique; other columns are not read. An empty table gives an empty result."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = _encoded(rows.where(F.length("text") <= chunk), ["key"], name, folder)
    long = (rows.where(F.length("text") > chunk).groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("digest", F.xxhash64("text")))
    pieces = _encoded(_pieces(long, chunk, overlap), ["key", "digest", "copies", "piece"], name, folder)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda s: s["ids"])
    joined = (pieces.groupBy("key", "digest", "copies").agg(F.flatten(in_order).alias("ids"))
              .select("key", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("key", "ids"))
    return short.unionByName(joined)


def token_counts(df: DataFrame, columns: list[str], text: str = "text", name: str = "byte_bpe_50k",
                 folder: str = FOLDER) -> DataFrame:
    """The given columns and n_tokens of every row (0 for null and empty)."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema), "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            plain = encoder(name, folder).encode_ordinary
            counts = pa.array([len(plain(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*columns, "n_tokens"])
    return df.select(*columns, text).mapInArrow(run, schema)
