"""Terms of records: corpus-wide frequencies and distinctiveness.

A term: the string is cut at every character that is neither a letter nor a
digit, then at camel humps (ASCII); pieces are lower-cased; those of one
character or of digits only are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.operators.points import once
from lakeseek.session import cut

#: The places where a string is cut into terms (Java regex).
TERM_CUTS = r"[^\p{L}\p{Nd}]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def record_terms(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """record, term, n: how often each term occurs in each record.

    Rows of one key count once, rows with a null key are one record; other
    columns are not read, so names that clash with the operators' own do no
    harm. Counting stays within the row: the record's terms are sorted, a term's
    count is the distance between the places where runs of equal terms begin.
    """
    records = once(df.select(F.col(key).alias("record"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)]), "record", [f"t{i}" for i in range(len(texts))])
    cut_up = F.lower(F.regexp_replace(F.concat_ws(" ", *[f"t{i}" for i in range(len(texts))]), TERM_CUTS, " "))
    held = records.select("record", F.array_sort(F.split(cut_up, " ")).alias("terms"))
    begins = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("terms")))
    counts = F.zip_with("begins", ends, lambda a, b: F.struct(F.get("terms", a).alias("term"), (b - a).cast("long").alias("n")))
    each = held.withColumn("begins", begins).select("record", F.inline(counts))
    return each.where((F.length("term") >= 2) & ~F.col("term").rlike(r"^\p{Nd}+$"))


def term_frequencies(df: DataFrame, key: str, text: str, min_records: int = 3, max_share: float = 0.22) -> DataFrame:
    """term, occurrences, records, mark for every distinct term of the collection.

    ``mark`` is 'rare' below ``min_records`` records, 'common' above
    ``max_share`` of all records (those with null text count in the total), else
    null; 'rare' wins where both hold. Per-record counts are combined by hash
    within each task before the shuffle by term, so a term that occurs
    everywhere arrives as one row a task. Null and empty texts have no terms; an
    empty table gives an empty result.
    """
    counts = record_terms(df, key, [text]).groupBy("term").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    total = df.select(F.col(key).alias("record")).distinct().agg(F.count(F.lit(1))).scalar()
    mark = (F.when(F.col("records") < min_records, "rare")
            .when(F.col("records") > F.lit(max_share) * total, "common"))
    return counts.withColumn("mark", mark)


def distinctive_terms(df: DataFrame, key: str, texts: list[str], min_count: int = 1, min_records: int = 1,
                      max_records: int | None = None) -> DataFrame:
    """record, term, n, records, occurrences, score: residual inverse document
    frequency times the term's count in the record.

    With N records, df of which hold the term cf times in all, the observed
    -log2(df/N) is compared with what a Poisson scatter of the cf occurrences
    would give, -log2(1 - exp(-cf/N)); the difference is large for terms
    concentrated in few records and near zero for words spread evenly. The
    counts are written once, for the statistics and the scores. Only
    terms with at least ``min_count`` in the record and within the bounds on
    records are returned; statistics are over all records. Null texts have no
    terms.
    """
    counts = cut(record_terms(df, key, texts))
    spread = counts.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    bounds = F.col("records") >= min_records
    if max_records is not None:
        bounds = bounds & (F.col("records") <= max_records)
    total = df.select(F.col(key).alias("record")).distinct().agg(F.count(F.lit(1))).scalar()
    observed = -F.log2(F.col("records") / total)
    expected = -F.log2(-F.expm1(-F.col("occurrences") / total))
    return (counts.where(F.col("n") >= min_count).join(spread.where(bounds), "term")
            .select("record", "term", "n", "records", "occurrences",
                    (F.col("n") * (observed - expected)).alias("score")))
