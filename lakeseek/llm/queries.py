"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm import docpairs, encoding, fusion, origin, packing, reading, terms
from lakeseek.llm.syntax import validity
from lakeseek.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = terms.distinctive_terms(read(spark, d, "chunk_points"), "chunk_id", ["content", "name"],
                                    min_count=3, min_records=2, max_records=15)
    return found.select(F.col("record").alias("chunk_id"), "term")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    found = terms.distinctive_terms(read(spark, d, "chunk_points"), "chunk_id", ["content", "name"])
    return found.select(F.col("record").alias("chunk_id"), "term", "n", "records", "occurrences",
                        F.round("score", 6).alias("score"))


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(read(spark, d, "chunk_points"), "chunk_id", "content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_frequencies(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return validity.unparsed_files(read(spark, d, "file_info")).select("file_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(read(spark, d, "file_info"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(read(spark, d, "search_results"), "query_id", "point_id", "branch", "point_type", "score")
    return fused.select(F.col("query").alias("query_id"), F.col("point").alias("point_id"), F.round("fused", 9).alias("fused"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(read(spark, d, "search_results"), "query_id", "point_id", "branch", "point_type", "score")
    return fusion.first_of_each(fused).select(F.col("query").alias("query_id"), F.col("point").alias("point_id"))


def p6_origins(spark: SparkSession, d: str) -> DataFrame:
    return origin.origins(read(spark, d, "file_info"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_origins(spark, d).where(F.col("label") != "handwritten").select("file_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = docpairs.documented_functions(read(spark, d, "chunk_points"), read(spark, d, "file_points"))
    return found.select("chunk_id", "function_name")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.function_pairs(read(spark, d, "chunk_points"), read(spark, d, "file_points"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(read(spark, d, "documents")).withColumnRenamed("key", "doc_id")


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_corpus(read(spark, d, "documents"), read(spark, d, "token_budgets"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(read(spark, d, "documents"), read(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).where(F.col("reading_level").isNotNull()).select("doc_id", "reading_level")


QUERIES = {
    "p10_found": p10_found, "p10_levels": p10_levels,
    "p1_found": p1_found, "p1_scores": p1_scores, "p2_found": p2_found, "p2_frequencies": p2_frequencies,
    "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_ranking": p4_ranking, "p6_found": p6_found, "p6_origins": p6_origins,
    "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_ids": p8_ids, "p9_packing": p9_packing,
}

#: RE2 has no look-around: humps are marked by two replacements (the second twice, as matches may share a letter).
_TERMS = r"""regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
    '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'),
    '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^\p{{L}}\p{{Nd}}]+')"""


def _counts(text: str) -> str:
    return f"""records as (select chunk_id, any_value(content) content, any_value(name) "name" from chunk_points group by chunk_id),
        pieces as (select chunk_id, lower(unnest({_TERMS.format(text)})) term from records),
        counts as (select chunk_id, term, count(*) n from pieces
                   where length(term) >= 2 and not regexp_full_match(term, '\\p{{Nd}}+') group by all),
        spread as (select term, sum(n) occurrences, count(*) records from counts group by term),
        total as (select count(*) c from records)"""


_FUSED = """rows_ as (select query_id, point_id, branch, point_type, max(score) score from search_results
                 where score is not null group by all),
        ranked as (select *, rank() over (partition by query_id, branch, point_type order by score desc) r from rows_),
        fused as (select query_id, point_id, sum(1.0::double / (60 + r)) f from ranked group by all)"""

SQL = {
    "p1_found": f"""with {_counts("concat_ws(' ', content, name)")}
        select chunk_id, term from counts join spread using (term) where n >= 3 and records between 2 and 15""",
    "p1_scores": f"""with {_counts("concat_ws(' ', content, name)")}
        select chunk_id, term, n, records, occurrences::bigint occurrences,
               round(n * (-log2(records / c) + log2(1 - exp(-occurrences / c))), 6) score
        from counts join spread using (term), total""",
    "p2_frequencies": f"""with {_counts("content")}
        select term, occurrences::bigint occurrences, records,
               case when records < 3 then 'rare' when records > 0.22 * c then 'common' end mark from spread, total""",
    "p2_found": f"""with {_counts("content")}
        select term, case when records < 3 then 'rare' else 'common' end mark from spread, total
        where records < 3 or records > 0.22 * c""",
    "p4_ranking": f"with {_FUSED} select query_id, point_id, round(f, 9) fused from fused",
    "p4_found": f"with {_FUSED} select query_id, arg_max(point_id, (round(f, 12), -point_id)) point_id from fused group by query_id",
}
