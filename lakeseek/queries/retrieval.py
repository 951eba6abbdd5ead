"""Queries of retrieval, filters, ranking and the query language, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeseek import api
from lakeseek.functions import text, values
from lakeseek.operators import filters, points, ranking, retrieve
from lakeseek.plans import dsl, planner
from lakeseek.session import read

RESULT = ["point_id", "path", "point_type", "start_line", "score"]


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return points.from_tables(read(spark, d, "file_points"), read(spark, d, "chunk_points"))


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("point_id", "path", "point_type", *more)


def _where(predicate):
    return lambda spark, d: _shown(corpus(spark, d).where(predicate()))


def exact_phrase_topk(spark, d):
    found = ranking.boosted(retrieve.exact(corpus(spark, d), "account queue", None))
    return ranking.normalized(ranking.top(found, 10)).select(*RESULT)


def exact_rank_false(spark, d):
    return retrieve.exact(corpus(spark, d), "queue", 50, ranked=False).select(*RESULT)


def exact_tiers(spark, d):
    return retrieve.exact(corpus(spark, d), "account", None).groupBy("point_type", "score").agg(F.count(F.lit(1)).alias("n"))


def exact_punct_edge(spark, d):
    return _shown(corpus(spark, d).where(text.edge_match(F.col("content"), "console.log(")))


def exact_long_text(spark, d):
    docs = read(spark, d, "documents")
    return docs.where(text.edge_match(F.col("text"), "batch")).select("doc_id", (F.length("text") > values.MAX_REGEX_CHARS).alias("long"))


def filter_mode_language(spark, d):
    return _shown(filters.pushed(corpus(spark, d), "chunk", "python"))


def filter_restrict_paths(spark, d):
    listed = read(spark, d, "file_info").where(F.col("mtime") == 0).select(F.col("rel_path").alias("path"))
    return _shown(filters.pushed(corpus(spark, d), paths=listed))


def detect_language(spark, d):
    return read(spark, d, "file_info").groupBy(text.language_of(F.col("rel_path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def parse_query_log(spark, d):
    parsed = dsl.parse_column(read(spark, d, "search_queries").select("query_id", "query_text"), "query_text")
    return parsed.select("query_id", "function_name", "class_name", "file_pattern", "path_prefix", "scope", F.array_join("exclude_paths", "|").alias("excluded"), "text")


def infer_language_hint(spark, d):
    return read(spark, d, "chunk_points").select("chunk_id", text.infer_language(F.col("content")).alias("hint")).where(F.col("hint").isNotNull()).distinct()


def expand_camelcase(spark, d):
    return read(spark, d, "chunk_points").where(F.col("name").isNotNull()).select("name", text.expand_camel(F.col("name")).alias("expanded")).distinct()


def expand_synonyms(spark, d):
    """Set-based: tokens with their positions, a small table of synonyms, a running count of expansions."""
    log = read(spark, d, "search_queries").where(F.col("query_text").isNotNull()).select("query_id", F.posexplode(F.split(F.lower("query_text"), "[^a-z0-9_]+")).alias("pos", "word"))
    table = spark.createDataFrame([(k, " ".join([k, *v[:values.MAX_SYNONYMS]])) for k, v in values.SYNONYMS.items()], "word string, more string")
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hit = log.join(table, "word", "left").withColumn("n", F.sum(F.col("more").isNotNull().cast("int")).over(w))
    out = F.when(F.col("more").isNotNull() & (F.col("n") <= values.MAX_EXPANSIONS), F.col("more")).otherwise(F.col("word"))
    return hit.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", out.alias("w")))), lambda s: s["w"]), " ").alias("expanded"))


def tokenize_terms(spark, d):
    p = corpus(spark, d)
    return retrieve.postings(p).groupBy("point_id").agg(F.sum("tf").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens"))


def doc_frequency(spark, d):
    return retrieve.document_frequency(corpus(spark, d))


def idf_table(spark, d):
    p = corpus(spark, d)
    total = p.agg(F.count(F.lit(1))).scalar()
    return retrieve.document_frequency(p).select("token", "df", F.round(retrieve.idf(F.col("df"), total), 6).alias("idf"))


def vocab_totals(spark, d):
    p = corpus(spark, d)
    tokens = retrieve.postings(p).select("collection", "token", "point_id")
    return tokens.groupBy("collection").agg(F.countDistinct("token").alias("tokens"), F.countDistinct("point_id").alias("points"))


def new_tokens(spark, d):
    """Tokens of files that the index does not hold yet."""
    known = retrieve.document_frequency(corpus(spark, d)).select("token")
    fresh = read(spark, d, "file_info").select(F.explode(F.array_distinct(text.tokens(F.col("content")))).alias("token")).distinct()
    return fresh.join(known, "token", "left_anti")


SPARSE_QUERY = "expire account queue handler"


def sparse_topk(spark, d):
    p = corpus(spark, d)
    return retrieve.sparse(p, planner.query_tokens(p, SPARSE_QUERY), 20).select("point_id", F.round("score", 5).alias("score"))


def sparse_degraded(spark, d):
    p = corpus(spark, d)
    found, _ = planner.hybrid(p, SPARSE_QUERY, None, None, 20)
    return found.select("point_id", F.round("score", 5).alias("score"), "degraded")


def fuzzy_terms(spark, d):
    return retrieve.nearest_terms(corpus(spark, d), ["acount", "queeue", "handlr", "parcell", "zzzzzz"])


def _query_vector(spark, d):
    return read(spark, d, "embeddings").where(F.col("vec_id") == 0).first()["embedding"]


def dense_knn(spark, d):
    return retrieve.dense(read(spark, d, "embeddings"), _query_vector(spark, d), 10)


def dense_knn_filtered(spark, d):
    return retrieve.dense(read(spark, d, "embeddings").where(F.col("label") == 3), _query_vector(spark, d), 10)


def dense_knn_batch(spark, d):
    v = read(spark, d, "embeddings")
    return retrieve.dense_batch(v, v.where(F.col("vec_id") % 50 == 0), 10)


def knn_per_label(spark, d):
    v = read(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    scored = v.select("vec_id", "label", F.round(retrieve.cosine(F.col("embedding"), q), 6).alias("score"))
    scored = scored.select(F.col("vec_id").alias("point_id"), "label", "score", F.lit("").alias("path"), F.lit(0).alias("start_line"))
    return ranking.top_per(scored, "label", 3).select("label", "point_id", "score", "rank")


def _lists(spark, d):
    p = corpus(spark, d).where(F.col("point_type") == "file")
    vectors = read(spark, d, "embeddings").join(p.select(F.col("point_id").alias("vec_id")), "vec_id", "left_semi")
    return retrieve.dense(vectors, _query_vector(spark, d)), retrieve.sparse(p, planner.query_tokens(p, SPARSE_QUERY))


def hybrid_rrf(spark, d):
    return retrieve.weighted_rrf(*_lists(spark, d)).orderBy(F.col("score").desc(), "point_id").limit(20)


def hybrid_rrf_equal_weights(spark, d):
    return retrieve.weighted_rrf(*_lists(spark, d), 1.0, 1.0).orderBy(F.col("score").desc(), "point_id").limit(20)


def path_boost(spark, d):
    return read(spark, d, "file_points").select("path", F.round(text.path_boost(F.col("path")), 6).alias("boost")).distinct()


def normalize_scores(spark, d):
    return ranking.normalized(ranking.top(ranking.boosted(retrieve.exact(corpus(spark, d), "queue", None)), 25)).select(*RESULT)


def merge_first_seen(spark, d):
    p = corpus(spark, d)
    a, b = retrieve.exact(p, "queue", 40), retrieve.exact(p, "account", 40)
    return ranking.merged([a, b]).select("list", "pos", "point_id")


def search_name_only(spark, d):
    return planner.search(corpus(spark, d), "fn:account path:src -path:tests", 20).select(*RESULT)


def search_phrase_full(spark, d):
    return planner.search(corpus(spark, d), '"the account"', 20, mode="chunk").select(*RESULT)


def search_name_semantic(spark, d):
    return planner.search(corpus(spark, d), "fn:expire the queue", 20).select(*RESULT, "degraded")


def search_semantic_full(spark, d):
    p = corpus(spark, d)
    return planner.search(p, "expire account queue handler", 20, vectors=read(spark, d, "embeddings"), query_vector=_query_vector(spark, d)).select(*RESULT, "degraded")


def _by_collection(spark, d, query: str):
    found = ranking.boosted(retrieve.exact(corpus(spark, d), query, None))
    return ranking.top_per(found, "collection", 20)


def exact_per_collection(spark, d):
    return _by_collection(spark, d, "queue").select("collection", "point_id", "score", "rank")


def multi_corpus_rrf(spark, d):
    ranked = _by_collection(spark, d, "queue")
    roots = read(spark, d, "codebases").select("collection", "codebase_path").distinct()
    return ranking.fused_across(ranked.join(roots, "collection"), "collection", F.col("codebase_path"), 30)


def find_references(spark, d):
    return api.find_references(corpus(spark, d), "report", 50).select("point_id", "path", "content")


def find_references_all(spark, d):
    return api.find_references(corpus(spark, d), "account", 50, include_definition=True).select("point_id", "path", F.col("content").startswith("[DEFINITION] ").alias("definition"))


def find_similar(spark, d):
    p = corpus(spark, d)
    snippet = p.where((F.col("point_type") == "chunk") & F.col("content").isNotNull()).orderBy("point_id").first()["content"]
    return api.find_similar(p, snippet, 10).select("point_id", F.round("score", 5).alias("score"))


def search_changed(spark, d):
    last = read(spark, d, "file_scans").where(F.col("recorded_at") >= "2025-02-01").select(F.col("rel_path").alias("path")).distinct()
    return api.search_changed(corpus(spark, d), '"queue"', last, 20).select(*RESULT)


QUERIES = {
    "exact_phrase_topk": exact_phrase_topk, "exact_rank_false": exact_rank_false, "exact_tiers": exact_tiers, "exact_punct_edge": exact_punct_edge, "exact_long_text": exact_long_text,
    "filter_mode_language": filter_mode_language, "filter_restrict_paths": filter_restrict_paths,
    "filter_path_tokens": _where(lambda: filters.path_token_superset(["src", "account"])),
    "filter_path_prefix": _where(lambda: text.in_path(F.col("path"), "src/")), "filter_path_prefix_multi": _where(lambda: text.in_path(F.col("path"), "app/util")),
    "filter_exclude_paths": _where(lambda: filters.outside(["tests", "vendor", "account"])),
    "filter_file_glob": _where(lambda: text.glob_match(F.col("path"), "account_*.py")), "filter_name_substring": _where(lambda: filters.name_contains("Queue")),
    "filter_scope_function": _where(lambda: filters.scope_predicate("function")), "filter_scope_class": _where(lambda: filters.scope_predicate("class")),
    "filter_scope_test": _where(lambda: filters.scope_predicate("test")), "filter_scope_impl": _where(lambda: filters.scope_predicate("impl")),
    "detect_language": detect_language, "parse_query_log": parse_query_log, "infer_language_hint": infer_language_hint, "expand_camelcase": expand_camelcase,
    "expand_synonyms": expand_synonyms, "tokenize_terms": tokenize_terms, "doc_frequency": doc_frequency, "idf_table": idf_table, "vocab_totals": vocab_totals,
    "new_tokens": new_tokens, "sparse_topk": sparse_topk, "sparse_degraded": sparse_degraded, "fuzzy_terms": fuzzy_terms, "dense_knn": dense_knn,
    "dense_knn_filtered": dense_knn_filtered, "dense_knn_batch": dense_knn_batch, "knn_per_label": knn_per_label, "hybrid_rrf": hybrid_rrf,
    "hybrid_rrf_equal_weights": hybrid_rrf_equal_weights, "path_boost": path_boost, "normalize_scores": normalize_scores, "merge_first_seen": merge_first_seen,
    "search_name_only": search_name_only, "search_phrase_full": search_phrase_full, "search_name_semantic": search_name_semantic, "search_semantic_full": search_semantic_full,
    "exact_per_collection": exact_per_collection, "multi_corpus_rrf": multi_corpus_rrf, "find_references": find_references, "find_references_all": find_references_all,
    "find_similar": find_similar, "search_changed": search_changed,
}

# ---- SQL --------------------------------------------------------------------

POINTS = """points as (
    select file_id point_id, any_value(collection) collection, 'file' point_type, any_value(path) path, any_value("language") "language", any_value(summary) summary,
           any_value(line_count) line_count, null::varchar chunk_type, null::varchar "name", null::int start_line, null::int end_line, null::varchar content
    from file_points where path is not null group by file_id
    union all
    select chunk_id, any_value(collection), 'chunk', any_value(path), any_value("language"), null, null, any_value(chunk_type), any_value("name"), any_value(start_line),
           any_value(end_line), any_value(content) from chunk_points where path is not null group by chunk_id)"""
_W = r"[^\p{L}\p{N}_]"


def _edge(column: str, query: str) -> str:
    body = re.sub(r"([.()\[\]*+?^$|\\])", r"\\\1", query)
    left = f"(?:^|{_W})" if re.match(r"\w", query) else ""
    right = f"(?:$|{_W})" if re.search(r"\w$", query) else ""
    return f"coalesce(regexp_matches({column}, '(?i){left}{body}{right}'), false)"


def _exact(query: str, source: str = "points") -> str:
    return (f"(select *, case when {_edge(chr(34) + 'name' + chr(34), query)} then 3.0 when {_edge('summary', query)} then 2.0 "
            f"when {_edge('content', query)} then 1.0 else 0.0 end::double raw from {source})")


_BOOST = "least(0.3, greatest(-0.3, " + " + ".join(f"case when contains(lower(path), '{p}') then {v}::double else 0 end" for p, v in values.PATH_BOOSTS.items()) + "))"
_TIES = "path, start_line nulls first, point_id"


def _found(query: str, where: str = "true", source: str = "points") -> str:
    return f"(select *, round(greatest(0, raw + {_BOOST}), 6) score from {_exact(query, source)} where raw > 0 and ({where}))"


def _topped(query: str, limit: int, where: str = "true", source: str = "points") -> str:
    return (f"with {POINTS}, t as (select * from {_found(query, where, source)} order by score desc, {_TIES} limit {limit}), m as (select max(score) s from t) "
            "select point_id, path, point_type, start_line, case when s > 0 then round(score / s, 6) else score end score from t, m")


def _plain(where: str, source: str = "points") -> str:
    return f"with {POINTS} select point_id, path, point_type from {source} where {where}"


_TEST = """list_has_any(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'),
    '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)),
    ['test', 'tests', 'spec', 'specs'])"""
_IS_TEST = f"({_TEST.format('path')} or coalesce({_TEST.format(chr(34) + 'name' + chr(34))}, false))"
_STOP = ", ".join(f"'{w}'" for w in values.STOP_WORDS)


def tokens_sql(column: str) -> str:
    return (r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(" + column + r", ''), "
            r"'([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^\p{L}\p{N}]+'), "
            r"lambda x: lower(x)), lambda x: length(x) >= 2 and x not in (" + _STOP + "))")


_DF = f"df as (select token, count(*) df from (select point_id, unnest(list_distinct({tokens_sql('coalesce(content, summary)')})) token from points) group by token)"


def _sparse(source: str = "points", query: str = "['expire', 'account', 'queue', 'handler']") -> str:
    return (f"tf as (select point_id, token, count(*) tf from (select point_id, unnest({tokens_sql('coalesce(content, summary)')}) token from {source}) where token in (select unnest({query})) group by all), "
            f"w as (select token, ln(((select count(*) from {source}) + 1)::double / (count(*) + 1)) + 1 w from tf group by token), "
            "sparse as (select point_id, round(sum(tf * w), 6) score from tf join w using (token) group by point_id order by score desc, point_id limit 100)")


_COS = "round(list_inner_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(q.embedding::double[], q.embedding::double[]))), 6)"


def _hybrid(a: float, b: float) -> str:
    return (f"with {POINTS}, files as (select * from points where point_type = 'file'), {_sparse('files')}, "
            f"dense as (select e.vec_id point_id, {_COS} score from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.vec_id in (select point_id from files) order by score desc, point_id limit 100), "
            "x as (select point_id, row_number() over (order by score desc, point_id) r from dense), y as (select point_id, row_number() over (order by score desc, point_id) r from sparse) "
            f"select coalesce(x.point_id, y.point_id) point_id, round(coalesce({a}::double / (60 + x.r), 0) + coalesce({b}::double / (60 + y.r), 0), 8) score from x full join y on x.point_id = y.point_id order by score desc, point_id limit 20")


_PER = f"ranked as (select * from (select *, row_number() over (partition by collection order by score desc, {_TIES}) rank from {_found('queue')}) where rank <= 20)"
_HINTS = " ".join("when regexp_matches(content, '(?i)" + p.replace("'", "''") + f"') then '{language}'" for language, p in values.LANGUAGE_HINTS)
_EXT = " ".join(f"when '{e}' then '{language}'" for e, language in values.EXTENSIONS.items())

SQL = {
    "exact_phrase_topk": _topped("account queue", 10),
    "exact_rank_false": f"with {POINTS} select point_id, path, point_type, start_line, raw score from {_exact('queue')} where raw > 0 order by point_id limit 50",
    "exact_tiers": f"with {POINTS} select point_type, raw score, count(*) n from {_exact('account')} where raw > 0 group by all",
    "exact_punct_edge": _plain(_edge("content", "console.log(")),
    "exact_long_text": f"select doc_id, length(text) > 50000 long from documents where case when length(text) > 50000 then contains(lower(text), 'batch') else {_edge('text', 'batch')} end",
    "filter_mode_language": _plain("point_type = 'chunk' and \"language\" = 'python'"),
    "filter_restrict_paths": _plain("path in (select rel_path from file_info where mtime = 0)"),
    "filter_path_tokens": _plain("list_has_all(regexp_split_to_array(lower(path), '[^a-z0-9]+'), ['src', 'account'])"),
    "filter_path_prefix": _plain("contains(path, '/') and contains(regexp_replace(path, '/[^/]*$', ''), 'src')"),
    "filter_path_prefix_multi": _plain("contains(path, '/') and contains('/' || path, '/app/util')"),
    "filter_exclude_paths": _plain("not contains(path, 'tests') and not contains(path, 'vendor') and not contains(path, 'account')"),
    "filter_file_glob": _plain("lower(regexp_extract(path, '([^/]*)$', 1)) glob 'account_*.py'"),
    "filter_name_substring": _plain("contains(lower(\"name\"), 'queue')"),
    "filter_scope_function": _plain("chunk_type in ('function', 'method')"),
    "filter_scope_class": _plain("chunk_type in ('class', 'class_overview', 'struct', 'interface', 'impl', 'enum', 'type', 'module')"),
    "filter_scope_test": _plain(_IS_TEST), "filter_scope_impl": _plain(f"not {_IS_TEST}"),
    "detect_language": f"select case lower(regexp_extract(rel_path, '(\\.[^./]+)$', 1)) {_EXT} end \"language\", count(*) n from file_info group by 1",
    "infer_language_hint": f"select distinct chunk_id, case {_HINTS} end hint from chunk_points where case {_HINTS} end is not null",
    "expand_camelcase": r"""with n as (select distinct "name" from chunk_points where "name" is not null), s as (select "name", regexp_replace(regexp_replace("name", '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') x from n)
        select "name", case when x <> "name" then "name" || ' ' || lower(x) else "name" end expanded from s""",
    "tokenize_terms": f"with {POINTS} select point_id, len(t)::bigint tokens, len(list_distinct(t))::bigint distinct_tokens from (select point_id, {tokens_sql('coalesce(content, summary)')} t from points) where len(t) > 0",
    "doc_frequency": f"with {POINTS}, {_DF} select token, df from df",
    "idf_table": f"with {POINTS}, {_DF} select token, df, round(ln(((select count(*) from points) + 1)::double / (df + 1)) + 1, 6) idf from df",
    "vocab_totals": f"with {POINTS}, t as (select collection, point_id, unnest({tokens_sql('coalesce(content, summary)')}) token from points) select collection, count(distinct token) tokens, count(distinct point_id) points from t group by collection",
    "new_tokens": f"with {POINTS}, {_DF} select distinct token from (select unnest({tokens_sql('content')}) token from file_info) where token not in (select token from df)",
    "sparse_topk": f"with {POINTS}, {_sparse()} select point_id, round(score, 5) score from sparse order by sparse.score desc, point_id limit 20",
    "sparse_degraded": f"with {POINTS}, {_sparse()} select point_id, round(score, 5) score, true degraded from sparse order by sparse.score desc, point_id limit 20",
    "fuzzy_terms": f"""with {POINTS}, {_DF}, q as (select unnest(['acount', 'queeue', 'handlr', 'parcell', 'zzzzzz']) term)
        select term, arg_min(token, (levenshtein(term, token), -df, token)) token from q, df where levenshtein(term, token) <= 2 and levenshtein(term, token) <= length(term) * 0.25 group by term""",
    "dense_knn": f"select e.vec_id point_id, {_COS} score from embeddings e, (select embedding from embeddings where vec_id = 0) q order by score desc, point_id limit 10",
    "dense_knn_filtered": f"select e.vec_id point_id, {_COS} score from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.label = 3 order by score desc, point_id limit 10",
    "dense_knn_batch": f"""select query_id, point_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, point_id) rank from
        (select q.vec_id query_id, e.vec_id point_id, {_COS} score from embeddings e, embeddings q where q.vec_id % 50 = 0)) where rank <= 10""",
    "knn_per_label": f"""select label, point_id, score, rank from (select *, row_number() over (partition by label order by score desc, point_id) rank from
        (select e.label, e.vec_id point_id, {_COS} score from embeddings e, (select embedding from embeddings where vec_id = 0) q)) where rank <= 3""",
    "hybrid_rrf": _hybrid(1.0, 0.8), "hybrid_rrf_equal_weights": _hybrid(1.0, 1.0),
    "path_boost": f"select distinct path, round({_BOOST}, 6) boost from file_points",
    "normalize_scores": _topped("queue", 25),
    "merge_first_seen": f"""with {POINTS}, a as (select * from (select *, row_number() over (order by raw desc, {_TIES}) pos from {_exact('queue')} where raw > 0) where pos <= 40),
        b as (select * from (select *, row_number() over (order by raw desc, {_TIES}) pos from {_exact('account')} where raw > 0) where pos <= 40),
        u as (select 0 list, pos, point_id, path, start_line from a union all select 1, pos, point_id, path, start_line from b)
        select list, pos, point_id from (select *, row_number() over (partition by path, start_line order by list, pos) n from u) where n = 1""",
    "search_name_only": _topped("account", 20, "contains(path, '/') and contains(regexp_replace(path, '/[^/]*$', ''), 'src') and not contains(path, 'tests') and coalesce(contains(lower(\"name\"), 'account'), false)"),
    "search_phrase_full": _topped("the account", 20, "point_type = 'chunk'"),
    "exact_per_collection": f"with {POINTS}, {_PER} select collection, point_id, score, rank from ranked",
    "multi_corpus_rrf": f"""with {POINTS}, {_PER}, k as (select c.codebase_path || '/' || path file, point_type, coalesce(nullif(start_line, 0), -1) first, coalesce(nullif(end_line, 0), -1) last, collection, rank, point_id
        from ranked join (select distinct collection, codebase_path from codebases) c using (collection))
        select file, point_type, first, last, round(sum(1.0::double / (60 + rank)), 8) rrf, arg_min(point_id, (collection, rank)) point_id from k group by all order by rrf desc, file, first, last, point_id limit 30""",
    "find_references": f"""with {POINTS} select point_id, path, content from points where point_type = 'chunk' and ({_edge('content', 'report')} or {_edge(chr(34) + 'name' + chr(34), 'report')})
        and (coalesce(contains(content, 'report'), false) or coalesce(contains("name", 'report'), false)) and coalesce(lower("name") <> 'report', true) order by point_id limit 50""",
    "find_references_all": f"""with {POINTS} select point_id, path, coalesce(lower("name") = 'account', false) definition from points where point_type = 'chunk' and ({_edge('content', 'account')} or {_edge(chr(34) + 'name' + chr(34), 'account')})
        and (coalesce(contains(content, 'account'), false) or coalesce(contains("name", 'account'), false)) order by point_id limit 50""",
    "search_changed": _topped("queue", 20, "path in (select rel_path from file_scans where recorded_at >= timestamp '2025-02-01')"),
    "parse_query_log": r"""with a as (select query_id, query_text q0, nullif(regexp_extract(query_text, '(?i)\b(?:function|fn|def|method):(\w+)', 1), '') function_name from search_queries),
        b as (select *, regexp_replace(q0, '(?i)\b(?:function|fn|def|method):(\w+)', '') q1 from a),
        c as (select *, nullif(regexp_extract(q1, '(?i)\b(?:class|cls|type|struct):(\w+)', 1), '') class_name, regexp_replace(q1, '(?i)\b(?:class|cls|type|struct):(\w+)', '') q2 from b),
        d as (select *, nullif(regexp_extract(q2, '(?i)\bfile:(\S+)', 1), '') file_pattern, regexp_replace(q2, '(?i)\bfile:(\S+)', '') q3 from c),
        e as (select *, array_to_string(regexp_extract_all(q3, '(?i)-path:(\S+)', 1), '|') excluded, regexp_replace(q3, '(?i)-path:(\S+)', '', 'g') q4 from d),
        f as (select *, nullif(regexp_extract(q4, '(?i)\bpath:(\S+)', 1), '') path_prefix, regexp_replace(q4, '(?i)\bpath:(\S+)', '') q5 from e),
        g as (select *, lower(nullif(regexp_extract(q5, '(?i)\bscope:(function|method|class|struct|enum|interface|type|module|test|impl)\b', 1), '')) s,
              regexp_replace(q5, '(?i)\bscope:(function|method|class|struct|enum|interface|type|module|test|impl)\b', '') q6 from f)
        select query_id, function_name, class_name, file_pattern, path_prefix, case when s = 'method' then 'function' when s in ('struct', 'enum', 'interface', 'type', 'module') then 'class' else s end scope,
               excluded, trim(regexp_replace(q6, '\s+', ' ', 'g')) "text" from g""",
}
SQL["expand_synonyms"] = ("with s(word, more) as (values " + ", ".join(f"('{k}', '{' '.join([k, *v[:values.MAX_SYNONYMS]])}')" for k, v in values.SYNONYMS.items()) + """),
    t as (select query_id, unnest(w) word, generate_subscripts(w, 1) pos from (select query_id, regexp_split_to_array(lower(query_text), '[^a-z0-9_]+') w from search_queries where query_text is not null)),
    h as (select t.*, more, sum((more is not null)::int) over (partition by query_id order by pos) n from t left join s using (word))
    select query_id, string_agg(case when more is not null and n <= 5 then more else word end, ' ' order by pos) expanded from h group by query_id""")

# Whole searches. The snippet's or query's tokens, weighted by how often they occur in it, then the steps of the planner.
_SIMILAR = tokens_sql("content")
SQL["find_similar"] = f"""with {POINTS}, chunks as (select * from points where point_type = 'chunk'), snip as (select content from chunks where content is not null order by point_id limit 1),
    q as (select token, count(*) c from (select unnest({_SIMILAR}) token from snip) group by token),
    tf as (select point_id, token, count(*) tf from (select point_id, unnest({_SIMILAR}) token from chunks) where token in (select token from q) group by all),
    w as (select token, ln(((select count(*) from chunks) + 1)::double / (count(*) + 1)) + 1 w from tf group by token),
    s as (select point_id, round(sum(tf * w * c), 6) score from tf join w using (token) join q using (token) group by point_id order by score desc, point_id limit 15)
    select point_id, round(score, 5) score from s join chunks using (point_id)
    where content is null or regexp_replace(lower(content), '^\\s+|\\s+$', '', 'g') <> (select trim(lower(content), chr(10) || chr(13) || chr(9) || ' ') from snip) order by s.score desc, {_TIES} limit 10"""
_FULL_TOKENS = "['expire', 'account', 'queue', 'list', 'fifo', 'handler', 'process', 'callback']"
SQL["search_semantic_full"] = f"""with {POINTS}, {_sparse('points', _FULL_TOKENS)},
    dense as (select e.vec_id point_id, {_COS} score from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.vec_id in (select point_id from points) order by score desc, point_id limit 100),
    x as (select point_id, row_number() over (order by score desc, point_id) r from dense), y as (select point_id, row_number() over (order by score desc, point_id) r from sparse),
    f as (select coalesce(x.point_id, y.point_id) point_id, round(round(coalesce(1.0::double / (60 + x.r), 0) + coalesce(0.8::double / (60 + y.r), 0), 8) / (1.8::double / 61), 6) raw from x full join y on x.point_id = y.point_id
          order by raw desc, point_id limit 40),
    t as (select *, round(greatest(0, raw + {_BOOST}), 6) score from f join points using (point_id)), k as (select * from t order by score desc, {_TIES} limit 20), m as (select max(score) s from k)
    select point_id, path, point_type, start_line, case when s > 0 then round(score / s, 6) else score end score, false degraded from k, m"""
_NAME = "coalesce(contains(lower(\"name\"), 'expire'), false)"
SQL["search_name_semantic"] = f"""with {POINTS}, {_sparse('points', "['queue', 'list', 'fifo', 'function', 'expire']")},
    a as (select *, row_number() over (order by score desc, {_TIES}) pos, 0 list, false degraded from (select * from {_found('expire', _NAME)} order by score desc, {_TIES} limit 200)),
    h as (select points.*, round(greatest(0, sparse.score + {_BOOST}), 6) score from sparse join points using (point_id) where {_NAME}),
    b as (select *, row_number() over (order by score desc, {_TIES}) pos, 1 list, true degraded from h),
    u as (select point_id, path, point_type, start_line, score, list, pos, degraded from a union all select point_id, path, point_type, start_line, score, list, pos, degraded from b),
    k as (select * from (select *, row_number() over (partition by path, start_line order by list, pos) n from u) where n = 1 order by list, pos limit 20), m as (select max(score) s from k)
    select point_id, path, point_type, start_line, case when s > 0 then round(score / s, 6) else score end score, degraded from k, m"""
