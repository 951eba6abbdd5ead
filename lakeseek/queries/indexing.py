"""Queries of ingest: windows, summaries, identities, changes and catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions import text, values
from lakeseek.operators import catalog, changes, chunking, indexing, points, retrieve
from lakeseek.queries.retrieval import POINTS, corpus, tokens_sql
from lakeseek.session import read
from lakeseek.sources import notebook
from lakeseek.streaming import ingest

KEYS = ["collection", "path"]


def files(spark: SparkSession, d: str) -> DataFrame:
    """file_info with each file once."""
    kept = ["collection", "rel_path", "language", "size_bytes", "content", "content_hash", "line_count", "mtime"]
    return read(spark, d, "file_info").groupBy("file_id").agg(F.first(F.struct(*kept)).alias("f")).select("file_id", "f.*")


def file_scan_hash_lines(spark, d):
    f = files(spark, d).where(F.col("content").isNotNull())
    return f.select("file_id", F.sha2("content", 256).alias("hash"), text.line_count(F.col("content")).alias("lines"), F.length("content").alias("chars"))


def line_windows(spark, d):
    made = chunking.line_windows(read(spark, d, "documents"), "doc_id", "text", 40, 5)
    return made.select("doc_id", "ordinal", "start_line", "end_line", F.sha2("content", 256).alias("hash"))


def chunk_merge_small(spark, d):
    """Each file's chunks, as (type, first, last), after short blocks are joined."""
    c = read(spark, d, "chunk_points").select("collection", "path", "chunk_type", "start_line", "end_line").distinct()
    each = c.groupBy("collection", "path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "chunk_type"))).alias("c"))
    as_structs = F.transform("c", lambda s: F.struct(s["chunk_type"].alias("chunk_type"), s["start_line"].cast("int").alias("start_line"), s["end_line"].cast("int").alias("end_line")))
    return each.select("collection", "path", F.explode(chunking.merge_small_column(as_structs)).alias("m")).select("collection", "path", "m.*")


def chunk_definitions(spark, d):
    return chunking.chunks(files(spark, d).withColumn("language", F.lower("language"))).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


def imports_python(spark, d):
    f = files(spark, d).where((F.col("language") == "python") & F.col("content").isNotNull())
    return f.select("file_id", F.array_join(text.imports_of(F.col("content"), F.col("language")), "|").alias("imports"))


def imports_script(spark, d):
    f = files(spark, d).where(F.col("language").isin("javascript", "typescript") & F.col("content").isNotNull())
    return f.select("file_id", F.array_join(text.imports_of(F.col("content"), F.col("language")), "|").alias("imports"))


def module_docstring(spark, d):
    f = files(spark, d).where(F.col("language") == "python")
    return f.select("file_id", text.module_docstring(F.regexp_replace("content", "\r\n?", "\n"), F.col("language")).alias("doc")).where(F.col("doc").isNotNull())


def file_summary(spark, d):
    f = files(spark, d).where(F.col("content").isNotNull())
    chunks = read(spark, d, "chunk_points").select(*KEYS, "start_line", "ordinal", "chunk_type", "name").distinct()
    defined = indexing.first_definitions(chunks, ["start_line", "ordinal"])
    joined = f.withColumnRenamed("rel_path", "path").join(defined, KEYS, "left")
    summary = chunking.file_summary(F.lit(None).cast("string"), text.imports_of(F.col("content"), F.col("language")), F.coalesce("defines", F.array().cast("array<string>")), F.col("content"))
    return joined.where(F.col("language") == "python").select("file_id", summary.alias("summary"))


def notebook_cells(spark, d):
    """The code cells of notebooks made from the stored python chunks of each file."""
    c = read(spark, d, "chunk_points").where((F.col("language") == "python") & F.col("content").isNotNull()).select("collection", "path", "ordinal", "content").distinct()
    cell = F.struct(F.lit("code").alias("cell_type"), F.col("content").alias("source"))
    raw = c.groupBy(*KEYS).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", cell.alias("cell")))), lambda s: s["cell"]).alias("cells"))).alias("raw"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([notebook.code(r) for r in b.column(2).to_pylist()])], ["collection", "path", "code"])
    made = raw.mapInArrow(run, "collection string, path string, code string")
    return made.select(*KEYS, F.sha2("code", 256).alias("hash"))


def node_type_map(spark, d):
    names = ["function_definition", "method_declaration", "class_declaration", "interface_declaration", "trait_item", "struct_item", "enum_item", "impl_item", "module", "type_alias", "expression"]
    df = spark.createDataFrame([(n,) for n in names], "node string")
    return df.select("node", text.chunk_type_of(F.col("node")).alias("chunk_type"))


def context_path(spark, d):
    c = read(spark, d, "chunk_points").select("chunk_id", F.nullif(F.array_join(F.filter(F.split(F.coalesce("context", F.lit("")), "\\."), lambda x: x != ""), "."), F.lit("")).alias("context")).distinct()
    return c


def vocabulary_texts(spark, d):
    c = read(spark, d, "chunk_points").select("chunk_id", chunking.vocabulary_text(F.col("content"), F.col("imports")).alias("t")).distinct()
    return c.select("chunk_id", F.sha2("t", 256).alias("hash"))


def point_ids(spark, d):
    c = read(spark, d, "chunk_points").select("chunk_id", points.point_uuid(points.chunk_key(F.col("path"), F.col("start_line"), F.col("ordinal"))).alias("uuid")).distinct()
    return c


def collection_ids(spark, d):
    return read(spark, d, "codebases").select("codebase_path", points.collection_id(F.col("codebase_path")).alias("id"), F.col("collection").rlike(catalog.COLLECTION_ID).alias("well_formed")).distinct()


def first_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", text.first_line(F.col("text")).alias("line")).where(F.col("line").isNotNull())


def _indexed(spark, d):
    return read(spark, d, "file_points").groupBy(*KEYS).agg(F.first(F.struct("file_hash", "mtime", "size_bytes")).alias("f")).select(
        *KEYS, F.col("f.file_hash").alias("hash"), F.col("f.mtime").alias("mtime"), F.col("f.size_bytes").alias("size"))


def _disk(spark, d):
    """What a listing a week later could find: some files gone, some grown, some touched."""
    f = files(spark, d).withColumnRenamed("rel_path", "path").where(F.col("file_id") % 11 != 3)
    grown, touched = F.col("file_id") % 7 == 2, F.col("file_id") % 5 == 1
    return f.select(*KEYS, F.when(F.col("content").isNull(), None).when(grown, F.sha2(F.concat("content", F.lit("\n# end of the file\n")), 256)).otherwise(F.col("content_hash")).alias("hash"),
                    F.when(grown | touched, F.col("mtime") + 60).otherwise(F.col("mtime")).alias("mtime"), F.when(grown, F.col("size_bytes") + 19).otherwise(F.col("size_bytes")).alias("size"))


def change_detection(spark, d):
    return changes.changes(_indexed(spark, d), _disk(spark, d))


def deleted_files(spark, d):
    return changes.deleted(_indexed(spark, d), _disk(spark, d))


def index_status(spark, d):
    return changes.status_counts(changes.changes(_indexed(spark, d), _disk(spark, d)))


def vocab_delta(spark, d):
    """The change of document frequencies when all files of one language are taken out."""
    p = corpus(spark, d)
    rows = p.select("language", F.explode(F.array_distinct(text.tokens(retrieve.vocabulary_text()))).alias("token"))
    return changes.vocabulary_delta(rows, rows.where(~F.col("language").eqNullSafe("go")))


def vocab_applied(spark, d):
    """Frequencies after that delta: as if counted anew."""
    p = corpus(spark, d)
    return changes.applied(retrieve.document_frequency(p), vocab_delta(spark, d))


def upsert_snapshot(spark, d):
    old = _indexed(spark, d)
    new = _disk(spark, d).where(F.col("hash").isNotNull()).select(*old.columns)
    return catalog.upserted(old, new, KEYS)


def delete_by_paths(spark, d):
    gone = read(spark, d, "file_info").where(F.col("language") == "json").select(F.col("rel_path").alias("path"))
    return catalog.without_paths(_indexed(spark, d), gone).select(*KEYS)


def language_histogram(spark, d):
    return indexing.languages(files(spark, d))


def preview_index(spark, d):
    return indexing.preview(files(spark, d))


def list_collections(spark, d):
    held = read(spark, d, "file_points").select("collection", "path").distinct().groupBy("collection").agg(F.count(F.lit(1)).alias("files"))
    return read(spark, d, "codebases").select("collection", "codebase_path", "embedding_model").distinct().join(held, "collection", "left").select(
        "collection", "codebase_path", "embedding_model", F.coalesce("files", F.lit(0)).alias("files"))


def inferred_paths(spark, d):
    return catalog.inferred_path(read(spark, d, "file_points"))


def orphan_classify(spark, d):
    roots = read(spark, d, "codebases").select("codebase_path").distinct()
    n = F.pmod(F.length("codebase_path"), F.lit(3))
    seen = roots.select("codebase_path", F.when(n == 0, True).when(n == 1, False).alias("present"))
    return catalog.verdicts(read(spark, d, "codebases"), seen).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def stored_content(spark, d):
    """What is stored for each path: how many points and how much text."""
    p = corpus(spark, d)
    return p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("points"), F.sum(F.length(retrieve.vocabulary_text())).alias("chars"))


def stream_windows(spark, d):
    return ingest.event_windows(read(spark, d, "events"))


QUERIES = {f.__name__: f for f in (
    file_scan_hash_lines, line_windows, chunk_merge_small, chunk_definitions, imports_python, imports_script, module_docstring, file_summary, notebook_cells, node_type_map, context_path,
    vocabulary_texts, point_ids, collection_ids, first_lines, change_detection, deleted_files, index_status, vocab_delta, vocab_applied, upsert_snapshot, delete_by_paths,
    language_histogram, preview_index, list_collections, inferred_paths, orphan_classify, stored_content, stream_windows)}

# ---- SQL --------------------------------------------------------------------

FILES = """files as (select file_id, any_value(collection) collection, any_value(rel_path) rel_path, any_value("language") "language", any_value(size_bytes) size_bytes, any_value(content) content,
    any_value(content_hash) content_hash, any_value(mtime) mtime from file_info group by file_id)"""
_DISK = f"""{FILES}, indexed as (select collection, path, any_value(file_hash) hash, any_value(mtime) mtime, any_value(size_bytes) size from file_points group by all),
    disk as (select collection, rel_path path, case when content is null then null when file_id % 7 = 2 then sha256(content || chr(10) || '# end of the file' || chr(10)) else content_hash end hash,
        case when file_id % 7 = 2 or file_id % 5 = 1 then mtime + 60 else mtime end mtime, case when file_id % 7 = 2 then size_bytes + 19 else size_bytes end size from files where file_id % 11 <> 3)"""
_STATUS = """changed as (select coalesce(i.collection, d.collection) collection, coalesce(i.path, d.path) path,
    case when i.path is null and d.hash is not null then 'added' when i.path is null then 'unreadable' when d.path is null or d.hash is null then 'deleted'
         when i.mtime is distinct from d.mtime and i.size is distinct from d.size and abs(i.size - d.size) > 10 and not ends_with(lower(i.path), '.ipynb') then 'modified'
         when (i.mtime is distinct from d.mtime or i.size is distinct from d.size or i.mtime = 0) and i.hash is distinct from d.hash then 'modified' else 'unchanged' end status
    from indexed i full join disk d on i.collection = d.collection and i.path = d.path)"""


def _distinct_in_order(list_sql: str) -> str:
    return f"list_filter({list_sql}, lambda x, i: list_position({list_sql}, x) = i)[1:15]"


_PY = r"regexp_extract_all(content, '(?m)^(?:from|import)[ \t]+([^\s.,;]*)', 1)"
_JS = r"""regexp_extract_all(content, '(?:from[ \t]+|require\([ \t]*)[''"]([^''"]+)[''"]', 1)"""
_LABEL = "case chunk_type " + " ".join(f"when '{k}' then '{v}'" for k, v in values.SHORT_TYPES.items()) + " else chunk_type end || ':' || \"name\""

SQL = {
    "file_scan_hash_lines": f"with {FILES} select file_id, sha256(content) hash, len(string_split(content, chr(10)))::int lines, length(content)::int chars from files where content is not null",
    "line_windows": """with l as (select doc_id, string_split(text, chr(10)) lines from documents where text is not null),
        s as (select doc_id, lines, len(lines) n, unnest(generate_series(0, greatest(ceil((len(lines) - 40) / 35.0), 0)::bigint * 35, 35)) start from l)
        select doc_id, (start // 35)::int ordinal, (start + 1)::int start_line, least(start + 40, n)::int end_line, sha256(array_to_string(lines[start + 1:start + 40], chr(10))) hash from s""",
    "imports_python": f"with {FILES} select file_id, array_to_string({_distinct_in_order(_PY)}, '|') imports from files where \"language\" = 'python' and content is not null",
    "imports_script": f"with {FILES} select file_id, array_to_string({_distinct_in_order(_JS)}, '|') imports from files where \"language\" in ('javascript', 'typescript') and content is not null",
    "file_summary": f"""with {FILES}, c as (select distinct collection, path, start_line, ordinal, {_LABEL} label from chunk_points where "name" is not null),
        g as (select collection, path, list(label order by start_line, ordinal, label) defines from c group by all),
        x as (select file_id, content, {_distinct_in_order(_PY)} imports, coalesce(defines, []) defines from files left join g on files.collection = g.collection and files.rel_path = g.path where "language" = 'python' and content is not null),
        y as (select *, nullif(concat_ws(chr(10), case when len(imports) > 0 then 'Imports: ' || array_to_string(imports, ', ') end, case when len(defines) > 0 then 'Defines: ' || array_to_string(defines[1:15], ', ') end), '') parts,
              substring(content, 1, 500) head from x), z as (select *, length(head) - length(string_split(head, chr(10))[-1]) - 1 cut from y)
        select file_id, coalesce(parts, case when length(content) > 500 and cut > 200 then substring(head, 1, cut) else head end) summary from z""",
    "notebook_cells": """with c as (select distinct collection, path, ordinal, content from chunk_points where "language" = 'python' and content is not null),
        n as (select *, row_number() over (partition by collection, path order by ordinal, content) k from c)
        select collection, path, sha256(string_agg('# %% [cell ' || k || ']' || chr(10) || content, chr(10) || chr(10) order by k)) hash from n group by all""",
    "node_type_map": """select node, case when contains(node, 'function') or contains(node, 'method') then 'function' when contains(node, 'class') then 'class' when contains(node, 'interface') or contains(node, 'trait') then 'interface'
        when contains(node, 'struct') then 'struct' when contains(node, 'enum') then 'enum' when contains(node, 'impl') then 'impl' when contains(node, 'module') then 'module' when contains(node, 'type') then 'type' else 'block' end chunk_type
        from (select unnest(['function_definition', 'method_declaration', 'class_declaration', 'interface_declaration', 'trait_item', 'struct_item', 'enum_item', 'impl_item', 'module', 'type_alias', 'expression']) node)""",
    "context_path": "select distinct chunk_id, nullif(context, '') context from chunk_points",
    "vocabulary_texts": """select distinct chunk_id, sha256(case when len(coalesce(imports, [])) > 0 then 'Uses: ' || array_to_string(imports, ', ') || chr(10) || chr(10) else '' end || substring(content, 1, 30000)) hash from chunk_points""",
    "point_ids": """select distinct chunk_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] uuid from (select chunk_id, sha256('chunk:' || path || ':' || start_line || '#' || ordinal) h from chunk_points)""",
    "collection_ids": "select distinct codebase_path, 'codesearch_' || sha256(rtrim(codebase_path, '/'))[1:12] id, regexp_full_match(collection, 'codesearch_[a-f0-9]{12}') well_formed from codebases",
    "change_detection": f"with {_DISK}, {_STATUS} select * from changed",
    "deleted_files": f"with {_DISK} select collection, path from indexed except select collection, path from disk",
    "index_status": f"""with {_DISK}, {_STATUS} select collection, count(*) filter (status = 'added') added, count(*) filter (status = 'modified') modified, count(*) filter (status = 'deleted') deleted,
        count(*) filter (status = 'unchanged') unchanged from changed group by collection""",
    "vocab_delta": f"with {POINTS} select token, -count(*)::bigint delta from (select \"language\", unnest(list_distinct({tokens_sql('coalesce(content, summary)')})) token from points) where \"language\" = 'go' group by token",
    "vocab_applied": f"with {POINTS} select token, count(*) df from (select \"language\", unnest(list_distinct({tokens_sql('coalesce(content, summary)')})) token from points) where \"language\" is distinct from 'go' group by token",
    "upsert_snapshot": f"with {_DISK}, n as (select collection, path, hash, mtime, size from disk where hash is not null) select * from n union all select * from indexed i where not exists (select 1 from n where n.collection = i.collection and n.path = i.path)",
    "delete_by_paths": f"with {_DISK} select collection, path from indexed where path not in (select rel_path from file_info where \"language\" = 'json')",
    "first_lines": """with x as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') l from documents) select doc_id, trim(l[1], ' ') line from x where len(l) > 0""",
    "module_docstring": f"""with {FILES}, c as (select file_id, regexp_replace(content, '\\r\\n?', chr(10), 'g') content from files where "language" = 'python'),
        x as (select file_id, coalesce(nullif(regexp_extract(content, '(?s)\\A(?:(?:#[^\\n]*|[ \\t]*)\\n){{0,5}}[ \\t]*(?:\"\"\"(.*?)\"\"\"|''''''(.*?)'''''')', 1), ''),
            regexp_extract(content, '(?s)\\A(?:(?:#[^\\n]*|[ \\t]*)\\n){{0,5}}[ \\t]*(?:''''''(.*?)'''''')', 1)) doc from c),
        y as (select file_id, substring(trim(regexp_replace(doc, '^\\s+|\\s+$', '', 'g'), ' '), 1, 300) doc from x) select file_id, doc from y where doc <> ''""",
    "language_histogram": f"with {FILES} select \"language\", count(*) files from files group by 1",
    "preview_index": f"with {FILES} select \"language\", count(*) files, sum(size_bytes)::bigint bytes from files group by 1",
    "list_collections": """with h as (select collection, count(distinct path) files from file_points group by 1)
        select distinct c.collection, codebase_path, embedding_model, coalesce(files, 0) files from codebases c left join h using (collection)""",
    "inferred_paths": "select collection, min(left(abs_path, length(abs_path) - length(path) - 1)) codebase_path from file_points where ends_with(abs_path, '/' || path) group by 1",
    "orphan_classify": """select case when codebase_path is null or not regexp_full_match(collection, 'codesearch_[a-f0-9]{12}') then 'skip' when length(codebase_path) % 3 = 0 then 'valid' when length(codebase_path) % 3 = 1 then 'orphan' else 'skip' end verdict,
        count(*) n from (select distinct collection, codebase_path from codebases) group by 1""",
    "stored_content": f"with {POINTS} select collection, path, count(*) points, sum(length(coalesce(content, summary, '')))::bigint chars from points group by all",
    "stream_windows": "select time_bucket(interval '1 hour', ts) \"start\", event_type, count(*) n, round(sum(value), 6) total from events group by all",
}
