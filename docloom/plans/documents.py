"""Queries over documents and chunks: scans, counts, joins, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import chunking, tables
from docloom.operators.ranking import numbered
from docloom.tables import read

from .base import TRIM, W, query, stamp


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"""select kb_id, doc_id, filename, status, {stamp('created_at')} as created_at, row_number() over (partition by kb_id order by created_at desc nulls last, doc_id desc) as rank from documents""")
def documents_newest(spark, sf_dir):
    """Each base's documents, newest first, those without a time last."""
    d = read(spark, sf_dir, "documents").select("kb_id", "doc_id", "filename", "status", "created_at")
    rows = numbered(d, "kb_id", [F.desc_nulls_last("created_at"), F.desc("doc_id")], "rank")
    return rows.select("kb_id", "doc_id", "filename", "status", _stamp("created_at").alias("created_at"), (F.col("rank") + 1).alias("rank"))


@query("""select k.id as kb_id, k.name, coalesce(d.n, 0) as documents, coalesce(c.n, 0) as chunks, coalesce(e.n, 0) as entities, coalesce(r.n, 0) as relationships
from knowledge_bases k left join (select kb_id, count(*) n from documents where status = 'ready' group by 1) d on d.kb_id = k.id
left join (select kb_id, count(*) n from chunks group by 1) c on c.kb_id = k.id left join (select kb_id, count(*) n from entities group by 1) e on e.kb_id = k.id
left join (select kb_id, count(*) n from relationships group by 1) r on r.kb_id = k.id""")
def base_counts(spark, sf_dir):
    """Sizes of every base."""
    t = {n: read(spark, sf_dir, n) for n in ("documents", "chunks", "entities", "relationships")}
    t["documents"] = tables.ready(t["documents"])
    return tables.base_counts(read(spark, sf_dir, "knowledge_bases"), **t)


@query("select sum(n)::bigint as documents, count(*) as bases, max(n) as largest from (select kb_id, count(*) n from documents group by 1)")
def documents_total(spark, sf_dir):
    """The total over the bases."""
    n = read(spark, sf_dir, "documents").groupBy("kb_id").count()
    return n.agg(F.sum("count").alias("documents"), F.count(F.lit(1)).alias("bases"), F.max("count").alias("largest"))


@query("""select doc_id, case when e in ('png','jpg','jpeg','webp','bmp','tif','tiff') then 'image' when e in ('txt','md','markdown') then 'text' when e = 'csv' then 'csv'
when e = 'json' then 'json' when e in ('html','htm') then 'html' when e in ('pdf','docx','pptx','xlsx') then e end as reader
from (select doc_id, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) e from documents)""")
def file_routing(spark, sf_dir):
    """The reader of each file."""
    return tables.routed(read(spark, sf_dir, "documents"))


@query(r"""select doc_id, case when length(coalesce(f, '')) = 0 then 'document' else f end as safe_name from (
select doc_id, substr(regexp_replace(regexp_extract(filename, '([^/\\]*)$', 1), '[^0-9A-Za-z_.()\-\x{4e00}-\x{9fff}]+', '_', 'g'), 1, 180) f from documents)""")
def safe_filenames(spark, sf_dir):
    """Names that any file system takes."""
    return read(spark, sf_dir, "documents").select("doc_id", T.safe_filename(F.col("filename")).alias("safe_name"))


@query("select doc_id, coalesce(case when length(sha256) > 0 then sha256 end, sha256(text)) as content_hash from documents")
def content_hashes(spark, sf_dir):
    """Stored hashes, missing ones from the text."""
    return tables.content_hash(read(spark, sf_dir, "documents")).select("doc_id", "content_hash")


@query("select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def duplicate_documents(spark, sf_dir):
    """Texts uploaded more than once."""
    return tables.duplicates(read(spark, sf_dir, "documents"))


@query("""select doc_id, copies from (select doc_id, count(*) over (partition by sha256(text)) copies,
row_number() over (partition by sha256(text) order by created_at nulls first, doc_id) r from documents where text is not null) where r = 1""")
def documents_keep_first(spark, sf_dir):
    """One document of each text, the first upload."""
    return tables.keep_first(read(spark, sf_dir, "documents"))


@query("""select document_id, count(*) as sections, count_if(length(regexp_replace(content, '[ \\t\\n\\x0b\\f\\r]+', '', 'g')) >= 80) as dense_sections,
case when count_if(length(regexp_replace(content, '[ \\t\\n\\x0b\\f\\r]+', '', 'g')) >= 80) = count(*) then 'native'
when count_if(length(regexp_replace(content, '[ \\t\\n\\x0b\\f\\r]+', '', 'g')) >= 80) = 0 then 'ocr' else 'hybrid' end as method from chunks group by 1""")
def extraction_methods(spark, sf_dir):
    """Documents by how many of their sections hold enough text."""
    return tables.extraction_method(read(spark, sf_dir, "chunks"))


@query("""select c.kb_id, c.id as chunk_id, d.filename, c.chunk_index from chunks c join documents d on d.doc_id = c.document_id
where d.status = 'ready' and c.embedding is not null""")
def searchable_chunks(spark, sf_dir):
    """The rows that a search reads, without their large columns."""
    rows = tables.searchable(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "documents"))
    return rows.select("kb_id", F.col("id").alias("chunk_id"), "filename", "chunk_index")


@query("""select c.kb_id, c.id as chunk_id, row_number() over (partition by c.kb_id order by d.created_at nulls first, c.document_id, c.chunk_index, c.id) - 1 as position
from chunks c join documents d on d.doc_id = c.document_id where d.status = 'ready'""")
def graph_positions(spark, sf_dir):
    """Reading order of the graph build."""
    return tables.graph_order(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "documents"))


@query("""select id as chunk_id, case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.extraction_method') end as method,
case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.page') end as page from chunks""")
def chunk_metadata(spark, sf_dir):
    """JSON metadata, empty where it is missing or cut off."""
    m = T.metadata(F.col("metadata_json"))
    return read(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), F.try_element_at(m, F.lit("extraction_method")).alias("method"), F.try_element_at(m, F.lit("page")).alias("page"))


@query("select id, substr(name, 1, 160) as name, substr(entity_type, 1, 40) as entity_type, substr(description, 1, 600) as description from entities")
def truncated_entities(spark, sf_dir):
    """P10: texts cut to the longest kept."""
    return tables.truncated(read(spark, sf_dir, "entities"))


@query("""select document_id as query, row_number() over (partition by document_id order by chunk_index desc, id) - 1 as pos, id as chunk_id, length(content) as size from chunks""")
def chunks_in_asked_order(spark, sf_dir):
    """Rows in the order of an id list; here each document's chunks from the last to the first."""
    c = read(spark, sf_dir, "chunks")
    wanted = numbered(c.select(F.col("document_id").alias("query"), "chunk_index", F.col("id").alias("chunk_id")), "query", [F.desc("chunk_index"), F.col("chunk_id")], "pos")
    return tables.in_order(wanted, c).select("query", F.col("pos").cast("long").alias("pos"), "chunk_id", F.length("content").cast("long").alias("size"))


@query("select embedding_dim, count(*) as chunks, count(embedding) as with_vector, count(*) filter (where len(embedding) = embedding_dim) as fitting from chunks group by 1")
def dimension_counts(spark, sf_dir):
    """Which vectors can be compared."""
    fits = F.size("embedding") == F.col("embedding_dim")
    return read(spark, sf_dir, "chunks").groupBy("embedding_dim").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("with_vector"), F.count_if(fits).alias("fitting"))


@query("""select id as chunk_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 4) as norm,
round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 4) as first from chunks where embedding is not null""")
def unit_vectors(spark, sf_dir):
    """Vectors brought to unit length."""
    rows = read(spark, sf_dir, "chunks").where("embedding is not null")
    return rows.select(F.col("id").alias("chunk_id"), F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.round(V.normalize(F.col("embedding"))[0], 4).alias("first"))


_NORMAL = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')"


@query(f"select doc_id, md5({_NORMAL}) as hash, length({_NORMAL}) as size from documents")
def normalized_space(spark, sf_dir):
    """Line ends and spaces."""
    t = T.normalize_space(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("hash"), F.length(t).cast("long").alias("size"))


# U+0001 marks cuts in the SQL, so a text's own is U+E001 meanwhile
_SAFE = "replace(text, chr(1), chr(57345))"


@query(f"""select doc_id, unnest(range(len(p))) as position, md5(replace(unnest(p), chr(57345), chr(1))) as hash from (select doc_id, list_filter(list_transform(
string_split_regex(replace({_NORMAL.replace('text', _SAFE)}, '。' || chr(10), '。' || chr(1)), '\\n{{2,}}|\\x01'), lambda x: regexp_replace(x, {TRIM})), lambda x: length(x) > 0) p from documents where text is not null)""")
def paragraphs(spark, sf_dir):
    """Paragraphs of every text."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    p = T.paragraphs(T.normalize_space(F.col("text")))
    return d.select("doc_id", F.posexplode(p).alias("position", "x")).select("doc_id", F.col("position").cast("long").alias("position"), F.md5("x").alias("hash"))


@query(f"""select doc_id, len(list_filter(list_transform(string_split(regexp_replace({_SAFE}, '([。！？.!?；;]){W}*', '\\1' || chr(1), 'g'), chr(1)),
lambda x: regexp_replace(x, {TRIM})), lambda x: length(x) > 0)) as sentences from documents where text is not null""")
def sentence_counts(spark, sf_dir):
    """C4: sentences of every text."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("""select id as chunk_id, case when p is null then t else substr(t, p + 1) end as tail from (select id, t, least(nullif(instr(t, chr(10)), 0), nullif(instr(t, '。'), 0), nullif(instr(t, ' '), 0)) p
from (select id, right(content, 160) t from chunks))""")
def overlap_tails(spark, sf_dir):
    """What the next chunk repeats."""
    return read(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), T.overlap_tail(F.col("content"), 160).alias("tail"))


@query("""select doc_id, i as position, md5(substr(text, i * 900 + 1, 900)) as hash from (select doc_id, text, unnest(range(ceil(length(text) / 900)::bigint)) i from documents where length(text) > 0)""")
def hard_slices(spark, sf_dir):
    """Slices of a fixed size."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.hard_slices(F.col("text"), 900)).alias("position", "x"))
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), F.md5("x").alias("hash"))


@query("""select doc_id, i as position, md5(substr(text, i * 740 + 1, 900)) as hash from (select doc_id, text, unnest(range(greatest(0, length(text) - 161) // 740 + 1)) i from documents where length(text) > 0)""")
def sliding_windows(spark, sf_dir):
    """Overlapping windows."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"), 900, 160)).alias("position", "x"))
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), F.md5("x").alias("hash"))


@query("select id as chunk_id, greatest(1, length(content) // 3) as token_count, greatest(1, length(content) // 3) = token_count as stored_right from chunks")
def token_counts(spark, sf_dir):
    """C11: the token estimate, and whether the stored one is right."""
    n = T.token_count(F.col("content"))
    return read(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), n.alias("token_count"), (n == F.col("token_count")).alias("stored_right"))


@query()
def chunk_documents(spark, sf_dir):
    """Every text cut into chunks (a fold over the text; tested against invariants)."""
    return chunking.chunk(read(spark, sf_dir, "documents"), "text", ["doc_id", "kb_id"])


@query(r"select event_id, case when json_valid(props) then json_extract_string(props, '$.k') end as k from events")
def json_values(spark, sf_dir):
    """Tolerant JSON."""
    k = F.get_json_object(T.json_object(F.col("props")), "$.k")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"))


@query(r"select doc_id, regexp_extract(text, '([^\n]*)', 1) as title, length(text) - length(replace(text, chr(10), '')) as line_breaks from documents where text is not null")
def document_titles(spark, sf_dir):
    """S5 in part: the first line of a text and the number of its line breaks."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return d.select("doc_id", F.regexp_extract("text", "([^\n]*)", 1).alias("title"), breaks.cast("long").alias("line_breaks"))


@query("select kb_id, count(*) as documents, count(*) filter (where size_bytes > 20000) as too_large, count(*) filter (where error like '%timeout%' or error like '%超时%') as timeouts from documents group by 1")
def quarantine_counts(spark, sf_dir):
    """Uploads over a size cap and failures, per base."""
    bad = F.col("error").like("%timeout%") | F.col("error").like("%超时%")
    return read(spark, sf_dir, "documents").groupBy("kb_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("size_bytes") > 20000).alias("too_large"), F.count_if(bad).alias("timeouts"))


@query("select document_id, id as chunk_id, row_number() over (partition by document_id order by coalesce(page_number, 0), chunk_index, id) as reading_order from chunks")
def sections_in_page_order(spark, sf_dir):
    """Sections by page, those without a page first, otherwise as they came."""
    c = read(spark, sf_dir, "chunks").select("document_id", F.coalesce("page_number", F.lit(0)).alias("_page"), "chunk_index", F.col("id").alias("chunk_id"))
    rows = numbered(c, "document_id", [F.col("_page"), F.col("chunk_index"), F.col("chunk_id")], "reading_order")
    return rows.select("document_id", "chunk_id", (F.col("reading_order") + 1).alias("reading_order"))
