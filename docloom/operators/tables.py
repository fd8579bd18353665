"""Views over the document tables: scans, joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

from .ranking import numbered

#: Extensions that can be read, by reader (fixed values).
READERS = {"txt": "text", "md": "text", "markdown": "text", "csv": "csv", "json": "json", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx"}
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")


def ready(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status") == "ready")


def routed(documents: DataFrame) -> DataFrame:
    """doc_id, reader: by the lower-case extension; null where no reader fits."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    reader = F.when(ext.isin(*IMAGES), F.lit("image"))
    for e, r in READERS.items():
        reader = reader.when(ext == e, F.lit(r))
    return documents.select("doc_id", reader.alias("reader"))


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with filename and creation time of their document."""
    d = documents.select(F.col("doc_id").alias("document_id"), "filename", "status", F.col("created_at").alias("document_created_at"))
    return chunks.join(d, "document_id")


def searchable(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of ready documents that have a vector."""
    return with_documents(chunks, documents).where((F.col("status") == "ready") & F.col("embedding").isNotNull())


def graph_order(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """kb_id, chunk_id, position: chunks of ready documents in reading order, from 0 in each base."""
    rows = with_documents(chunks, documents).where(F.col("status") == "ready")
    rows = rows.select("kb_id", F.col("id").alias("chunk_id"), "document_created_at", "document_id", "chunk_index")
    order = [F.col(c) for c in ("document_created_at", "document_id", "chunk_index", "chunk_id")]
    return numbered(rows, "kb_id", order, "position").select("kb_id", "chunk_id", "position")


def base_counts(bases: DataFrame, **tables: DataFrame) -> DataFrame:
    """Per base the number of rows of each table; every table is counted once, before the join."""
    out = bases.select(F.col("id").alias("kb_id"), "name")
    for name, table in tables.items():
        out = out.join(table.groupBy("kb_id").agg(F.count(F.lit(1)).alias(name)), "kb_id", "left")
    return out.fillna(0, list(tables))


def content_hash(documents: DataFrame) -> DataFrame:
    """The stored hash, or where it is missing the text's own; null texts without a hash have none."""
    stored = F.when(F.length("sha256") > 0, F.col("sha256"))
    return documents.withColumn("content_hash", F.coalesce(stored, F.sha2(F.col("text"), 256)))


def duplicates(documents: DataFrame) -> DataFrame:
    """content_hash, copies, first_id: texts that were uploaded more than once."""
    rows = documents.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("content_hash"))
    return rows.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def keep_first(documents: DataFrame) -> DataFrame:
    """doc_id of the first upload of each text; an aggregation, so a hot text is combined before the shuffle."""
    rows = documents.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("content_hash"))
    return rows.agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def extraction_method(chunks: DataFrame) -> DataFrame:
    """document_id, sections, dense_sections, method: by how many pages hold enough text of their own."""
    dense = F.length(F.regexp_replace("content", r"\s+", "")) >= 80
    rows = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("sections"), F.count_if(dense).alias("dense_sections"))
    method = F.when(F.col("dense_sections") == F.col("sections"), "native").when(F.col("dense_sections") == 0, "ocr").otherwise("hybrid")
    return rows.withColumn("method", method)


def in_order(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """query, pos, chunk_id, content of the chunks that rows (query, pos, chunk_id) name; unknown ones are left out."""
    return wanted.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").select("query", "pos", "chunk_id", "content")


def lookup(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks in the order of an array of ids: (query, ids) -> query, pos, chunk_id, content."""
    return in_order(keys.select("query", F.posexplode("ids").alias("pos", "chunk_id")), chunks)


def truncated(entities: DataFrame) -> DataFrame:
    """Entities with their texts cut to the longest kept lengths."""
    cut = [F.substring(c, 1, T.CAPS[c]).alias(c) for c in ("name", "entity_type", "description")]
    return entities.select("id", *cut)
