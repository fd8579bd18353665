"""From a folder of files to the tables of documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.embedding import Provider, embed, hashed_words
from docloom.sources.files import read_sections

from .chunking import chunk
from .ranking import numbered


def ingest(spark: SparkSession, path: str, kb_id: str, provider: Provider | None = None, size: int = 900, overlap: int = 160, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of the files below ``path``.

    Ids are hashes of base, content and place, so a task that runs again gives the same
    rows. A file that cannot be read is a document with status ``error`` and no chunks. A chunk has
    its section's page and metadata; chunk_index counts through all sections of the document.
    """
    sections = read_sections(spark, path, **options)
    doc = F.sha2(F.concat_ws("\x1f", F.lit(kb_id), "path", "sha256"), 256)
    sections = sections.withColumn("document_id", doc).withColumn("kb_id", F.lit(kb_id))
    documents = sections.groupBy("document_id", "kb_id", "filename", "sha256").agg(
        F.max("error").alias("error"), F.greatest(F.lit(1), F.count("text")).alias("page_count"), F.when(F.count("error") > 0, "error").otherwise("ready").alias("status")
    )
    kept = ["document_id", "kb_id", "section", "page_number", "metadata"]
    parts = chunk(sections.where("text is not null"), "text", kept, size, overlap).withColumnsRenamed({"chunk_index": "_in_section", "metadata": "metadata_json"})
    # the same file below two paths is two documents; one document's sections have distinct numbers
    parts = numbered(parts, "document_id", [F.col("section"), F.col("_in_section")], "chunk_index").drop("section", "_in_section")
    place = F.concat_ws("\x1f", "document_id", F.col("chunk_index").cast("string"))
    parts = parts.withColumn("id", F.sha2(place, 256)).withColumn("embedding", embed(F.col("content"), provider or hashed_words()))
    return documents, parts.withColumn("embedding_dim", F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding")))


def store(chunks: DataFrame, out: str) -> None:
    """Append chunks by base, so that a base is read, replaced or dropped as a partition."""
    chunks.write.partitionBy("kb_id").mode("append").parquet(out)


def replace_base(chunks: DataFrame, out: str) -> None:
    """Write the bases in ``chunks`` anew and leave the others as they are."""
    chunks.write.partitionBy("kb_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
