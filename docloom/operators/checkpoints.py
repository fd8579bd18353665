"""The build log of the graph reduced to states and progress.

Every update was appended; a state is an aggregate over the log, ordered by time and then
by arrival, so late and repeated rows do no harm and no row is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """kb_id, chunk_id, status, error, attempts, position, updated_at of each chunk's last row."""
    last = F.max_by(F.struct("status", "error", "attempts", "position", "updated_at"), F.struct("updated_at", "seq"))
    return log.groupBy("kb_id", "chunk_id").agg(last.alias("s")).select("kb_id", "chunk_id", "s.*")


def late_rows(log: DataFrame) -> DataFrame:
    """Per base the rows that arrived after a newer one of the same chunk."""
    from pyspark.sql import Window

    before = Window.partitionBy("kb_id", "chunk_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("updated_at") < F.max("updated_at").over(before)
    return log.withColumn("late", late).groupBy("kb_id").agg(F.count_if("late").alias("late_rows"), F.count(F.lit(1)).alias("rows"))


def stats(states: DataFrame) -> DataFrame:
    """Per base total, processed, succeeded, failed, and the share that succeeded."""
    s = F.col("status")
    rows = states.groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s.isin("succeeded", "failed")).alias("processed"), F.count_if(s == "succeeded").alias("succeeded"), F.count_if(s == "failed").alias("failed")
    )
    return rows.withColumn("success_ratio", F.col("succeeded") / F.col("total"))


def pending(states: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of ready documents that have not succeeded, in order of position."""
    open_ = states.where("status <> 'succeeded'")
    rows = open_.join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index"), "chunk_id")
    rows = rows.join(documents.where("status = 'ready'").select(F.col("doc_id").alias("document_id"), "filename"), "document_id")
    return rows.select("kb_id", "chunk_id", "document_id", "filename", "chunk_index", "position", "attempts")


def recovered(states: DataFrame, entity_chunks: DataFrame) -> DataFrame:
    """States with chunks that already gave entities counted as succeeded (a semi-join)."""
    marked = entity_chunks.where("chunk_id is not null").select("chunk_id").distinct().withColumn("_has", F.lit(True))
    rows = states.join(marked, "chunk_id", "left")
    return rows.select("kb_id", "chunk_id", F.when(F.col("_has"), "succeeded").otherwise(F.col("status")).alias("status"))
