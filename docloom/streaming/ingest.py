"""Structured Streaming over an append-only source: what is there is taken in micro-batches, then the query ends.

Results go to a table in the shared folder, so they survive the query and any executor.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.extraction import logs
from docloom.tables import shared_dir


def source(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stream of the files at ``path`` (one file or a folder), ``files`` of them in a batch."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        stream = stream.option("pathGlobFilter", where.getName())
        path = where.getParent().toString()
    return stream.parquet(path)


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """Run to the end; with each batch the table is written anew (complete) or added to (append)."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """event_type, events, total."""
    rows = source(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return _drain(rows, "complete")


def hourly(spark: SparkSession, path: str, late: str = "2 hours") -> DataFrame:
    """hour, event_type, events in tumbling windows; rows later than ``late`` are dropped by the watermark.

    All windows are given out, also those that the watermark has not closed at the end.
    """
    rows = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    out = rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events")
    return _drain(out, "complete")


def extraction_waves(chunks: DataFrame, extract, out: str, state: str):
    """A running query that extracts every new chunk and appends to the log at ``out``.

    ``extract`` maps an iterator of pandas frames (chunk_id, content) to frames of (chunk_id,
    item); a batch's rows carry its number, so a replayed batch overwrites only itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.select("chunk_id", "content").mapInPandas(extract, "chunk_id string, item string")
        rows.write.mode("overwrite").parquet(f"{out}/wave={number}")

    return chunks.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(store).start()


def capitalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An extractor without a model: the capitalised words of a chunk as an answer's entities, in order of appearance."""
    for batch in batches:
        items = [json.dumps({"entities": [{"name": w} for w in dict.fromkeys(re.findall("[A-Z][a-z]{3,}", text or ""))]}) for text in batch["content"]]
        yield pd.DataFrame({"chunk_id": batch["chunk_id"], "item": items})


def extracted(spark: SparkSession, path: str, extract) -> DataFrame:
    """The entity log of all chunks at ``path``: waves of answers in the shared folder, then read as `operators.extraction` does."""
    base = f"{shared_dir(spark)}/waves-{uuid.uuid4().hex}"
    chunks = source(spark, path).select("kb_id", F.col("id").alias("chunk_id"), "content").where("content is not null")
    extraction_waves(chunks, extract, f"{base}/log", f"{base}/state").awaitTermination()
    log = spark.read.schema("chunk_id string, item string, wave int").parquet(f"{base}/log")
    place = spark.read.parquet(path).select(F.col("id").alias("chunk_id"), "kb_id")
    return logs(log.join(place, "chunk_id").select("kb_id", "chunk_id", F.col("item").alias("answer")))[0]
