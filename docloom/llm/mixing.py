"""Problem 7: sources mixed to target shares of a wanted total size.

Every source's documents stand in the order of a hash of their id; range partitions of
(source, hash) split a source over as many tasks as its size asks. Each partition adds up
its tokens, the sums of earlier partitions of the source (a table of one row for each
partition and source) are added, and a document's place on this line decides how often it
is drawn: whole passes over the source first, then the documents before the cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.tables import Stage

from . import tokens


def placed(docs: DataFrame, key: str, source: str, size: str, seed: int = 7) -> DataFrame:
    """key, source, size and upto: the sizes of the source's documents up to this one, it included.

    Documents without a source or with no (or a null) size are left out: they belong to no
    share or add nothing to it.
    """
    stage = Stage(docs.sparkSession, "mixing")
    rows = docs.select(F.col(key), F.col(source), F.col(size).cast("long").alias(size)).where(F.col(source).isNotNull() & (F.col(size) > 0))
    rows = rows.withColumn("_h", F.xxhash64(key, F.lit(seed)))
    rows = rows.repartitionByRange(source, "_h", key).sortWithinPartitions(source, "_h", key).drop("_h")
    schema = StructType([*rows.schema.fields, StructField("local", LongType())])

    def add_up(batches):
        held, total = None, 0
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            names = batch.column(1).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            run = np.cumsum(n)
            first = np.append(True, codes[1:] != codes[:-1])
            base = np.where(first, run - n, 0)
            base = np.maximum.accumulate(base)
            local = run - base
            if len(n):
                if names.dictionary[int(codes[0])].as_py() == held:
                    local[codes == codes[0]] += total
                held, total = names.dictionary[int(codes[-1])].as_py(), int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "local"])

    rows = stage.put(rows.mapInArrow(add_up, schema).withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy(source, "part").agg(F.max("local").alias("_sum"))
    earlier = Window.partitionBy(source).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(source, "part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(sums, [source, "part"]).select(key, source, size, (F.col("local") + F.col("_before")).alias("upto"))


def budgets(line: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """Per mix and source: the source's size, the wanted size, whole passes and the size after them.

    A null share, cap or ratio counts as 0. Sources of the targets without documents are kept
    with size 0; repeated rows of a mix and source count once.
    """
    sizes = line.groupBy(source).agg(F.sum(size).alias("source_size"))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total_size"))
    t = targets.where(F.col("source").isNotNull()).groupBy("mix", F.col("source").alias(source)).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("target_share", "max_repeats", "size_ratio")])
    t = t.join(sizes, source, "left").withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")
    t = t.withColumn("source_size", F.coalesce("source_size", F.lit(0))).withColumn("wanted", F.expr("target_share * size_ratio * total_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("passes", F.least(passes, F.col("max_repeats").cast("long")))
    rest = F.when(F.col("passes") < F.col("max_repeats"), F.col("wanted") - F.col("passes") * F.col("source_size")).otherwise(0.0)
    return t.withColumn("rest", F.when(F.col("source_size") > 0, rest).otherwise(0.0))


def draw(line: DataFrame, targets: DataFrame, key: str, source: str, size: str) -> DataFrame:
    """mix, key, source, size, repeats: the documents of each mix and how often each stands in it.

    After the whole passes a document is drawn once more if more than half of it lies before
    the cut, so each reachable source misses its budget by half a document at most.
    """
    t = budgets(line, targets, source, size).select("mix", source, "passes", "rest")
    rows = line.join(t, source)
    extra = (F.col("upto") - F.col(size) / 2 < F.col("rest")).cast("long")
    return rows.withColumn("repeats", F.col("passes") + extra).where("repeats > 0").select("mix", key, source, size, "repeats")


def counted(documents: DataFrame, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of every document, written once: the range partitioning reads it twice."""
    rows = tokens.count(documents.select("doc_id", "source", "text"), "text", "n_tokens", tokenizer)
    return Stage(documents.sparkSession, "counted").put(rows)


def document_mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """p7_chosen: mix, doc_id, source, n_tokens, repeats."""
    return draw(placed(counted(documents), "doc_id", "source", "n_tokens"), targets, "doc_id", "source", "n_tokens")


def mix_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """p7_shares: for each row of the targets the wanted and the drawn tokens and shares.

    ``reached`` is false where the cap keeps the source below its budget.
    """
    line = placed(counted(documents), "doc_id", "source", "n_tokens")
    drawn = draw(line, targets, "doc_id", "source", "n_tokens")
    got = drawn.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    rows = budgets(line, targets, "source", "n_tokens").join(got, ["mix", "source"], "left").fillna(0, ["drawn_tokens", "documents", "most_repeats"])
    all_drawn = F.sum("drawn_tokens").over(Window.partitionBy("mix"))
    return rows.select(
        "mix", "source", "target_share", F.col("wanted").alias("wanted_tokens"), "drawn_tokens",
        F.when(all_drawn > 0, F.col("drawn_tokens") / all_drawn).otherwise(0.0).alias("actual_share"),
        "documents", "most_repeats", (F.col("wanted") <= F.col("source_size") * F.col("max_repeats")).alias("reached"),
    )
