"""Numbering rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.tables import Stage


def numbered(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """``df`` with each row's number from 0 in its group, in the given order (which must be total).

    A window over the group would sort a hot group in one task. Here ranges of (group, order)
    are sorted apart, and the numbers of the ranges before are added from a table of one row
    per range and group. Null groups are a group.
    """
    stage = Stage(df.sparkSession, "numbered")
    rows = df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy("_part", group).orderBy(*order)
    rows = stage.put(rows.withColumn("_local", F.row_number().over(local)))
    sizes = rows.groupBy(group, "_part").agg(F.max("_local").alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    rows = rows.join(sizes, rows[group].eqNullSafe(sizes["_group"]) & (rows["_part"] == sizes["_p"]))
    return rows.withColumn(out, (F.col("_local") - 1 + F.col("_base")).cast("long")).select(*df.columns, out)
