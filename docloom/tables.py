"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's readers prune columns and push filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset a temporary folder is made and set, and only for a local master:
    on a cluster no machine's own folder would do, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Stage:
    """Intermediate tables of one job, written to the shared folder.

    A written table cuts lineage and survives the loss of executors. ``drop`` frees one
    that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` written and read back; ``by`` (its last column) makes folders, so that a reader of one value reads no other."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        _written.setdefault(self.spark.sparkContext.applicationId, set()).add(self.base)
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stage_path", None)
        if path:
            _delete(self.spark, path)


_written: dict[str, set[str]] = {}


def clear(spark: SparkSession) -> int:
    """Delete all tables that stages of this application wrote; only once no result that reads them is needed. Gives their number."""
    bases = _written.pop(spark.sparkContext.applicationId, set())
    for base in bases:
        _delete(spark, base)
    return len(bases)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
