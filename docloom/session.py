"""Session defaults shared by tests, bench and applications."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that results depend on (UTC) or that plans are written for (AQE, Arrow).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", app: str = "docloom", **extra: str) -> SparkSession:
    """A session with DEFAULTS; ``extra`` holds further settings with ``_`` for ``.``."""
    conf = {**DEFAULTS, **{k.replace("_", "."): v for k, v in extra.items()}}
    return SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for clusters on which it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "docloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._docloom_shipped = True
