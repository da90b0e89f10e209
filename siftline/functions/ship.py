"""The package on the executors: Python workers import it by name."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Session settings: Spark's default, and what stands in its place where the session says nothing else. Whole texts travel in rows, so
#: batches are bounded by bytes too: an Arrow batch stands outside the heap on both sides of the pipe, in buffers that double as they grow
#: and go only when the collector comes by, and a reader's batch is an array on the heap.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "1m"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and bound the batches of the session (SETTINGS)."""
    context = spark.sparkContext
    for key, (default, ours) in SETTINGS.items():
        if not context.getConf().contains(key) and spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    if getattr(context, "_siftline_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="siftline-"), "siftline.zip")  # Spark's file server hands it on
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._siftline_sent = True
