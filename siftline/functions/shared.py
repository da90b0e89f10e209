"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='siftline-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in the shared folder: its lineage is cut, and it survives the loss of any executor."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder under the shared root, removed when the driver ends."""
    path = f"{shared_root(spark)}/siftline-{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(drop)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: made once, however often it is read."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contained(root: str, path: str) -> str:
    """The path, if it lies in root after links are followed."""
    top, at = Path(root).resolve(), Path(root, path).resolve()
    if top != at and top not in at.parents:
        raise ValueError(f"{path} lies outside {root}")
    return str(at)
