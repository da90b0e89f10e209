"""What the operators share: reading tables, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.shared import shared_root
from siftline.functions.ship import ship

__all__ = ["WORD", "drop_folder", "scratch", "ship", "table", "unit_hash", "word_count", "written"]

#: ASCII white space as the contracts define it; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        drop_folder(spark, path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder under the shared root, removed when the driver ends."""
    path = f"{shared_root(spark)}/siftline-{what}-{uuid.uuid4().hex}"
    atexit.register(_drop_at_exit, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """32 bits of an MD5 as a long: an engine-neutral hash that SQL oracles can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("long")
