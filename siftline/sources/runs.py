"""Saved audit runs: an append-only table, each run once, and JSON results."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = "run_id string, saved_at string, completed_at string, site string, site_key string, sha256 string, bytes bigint, audit string"
# The cap on a stored run, and names of fields that must not be stored.
MAX_BYTES = 50 * 1024 * 1024
#: Hexadecimal digits of a site's key that name its folder. A folder a site would be as many small files as there are sites, in each save.
PART = 2
SENSITIVE = re.compile(r"^(?:access_?token|refresh_?token|client_?secret|authorization|cookie|raw_?html|body)$", re.IGNORECASE)


def sensitive_fields(kind: T.DataType, path: str = "") -> list[str]:
    """Fields of a schema, however deep, whose names tell of credentials."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            at = f"{path}.{f.name}" if path else f.name
            out += ([at] if SENSITIVE.match(f.name) else []) + sensitive_fields(f.dataType, at)
        return out
    if isinstance(kind, T.ArrayType):
        return sensitive_fields(kind.elementType, f"{path}[]")
    if isinstance(kind, T.MapType):
        return sensitive_fields(kind.valueType, f"{path}{{}}")
    return []


def as_runs(audits: DataFrame) -> DataFrame:
    """run_id, saved_at, completed_at, site and any further fields -> rows of RUNS."""
    if bad := sensitive_fields(audits.schema):
        raise ValueError(f"fields that may hold credentials aren't stored: {', '.join(bad)}")
    body = F.to_json(F.struct(*audits.columns))
    out = audits.select("run_id", "saved_at", "completed_at", "site", F.substring(F.sha2(F.lower("site"), 256), 1, 24).alias("site_key"), body.alias("audit"))
    return out.select("run_id", "saved_at", "completed_at", "site", "site_key", F.sha2("audit", 256).alias("sha256"), F.octet_length("audit").cast("long").alias("bytes"), "audit")


def save(audits: DataFrame, path: str) -> DataFrame:
    """Append the runs that aren't there yet; one that is stays as it was. -> rejects: run_id, bytes and reason of runs that are too large.

    Of rows with one run_id in the same batch, the one saved first stays (then the one of the least digest), as if they had come one by one.
    """
    rows = as_runs(audits)
    spark = rows.sparkSession
    large = F.col("bytes") > MAX_BYTES
    rejects = rows.where(large).select("run_id", "bytes", F.lit(f"a stored run has at most {MAX_BYTES} bytes").alias("reason"))
    order = Window.partitionBy("run_id").orderBy("saved_at", "sha256")
    good = rows.where(~large).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        good = good.join(read(spark, path).select("run_id"), "run_id", "left_anti")
    append(good, path)
    return rejects


def append(runs: DataFrame, path: str) -> None:
    """Rows of RUNS as further files of the table, in up to 256 folders of sites: a file a folder and save, more only where a folder gets many rows."""
    parted = runs.withColumn("part", F.substring("site_key", 1, PART))
    parted.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RUNS}, part string").parquet(path).drop("part")


def of_site(spark: SparkSession, path: str, site: str) -> DataFrame:
    """The runs of one site, from its folder alone."""
    key = hashlib.sha256(site.lower().encode()).hexdigest()[:24]
    return spark.read.schema(f"{RUNS}, part string").parquet(path).where((F.col("part") == key[:PART]) & (F.col("site_key") == key)).drop("part")


def checked(runs: DataFrame) -> DataFrame:
    """With a warning for each run whose text isn't what was saved; the others are unaffected."""
    good = (F.sha2("audit", 256) == F.col("sha256")) & F.try_parse_json("audit").isNotNull()
    return runs.withColumn("warning", F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("run "), "run_id", F.lit(" is damaged"))))


def listed(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("saved_at"), F.desc("run_id")).limit(limit)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))
