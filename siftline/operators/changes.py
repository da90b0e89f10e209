"""Change records: what was done about an opportunity, append-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.urls import document_url

# Kinds of change, and caps.
TYPES = ("metadata", "content", "internal-links", "structured-data", "technical", "measurement", "other")
HASH = r"^[a-f0-9]{64}$"
MAX_URLS, MAX_NOTE, LIST, LIST_URLS = 100, 2000, 20, 5
CHANGES = """id string, recorded_at string, opportunity_id string, site string, urls array<string>, type string, git_commit string, deployment_ref string,
before_content_hash string, after_content_hash string, note string, concurrent_changes array<string>"""


def problems() -> Column:
    """Why a record can't be stored; empty if it can."""
    bad_hash = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(HASH)
    return F.array_compact(F.array(
        F.when(~F.col("type").isin(*TYPES), "unknown type"), F.when(bad_hash("before_content_hash"), "before_content_hash is no SHA-256"),
        F.when(bad_hash("after_content_hash"), "after_content_hash is no SHA-256"), F.when((F.size("urls") < 1) | (F.size("urls") > MAX_URLS), f"urls must be 1 to {MAX_URLS}"),
        F.when(F.length("note") > MAX_NOTE, f"note must have at most {MAX_NOTE} characters"), F.when(F.exists("urls", lambda u: ~u.rlike(r"(?i)^https?://[^/?#@\s]+")), "a url is not http(s)"),
    ))


def prepared(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with each document once, in order -> those to store, and rejects with their problems."""
    clean = records.withColumn("urls", F.array_distinct(F.transform("urls", document_url))).withColumn("_bad", problems())
    return clean.where(F.size("_bad") == 0).drop("_bad"), clean.where(F.size("_bad") > 0).withColumnRenamed("_bad", "problems")


def appended(stored: DataFrame, records: DataFrame) -> DataFrame:
    """Stored ids stay as they are."""
    return stored.unionByName(records.join(stored.select("id"), "id", "left_anti").select(*stored.columns))


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(folder)


def save(records: DataFrame, folder: str) -> DataFrame:
    """Append the records that can be stored and whose ids aren't there yet; the rejects come back. Of one id in the same batch, the one recorded first stays."""
    spark = records.sparkSession
    good, bad = prepared(records)
    names = [c.split()[0] for c in CHANGES.replace("\n", " ").split(", ")]
    order = Window.partitionBy("id").orderBy("recorded_at", F.xxhash64(*names))
    good = good.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        good = good.join(read(spark, folder).select("id"), "id", "left_anti")
    good.select(*names).write.mode("append").parquet(folder)
    return bad


def listed(stored: DataFrame, opportunity_id: str | None = None, url: str | None = None, limit: int = LIST) -> DataFrame:
    """Newest first; a url matches whatever its fragment."""
    rows = stored
    if opportunity_id is not None:
        rows = rows.where(F.col("opportunity_id") == opportunity_id)
    if url is not None:
        rows = rows.where(F.array_contains(F.col("urls"), document_url(F.lit(url))))
    out = rows.orderBy(F.desc("recorded_at"), F.desc("id")).limit(limit)
    return out.withColumns({"additional_urls": F.greatest(F.size("urls") - LIST_URLS, F.lit(0)), "urls": F.slice("urls", 1, LIST_URLS)})


def with_opportunities(stored: DataFrame, queue: DataFrame) -> DataFrame:
    return stored.join(queue.select(F.col("id").alias("opportunity_id"), F.col("status").alias("opportunity_status"), "observation_state"), "opportunity_id", "left")
