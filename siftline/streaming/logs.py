"""Access logs as a stream: the batch parser on new lines, counts that update, and rejects kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.sources.logs import parse_lines


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder, as lines; their order is that of the files."""
    return spark.readStream.text(path).select(F.lit(None).cast("bigint").alias("line_number"), "value")


def requests_by_agent(lines: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Requests of claimed agents by hour. State of windows older than the watermark is dropped."""
    seen = parse_lines(lines).where("ok AND observation.agent.matched").select(F.col("observation.ts").alias("ts"), F.col("observation.agent.display_name").alias("agent"))
    return seen.withWatermark("ts", late).groupBy(F.window("ts", window), "agent").agg(F.count("*").alias("requests")).select(F.col("window.start").alias("start"), "agent", "requests")


def write_parsed(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Observations and rejects as two tables; a batch that is run again writes the same files anew."""

    def both(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch).persist()
        try:
            parsed.where("ok").select("observation.*").write.mode("overwrite").parquet(f"{out}/observations/batch={number}")
            parsed.where("NOT ok").select("reason").write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        finally:
            parsed.unpersist()

    return lines.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
