"""Streams give what batches give."""

from pyspark.sql import functions as F

from siftline.operators import queue_state, traffic
from siftline.sources.adapters import log_lines
from siftline.sources.commits import Tables
from siftline.sources.logs import parse_lines
from siftline.streaming import logs, queue


def test_log_stream(spark, tmp_path):
    lines = log_lines(spark, "/root/testdata/sf0.001")
    lines.select("value").repartition(3).write.text(str(tmp_path / "in"))
    logs.write_parsed(logs.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    want = {r.agent: r.requests for r in traffic.by_agent(parse_lines(lines)).collect()}
    got = spark.read.parquet(str(tmp_path / "out/observations")).where("agent.matched").groupBy("agent.display_name").count()
    assert {r.display_name: r["count"] for r in got.collect()} == want
    hourly = logs.requests_by_agent(logs.read_stream(spark, str(tmp_path / "in")), late="60 days")
    stream = hourly.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert {r.agent: r.n for r in spark.table("hourly").groupBy("agent").agg(F.sum("requests").alias("n")).collect()} == want


def test_queue_stream(spark, tmp_path):
    schema = "site string, run_id string, completed_at string"
    source, folder = tmp_path / "runs", f"file://{tmp_path}/q"

    def derive(due):
        return due.select("site", F.lit("technical").alias("source"), F.lit("k").alias("kind"), F.lit("c").alias("comparison_key"), F.lit("high").alias("priority"))

    def judge(state, due):
        return spark.createDataFrame([], "site string, source string, comparison_key string, latest_run_id string, verdict string")

    for n, rows in enumerate(([("a", "r1", "1"), ("a", "r2", "2"), ("b", "x1", "1")], [("a", "r0", "0"), ("b", "x1", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        queue.start(spark.readStream.schema(schema).json(str(source)), folder, f"{tmp_path}/c", derive, judge).awaitTermination()
    state = {r.site: r.occurrences for r in Tables(spark, folder).read("state", queue_state.STATE).collect()}
    assert state == {"a": 2, "b": 1}
    assert [r.run_id for r in Tables(spark, folder).read("late", schema).collect()] == ["r0"]
