"""Queries over access logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.agents import AGENTS, classify_user_agent
from siftline.functions.shared import scratch
from siftline.operators import traffic
from siftline.sources.adapters import PARSED_SQL, log_lines, view, with_views
from siftline.sources.logs import FIELDS, parse_lines, read_log


def parsed(spark, sf_dir, *fields):
    """fields: those of an observation that the query reads; all, if none is named."""
    return parse_lines(log_lines(spark, sf_dir), fields or FIELDS)


def scanned(spark, sf_dir):
    """The log as text files in the shared folder, read back and parsed. Files are written in order, so line numbers run through them."""
    folder = scratch(spark, "log")
    log_lines(spark, sf_dir).repartitionByRange(4, "line_number").sortWithinPartitions("line_number").select("value").write.text(folder)
    rows = parse_lines(read_log(spark, folder), ("path", "status", "bytes"))
    return rows.select("line_number", "ok", "reason", F.col("observation.path").alias("path"), F.col("observation.status").alias("status"), F.col("observation.bytes").alias("bytes"))


def scan_totals(spark, sf_dir):
    """Of each path, or reason of a reject: lines and bytes. Whatever the files, none is lost or read twice."""
    rows = scanned(spark, sf_dir)
    return rows.groupBy("path", "reason").agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"), F.min("line_number").cast("long").alias("first_line") >= 1).toDF("path", "reason", "lines", "bytes", "numbered")


def _observed(spark, sf_dir):
    o = F.col("observation")
    return parsed(spark, sf_dir).where("ok").select(
        "line_number", o.method.alias("method"), o.path.alias("path"), o.status.alias("status"), o.bytes.alias("bytes"), o.referrer.alias("referrer"),
        o.user_agent.alias("user_agent"), F.date_format(o.ts, "yyyy-MM-dd HH:mm:ss").alias("ts"), o.agent.display_name.alias("agent"), o.agent.behavior.alias("behavior"),
    )


OBSERVED_SQL = PARSED_SQL + """ SELECT line_number, 'GET' AS method, path, status::DOUBLE AS status, bytes::DOUBLE AS bytes, NULL::VARCHAR AS referrer, user_agent,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, agent, coalesce(behavior, 'unknown') AS behavior FROM parsed WHERE ok"""

def agent_cases(spark, sf_dir):
    """The agents of all requests, named alone, in other cases, and as parts of longer words."""
    spelled = F.array("user_agent", F.upper("user_agent"), F.concat("user_agent", F.lit(" gptbot")), F.concat("user_agent", F.lit("_x")), F.concat(F.lit("x"), "user_agent"))
    cases = view(spark, sf_dir, "v_requests").select(F.explode(spelled).alias("user_agent")).groupBy("user_agent").agg(F.count("*").alias("requests"))
    a = classify_user_agent(F.col("user_agent"))
    return cases.select("user_agent", "requests", *[a.getField(f).alias(f) for f in ("matched", "agent_id", "operator", "behavior", "verification", "confidence")])


AGENT_CASES_SQL = (
    with_views("v_requests") + ", agents(ord, id, operator, behavior, pattern) AS (VALUES " + ", ".join(f"({i}, '{a}', '{o}', '{b}', '{p}')" for i, (a, _, o, b, p) in enumerate(AGENTS)) + r"""), cases AS (
  SELECT user_agent, count(*) AS requests FROM (SELECT unnest([user_agent, upper(user_agent), user_agent || ' gptbot', user_agent || '_x', 'x' || user_agent]) AS user_agent FROM v_requests) GROUP BY 1
), hits AS (
  SELECT user_agent, arg_min(id, ord) AS agent_id, arg_min(operator, ord) AS operator, arg_min(behavior, ord) AS behavior
  FROM cases JOIN agents ON regexp_matches(user_agent, '(?i)\b' || pattern || '\b') GROUP BY user_agent)
SELECT c.user_agent, requests, agent_id IS NOT NULL AS matched, agent_id, operator, coalesce(behavior, 'unknown') AS behavior,
  CASE WHEN agent_id IS NULL THEN 'unknown' ELSE 'user_agent_only' END AS verification, CASE WHEN agent_id IS NULL THEN 0.0 ELSE 0.35 END::DOUBLE AS confidence
FROM cases c LEFT JOIN hits h USING (user_agent)"""
)

QUERIES = {
    "s1_log_scan": scan_totals,
    "s2_s3_log_observations": _observed,
    "s4_log_rejects": lambda s, d: parsed(s, d, "status").where(~F.col("ok")).select("line_number", "reason"),
    "a1_log_counters": lambda s, d: traffic.counters(parsed(s, d, "agent")),
    "a2_requests_by_agent": lambda s, d: traffic.by_agent(parsed(s, d, "agent")),
    "a2_requests_by_behavior": lambda s, d: traffic.by_behavior(parsed(s, d, "agent")),
    "a2_requests_by_status": lambda s, d: traffic.by_status(parsed(s, d, "status")),
    "a3_requests_by_path": lambda s, d: traffic.by_path(parsed(s, d, "path")),
    "t1_top_paths": lambda s, d: traffic.top_paths(parsed(s, d, "path")),
    "t2_first_errors": lambda s, d: traffic.first_errors(parsed(s, d, "status")),
    "f15_classify_user_agent": agent_cases,
}
ORACLES = {
    "s1_log_scan": PARSED_SQL + " SELECT CASE WHEN ok THEN path END AS path, reason, count(*) AS lines, sum(CASE WHEN ok THEN bytes END)::DOUBLE AS bytes, true AS numbered FROM parsed GROUP BY 1, 2",
    "s2_s3_log_observations": OBSERVED_SQL,
    "s4_log_rejects": PARSED_SQL + " SELECT line_number, reason FROM parsed WHERE NOT ok",
    "a1_log_counters": PARSED_SQL + """ SELECT count(*) AS total_lines, count(*) FILTER (WHERE ok) AS parsed_lines, count(*) FILTER (WHERE NOT ok) AS skipped_lines,
  count(*) FILTER (WHERE ok AND agent IS NOT NULL) AS claimed_agent_requests FROM parsed""",
    "a2_requests_by_agent": PARSED_SQL + " SELECT agent, count(*) AS requests FROM parsed WHERE ok AND agent IS NOT NULL GROUP BY 1",
    "a2_requests_by_behavior": PARSED_SQL + " SELECT behavior, count(*) AS requests FROM parsed WHERE ok AND agent IS NOT NULL GROUP BY 1",
    "a2_requests_by_status": PARSED_SQL + " SELECT status::VARCHAR AS status, count(*) AS requests FROM parsed WHERE ok GROUP BY 1",
    "a3_requests_by_path": PARSED_SQL + " SELECT path, count(*) AS requests FROM parsed WHERE ok GROUP BY 1",
    "t1_top_paths": PARSED_SQL + " SELECT path, count(*) AS requests FROM parsed WHERE ok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "t2_first_errors": PARSED_SQL + " SELECT line_number, reason FROM parsed WHERE NOT ok ORDER BY 1 LIMIT 10",
    "f15_classify_user_agent": AGENT_CASES_SQL,
}
