"""Counts over parsed access logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_PATHS, FIRST_ERRORS = 20, 10


def counters(parsed: DataFrame) -> DataFrame:
    matched = F.coalesce(F.col("observation.agent.matched"), F.lit(False))
    return parsed.agg(
        F.count("*").alias("total_lines"), F.count_if("ok").alias("parsed_lines"),
        (F.count("*") - F.count_if("ok")).alias("skipped_lines"), F.count_if(matched).alias("claimed_agent_requests"),
    )


def _counted(rows: DataFrame, key, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("requests"))


def by_agent(parsed: DataFrame) -> DataFrame:
    return _counted(parsed.where("observation.agent.matched"), F.col("observation.agent.display_name"), "agent")


def by_behavior(parsed: DataFrame) -> DataFrame:
    return _counted(parsed.where("observation.agent.matched"), F.col("observation.agent.behavior"), "behavior")


def by_status(parsed: DataFrame) -> DataFrame:
    status = F.col("observation.status")
    spelled = F.when(status == F.floor(status), F.floor(status).cast("string")).otherwise(status.cast("string"))
    return _counted(parsed.where("ok"), spelled, "status")


def by_path(parsed: DataFrame) -> DataFrame:
    return _counted(parsed.where("ok"), F.col("observation.path"), "path")


def top_paths(parsed: DataFrame, n: int = TOP_PATHS) -> DataFrame:
    """Ties go by the path's code points."""
    return by_path(parsed).orderBy(F.desc("requests"), "path").limit(n)


def first_errors(parsed: DataFrame, n: int = FIRST_ERRORS) -> DataFrame:
    return parsed.where(~F.col("ok")).orderBy("line_number").limit(n).select("line_number", "reason")


def analysis(parsed: DataFrame) -> dict[str, DataFrame]:
    """The parts of a log report."""
    return {
        "counters": counters(parsed), "by_agent": by_agent(parsed), "by_behavior": by_behavior(parsed), "by_status": by_status(parsed),
        "top_paths": top_paths(parsed), "errors": first_errors(parsed),
    }
