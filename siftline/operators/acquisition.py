"""The acquisition report: analytics rows by channel, search totals, and what changed between equal periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.agents import is_ai_assistant

METRICS = ["sessions", "total_users", "engaged_sessions", "key_events", "total_revenue"]
TOP, OPPORTUNITIES = 10, 20


def percent_change(current: Column, previous: Column) -> Column:
    """Null if there was nothing before."""
    return F.when(previous != 0, (current - previous) / previous * 100)


def _metrics(rows: DataFrame) -> list[str]:
    return [m for m in METRICS if m in rows.columns]


def traffic_totals(rows: DataFrame, by: str = "period") -> DataFrame:
    """Sums of all and of AI assistants' traffic, and the latter's share of sessions (null without sessions)."""
    ai = is_ai_assistant(F.col("channel_group"), F.col("source"))
    marked = rows.withColumn("_ai", ai)
    value = lambda m: F.coalesce(F.col(m), F.lit(0.0))
    sums = [F.sum(value(m)).alias(f"all_{m}") for m in _metrics(rows)] + [F.sum(F.when(F.col("_ai"), value(m)).otherwise(0.0)).alias(f"ai_{m}") for m in _metrics(rows)]
    out = marked.groupBy(by).agg(*sums, F.count("*").alias("returned_rows"))
    return out.withColumn("ai_session_share", F.try_divide("ai_sessions", "all_sessions"))


def traffic_change(totals: DataFrame) -> DataFrame:
    """One row of percent changes, from the totals of both periods."""
    at = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c)))
    return totals.agg(*[percent_change(at(c, "current"), at(c, "previous")).alias(f"{c}_percent") for c in ("ai_sessions", "ai_key_events", "ai_total_revenue")])


def top_ai(rows: DataFrame, field: str, name: str, n: int = TOP) -> DataFrame:
    """AI assistants' sessions by a field; ties go by its value."""
    ai = rows.where(is_ai_assistant(F.col("channel_group"), F.col("source")))
    key = F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit("(not set)"))
    return ai.groupBy(key.alias(name)).agg(F.sum(F.coalesce("sessions", F.lit(0.0))).alias("sessions")).orderBy(F.desc("sessions"), name).limit(n)


def search_totals(rows: DataFrame, by: str = "period") -> DataFrame:
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shown = F.sum(value("impressions"))
    return rows.groupBy(by).agg(
        F.sum(value("clicks")).alias("clicks"), shown.alias("impressions"), F.coalesce(F.try_divide(F.sum(value("clicks")), shown), F.lit(0.0)).alias("ctr"),
        F.try_divide(F.sum(value("position") * value("impressions")), shown).alias("position"), F.count("*").alias("rows"),
    )


def striking_distance(rows: DataFrame, n: int = OPPORTUNITIES) -> DataFrame:
    """Rows as returned with 10 impressions or more that rank from 4 to 20; ties go by query, page and position."""
    found = rows.where("query <> '' AND page <> '' AND impressions >= 10 AND position BETWEEN 4 AND 20")
    return found.orderBy(F.desc("impressions"), "query", "page", "position", F.desc("clicks")).limit(n).select("query", "page", "impressions", "clicks", "position")
