"""Search opportunities: rows of two equal periods rolled up, joined, ranked and compared.

Inputs: search rows (query, page, clicks, impressions, position) of the current and the previous period, and landing outcomes.
Ties in every ranking go by query, then page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.urls import document_url, page_key
from siftline.sources.logs import once

MIN_IMPRESSIONS, CANDIDATES, GROUPS, GROUP_PAGES, MOVEMENTS = 100, 25, 10, 5, 10
METRICS = ["sessions", "engaged_sessions", "key_events", "total_revenue"]
PRIORITY_RANK = {"high": 3, "medium": 2, "low": 1}


def roll_up(rows: DataFrame) -> DataFrame:
    """One row per query and document: fragments of a page are one document; blank queries and pages are left out."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    cleaned = rows.select(F.trim("query").alias("query"), F.trim("page").alias("raw"), *[number(c).alias(c) for c in ("clicks", "impressions", "position")])
    # added up by spelling first, so that a URL is taken apart once for each query and spelling, and lists of spellings get each once
    spelled = cleaned.where("query <> '' AND raw <> ''").groupBy("query", "raw").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("weighted"))
    total = F.sum("impressions")
    # a join's filter on page would be put below the first sums, and take URLs apart row by row, but for the generator
    return once(spelled.withColumn("page", document_url(F.col("raw"))), spelled.columns, "page").groupBy("query", "page").agg(
        F.array_sort(F.collect_set("raw")).alias("page_variants"), F.sum("clicks").alias("clicks"), total.alias("impressions"),
        F.coalesce(F.try_divide(F.sum("clicks"), total), F.lit(0.0)).alias("ctr"),
        F.coalesce(F.try_divide(F.sum("weighted"), total), F.lit(0.0)).alias("position"),
    )


def landing_outcomes(rows: DataFrame) -> DataFrame:
    """One row per host and path: sums, and the engagement rate (null without sessions)."""
    missing = {"host_name", "landing_page", *METRICS} - set(rows.columns)
    if missing:
        raise ValueError(f"the analytics rows lack {', '.join(sorted(missing))}")
    keyed = rows.withColumn("page_key", page_key(F.coalesce("landing_page", F.lit("")), F.col("host_name")))
    sums = keyed.groupBy("page_key").agg(*[F.sum(F.coalesce(m, F.lit(0.0))).alias(m) for m in METRICS])
    return sums.withColumn("engagement_rate", F.try_divide("engaged_sessions", "sessions"))


def baseline(current: DataFrame) -> DataFrame:
    """The property's ratio of clicks to impressions: one row."""
    return current.agg(F.coalesce(F.try_divide(F.sum("clicks"), F.sum("impressions")), F.lit(0.0)).alias("baseline"))


def priority(impressions: Column, change: Column) -> Column:
    return F.when((change <= -10) | (impressions >= 1000), "high").when((impressions >= 250) | (change <= -3), "medium").otherwise("low")


def candidates(current: DataFrame, previous: DataFrame, min_impressions: int = MIN_IMPRESSIONS) -> DataFrame:
    """Rows with demand and at least one signal, with the change in clicks (null without a previous row) and a priority."""
    before = previous.select("query", "page", F.col("clicks").alias("previous_clicks"))
    joined = current.where(F.col("impressions") >= min_impressions).join(before, ["query", "page"], "left")
    # one row against all: an aggregate of the whole property
    joined = joined.join(F.broadcast(baseline(current)))
    change = F.col("clicks") - F.col("previous_clicks")
    low_ctr = (F.col("position") > 0) & (F.col("position") <= 20) & (F.col("ctr") < F.col("baseline"))
    fallen = F.col("previous_clicks").isNotNull() & (change <= -F.greatest(F.lit(3), F.ceil(F.col("previous_clicks") * 0.2)))
    signals = F.array_compact(F.array(
        F.when(low_ctr, "low_ctr"), F.when(F.col("position").between(4, 20), "striking_distance"), F.when(fallen, "declining_clicks"),
    ))
    out = joined.withColumns({"click_change": change, "signals": signals}).where(F.size("signals") > 0)
    return out.withColumn("priority", priority(F.col("impressions"), F.coalesce("click_change", F.lit(0.0)))).drop("baseline")


def priority_rank(column: Column) -> Column:
    return F.when(column == "high", 3).when(column == "medium", 2).otherwise(1)


def ranked(found: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The first n, numbered from 1, by priority and impressions. Only n rows go on to the numbering."""
    order = [priority_rank(F.col("priority")).desc(), F.desc("impressions"), F.asc("query"), F.asc("page")]
    first = found.orderBy(*order).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page_findings(found: DataFrame, outcomes: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """Ranked candidates with their landing outcome, ids, reason and evidence."""
    first = ranked(found, n).withColumn("page_key", page_key(F.col("page")))
    out = first.join(outcomes, "page_key", "left").drop("page_key")
    has = lambda s: F.array_contains("signals", s)
    amount = F.abs("click_change")
    amount = F.when(amount == F.floor(amount), F.floor(amount).cast("string")).otherwise(amount.cast("string"))
    reason = F.concat_ws(
        " ", F.when(has("declining_clicks"), F.concat(F.lit("Clicks are down by "), amount, F.lit(" on the period before."))),
        F.when(has("low_ctr"), "Fewer of its impressions end in a click than the property's rows do on average."), F.when(has("striking_distance"), "It ranks from 4 to 20 for a query with demand."),
    )
    id_of = lambda kind: F.concat(F.lit(kind), F.col("rank").cast("string"))
    refs = F.array_compact(F.array(
        id_of("ev_gsc_current_"), F.when(F.col("previous_clicks").isNotNull(), id_of("ev_gsc_previous_")), F.when(F.col("sessions").isNotNull(), id_of("ev_ga4_")),
    ))
    return out.withColumns({"id": id_of("finding_page_"), "kind": F.lit("page_query"), "reason": reason, "evidence_refs": refs})


def overlaps(current: DataFrame, min_impressions: int = MIN_IMPRESSIONS, n: int = GROUPS, pages: int = GROUP_PAGES) -> DataFrame:
    """Queries for which several pages have real impressions: the first n by impressions, each with its first pages.

    Sums come first, from a partial aggregation; only the rows of the n queries are ranked.
    """
    meaningful = current.where(F.col("impressions") >= F.greatest(F.lit(10.0), F.lit(min_impressions / 10)))
    groups = meaningful.groupBy("query").agg(F.count("*").alias("pages"), F.sum("impressions").alias("total")).where((F.col("pages") >= 2) & (F.col("total") >= min_impressions))
    order = [F.desc("total"), F.asc("query")]
    first = groups.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    within = Window.partitionBy("query").orderBy(F.desc("impressions"), "page")
    # at most n rows
    rows = meaningful.join(F.broadcast(first), "query").withColumn("page_rank", F.row_number().over(within)).where(F.col("page_rank") <= pages)
    return rows.select("rank", "query", "page_rank", "page", "clicks", "impressions", F.greatest(F.lit(0), F.col("pages") - pages).cast("long").alias("additional_pages"))


def overlap_findings(rows: DataFrame) -> DataFrame:
    """One row per query of overlaps(): metrics of the pages reported, priority and ids."""
    pages = F.array_sort(F.collect_list(F.struct("page_rank", "page", "clicks", "impressions")))
    out = rows.groupBy("rank", "query").agg(pages.alias("competing_pages"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.max("additional_pages").alias("additional_pages"))
    refs = F.transform("competing_pages", lambda p: F.concat_ws("_", F.lit("ev_cannibal"), F.col("rank").cast("string"), p.page_rank.cast("string")))
    return out.withColumns({
        "id": F.concat(F.lit("finding_cannibal_"), F.col("rank").cast("string")), "kind": F.lit("cannibalization"),
        "ctr": F.coalesce(F.try_divide("clicks", "impressions"), F.lit(0.0)), "priority": F.when(F.col("impressions") >= 1000, "high").otherwise("medium"), "evidence_refs": refs,
    })


def movements(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of both periods, with the change in clicks."""
    before = previous.select("query", "page", F.col("clicks").alias("previous_clicks"))
    both = current.select("query", "page", F.col("clicks").alias("current_clicks")).join(before, ["query", "page"])
    return both.withColumn("click_change", F.col("current_clicks") - F.col("previous_clicks"))


def winners(moved: DataFrame, n: int = MOVEMENTS) -> DataFrame:
    return moved.where("click_change > 0").orderBy(F.desc("click_change"), "query", "page").limit(n)


def losers(moved: DataFrame, n: int = MOVEMENTS) -> DataFrame:
    return moved.where("click_change < 0").orderBy("click_change", "query", "page").limit(n)


def previous_only(current: DataFrame, previous: DataFrame, n: int = MOVEMENTS) -> DataFrame:
    gone = previous.join(current.select("query", "page"), ["query", "page"], "left_anti")
    return gone.orderBy(F.desc("clicks"), "query", "page").limit(n).select("query", "page", F.col("clicks").alias("previous_clicks"))


# Operators of a search filter.
FILTER_OPERATORS = ("equals", "notEquals", "contains", "notContains", "includingRegex", "excludingRegex")


def search_filter(column: Column, operator: str, value: str) -> Column:
    """One condition; a null value contains nothing, so the negated ones hold for it."""
    if operator not in FILTER_OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    plain = {
        "equals": lambda: column == value, "notEquals": lambda: column == value, "contains": lambda: column.contains(value),
        "notContains": lambda: column.contains(value), "includingRegex": lambda: column.rlike(value), "excludingRegex": lambda: column.rlike(value),
    }[operator]()
    held = F.coalesce(plain, F.lit(False))
    return ~held if operator in ("notEquals", "notContains", "excludingRegex") else held


# Match types of an analytics filter.
MATCH_TYPES = ("EXACT", "BEGINS_WITH", "ENDS_WITH", "CONTAINS", "FULL_REGEXP", "PARTIAL_REGEXP")


def string_filter(column: Column, match_type: str, value: str, case_sensitive: bool = False) -> Column:
    if match_type not in MATCH_TYPES:
        raise ValueError(f"unknown match type {match_type}")
    c, v = (column, value) if case_sensitive or "REGEXP" in match_type else (F.lower(column), value.lower())
    flag = "" if case_sensitive else "(?i)"
    return {
        "EXACT": lambda: c == v, "BEGINS_WITH": lambda: c.startswith(v), "ENDS_WITH": lambda: c.endswith(v), "CONTAINS": lambda: c.contains(v),
        "FULL_REGEXP": lambda: c.rlike(f"{flag}^(?:{v})$"), "PARTIAL_REGEXP": lambda: c.rlike(f"{flag}{v}"),
    }[match_type]()
