"""Queries over search and analytics rows."""

from __future__ import annotations

import functools
from datetime import date

from pyspark.sql import functions as F

from siftline.functions.periods import acquisition_periods, length_days, period_of
from siftline.operators import acquisition, coverage, search
from siftline.sources.adapters import table, view, with_views

NOW, DAYS = date(2001, 11, 7), 366
AI_NOW, AI_DAYS = date(2024, 1, 31), 14
GSC = acquisition_periods(DAYS, NOW)["gsc"]
AI = acquisition_periods(AI_DAYS, AI_NOW)["ga4"]


def _between(name, periods, which):
    a, b = periods[which]
    return f"{name} BETWEEN DATE '{a}' AND DATE '{b}'"


def gsc(s, d):
    rows = view(s, d, "v_gsc")
    return rows.withColumn("period", period_of(F.col("day"), GSC)).where("period IS NOT NULL")


def rolled(s, d, which):
    a, b = GSC[which]
    rows = view(s, d, "v_gsc").where(F.col("day").between(F.lit(a), F.lit(b)))
    return search.roll_up(rows)


def both(s, d):
    return rolled(s, d, "current"), rolled(s, d, "previous")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def ai_rows(s, d):
    rows = view(s, d, "v_ai_sessions")
    return rows.withColumn("period", period_of(F.col("day"), AI)).where("period IS NOT NULL")


LENGTHS = (366, 28, 1)


def period_rows(s, d):
    """Rows of each period of each source, for several lengths: bounds, days and how many rows lie within."""
    rows, parts = view(s, d, "v_gsc").select("day"), []
    for n in LENGTHS:
        for source, periods in acquisition_periods(n, NOW).items():
            known = rows.withColumn("period", period_of(F.col("day"), periods)).where("period IS NOT NULL").groupBy("period").agg(F.count("*").alias("rows"))
            bounds = s.createDataFrame([(n, source, which, a, b) for which, (a, b) in periods.items()], "days int, source string, period string, start date, end date")
            parts.append(bounds.join(known, "period", "left").withColumn("rows", F.coalesce("rows", F.lit(0))))
    every = functools.reduce(lambda a, b: a.unionByName(b), parts)
    return every.withColumn("length", length_days(F.col("start"), F.col("end"))).withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


def _rolled_sql(name, which):
    return f"""{name} AS (SELECT query, split_part(page, '#', 1) AS page, sum(clicks) AS clicks, sum(impressions) AS impressions,
  sum(clicks) / sum(impressions) AS ctr, sum(position * impressions) / sum(impressions) AS position, list_sort(list(DISTINCT page)) AS page_variants
  FROM v_gsc WHERE {_between("day", GSC, which)} GROUP BY 1, 2)"""


BOTH = with_views("v_gsc") + ", " + _rolled_sql("cur", "current") + ", " + _rolled_sql("prev", "previous")
CANDIDATES = BOTH + """, judged AS (
  SELECT c.*, p.clicks AS previous_clicks, c.clicks - p.clicks AS click_change, (SELECT sum(clicks) / sum(impressions) FROM cur) AS baseline
  FROM cur c LEFT JOIN prev p USING (query, page) WHERE c.impressions >= 100
), found AS (
  SELECT *, concat_ws(',', CASE WHEN position > 0 AND position <= 20 AND ctr < baseline THEN 'low_ctr' END, CASE WHEN position BETWEEN 4 AND 20 THEN 'striking_distance' END,
    CASE WHEN click_change <= -greatest(3, ceil(previous_clicks * 0.2)) THEN 'declining_clicks' END) AS signals,
    CASE WHEN coalesce(click_change, 0) <= -10 OR impressions >= 1000 THEN 'high' WHEN impressions >= 250 OR coalesce(click_change, 0) <= -3 THEN 'medium' ELSE 'low' END AS priority
  FROM judged
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, impressions DESC, query, page) AS rank FROM found WHERE signals <> ''
)"""
OUTCOMES = """outcomes AS (
  SELECT lower(host_name) || regexp_replace(regexp_replace(landing_page, '[?#].*$', ''), '/+$', '') AS page_key, sum(sessions) AS sessions, sum(engaged_sessions) AS engaged_sessions,
    sum(key_events) AS key_events, round(sum(total_revenue), 2) AS total_revenue, round(sum(engaged_sessions) / sum(sessions), 6) AS engagement_rate FROM v_ga4 GROUP BY 1)"""
OVERLAPS = BOTH + """, meaningful AS (SELECT * FROM cur WHERE impressions >= 10), groups AS (
  SELECT query, count(*) AS pages, sum(impressions) AS total FROM meaningful GROUP BY 1 HAVING count(*) >= 2 AND sum(impressions) >= 100
), first AS (SELECT *, row_number() OVER (ORDER BY total DESC, query) AS rank FROM groups), overlap AS (
  SELECT rank, query, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page) AS page_rank, page, clicks, impressions, greatest(0, pages - 5)::BIGINT AS additional_pages
  FROM meaningful JOIN first USING (query) WHERE rank <= 10 QUALIFY page_rank <= 5
)"""
AI_CASE = r"""(lower(trim(channel_group)) = 'ai assistants' OR regexp_matches(split_part(regexp_replace(trim(source), '^https?://', ''), '/', 1),
  '(?i)(^|\.)(chatgpt\.com|openai\.com|perplexity\.ai|claude\.ai|anthropic\.com|gemini\.google\.com|copilot\.microsoft\.com)$'))"""
AI_ROWS = with_views("v_ai_sessions") + f""", marked AS (SELECT *, {AI_CASE} AS ai,
  CASE WHEN {_between("day", AI, "current")} THEN 'current' WHEN {_between("day", AI, "previous")} THEN 'previous' END AS period FROM v_ai_sessions)"""
_CUR_COLS = "query, page, clicks, impressions, round(ctr, 6) AS ctr, round(position, 6) AS position"

FILTERS = [("query", "contains", "green"), ("query", "notContains", "green"), ("page", "equals", "https://shop.example.com/PROMO"), ("query", "includingRegex", "^[a-m]"), ("query", "excludingRegex", "^[a-m]"), ("page", "notEquals", "x")]


def filtered(s, d):
    rows = view(s, d, "v_gsc")
    return rows.agg(*[F.count_if(search.search_filter(F.col(c), o, v)).alias(f"f{i}") for i, (c, o, v) in enumerate(FILTERS)], F.count_if(search.string_filter(F.col("query"), "EXACT", "ALMOND antique")).alias("exact"),
                    F.count_if(search.string_filter(F.col("query"), "BEGINS_WITH", "A")).alias("begins"), F.count_if(search.string_filter(F.col("query"), "PARTIAL_REGEXP", "^a.*d$", True)).alias("partial"))


PAGED = [("n * 2", 500), ("(n + 1) DIV 2", 500), ("n", 500), ("n", 700), ("1000", 400)]


def _pages(s, d, kind):
    """Coverage of all events as rows of a source, in their order, for several caps and page sizes."""
    ordered = table(s, d, "events").select((F.col("event_id") + 1).alias("ordinal"))
    n = ordered.count()
    caps = [n * 2, (n + 1) // 2, n, n, 1000]
    parts = [coverage.paged(ordered, most, size, kind, reported=n if kind == "ga4" else None)[1] for most, (_, size) in zip(caps, PAGED, strict=True)]
    return functools.reduce(lambda a, b: a.unionByName(b), parts).withColumn("incomplete_reasons", F.concat_ws(";", "incomplete_reasons"))


QUERIES = {
    "f13_f14_periods": period_rows,
    "p1_p2_filters": filtered,
    "p3_min_impressions": lambda s, d: rolled(s, d, "current").where("impressions >= 100").select("query", "page", "impressions"),
    "a4_search_rollup": lambda s, d: _rounded(rolled(s, d, "current"), "ctr", "position").withColumn("page_variants", F.concat_ws(" ", "page_variants")),
    "a5_landing_outcomes": lambda s, d: _rounded(search.landing_outcomes(view(s, d, "v_ga4")), "engagement_rate").withColumn("total_revenue", F.round("total_revenue", 2)),
    "a6_ctr_baseline": lambda s, d: _rounded(search.baseline(rolled(s, d, "current")), "baseline"),
    "a7_search_totals": lambda s, d: _rounded(acquisition.search_totals(gsc(s, d)), "ctr", "position"),
    "a8_j1_p4_candidates": lambda s, d: search.candidates(*both(s, d)).select("query", "page", "clicks", "impressions", "previous_clicks", "click_change", F.concat_ws(",", "signals").alias("signals"), "priority"),
    "w1_t3_ranked_candidates": lambda s, d: search.ranked(search.candidates(*both(s, d))).select("rank", "query", "page", "priority", "impressions"),
    "j2_page_findings": lambda s, d: search.page_findings(search.candidates(*both(s, d)), search.landing_outcomes(view(s, d, "v_ga4"))).select(
        "id", "page", "query", "priority", F.concat_ws(",", "signals").alias("signals"), F.concat_ws(",", "evidence_refs").alias("evidence_refs"), "sessions", F.round("engagement_rate", 6).alias("engagement_rate")),
    "a9_w2_t4_overlaps": lambda s, d: search.overlaps(rolled(s, d, "current")),
    "a9_overlap_findings": lambda s, d: search.overlap_findings(search.overlaps(rolled(s, d, "current"))).select("id", "query", "clicks", "impressions", F.round("ctr", 6).alias("ctr"), "priority", F.size("competing_pages").alias("pages"), "additional_pages", F.concat_ws(",", "evidence_refs").alias("evidence_refs")),
    "j3_movements": lambda s, d: search.movements(*both(s, d)),
    "t5_winners": lambda s, d: search.winners(search.movements(*both(s, d))),
    "t6_losers": lambda s, d: search.losers(search.movements(*both(s, d))),
    "j4_t7_previous_only": lambda s, d: search.previous_only(*both(s, d)),
    "t8_striking_distance": lambda s, d: acquisition.striking_distance(gsc(s, d).where("period = 'current'")),
    "a10_traffic_totals": lambda s, d: _rounded(acquisition.traffic_totals(ai_rows(s, d)), "ai_session_share"),
    "a11_w4_traffic_change": lambda s, d: _rounded(acquisition.traffic_change(acquisition.traffic_totals(ai_rows(s, d))), "ai_sessions_percent", "ai_key_events_percent", "ai_total_revenue_percent"),
    "a12_t9_top_ai_sources": lambda s, d: acquisition.top_ai(ai_rows(s, d).where("period = 'current'"), "source", "source"),
    "a12_t9_top_ai_pages": lambda s, d: acquisition.top_ai(ai_rows(s, d).where("period = 'current'"), "landing_page", "page"),
    "f16_ai_traffic": lambda s, d: view(s, d, "v_ai_sessions").withColumn("ai", acquisition.is_ai_assistant(F.col("channel_group"), F.col("source"))).groupBy("channel_group", "source", "ai").agg(F.count("*").alias("rows")),
    "s8_paged_ga4": lambda s, d: _pages(s, d, "ga4"),
    "s9_paged_gsc": lambda s, d: _pages(s, d, "gsc"),
}


def _paged_sql(kind):
    cases = " UNION ALL ".join(f"SELECT n, ({m.replace('DIV', '//')})::INT AS m, {z} AS z FROM e" for m, z in PAGED)
    again = "0" if kind == "ga4" else "CASE WHEN k < m AND k % z = 0 THEN 1 ELSE 0 END"
    return f"""WITH e AS (SELECT count(*) AS n FROM events), t AS (SELECT m, least(z, m) AS z, least(n, m) AS k, n FROM ({cases})), u AS (SELECT *, k = m {"OR k < n" if kind == "ga4" else ""} AS cut FROM t)
  SELECT m AS requested_rows, k::BIGINT AS observed_rows, (ceil(k / z) + {again})::BIGINT AS pages_fetched, z AS page_size, cut AS truncated, cut AS partial,
  CASE WHEN cut THEN 'row cap reached: ' || m ELSE '' END AS incomplete_reasons FROM u"""


ORACLES = {
    "f13_f14_periods": with_views("v_gsc") + f""", c(days) AS (VALUES {", ".join(f"({n})" for n in LENGTHS)}), l(source, lag) AS (VALUES ('ga4', 1), ('gsc', 3)), p(period, back) AS (VALUES ('current', 0), ('previous', 1)),
  b AS (SELECT days, source, period, (DATE '{NOW}' - lag - days + 1 - back * days)::DATE AS a, (DATE '{NOW}' - lag - back * days)::DATE AS z FROM c, l, p)
  SELECT days, source, period, a::VARCHAR AS start, z::VARCHAR AS "end", days AS length, (SELECT count(*) FROM v_gsc WHERE day BETWEEN a AND z) AS rows FROM b""",
    "p1_p2_filters": with_views("v_gsc") + r""" SELECT count(*) FILTER (WHERE contains(query, 'green')) AS f0, count(*) FILTER (WHERE NOT contains(query, 'green')) AS f1,
  count(*) FILTER (WHERE page = 'https://shop.example.com/PROMO') AS f2, count(*) FILTER (WHERE regexp_matches(query, '^[a-m]')) AS f3, count(*) FILTER (WHERE NOT regexp_matches(query, '^[a-m]')) AS f4, count(*) AS f5,
  count(*) FILTER (WHERE lower(query) = 'almond antique') AS exact, count(*) FILTER (WHERE lower(query) LIKE 'a%') AS begins, count(*) FILTER (WHERE regexp_matches(query, '^a.*d$')) AS partial FROM v_gsc""",
    "p3_min_impressions": BOTH + " SELECT query, page, impressions FROM cur WHERE impressions >= 100",
    "a4_search_rollup": BOTH + f" SELECT {_CUR_COLS}, array_to_string(page_variants, ' ') AS page_variants FROM cur",
    "a5_landing_outcomes": with_views("v_ga4") + ", " + OUTCOMES + " SELECT * FROM outcomes",
    "a6_ctr_baseline": BOTH + " SELECT round(sum(clicks) / sum(impressions), 6) AS baseline FROM cur",
    "a7_search_totals": with_views("v_gsc") + f""" SELECT CASE WHEN {_between("day", GSC, "current")} THEN 'current' ELSE 'previous' END AS period, sum(clicks) AS clicks, sum(impressions) AS impressions,
  round(sum(clicks) / sum(impressions), 6) AS ctr, round(sum(position * impressions) / sum(impressions), 6) AS position, count(*) AS rows FROM v_gsc
  WHERE {_between("day", GSC, "current")} OR {_between("day", GSC, "previous")} GROUP BY 1""",
    "a8_j1_p4_candidates": CANDIDATES + " SELECT query, page, clicks, impressions, previous_clicks, click_change, signals, priority FROM found WHERE signals <> ''",
    "w1_t3_ranked_candidates": CANDIDATES + " SELECT rank::INT AS rank, query, page, priority, impressions FROM ranked WHERE rank <= 25",
    "j2_page_findings": CANDIDATES.replace("WITH v_gsc AS", with_views("v_ga4") + ", v_gsc AS", 1) + ", " + OUTCOMES + """ SELECT 'finding_page_' || rank AS id, page, query, priority, signals,
  concat_ws(',', 'ev_gsc_current_' || rank, CASE WHEN previous_clicks IS NOT NULL THEN 'ev_gsc_previous_' || rank END, CASE WHEN sessions IS NOT NULL THEN 'ev_ga4_' || rank END) AS evidence_refs, sessions, engagement_rate
  FROM ranked LEFT JOIN outcomes ON page_key = replace(page, 'https://', '') WHERE rank <= 25""",
    "a9_w2_t4_overlaps": OVERLAPS + " SELECT rank::INT AS rank, query, page_rank::INT AS page_rank, page, clicks, impressions, additional_pages FROM overlap",
    "a9_overlap_findings": OVERLAPS + """ SELECT 'finding_cannibal_' || rank AS id, query, sum(clicks) AS clicks, sum(impressions) AS impressions, round(sum(clicks) / sum(impressions), 6) AS ctr,
  CASE WHEN sum(impressions) >= 1000 THEN 'high' ELSE 'medium' END AS priority, count(*)::INT AS pages, max(additional_pages) AS additional_pages,
  string_agg('ev_cannibal_' || rank || '_' || page_rank, ',' ORDER BY page_rank) AS evidence_refs FROM overlap GROUP BY rank, query""",
    "j3_movements": BOTH + " SELECT query, page, c.clicks AS current_clicks, p.clicks AS previous_clicks, c.clicks - p.clicks AS click_change FROM cur c JOIN prev p USING (query, page)",
    "t5_winners": BOTH + " SELECT query, page, c.clicks AS current_clicks, p.clicks AS previous_clicks, c.clicks - p.clicks AS click_change FROM cur c JOIN prev p USING (query, page) WHERE c.clicks > p.clicks ORDER BY 5 DESC, 1, 2 LIMIT 10",
    "t6_losers": BOTH + " SELECT query, page, c.clicks AS current_clicks, p.clicks AS previous_clicks, c.clicks - p.clicks AS click_change FROM cur c JOIN prev p USING (query, page) WHERE c.clicks < p.clicks ORDER BY 5, 1, 2 LIMIT 10",
    "j4_t7_previous_only": BOTH + " SELECT query, page, clicks AS previous_clicks FROM prev p ANTI JOIN cur USING (query, page) ORDER BY clicks DESC, query, page LIMIT 10",
    "t8_striking_distance": with_views("v_gsc") + f""" SELECT query, page, impressions, clicks, position FROM v_gsc WHERE {_between("day", GSC, "current")} AND impressions >= 10 AND position BETWEEN 4 AND 20
  ORDER BY impressions DESC, query, page, position, clicks DESC LIMIT 20""",
    "a10_traffic_totals": AI_ROWS + """ SELECT period, """ + ", ".join(f"sum({m})::DOUBLE AS all_{m}, sum(CASE WHEN ai THEN {m} ELSE 0 END)::DOUBLE AS ai_{m}" for m in ("sessions", "engaged_sessions", "key_events", "total_revenue")) + """,
  count(*) AS returned_rows, round(sum(CASE WHEN ai THEN sessions ELSE 0 END) / sum(sessions), 6)::DOUBLE AS ai_session_share FROM marked WHERE period IS NOT NULL GROUP BY 1""",
    "a11_w4_traffic_change": AI_ROWS + ", t AS (SELECT period, " + ", ".join(f"sum({m})::DOUBLE AS {m}" for m in ("sessions", "key_events", "total_revenue")) + """ FROM marked WHERE ai AND period IS NOT NULL GROUP BY 1)
  SELECT """ + ", ".join(f"round((c.{m} - p.{m}) / p.{m} * 100, 6) AS ai_{m}_percent" for m in ("sessions", "key_events", "total_revenue")) + " FROM t c, t p WHERE c.period = 'current' AND p.period = 'previous'",
    "a12_t9_top_ai_sources": AI_ROWS + " SELECT CASE WHEN source = '' THEN '(not set)' ELSE source END AS source, sum(sessions)::DOUBLE AS sessions FROM marked WHERE ai AND period = 'current' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "a12_t9_top_ai_pages": AI_ROWS + " SELECT CASE WHEN landing_page = '' THEN '(not set)' ELSE landing_page END AS page, sum(sessions)::DOUBLE AS sessions FROM marked WHERE ai AND period = 'current' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "f16_ai_traffic": AI_ROWS + " SELECT channel_group, source, ai, count(*) AS rows FROM marked GROUP BY 1, 2, 3",
    "s8_paged_ga4": _paged_sql("ga4"),
    "s9_paged_gsc": _paged_sql("gsc"),
}
