"""Queries in which what is rare elsewhere happens: blank rows, pages without a title, lists beyond their caps, the reasons' texts, JSON results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.shared import scratch, stored
from siftline.operators import html_facts, page_rules, priority, search
from siftline.plans import queries_search
from siftline.sources import report_pages, runs
from siftline.sources.adapters import table, view, with_views

BLANKED = """SELECT CASE CAST(position AS INT) % 4 WHEN 2 THEN '  ' ELSE query END AS query, CASE CAST(position AS INT) % 5 WHEN 1 THEN NULL WHEN 3 THEN ' ' ELSE page END AS page, clicks, impressions, position FROM {v_gsc}"""


def blank_rows(s, d):
    rolled = search.roll_up(s.sql(BLANKED, v_gsc=view(s, d, "v_gsc")))
    return rolled.select("query", "page", "clicks", "impressions", F.size("page_variants").cast("long").alias("variants"))


def untitled(s, d):
    """A third of the pages have no title element, another third only an empty one."""
    rows, k = view(s, d, "v_fetches"), F.col("page_id") % 3
    html = F.when(k == 0, F.replace("html", F.lit("<title>"), F.lit("<x-title>"))).when(k == 1, F.regexp_replace("html", "<title>[^<]*", "<title> ")).otherwise(F.col("html"))
    facts = rows.withColumn("facts", html_facts.html_facts(html, F.col("final_url"))).drop("html")
    ready = facts.withColumns({"x_robots_tag": F.array("x_robots"), "redirects": F.array().cast("array<struct<url:string,status:int,location:string>>")})
    found = page_rules.findings(ready, "page_id").where("rule_id LIKE 'TITLE_NOT_OBSERVED%'")
    return found.select("page_id", "rule_id", "severity")


def clipped_urls(s, d):
    """A finding for each site and status with all of its pages: lists longer and shorter than what is shown."""
    rows = view(s, d, "v_site_fetches").groupBy("site", F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("finding_id")).agg(F.array_sort(F.collect_set("url")).alias("urls"))
    found = rows.select("site", "finding_id", "urls", F.lit("technical").alias("source"), F.lit("high").alias("priority"), F.lit(0.0).alias("impressions"))
    return priority.ranked(found, 3).select("site", "finding_id", F.col("rank").cast("long").alias("rank"), F.array_join("urls", " ").alias("urls"), F.col("additional_urls").cast("long").alias("additional_urls"))


def reasons(s, d):
    found = search.page_findings(search.candidates(*queries_search.both(s, d)), search.landing_outcomes(view(s, d, "v_ga4")))
    return found.select("id", "reason")


def json_rows(s, d):
    return runs.as_json(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


def stored_report(s, d):
    """v_gsc as a stored report of pages, in the order of query, page and day."""
    folder, size = scratch(s, "report"), 2000
    rows = stored(view(s, d, "v_gsc").groupBy("query", "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")), "report-rows")
    # places in the whole order: those within a first letter, after all rows of the letters before
    letter = F.substring("query", 1, 1)
    sizes = rows.groupBy(letter.alias("letter")).agg(F.count("*").alias("n"))
    before = sizes.select("letter", F.coalesce(F.sum("n").over(Window.orderBy("letter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.withColumn("letter", letter).join(before, "letter").withColumn("ordinal", F.col("before") + F.row_number().over(Window.partitionBy("letter").orderBy("query", "page")))
    report_pages.write(placed, folder, ["query", "page"], ["clicks", "impressions"], size)
    return folder


def pushed_search(s, d):
    """Rows by an equality, a negation and a comparison, all judged in the reader; s6 and p2 over pages that are really read."""
    found = report_pages.scan(s, stored_report(s, d), 10**9)
    return found.where(report_pages.condition(F.col("page"), "contains", "/STANDARD/") & report_pages.condition(F.col("query"), "notContains", "anvil") & (F.col("query") < "m") & (F.col("impressions") >= 20))


def report_coverage(s, d):
    folder = stored_report(s, d)
    return reduce(DataFrame.unionByName, (report_pages.coverage(s, folder, cap).select("requested_rows", "observed_rows", "pages_fetched", "truncated") for cap in (3000, 4000, 10**9)))


QUERIES = {
    "s6_p2_pushed_search": pushed_search,
    "s9_stored_coverage": report_coverage,
    "p5_blank_rows": blank_rows,
    "r_title_not_observed": untitled,
    "t16_clipped_urls": clipped_urls,
    "f24_reasons": reasons,
    "s19_json_rows": json_rows,
}
PAIRS = with_views("v_gsc") + ", g AS (SELECT query, page, sum(clicks) AS clicks, sum(impressions) AS impressions FROM v_gsc GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM g)"
ORACLES = {
    "s6_p2_pushed_search": PAIRS + " SELECT * FROM g WHERE contains(page, '/STANDARD/') AND NOT contains(query, 'anvil') AND query < 'm' AND impressions >= 20",
    "s9_stored_coverage": PAIRS + """ SELECT cap AS requested_rows, least(n, cap)::BIGINT AS observed_rows, (ceil(least(n, cap) / 2000) + CASE WHEN least(n, cap) % 2000 = 0 AND least(n, cap) < cap THEN 1 ELSE 0 END)::BIGINT AS pages_fetched, n >= cap AS truncated
  FROM n, (VALUES (3000), (4000), (1000000000)) AS c(cap)""",
    "p5_blank_rows": with_views("v_gsc") + ", b AS (" + BLANKED.format(v_gsc="v_gsc") + """) SELECT query, split_part(page, '#', 1) AS page, sum(clicks) AS clicks, sum(impressions) AS impressions, count(DISTINCT page) AS variants FROM b
  WHERE trim(query) <> '' AND trim(page) <> '' GROUP BY 1, 2""",
    "r_title_not_observed": with_views("v_fetches") + " SELECT page_id, 'TITLE_NOT_OBSERVED_STATIC_HTML_V1' AS rule_id, 'medium' AS severity FROM v_fetches WHERE NOT disallowed AND content_type LIKE 'text/html%' AND page_id % 3 < 2",
    "t16_clipped_urls": with_views("v_site_fetches") + """, f AS (SELECT site, coalesce(status::VARCHAR, 'none') AS finding_id, list(DISTINCT url ORDER BY url) AS urls FROM v_site_fetches GROUP BY 1, 2)
  SELECT site, finding_id, row_number() OVER (PARTITION BY site ORDER BY finding_id) AS rank, array_to_string(urls[1:10], ' ') AS urls, greatest(len(urls) - 10, 0)::BIGINT AS additional_urls FROM f QUALIFY rank <= 3""",
    "f24_reasons": queries_search.CANDIDATES + """ SELECT 'finding_page_' || rank AS id, concat_ws(' ', CASE WHEN contains(signals, 'declining_clicks') THEN 'Clicks are down by ' || abs(click_change)::BIGINT || ' on the period before.' END,
  CASE WHEN contains(signals, 'low_ctr') THEN 'Fewer of its impressions end in a click than the property''s rows do on average.' END, CASE WHEN contains(signals, 'striking_distance') THEN 'It ranks from 4 to 20 for a query with demand.' END) AS reason FROM ranked WHERE rank <= 25""",
    "s19_json_rows": """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS json FROM orders""",
}
