"""This domain's inputs, derived from the driver's tables; each view also as SQL for the oracle, under the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USER_AGENTS = [
    "Mozilla/5.0 (compatible; OAI-SearchBot/1.0)", "OAI-AdsBot/1.0", "Mozilla/5.0 ChatGPT-User/1.0", "GPTBot/1.2", "Claude-SearchBot/1.0",
    "claude-user/1.0", "ClaudeBot/1.0", "Perplexity-User/1.0", "PerplexityBot/1.0", "Googlebot-Image/1.0", "Mozilla/5.0 (compatible; BINGBOT/2.0)",
    "Mozilla/5.0 (X11; Linux x86_64) Firefox/120.0", "xGPTBot/1.0", "curl/8.0",
]
SOURCES = ["chatgpt.com", "google", "", "https://www.perplexity.ai/search", "claude.ai", "bing", "gemini.google.com", "notchatgpt.com", "news.example"]
SHOP = "https://shop.example.com"


def _pick(index: str, values: list[str]) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REQUESTS = f"""SELECT event_id, ts, user_id, concat('/', event_type, '/', CAST(user_id % 20 AS VARCHAR(20))) AS path,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 403 ELSE 200 END AS status,
  {_pick("user_id % 14", USER_AGENTS)} AS user_agent, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events"""

#: Views as SQL that both engines read.
VIEWS = {
    "v_requests": REQUESTS,
    "v_gsc": f"""SELECT p_name AS query,
  concat('{SHOP}/', replace(p_type, ' ', '-'), '/', replace(p_brand, '#', '-'), CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('#', CAST(l_linenumber % 3 AS VARCHAR(9))) END) AS page,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS DOUBLE) AS clicks, CAST(floor(l_quantity) AS DOUBLE) AS impressions,
  CAST(3 * l_linenumber AS DOUBLE) AS position, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_ga4": f"""SELECT CASE WHEN p_brand LIKE '%3' THEN 'm.example.com' WHEN l_linenumber % 2 = 0 THEN 'Shop.Example.com' ELSE 'shop.example.com' END AS host_name,
  concat('/', replace(p_type, ' ', '-'), '/', replace(p_brand, '#', '-'), CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '/' ELSE '?utm_source=test' END) AS landing_page,
  CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS sessions, CAST(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN l_orderkey END) AS DOUBLE) AS engaged_sessions,
  CAST(count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN l_orderkey END) AS DOUBLE) AS key_events, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "v_ai_sessions": f"""SELECT CAST(ts AS DATE) AS day, CASE WHEN user_id % 23 = 0 THEN ' AI Assistants ' WHEN user_id % 2 = 0 THEN 'Organic Search' ELSE 'Referral' END AS channel_group,
  {_pick("user_id % 9", SOURCES)} AS source, CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('/', event_type) END AS landing_page, 1.0 AS sessions,
  CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS engaged_sessions, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS key_events,
  CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0.0 END AS total_revenue FROM events""",
    # stored fetches: real pages, with statuses, headers and head elements put in by page_id
    "v_fetches": """SELECT page_id, url AS requested_url, split_part(url, '#', 1) AS final_url,
  CASE WHEN page_id % 19 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 503 WHEN page_id % 29 = 0 THEN 304 ELSE 200 END AS status, page_id % 7 = 0 AS redirected, page_id % 47 = 0 AS disallowed,
  CASE WHEN page_id % 31 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 13 = 0 THEN 'googlebot: noindex' WHEN page_id % 17 = 0 THEN 'none' ELSE '' END AS x_robots,
  replace(replace(html, '<head>', concat('<head>', CASE WHEN page_id % 3 = 0 THEN '' ELSE '<meta name="Description" content=" d ">' END,
    CASE WHEN page_id % 5 = 0 THEN '<meta name="robots" content="NoIndex, follow">' ELSE '' END, CASE WHEN page_id % 37 = 0 THEN '<title>again</title>' ELSE '' END,
    CASE page_id % 8 WHEN 1 THEN '<link rel="canonical" href="/c">' WHEN 2 THEN '<link rel="canonical" href="/c"><link rel="x canonical" href="/d">' WHEN 3 THEN '<link rel="canonical" href=" ">'
      WHEN 4 THEN '<link rel="canonical" href="#part">' WHEN 5 THEN '<link rel="Canonical" href="https://other.example/x">' ELSE '' END,
    CASE page_id % 6 WHEN 1 THEN '<script type="application/ld+json">{broken</script>' WHEN 2 THEN '<script type="application/ld+json">{"@type": "Article", "author": {"@type": ["Person"], "@id": "p"}}</script>' ELSE '' END)),
    '<body>', CASE WHEN page_id % 8 = 6 THEN '<body><link rel="canonical" href="/late">' ELSE '<body>' END) AS html FROM pages""",
    # sites of 40 pages each: every page links to four further on, with gaps and ways back
    "v_edges": """SELECT page_id // 40 AS site, page_id % 40 AS src, k.position, (page_id % 40 * 4 + k.position) % 40 AS dst FROM pages, (VALUES (1), (2), (3), (4)) AS k(position) WHERE (page_id + k.position) % 7 <> 3""",
    # the same sites as stored fetches: failures, errors, redirects, listed pages, and links among the pages put into real html
    "v_site_fetches": """SELECT page_id, page_id // 40 AS site_no, page_id % 40 AS n, concat('s', CAST(page_id // 40 AS VARCHAR(9)), '.example') AS site,
  concat('https://s', CAST(page_id // 40 AS VARCHAR(9)), '.example/', CASE WHEN page_id % 40 = 0 THEN '' ELSE concat('p', CAST(page_id % 40 AS VARCHAR(9))) END) AS url,
  page_id % 41 = 5 AS failed, CASE WHEN page_id % 41 = 5 THEN NULL WHEN page_id % 11 = 3 THEN 404 WHEN page_id % 29 = 7 THEN 503 ELSE 200 END AS status,
  page_id % 3 <> 1 AS listed, page_id % 2 = 0 AS linked, page_id % 7 = 2 AS redirected, CASE WHEN page_id % 13 = 4 THEN 'noindex' ELSE '' END AS x_robots,
  replace(replace(html, '<head>', concat('<head>', CASE WHEN page_id % 5 = 1 THEN '<title>Again</title>' ELSE '' END, CASE WHEN page_id % 6 = 0 THEN '<link rel="canonical" href="/p2">' ELSE '' END)),
    '<body>', concat('<body><a href="/p', CAST((page_id * 3 + 1) % 40 AS VARCHAR(9)), '">a</a><a href="/p', CAST((page_id + 2) % 40 AS VARCHAR(9)), '#x">b</a>')) AS html FROM pages""",
    # single responses of the same sites: redirects to other pages, whole or as paths, ways back, downgrades, other hosts, pages that weren't fetched
    "v_responses": """SELECT page_id, concat('https://s', CAST(page_id // 40 AS VARCHAR(9)), '.example/h', CAST(page_id % 40 AS VARCHAR(9))) AS url,
  CASE WHEN page_id % 9 = 4 THEN 200 WHEN page_id % 13 = 0 THEN 304 WHEN page_id % 2 = 0 THEN 301 ELSE 308 END AS status,
  CASE WHEN page_id % 9 = 4 THEN NULL ELSE concat(CASE WHEN page_id % 10 = 0 THEN '' WHEN page_id % 31 = 7 THEN 'http://' ELSE 'https://' END,
    CASE WHEN page_id % 10 = 0 THEN '' WHEN page_id % 37 = 8 THEN 'other' WHEN page_id % 41 = 9 THEN concat('www.s', CAST(page_id // 40 AS VARCHAR(9))) ELSE concat('s', CAST(page_id // 40 AS VARCHAR(9))) END,
    CASE WHEN page_id % 10 = 0 THEN '/h' ELSE '.example/h' END, CAST(CASE WHEN page_id % 40 = 8 THEN 9 WHEN page_id % 40 = 9 THEN 8 ELSE (page_id % 40 * 7 + 3) % 40 END AS VARCHAR(9))) END AS location FROM pages""",
    # three audit runs of each host: findings come and go by page and run
    "v_run_findings": """SELECT r.run_no, concat('run-', CAST(r.run_no AS VARCHAR(9))) AS run_id, page_id, concat(split_part(url, '#', 1), '?n=', CAST(page_id AS VARCHAR(9))) AS url, rule_id,
  (page_id * 7 + r.run_no * 5 + k) % 4 <> 0 AS found, (page_id + r.run_no) % 11 <> 0 AS observed
  FROM pages, (VALUES (1), (2), (3)) AS r(run_no), (VALUES ('TITLE_NOT_OBSERVED_STATIC_HTML_V1', 1), ('HTTP_CLIENT_ERROR_V1', 2), ('SITEMAP_URL_REDIRECTS_V1', 3)) AS f(rule_id, k)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the tables of sf_dir; nothing is registered in the session."""
    used = {t: table(spark, sf_dir, t) for t in ("events", "lineitem", "part", "orders", "pages") if f" {t}" in VIEWS[name]}
    # tables that grow with the input are never sent whole to the driver and every executor, however small their files look
    used |= {t: used[t].hint("shuffle_hash") for t in ("part", "orders") if t in used}
    text = VIEWS[name].replace("VARCHAR(20)", "STRING").replace("VARCHAR(9)", "STRING")
    text = text.replace(" // ", " DIV ").replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ")
    return spark.sql(text, **used)


def with_views(*names: str) -> str:
    """The views as the beginning of a query for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_number and value: the requests as text, half in combined format, half NDJSON; every fiftieth is broken."""
    r = view(spark, sf_dir, "v_requests")
    time = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    combined = F.format_string('10.0.0.%d - - [%s +0000] "GET %s HTTP/1.1" %d %d "-" "%s"', F.col("user_id") % 250, time, "path", "status", "bytes", "user_agent")
    as_json = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("GET").alias("httpMethod"),
        F.struct("path", F.struct(F.col("user_agent").alias("user-agent")).alias("headers")).alias("request"),
        F.when(F.col("event_id") % 3 == 0, F.col("status").cast("string")).alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("status")).alias("statusCode"),
        F.col("bytes"), F.lit("10.0.0.1").alias("ip"),
    ))
    broken = F.when(F.col("event_id") % 200 == 0, "").when(F.col("event_id") % 150 == 0, '{"path": ').when(F.col("event_id") % 100 == 0, '{"path": "/x"}').otherwise("[1, 2]")
    value = F.when(F.col("event_id") % 50 == 0, broken).when(F.col("event_id") % 2 == 0, combined).otherwise(as_json)
    return r.select(F.col("event_id").alias("line_number"), value.alias("value"))


#: What parsing log_lines() must give, from the requests themselves.
PARSED_SQL = with_views("v_requests") + """, agents(ord, pattern, agent, behavior) AS (VALUES
  (1, 'OAI-SearchBot', 'OAI-SearchBot', 'search'), (2, 'OAI-AdsBot', 'OAI-AdsBot', 'ads'), (3, 'ChatGPT-User', 'ChatGPT-User', 'agent'),
  (4, 'GPTBot', 'GPTBot', 'training'), (5, 'Claude-SearchBot', 'Claude-SearchBot', 'search'), (6, 'Claude-User', 'Claude-User', 'agent'),
  (7, 'ClaudeBot', 'ClaudeBot', 'training'), (8, 'Perplexity-User', 'Perplexity-User', 'agent'), (9, 'PerplexityBot', 'PerplexityBot', 'search'),
  (10, 'Googlebot(?:-Image|-Video|-News)?', 'Googlebot', 'search'), (11, 'bingbot', 'bingbot', 'search')
), claimed AS (
  SELECT user_agent, arg_min(agent, ord) AS agent, arg_min(behavior, ord) AS behavior FROM (SELECT DISTINCT user_agent FROM v_requests)
  JOIN agents ON regexp_matches(user_agent, '(?i)\\b' || pattern || '\\b') GROUP BY user_agent
), parsed AS (
  SELECT r.event_id AS line_number, r.event_id % 50 <> 0 AS ok, r.*, agent, behavior,
    CASE WHEN event_id % 50 <> 0 THEN NULL WHEN event_id % 200 = 0 THEN 'Line is empty.' WHEN event_id % 150 = 0 THEN 'Invalid JSON log line.'
      WHEN event_id % 100 = 0 THEN 'JSON log line must include a request path and numeric status.'
      ELSE 'Line is neither supported JSON nor Apache/Nginx combined format.' END AS reason
  FROM v_requests r LEFT JOIN claimed USING (user_agent)
)"""
PARSED_SQL = PARSED_SQL.replace("'(?i)\\\\b'", "'(?i)\\b'").replace("'\\\\b'", "'\\b'")
