"""Queries over stored fetches: facts, page rules, robots, sitemaps, crawl graphs and rules on sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import urls
from siftline.operators import crawl, html_facts, page_rules
from siftline.sources import robots, sitemaps
from siftline.sources.adapters import view, with_views

SEVERITIES = page_rules.SEVERITIES


def fetches(s, d):
    """Facts are read once; the html goes no further."""
    rows = view(s, d, "v_fetches")
    facts = rows.withColumn("facts", html_facts.html_facts(F.col("html"), F.col("final_url"))).drop("html")
    hop = F.array(F.struct(F.lit("https://from.example/").alias("url"), F.lit(301).alias("status"), F.col("final_url").alias("location")))
    return facts.withColumns({
        "x_robots_tag": F.when(F.col("x_robots") == "", F.array().cast("array<string>")).otherwise(F.array("x_robots")), "redirects": F.when(F.col("redirected"), hop).otherwise(F.slice(hop, 1, 0)),
    })


def found(s, d):
    return page_rules.findings(fetches(s, d), "page_id")


def html_summary(s, d):
    f = F.col("facts")
    return fetches(s, d).select("page_id", f.html_lang.alias("html_lang"), F.size(f.titles).alias("titles"), f.links_total.alias("links_total"), F.size(F.filter(f.headings, lambda h: h.level == 1)).alias("h1"), F.size(f.canonicals).alias("canonicals"), F.array_join(F.flatten(F.transform(f.meta_robots, lambda m: m.directives)), ",").alias("robots"))


def structured(s, d):
    return fetches(s, d).select("page_id", *html_facts.structured_counts(F.col("facts.structured_data"))).withColumn("types", F.concat_ws(",", "types"))


def links(s, d):
    f = F.col("facts")
    return fetches(s, d).select("page_id", *html_facts.link_counts(f))


def heading_counts(s, d):
    return fetches(s, d).select("page_id", *html_facts.heading_counts(F.col("facts.headings")))


def content_hashes(s, d):
    """Pages whose hash changes when a script does, and when a heading does."""
    rows = view(s, d, "v_fetches").select("page_id", "final_url", "html")
    hash_of = lambda html: html_facts.html_facts(html, F.col("final_url")).content_hash
    script, heading = F.concat("html", F.lit("<script>let x = 1</script>")), F.replace("html", F.lit("<h1>"), F.lit("<h1>Another "))
    return rows.select("page_id", (hash_of(F.col("html")) == hash_of(script)).alias("script_ignored"), (hash_of(F.col("html")) != hash_of(heading)).alias("heading_seen"))


FINDINGS_SQL = with_views("v_fetches") + """, p AS (SELECT *, content_type LIKE 'text/html%' AS html_ok FROM v_fetches), rules AS (
  SELECT page_id, final_url, unnest(CASE WHEN disallowed THEN ['ROBOTS_DISALLOW_GOOGLEBOT_V1|high'] ELSE list_filter([
    CASE WHEN status BETWEEN 400 AND 499 THEN 'HTTP_CLIENT_ERROR_V1|critical' END, CASE WHEN status >= 500 THEN 'HTTP_SERVER_ERROR_V1|high' END, CASE WHEN status = 304 THEN 'HTTP_UNEXPECTED_STATUS_V1|medium' END,
    CASE WHEN final_url LIKE 'http://%' THEN 'FINAL_URL_NOT_HTTPS_V1|medium' END, CASE WHEN redirected THEN 'REDIRECT_CHAIN_OBSERVED_V1|info' END,
    CASE WHEN html_ok AND page_id % 37 = 0 THEN 'MULTIPLE_TITLE_ELEMENTS_V1|medium' END, CASE WHEN html_ok AND page_id % 3 = 0 THEN 'DESCRIPTION_NOT_OBSERVED_STATIC_HTML_V1|low' END,
    CASE WHEN html_ok AND (page_id % 5 = 0 OR page_id % 13 = 0 OR page_id % 17 = 0) THEN 'NOINDEX_DIRECTIVE_OBSERVED_V1|medium' END,
    CASE WHEN html_ok AND page_id % 8 = 2 THEN 'MULTIPLE_CANONICAL_TARGETS_V1|high' END, CASE WHEN html_ok AND page_id % 8 = 3 THEN 'INVALID_CANONICAL_URL_V1|medium' END,
    CASE WHEN html_ok AND page_id % 8 = 4 THEN 'CANONICAL_FRAGMENT_TARGET_V1|medium' END, CASE WHEN html_ok AND page_id % 8 = 6 THEN 'CANONICAL_OUTSIDE_HEAD_V1|medium' END,
    CASE WHEN html_ok AND page_id % 8 = 5 THEN 'CROSS_ORIGIN_CANONICAL_REVIEW_V1|low' END, CASE WHEN html_ok AND page_id % 6 = 1 THEN 'INVALID_JSON_LD_SYNTAX_V1|medium' END,
    CASE WHEN NOT html_ok THEN 'HTML_NOT_OBSERVED_V1|medium' END], lambda x: x IS NOT NULL) END) AS r, CASE WHEN disallowed THEN requested_url ELSE final_url END AS url FROM p
), found AS (SELECT page_id, split_part(r, '|', 1) AS rule_id, split_part(r, '|', 2) AS severity, url, 'finding_' || substr(sha256(split_part(r, '|', 1) || chr(0) || url), 1, 16) AS finding_id FROM rules)"""

def robots_files(s, d):
    """A file for each site of v_site_fetches: groups, an agent by prefix, wildcards, ends and comments."""
    no = F.col("site_no").cast("string")
    star = F.concat(F.lit("# site "), no, F.lit("\nUser-agent: *\nDisallow: /p1\nAllow: /p1"), (F.col("site_no") % 10).cast("string"), F.lit(" # one of them\nDisallow:\nSitemap: https://"), F.col("site"), F.lit("/s.xml\n"))
    more = F.when(F.col("site_no") % 2 == 0, "Disallow: /*9$\n").otherwise("Noindex: /x\n")
    named = F.when(F.col("site_no") % 3 == 2, "User-Agent: bingbot\r\nUser-agent: Google\r\nDisallow: /p2\r\n").otherwise("")
    return view(s, d, "v_site_fetches").select("site", "site_no").distinct().select("site", "site_no", F.concat(star, more, named).alias("body"))


def robots_decisions(s, d):
    """Of each page, by the rules of its own site; and what they come to, as the file itself was answered."""
    at = view(s, d, "v_site_fetches").select("site", "site_no", "url", urls.path(F.col("url")).alias("target"))
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 503, 429)]), (F.col("site_no") % 4 + 1).cast("int"))
    decided = robots.decide(at, robots_files(s, d).select("site", "body"))
    return decided.select("url", "decision", "rule_path", robots.fetched_decision(status, F.col("decision")).alias("fetched"))


def robots_groups(s, d):
    return robots.groups(robots.lines(robots_files(s, d))).select("site", "line", "group")


def robots_sitemaps(s, d):
    return robots.sitemaps(robots.lines(robots_files(s, d))).select("site", "sitemap", "line")


ROBOTS_SQL = with_views("v_site_fetches") + """, f AS (SELECT DISTINCT site, site_no FROM v_site_fetches), t AS (
  SELECT url, site_no, '/' || CASE WHEN n = 0 THEN '' ELSE 'p' || n END AS target FROM v_site_fetches), c AS (
  SELECT *, CASE WHEN site_no % 3 = 2 THEN CASE WHEN target LIKE '/p2%' THEN '/p2' END
    WHEN starts_with(target, '/p1' || site_no % 10) THEN '/p1' || site_no % 10 WHEN target LIKE '/p1%' THEN '/p1' WHEN site_no % 2 = 0 AND target LIKE '%9' THEN '/*9$' END AS rule_path FROM t
), e AS (SELECT url, site_no, CASE WHEN rule_path IS NULL OR (site_no % 3 <> 2 AND length(rule_path) = 4 AND rule_path LIKE '/p1%') THEN 'allowed' ELSE 'disallowed' END AS decision, rule_path FROM c)"""


def sitemap_files(s, d):
    """A sitemap of each site's pages: XML or text, some cut off, with a DOCTYPE, or of another kind."""
    rows = view(s, d, "v_site_fetches").groupBy("site", "site_no").agg(F.array_sort(F.collect_list(F.struct("n", "url"))).alias("p"))  # 40 pages at most
    entry = F.array_join(F.transform("p", lambda x: F.concat(F.lit("<s:url><s:loc> "), x.url, F.lit("?a=1&amp;b=2</s:loc><i:image><i:loc>https://i.example/</i:loc></i:image></s:url>"))), "")
    xml = F.concat(F.when(F.col("site_no") % 5 == 3, "<!DOCTYPE x>").otherwise(""), F.lit('<s:urlset xmlns:s="x" xmlns:i="y">'), entry, F.when(F.col("site_no") % 5 == 2, "<s:url><s:loc>broken").otherwise("</s:urlset>"))
    text = F.concat(F.lit("# text\nnot a url\n"), F.array_join(F.transform("p", lambda x: x.url), "\n"))
    return rows.select("site", "site_no", F.when(F.col("site_no") % 5 == 1, text).when(F.col("site_no") % 5 == 4, "<rss><channel/></rss>").otherwise(xml).alias("body"))


def parsed_sitemaps(s, d):
    m = F.col("m")
    rows = sitemap_files(s, d).select("site", sitemaps.parse_sitemap(F.col("body"), 25).alias("m"))
    return rows.select("site", m.format.alias("format"), m.kind.alias("kind"), m.total_entries.alias("total"), m.retained_entries.alias("retained"), m.truncated.alias("truncated"), (F.size(m.errors) > 0).alias("has_errors"),
                       F.get(F.transform(m.urls, lambda e: e["loc"]), F.lit(0)).alias("first"))


SITEMAPS_SQL = with_views("v_site_fetches") + """, c AS (SELECT site, site_no, count(*) AS n FROM v_site_fetches GROUP BY 1, 2)
  SELECT site, CASE WHEN site_no % 5 = 1 THEN 'text' ELSE 'xml' END AS format, CASE WHEN site_no % 5 = 4 THEN 'unsupported' ELSE 'urlset' END AS kind, CASE WHEN site_no % 5 = 4 THEN 0 ELSE n END AS total,
  CASE WHEN site_no % 5 = 4 THEN 0 ELSE least(n, 25) END AS retained, site_no % 5 <> 4 AND n > 25 AS truncated, site_no % 5 <> 0 AS has_errors,
  CASE WHEN site_no % 5 = 4 THEN NULL WHEN site_no % 5 = 1 THEN 'https://' || site || '/' ELSE 'https://' || site || '/?a=1&b=2' END AS first FROM c"""


def sitemap_documents(s, d):
    """Documents reached from each site's index: children in its folder, in their order, each once, to a cap of 20; and their children."""
    rows = view(s, d, "v_site_fetches").select("site", "n")
    at = lambda path: F.concat(F.lit("https://"), F.col("site"), F.lit(path))
    number = F.col("n").cast("string")
    roots = rows.select("site", at("/m/index.xml").alias("url"), F.lit(1).alias("ordinal")).distinct()
    first = rows.select("site", at("/m/index.xml").alias("url"), F.when(F.col("n") % 3 == 1, F.concat(at("/other/"), number)).otherwise(F.concat(at("/m/c"), (F.col("n") % 36).cast("string"), F.lit("/i.xml"))).alias("child"), F.col("n").alias("position"))
    deep = rows.where("n < 2").select("site", F.concat(at("/m/c"), number, F.lit("/i.xml")).alias("url"), F.concat(at("/m/c"), number, F.lit("/deep.xml")).alias("child"), F.lit(1).alias("position"))
    return crawl.sitemap_tree(roots, first.unionByName(deep)).select("site", "url", "ordinal", "depth")


SITEMAP_TREE_SQL = with_views("v_site_fetches") + """, k AS (SELECT site, n % 36 AS c, min(n) AS position FROM v_site_fetches WHERE n % 3 <> 1 GROUP BY 1, 2), o AS (
  SELECT site, 'https://' || site || '/m/index.xml' AS url, 1 AS ordinal, 0 AS depth FROM v_site_fetches GROUP BY 1
  UNION ALL SELECT site, 'https://' || site || '/m/c' || c || '/i.xml', 1 + row_number() OVER (PARTITION BY site ORDER BY position), 1 FROM k
  UNION ALL SELECT k.site, 'https://' || k.site || '/m/c0/deep.xml', 2 + (SELECT count(*) FROM k j WHERE j.site = k.site), 2 FROM k WHERE c = 0
) SELECT site, url, ordinal::BIGINT AS ordinal, depth FROM o WHERE ordinal <= 20"""


def graph(s, d, limit=500):
    """Discovery over v_edges: pages are URLs by number."""
    url = lambda site, n: F.concat(F.lit("https://s"), F.col(site).cast("string"), F.lit(".example/p"), F.col(n).cast("string"))
    e = view(s, d, "v_edges")
    edges = e.select(F.col("site").cast("string").alias("site"), url("site", "src").alias("page"), "position", url("site", "dst").alias("url"))
    seeds = e.select(F.col("site").cast("string").alias("site"), F.concat(F.lit("https://s"), F.col("site").cast("string"), F.lit(".example/p0")).alias("url")).distinct()
    empty = s.createDataFrame([], "site string, ordinal long, url string, lastmod string")
    return crawl.discover(seeds, empty, edges, limit)


GRAPH_SQL = "WITH RECURSIVE " + with_views("v_edges")[5:] + """, reach(site, n, depth) AS (
  SELECT DISTINCT site, 0::BIGINT, 0 FROM v_edges UNION SELECT e.site, e.dst::BIGINT, depth + 1 FROM reach r JOIN v_edges e ON e.site = r.site AND e.src = r.n WHERE depth < 45
) SELECT site::VARCHAR AS site, 'https://s' || site || '.example/p' || n AS url, min(depth)::INT AS depth FROM reach GROUP BY site, n"""

def capped(s, d):
    """Roots that link to eight spellings of each path, and sitemaps that list some of them first: five of a path count, ten are audited."""
    rows = view(s, d, "v_site_fetches").select("site", "n")
    root = F.concat(F.lit("https://"), "site", F.lit("/"))
    spelled = F.concat(root, F.lit("x"), (F.col("n") / 8).cast("int").cast("string"), F.lit("?v="), (F.col("n") % 8).cast("string"))
    seeds = rows.select("site", root.alias("url")).distinct()
    listed = rows.where("n % 10 = 9").select("site", F.col("n").cast("long").alias("ordinal"), spelled.alias("url"), F.lit("2024-01-01").alias("lastmod"))
    links = rows.select("site", root.alias("page"), F.col("n").alias("position"), spelled.alias("url"))
    return crawl.discover(seeds, listed, links, 10).select("site", "url", "ordinal", "depth", "source", F.concat_ws(",", "sources").alias("sources"), "lastmod", "audited")


CAPPED_SQL = with_views("v_site_fetches") + """, x AS (SELECT site, n, n // 8 AS p, 'https://' || site || '/x' || n // 8 || '?v=' || n % 8 AS url, n % 10 = 9 AS listed FROM v_site_fetches),
  k AS (SELECT *, row_number() OVER (PARTITION BY site, p ORDER BY listed DESC, n) AS nth FROM x), o AS (SELECT *, 1 + row_number() OVER (PARTITION BY site ORDER BY listed DESC, n) AS ordinal FROM k WHERE nth <= 5)
  SELECT site, url, ordinal, CASE WHEN listed THEN 0 ELSE 1 END AS depth, CASE WHEN listed THEN 'sitemap' ELSE 'link' END AS source, CASE WHEN listed THEN 'link,sitemap' ELSE 'link' END AS sources, CASE WHEN listed THEN '2024-01-01' END AS lastmod, ordinal <= 10 AS audited FROM o
  UNION ALL SELECT DISTINCT site, 'https://' || site || '/', 1, 0, 'seed', 'seed', NULL, true FROM v_site_fetches"""

VARIANTS = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat('HTTP://WWW.S', CAST(site_no AS VARCHAR(9)), '.example/Path/#x') WHEN 2 THEN concat('https://sub.', site, '/x.PDF') WHEN 3 THEN concat('https://u:p@', site, '/') WHEN 4 THEN concat('https://', site, ':8443/')
  WHEN 5 THEN concat('https://', site, '/api/auth/login') WHEN 6 THEN concat('https://', site, ':443/b/?q=', CAST(page_id AS VARCHAR(9)), '#f') ELSE concat('ftp://', site, '/x') END"""


def url_predicates(s, d):
    """Eight kinds of URL, against the root of the page's site."""
    u, seed = F.col("variant"), F.concat(F.lit("https://"), "site", F.lit("/"))
    rows = view(s, d, "v_site_fetches").select("page_id", "site", F.expr(VARIANTS.replace("VARCHAR(9)", "STRING")).alias("variant"))
    return rows.select(
        "page_id", "variant", urls.document_url(u).alias("document"), urls.page_key(u).alias("page_key"), urls.in_scope(u, seed).alias("in_scope"), urls.is_page(u, seed).alias("is_page"),
        urls.property_covers(F.concat(F.lit("sc-domain:"), "site"), u).alias("domain_covers"), urls.property_covers(seed, u).alias("prefix_covers"), urls.same_boundary(u, seed).alias("same_boundary"), urls.normalize_url(u).alias("normalized"),
    )


URLS_SQL = with_views("v_site_fetches") + f""", v AS (SELECT page_id, page_id % 8 AS k, site, n, url, {VARIANTS} AS variant FROM v_site_fetches)
  SELECT page_id, variant, CASE k WHEN 0 THEN url WHEN 1 THEN 'http://www.' || site || '/Path/' WHEN 6 THEN 'https://' || site || '/b/?q=' || page_id ELSE variant END AS document,
  CASE k WHEN 0 THEN site || '/' || CASE WHEN n = 0 THEN '' ELSE 'p' || n END WHEN 1 THEN 'www.' || site || '/Path' WHEN 2 THEN 'sub.' || site || '/x.PDF' WHEN 5 THEN site || '/api/auth/login' WHEN 6 THEN site || '/b' WHEN 7 THEN site || '/x' ELSE site || '/' END AS page_key,
  k IN (0, 1, 5, 6) AS in_scope, k NOT IN (2, 5) AS is_page, true AS domain_covers, k IN (0, 5, 6) AS prefix_covers, k NOT IN (2, 7) AS same_boundary,
  CASE k WHEN 0 THEN url WHEN 1 THEN 'http://www.' || site || '/Path/' WHEN 2 THEN 'https://sub.' || site || '/x.PDF' WHEN 5 THEN variant WHEN 6 THEN 'https://' || site || '/b/?q=' || page_id END AS normalized FROM v"""

ADDRESS = "concat(CAST(user_id % 256 AS VARCHAR(9)), '.', CAST(event_id % 257 AS VARCHAR(9)), '.', CAST(event_id % 3 AS VARCHAR(9)), '.9')"


def public_addresses(s, d):
    """Addresses of all requests, as they are and mapped into IPv6."""
    plain = view(s, d, "v_requests").select(F.expr(ADDRESS.replace("VARCHAR(9)", "STRING")).alias("a"))
    rows = plain.select(F.explode(F.array("a", F.concat(F.lit("::ffff:"), "a"), F.concat(F.lit("2606:4700::"), F.replace("a", F.lit("."), F.lit(":"))))).alias("address")).distinct()
    return rows.select("address", urls.is_public_address(F.col("address")).alias("public"))


ADDRESSES_SQL = with_views("v_requests") + f""", a AS (SELECT DISTINCT user_id % 256 AS x, event_id % 257 AS y, event_id % 3 AS z, {ADDRESS} AS a FROM v_requests), j AS (
  SELECT a, y < 256 AND x < 224 AND NOT (x IN (0, 10, 127) OR (x = 100 AND y BETWEEN 64 AND 127) OR (x = 169 AND y = 254) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND y IN (0, 2, 88, 168)) OR (x = 198 AND y IN (18, 19, 51)) OR (x = 203 AND y = 0)) AS public FROM a)
  SELECT a AS address, public FROM j UNION SELECT '::ffff:' || a, public FROM j UNION SELECT '2606:4700::' || replace(a, '.', ':'), true FROM j"""


def domains(s, d):
    """Facts of real URLs."""
    u = F.col("url")
    return view(s, d, "v_fetches").select("page_id", F.col("requested_url").alias("url")).select("page_id", urls.scheme(u).alias("scheme"), urls.boundary_host(urls.host(u)).alias("host"), urls.path(u).alias("path"), urls.document_url(u).alias("document"), urls.page_key(u).alias("page_key"))


def site_pages(s, d):
    """Audited pages of each site of v_site_fetches, in page order. Of failed ones there are neither facts nor a final URL."""
    rows = view(s, d, "v_site_fetches")
    facts = F.when(~F.col("failed"), html_facts.html_facts(F.col("html"), F.col("url")))
    sources = F.array_compact(F.array(F.when(F.col("linked"), "link"), F.when(F.col("listed"), "sitemap")))
    hop = F.array(F.struct(F.lit("https://from.example/").alias("url"), F.lit(301).alias("status"), F.col("url").alias("location")))
    return rows.select(
        "site", "site_no", "url", F.col("page_id").alias("ordinal"), sources.alias("sources"), F.when(~F.col("failed"), F.col("url")).alias("final_url"), "status", F.when(F.col("redirected") & ~F.col("failed"), hop).otherwise(F.slice(hop, 1, 0)).alias("redirects"),
        F.when((F.col("x_robots") != "") & ~F.col("failed"), F.array("x_robots")).otherwise(F.array().cast("array<string>")).alias("x_robots_tag"), facts.alias("facts"), F.when(F.col("failed"), "timeout").alias("error"), "page_id",
    )


def site_rules(s, d):
    """All rules; every fifth site's sitemaps and every seventh's crawl are incomplete, and every third has bad sitemaps."""
    rows, no = view(s, d, "v_site_fetches"), F.col("site_no")
    bad = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.concat(F.lit("ev_sitemap_"), i.cast("string"), F.lit("_"), "site"))
    sites = rows.select("site", "site_no").distinct().select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("root"), (no % 5 != 4).alias("sitemap_complete"), F.when(no % 8 == 7, 0).otherwise(1).alias("valid_sitemaps"), (no % 7 != 6).alias("crawl_complete"),
                                                           F.when(no % 3 == 0, bad).otherwise(F.slice(bad, 1, 0)).alias("bad_sitemaps"))
    return crawl.site_findings(site_pages(s, d), sites).withColumn("evidence_refs", F.concat_ws(",", "evidence_refs"))


_REF = "'ev_crawl_page_' || substr(sha256(url), 1, 16)"
SITE_SQL = with_views("v_site_fetches") + f""", p AS (
  SELECT *, {_REF} AS ref, 'https://' || site || '/' AS root, CASE WHEN NOT failed THEN trim(CASE WHEN page_id % 5 = 1 THEN 'Again' ELSE replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \n\t]+', ' ', 'g'), '&amp;', '&') END) END AS title FROM v_site_fetches
), t AS (SELECT site, lower(title) AS k, arg_min(title, page_id) AS title FROM p WHERE title <> '' GROUP BY ALL HAVING count(*) >= 2), l AS (
  SELECT site, page_id, ref, 0 AS position, (page_id * 3 + 1) % 40 AS target FROM p WHERE NOT failed UNION ALL SELECT site, page_id, ref, 1, (page_id + 2) % 40 FROM p WHERE NOT failed
), b AS (SELECT l.site, l.page_id, position, l.ref, q.ref AS target_ref FROM l JOIN p q ON q.site = l.site AND q.n = l.target AND q.n > 0 AND q.status >= 400), e AS (
  SELECT site, ref, min(struct_pack(a := page_id, b := position, c := side)) AS place FROM (SELECT site, page_id, position, 0 AS side, ref FROM b UNION ALL SELECT site, page_id, position, 1, target_ref FROM b) GROUP BY 1, 2
), f AS (
  SELECT site, 'PAGE_FETCH_FAILED_V1:' || url AS rule_id, 'high' AS severity, 40 AS cap, struct_pack(a := page_id, b := 0, c := 0) AS place, ref FROM p WHERE failed
  UNION ALL SELECT site, 'SITEMAP_URL_NOINDEX_CONFLICT_V1', 'high', 40, struct_pack(a := page_id, b := 0, c := 0), ref FROM p WHERE listed AND NOT failed AND x_robots <> ''
  UNION ALL SELECT site, 'SITEMAP_CANONICAL_TARGET_CONFLICT_V1', 'medium', 40, struct_pack(a := page_id, b := 0, c := 0), ref FROM p WHERE listed AND NOT failed AND page_id % 6 = 0 AND n <> 2
  UNION ALL SELECT site, 'SITEMAP_URL_REDIRECTS_V1', 'low', 40, struct_pack(a := page_id, b := 0, c := 0), ref FROM p WHERE listed AND redirected AND NOT failed
  UNION ALL SELECT p.site, 'DUPLICATE_TITLE_IN_AUDITED_SET_V1:' || t.title, 'low', 20, struct_pack(a := page_id, b := 0, c := 0), ref FROM p JOIN t ON t.site = p.site AND t.k = lower(p.title)
  UNION ALL SELECT site, 'AUDITED_INTERNAL_LINK_TARGET_ERROR_V1', 'high', 40, place, ref FROM e
  UNION ALL SELECT site, 'NOT_OBSERVED_IN_COMPLETE_SITEMAP_SET_V1', 'low', 40, struct_pack(a := page_id, b := 0, c := 0), ref FROM p WHERE site_no % 5 <> 4 AND site_no % 8 <> 7 AND linked AND NOT listed AND n > 0
  UNION ALL SELECT site, 'UNLINKED_IN_COMPLETE_STATIC_CRAWL_V1', 'medium', 40, struct_pack(a := page_id, b := 0, c := 0), ref FROM p WHERE site_no % 7 <> 6 AND n > 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.site = p.site AND l.target = p.n)
), g AS (SELECT site, rule_id, severity, count(*) AS pages, list(ref ORDER BY place)[1:any_value(cap)] AS refs FROM f GROUP BY 1, 2, 3
  UNION ALL SELECT DISTINCT site, 'SITEMAP_FETCH_OR_PARSE_INCOMPLETE_V1', 'medium', 2::BIGINT, ['ev_sitemap_1_' || site, 'ev_sitemap_2_' || site] FROM p WHERE site_no % 3 = 0)
SELECT site, rule_id, severity, pages, 'finding_' || substr(sha256('https://' || site || chr(0) || rule_id || chr(0) || array_to_string(refs, chr(0))), 1, 16) AS finding_id, array_to_string(refs, ',') AS evidence_refs FROM g"""


def unlinked_pages(s, d):
    """Pages that no audited page links to, and how many links each of the others has (J6, A19), from the pages' own links."""
    pages = site_pages(s, d)
    links = pages.select("site", F.explode("facts.links").alias("l")).select("site", F.col("l.resolved_url").alias("url"))
    return crawl.incoming_links(pages, links)


TOKENS = """CASE page_id % 5 WHEN 0 THEN 'NoIndex, follow' WHEN 1 THEN 'none' WHEN 2 THEN concat('a  b,a', CAST(page_id AS VARCHAR(9))) WHEN 3 THEN '' ELSE concat(' MAX-snippet:', CAST(page_id AS VARCHAR(9)), ',') END"""


def directive_tokens(s, d):
    rows = view(s, d, "v_fetches").select("page_id", F.expr(TOKENS.replace("VARCHAR(9)", "STRING")).alias("v"))
    return rows.select("page_id", F.concat_ws("|", html_facts.directive_tokens(F.col("v"))).alias("tokens"))


QUERIES = {
    "s12_w6_robots_groups": robots_groups,
    "f18_f19_robots_decisions": robots_decisions,
    "s13_sitemaps": parsed_sitemaps,
    "s14_html_facts": html_summary,
    "f1_f6_p7_p8_p12_p13_url_predicates": url_predicates,
    "f1_f3_f6_page_urls": domains,
    "p14_public_addresses": public_addresses,
    "f7_directive_tokens": directive_tokens,
    "f20_a16_structured_data": structured,
    "f21_content_hash": content_hashes,
    "a15_heading_counts": heading_counts,
    "a17_link_counts": links,
    "r_page_findings": found,
    "a13_severity_counts": lambda s, d: page_rules.severity_counts(found(s, d), "rule_id"),
    "a14_status_classes": lambda s, d: crawl.status_classes(view(s, d, "v_fetches")),
    "st1_st2_w7_crawl_discovery": lambda s, d: graph(s, d).select("site", "url", "depth"),
    "st2_w7_crawl_caps": capped,
    "st3_sitemap_tree": sitemap_documents,
    "s12_robots_sitemaps": robots_sitemaps,
    "r_site_findings": site_rules,
    "a18_duplicate_titles": lambda s, d: site_rules(s, d).where("rule_id LIKE 'DUPLICATE%'"),
    "a19_j6_incoming_links": lambda s, d: crawl.incoming_links(graph(s, d).select("site", "url", F.col("url").alias("final_url")), _numbered_links(s, d)),
    "j6_links_of_pages": unlinked_pages,
}


def _numbered_links(s, d):
    e = view(s, d, "v_edges")
    return e.select(F.col("site").cast("string").alias("site"), F.concat(F.lit("https://s"), F.col("site").cast("string"), F.lit(".example/p"), F.col("dst").cast("string")).alias("url"))


ORACLES = {
    "s12_w6_robots_groups": ROBOTS_SQL + """ SELECT site, unnest(CASE WHEN site_no % 2 = 0 THEN CASE WHEN site_no % 3 = 2 THEN [2, 3, 4, 7, 8, 9, 10] ELSE [2, 3, 4, 7] END ELSE CASE WHEN site_no % 3 = 2 THEN [2, 3, 4, 8, 9, 10] ELSE [2, 3, 4] END END) AS line,
  unnest(CASE WHEN site_no % 2 = 0 THEN CASE WHEN site_no % 3 = 2 THEN [1, 1, 1, 1, 2, 2, 2] ELSE [1, 1, 1, 1] END ELSE CASE WHEN site_no % 3 = 2 THEN [1, 1, 1, 2, 2, 2] ELSE [1, 1, 1] END END)::BIGINT AS "group" FROM f""",
    "s12_robots_sitemaps": ROBOTS_SQL + " SELECT site, 'https://' || site || '/s.xml' AS sitemap, 6 AS line FROM f",
    "f1_f6_p7_p8_p12_p13_url_predicates": URLS_SQL,
    "st2_w7_crawl_caps": CAPPED_SQL,
    "st3_sitemap_tree": SITEMAP_TREE_SQL,
    "j6_links_of_pages": with_views("v_site_fetches") + """, l AS (SELECT site_no, (page_id * 3 + 1) % 40 AS target FROM v_site_fetches WHERE NOT failed UNION ALL SELECT site_no, (page_id + 2) % 40 FROM v_site_fetches WHERE NOT failed)
  SELECT site, url, count(l.target) AS incoming FROM v_site_fetches p LEFT JOIN l ON l.site_no = p.site_no AND l.target = p.n AND p.n > 0 GROUP BY 1, 2""",
    "a17_link_counts": with_views("v_fetches") + """, a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM v_fetches) SELECT page_id, len(hrefs)::BIGINT AS links_total, len(list_distinct(list_filter(hrefs, lambda h: h LIKE '/%')))::BIGINT AS unique_internal,
  len(list_distinct(list_filter(hrefs, lambda h: h LIKE 'http%')))::BIGINT AS unique_external, 0::BIGINT AS links_nofollow, len(hrefs) > 500 AS links_truncated FROM a""",
    "a18_duplicate_titles": SITE_SQL + " WHERE rule_id LIKE 'DUPLICATE%'",
    "f18_f19_robots_decisions": ROBOTS_SQL + """ SELECT url, decision, rule_path, CASE site_no % 4 WHEN 0 THEN decision WHEN 1 THEN 'allowed' ELSE 'unknown' END AS fetched FROM e""",
    "s13_sitemaps": SITEMAPS_SQL,
    "p14_public_addresses": ADDRESSES_SQL,
    "f7_directive_tokens": with_views("v_fetches") + " SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'noindex|follow' WHEN 1 THEN 'none|noindex|nofollow' WHEN 2 THEN concat_ws('|', 'a', 'b', 'a' || page_id) WHEN 3 THEN '' ELSE 'max-snippet:' || page_id END AS tokens FROM v_fetches",
    "f1_f3_f6_page_urls": with_views("v_fetches") + r""" SELECT page_id, regexp_extract(requested_url, '^(https?)://', 1) AS scheme, regexp_replace(regexp_extract(requested_url, '^https?://([^/?#]+)', 1), '^www\.', '') AS host,
  CASE WHEN regexp_extract(requested_url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(requested_url, '^https?://[^/?#]+([^?#]*)', 1) END AS path, split_part(requested_url, '#', 1) AS document,
  regexp_extract(requested_url, '^https?://([^/?#]+)', 1) || CASE WHEN regexp_replace(regexp_extract(requested_url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(requested_url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') END AS page_key FROM v_fetches""",
    "s14_html_facts": with_views("v_fetches") + """ SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang, ((len(html) - len(replace(html, '<title>', ''))) // 7)::INT AS titles, len(regexp_extract_all(html, '<a[ >]')) AS links_total, len(regexp_extract_all(html, '<h1[ >]'))::INT AS h1,
  CASE page_id % 8 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS canonicals, CASE WHEN page_id % 5 = 0 THEN 'noindex,follow' ELSE '' END AS robots FROM v_fetches""",
    "f20_a16_structured_data": with_views("v_fetches") + " SELECT page_id, (page_id % 6 = 2)::BIGINT AS valid_blocks, (page_id % 6 = 1)::BIGINT AS invalid_blocks, CASE WHEN page_id % 6 = 2 THEN 'Article,Person' ELSE '' END AS types FROM v_fetches",
    "f21_content_hash": with_views("v_fetches") + " SELECT page_id, true AS script_ignored, html LIKE '%<h1>%' AS heading_seen FROM v_fetches",
    "a15_heading_counts": with_views("v_fetches") + " SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<h{n}[ >]'))::BIGINT AS h{n}" for n in range(1, 7)) + " FROM v_fetches",
    "r_page_findings": FINDINGS_SQL + " SELECT * FROM found",
    "a13_severity_counts": FINDINGS_SQL + " SELECT rule_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in SEVERITIES) + " FROM found GROUP BY 1",
    "a14_status_classes": with_views("v_fetches") + """ SELECT count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS success_2xx, count(*) FILTER (WHERE status BETWEEN 300 AND 399) AS redirect_3xx, count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_error_4xx,
  count(*) FILTER (WHERE status >= 500) AS server_error_5xx, count(*) FILTER (WHERE status IS NULL) AS unavailable FROM v_fetches""",
    "st1_st2_w7_crawl_discovery": GRAPH_SQL,
    "r_site_findings": SITE_SQL,
    "a19_j6_incoming_links": GRAPH_SQL.rpartition(" SELECT site::VARCHAR")[0] + """, pages AS (SELECT DISTINCT site, n FROM reach) SELECT p.site::VARCHAR AS site, 'https://s' || p.site || '.example/p' || n AS url, count(e.dst) AS incoming
  FROM pages p LEFT JOIN v_edges e ON e.site = p.site AND e.dst = p.n GROUP BY 1, 2""",
}
