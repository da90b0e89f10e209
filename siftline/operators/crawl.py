"""Bounded breadth-first discovery over stored fetches, for many sites at once, and rules on whole sites.

Discovery order of a site: the seed, then sitemap entries in their order, then links level by level, by their page's place and
their own. The first ``limit`` pages are audited, and only their links count. Each level is a few joins over all sites; its
result is checkpointed, and the loop ends with the deepest site.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.shared import checkpointed
from siftline.functions.urls import document_url, in_scope, is_page, origin, path
from siftline.operators.page_rules import fingerprint

# Caps on discovery.
LIMIT, MAX_LIMIT, PER_PATH, LEAST_DISCOVERED, MOST_DISCOVERED, PER_PAGE = 25, 500, 5, 1000, 10_000, 20
REFS, TITLE_REFS = 40, 20


def most_discovered(limit: int) -> int:
    return min(MOST_DISCOVERED, max(LEAST_DISCOVERED, limit * PER_PAGE))


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return value


def _numbered(new: DataFrame, have: DataFrame | None, cap: int) -> DataFrame:
    """New URLs with their order key -> those within the caps, numbered after what the site has."""
    key = F.concat(origin(F.col("url")), path(F.col("url")))
    new = new.withColumn("path_key", key)
    if have is not None:
        new = new.join(have.select("site", "url"), ["site", "url"], "left_anti")
        counts = have.groupBy("site", "path_key").agg(F.count("*").alias("on_path"))
        sizes = have.groupBy("site").agg(F.max("ordinal").alias("before"))
        new = new.join(counts, ["site", "path_key"], "left").join(sizes, "site", "left")
    else:
        new = new.withColumns({"on_path": F.lit(0), "before": F.lit(0)})
    # each rank is cut to the cap itself first, a filter that Spark applies before the shuffle, and then to what the site has left
    within = Window.partitionBy("site", "path_key").orderBy("at")
    ranked = new.withColumn("_nth", F.row_number().over(within)).where(F.col("_nth") <= PER_PATH).where(F.col("_nth") + F.coalesce("on_path", F.lit(0)) <= PER_PATH)
    number = ranked.withColumn("_number", F.row_number().over(Window.partitionBy("site").orderBy("at"))).where(F.col("_number") <= cap)
    return number.withColumn("ordinal", (F.col("_number") + F.coalesce("before", F.lit(0))).cast("long")).where(F.col("ordinal") <= cap).select("site", "url", "path_key", "source", "lastmod", "ordinal", "at")


def discover(seeds: DataFrame, sitemap_entries: DataFrame, links: DataFrame, limit: int = LIMIT) -> DataFrame:
    """seeds: site, url. sitemap_entries: site, ordinal, url, lastmod. links: site, page, position, url (internal links).

    -> site, url, ordinal, depth, first source, all sources, lastmod, audited.
    """
    cap = most_discovered(bounded(limit, 1, MAX_LIMIT, "limit"))
    root = seeds.select("site", F.col("url").alias("seed"))

    def scoped(rows: DataFrame) -> DataFrame:
        return rows.join(root, "site").where(in_scope(F.col("url"), F.col("seed")) & is_page(F.col("url"), F.col("seed"))).withColumn("url", document_url(F.col("url"))).drop("seed")

    first = seeds.select("site", document_url(F.col("url")).alias("url"), F.lit("seed").alias("source"), F.lit(None).cast("string").alias("lastmod"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"))
    listed = scoped(sitemap_entries.select("site", "ordinal", "url", "lastmod"))
    listed = listed.select("site", "url", F.lit("sitemap").alias("source"), "lastmod", F.struct(F.lit(1).cast("long").alias("a"), F.col("ordinal").cast("long").alias("b")).alias("at"))
    both = first.unionByName(listed).groupBy("site", "url").agg(F.min_by("source", "at").alias("source"), F.min_by("lastmod", F.when(F.col("lastmod").isNotNull(), F.col("at"))).alias("lastmod"), F.min("at").alias("at"))
    have = checkpointed(_numbered(both, None, cap).withColumn("depth", F.lit(0)))
    inner = checkpointed(scoped(links.select("site", "page", "position", "url")).select("site", document_url(F.col("page")).alias("page"), "position", "url"))
    level, depth = have, 0
    while level.agg(F.min("ordinal") <= limit).first()[0]:
        depth += 1
        pages = level.where(F.col("ordinal") <= limit).select("site", F.col("url").alias("page"), F.col("ordinal").alias("parent"))
        found = inner.join(pages, ["site", "page"]).groupBy("site", "url").agg(F.min(F.struct(F.col("parent").alias("a"), F.col("position").cast("long").alias("b"))).alias("at"))
        found = found.withColumns({"source": F.lit("link"), "lastmod": F.lit(None).cast("string")})
        level = checkpointed(_numbered(found, have, cap).withColumn("depth", F.lit(depth)))
        have = have.unionByName(level)
    audited = have.withColumn("audited", F.col("ordinal") <= limit)
    linked = inner.join(audited.where("audited").select("site", F.col("url").alias("page")), ["site", "page"], "left_semi").select("site", "url").distinct().withColumn("s", F.lit("link"))
    sources = [audited.where("source = 'seed'").select("site", "url").withColumn("s", F.lit("seed")), listed.select("site", "url").distinct().withColumn("s", F.lit("sitemap")), linked]
    marks = reduce(DataFrame.unionByName, sources).groupBy("site", "url").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    return audited.join(marks, ["site", "url"]).select("site", "url", "ordinal", "depth", "source", "sources", "lastmod", "audited")


def page_evidence_id(url: Column) -> Column:
    return F.concat(F.lit("ev_crawl_page_"), fingerprint(url))


def noindex_observed(facts: Column, x_robots: Column) -> Column:
    """Of meta directives or headers as they stand: neither a prefix nor "none" is taken into account in headers."""
    header = F.exists(F.coalesce(x_robots, F.array().cast("array<string>")), lambda v: F.array_contains(F.split(F.lower(v), r"[,\s]+"), "noindex"))
    return header | F.coalesce(F.exists(facts.meta_robots, lambda m: F.array_contains(m.directives, "noindex")), F.lit(False))


#: Rules on one page: when they find, of the columns of site_pages().
ON_PAGE = {
    "SITEMAP_URL_NOINDEX_CONFLICT_V1": ("high", "listed AND noindex"),
    "SITEMAP_CANONICAL_TARGET_CONFLICT_V1": ("medium", "listed AND conflict"),
    "SITEMAP_URL_REDIRECTS_V1": ("low", "listed AND redirected"),
    "NOT_OBSERVED_IN_COMPLETE_SITEMAP_SET_V1": ("low", "sitemap_complete AND valid_sitemaps > 0 AND linked AND NOT listed AND url <> root"),
}


def site_pages(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """What the rules on sites need of each page, in one narrow row; the facts are read once and go no further.

    links: the targets of the page's internal links, in their order."""
    root = sites.select("site", origin(F.col("root")).alias("origin"), document_url(F.col("root")).alias("root"), "sitemap_complete", "valid_sitemaps", "crawl_complete")
    f, at = F.col("facts"), F.coalesce("final_url", "url")
    targets = F.array_distinct(F.transform(F.filter(f.canonicals, lambda c: (c.location == "head") & c.resolved_url.isNotNull()), lambda c: c.resolved_url))
    title = F.get(F.filter(F.transform(f.titles, lambda t: F.trim(t)), lambda t: t != ""), F.lit(0))
    narrow = pages.join(root, "site").select(
        "site", "origin", "root", "sitemap_complete", "valid_sitemaps", "crawl_complete", "url", F.col("ordinal").cast("long").alias("ordinal"), page_evidence_id(F.col("url")).alias("ref"), at.alias("at"), "status",
        F.array_contains("sources", "sitemap").alias("listed"), F.array_contains("sources", "link").alias("linked"), noindex_observed(f, F.col("x_robots_tag")).alias("noindex"),
        ((F.size(targets) == 1) & (document_url(F.get(targets, F.lit(0))) != document_url(at))).alias("conflict"), (F.size("redirects") > 0).alias("redirected"), F.lower(title).alias("title_key"), F.get(f.titles, F.lit(0)).alias("title"),
        F.col("error").isNotNull().alias("failed"), F.transform(F.filter(f.links, lambda x: (x.kind == "internal") & x.resolved_url.isNotNull()), lambda x: x.resolved_url).alias("links"),
    )
    return checkpointed(narrow)


def _evidence(rows: DataFrame, rule: str, severity: str, group: str | Column = "", text: Column | None = None, *order: Column | str) -> DataFrame:
    """Rows of one rule: its evidence, the group that makes a finding of its own, what follows the rule's name, and the order."""
    group = F.lit(group) if isinstance(group, str) else group
    a, b, c = (*order, *[F.lit(0)] * (3 - len(order))) if order else ("ordinal", F.lit(0), F.lit(0))
    place = F.struct(*[(F.col(x) if isinstance(x, str) else x).cast("long").alias(n) for n, x in (("a", a), ("b", b), ("c", c))])
    return rows.select("site", "origin", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), group.alias("group"), (F.lit("") if text is None else text).alias("text"), "ref", place.alias("place"))


def _cited(rows: DataFrame) -> DataFrame:
    """A finding for each site, rule and group. The first refs of its evidence are found by rank, so no list is longer than what is kept."""
    by = ["site", "origin", "rule", "severity", "group"]
    counted = rows.groupBy(*by).agg(F.count("*").alias("pages"), F.min_by("text", "place").alias("text"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).where(F.col("n") <= REFS)
    first = first.where((F.col("n") <= TITLE_REFS) | ~F.startswith("rule", F.lit("DUPLICATE_TITLE")))
    refs = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ref"))), lambda x: x.ref).alias("evidence_refs"))
    return counted.join(refs, by)


def site_findings(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """pages: site, url, ordinal, sources, final_url, status, redirects, x_robots_tag, facts, error.

    sites: site, root, sitemap_complete, valid_sitemaps, crawl_complete, bad_sitemaps (ordered array of evidence ids).
    Gates are columns of sites; they hold before ids are made.
    """
    base = site_pages(pages, sites)
    on_page = base.select("*", F.inline(F.array_compact(F.array(*[F.when(F.expr(f"coalesce({when}, false)"), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, (severity, when) in ON_PAGE.items()]))))
    on_page = on_page.select("site", "origin", "rule", "severity", F.lit("").alias("group"), F.lit("").alias("text"), "ref", F.struct(F.col("ordinal").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("place"))
    titled = base.where("title_key IS NOT NULL")
    again = titled.groupBy("site", "title_key").agg(F.count("*").alias("n")).where("n >= 2").select("site", "title_key")
    same_title = titled.join(again, ["site", "title_key"])
    edges = base.select("site", "origin", "ordinal", "ref", F.posexplode("links").alias("position", "target"))
    broken = edges.join(base.where("status >= 400").select("site", F.col("at").alias("target"), F.col("ref").alias("target_ref")), ["site", "target"])
    # a page is cited where it is first met, as a source or, right after its source, as a target
    ends = broken.select("site", "origin", "ordinal", F.inline(F.array(F.struct("position", F.lit(0).alias("end"), "ref"), F.struct("position", F.lit(1).alias("end"), F.col("target_ref").alias("ref")))))
    ends = ends.groupBy("site", "origin", "ref").agg(F.min(F.struct("ordinal", "position", "end")).alias("at")).select("site", "origin", "ref", "at.*")
    unlinked = base.where("crawl_complete AND at <> root").join(edges.select("site", F.col("target").alias("at")).distinct(), ["site", "at"], "left_anti")
    rows = [
        on_page, _evidence(base.where("failed"), "PAGE_FETCH_FAILED_V1", "high", F.col("url"), F.concat(F.lit(":"), "url")),
        _evidence(same_title, "DUPLICATE_TITLE_IN_AUDITED_SET_V1", "low", F.col("title_key"), F.concat(F.lit(":"), F.coalesce("title", F.lit("")))),
        _evidence(ends, "AUDITED_INTERNAL_LINK_TARGET_ERROR_V1", "high", "", None, "ordinal", "position", "end"), _evidence(unlinked, "UNLINKED_IN_COMPLETE_STATIC_CRAWL_V1", "medium"),
    ]
    sitemaps = sites.where(F.size("bad_sitemaps") > 0).select(
        "site", origin(F.col("root")).alias("origin"), F.lit("SITEMAP_FETCH_OR_PARSE_INCOMPLETE_V1").alias("rule"), F.lit("medium").alias("severity"), F.lit("").alias("group"), F.size("bad_sitemaps").cast("long").alias("pages"), F.lit("").alias("text"), F.col("bad_sitemaps").alias("evidence_refs"),
    )
    found = _cited(reduce(DataFrame.unionByName, rows)).unionByName(sitemaps)
    rule_id = F.concat("rule", "text")
    fid = F.concat(F.lit("finding_"), fingerprint(F.col("origin"), rule_id, F.array_join("evidence_refs", "\0")))
    return found.select("site", fid.alias("finding_id"), rule_id.alias("rule_id"), "severity", "pages", "evidence_refs")


def status_classes(pages: DataFrame, *by: str) -> DataFrame:
    """Statuses below 200 are in no class."""
    s = F.col("status")
    within = lambda a, b: F.count_if(s.between(a, b))
    return pages.groupBy(*by).agg(within(200, 299).alias("success_2xx"), within(300, 399).alias("redirect_3xx"), within(400, 499).alias("client_error_4xx"), F.count_if(s >= 500).alias("server_error_5xx"), F.count_if(s.isNull()).alias("unavailable"))


def incoming_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links to each audited page, its own among them; 0 if there are none."""
    counts = links.groupBy("site", F.col("url").alias("at")).agg(F.count("*").alias("n"))
    at = F.coalesce("final_url", "url")
    return pages.select("site", at.alias("at")).distinct().join(counts, ["site", "at"], "left").select("site", F.col("at").alias("url"), F.coalesce("n", F.lit(0)).cast("long").alias("incoming"))


def sitemap_tree(roots: DataFrame, children: DataFrame, most: int = 20) -> DataFrame:
    """roots: site, url, ordinal. children: site, url (parent), child, position -> site, url, ordinal, depth of the documents read.

    A child must lie in its parent's directory and within its boundary; each document is read once, the first ``most`` in order.
    """
    seen = roots.select("site", document_url(F.col("url")).alias("url"), F.row_number().over(Window.partitionBy("site").orderBy("ordinal")).cast("long").alias("ordinal"), F.lit(0).alias("depth"))
    seen = checkpointed(seen.where(F.col("ordinal") <= most))
    folder = F.regexp_extract(path(F.col("url")), "^(.*/)", 1)
    inside = children.where(in_scope(F.col("child"), F.col("url")) & F.startswith(path(F.col("child")), folder)).select("site", document_url(F.col("url")).alias("url"), document_url(F.col("child")).alias("child"), "position")
    level, depth = seen, 0
    while level.agg(F.count("*")).first()[0]:
        depth += 1
        new = inside.join(level.select("site", "url", "ordinal"), ["site", "url"]).groupBy("site", F.col("child").alias("url")).agg(F.min(F.struct("ordinal", "position")).alias("at"))
        new = new.join(seen.select("site", "url"), ["site", "url"], "left_anti").join(seen.groupBy("site").agg(F.max("ordinal").alias("before")), "site")
        number = F.row_number().over(Window.partitionBy("site").orderBy("at")) + F.col("before")
        level = checkpointed(new.select("site", "url", number.cast("long").alias("ordinal"), F.lit(depth).alias("depth")).where(F.col("ordinal") <= most))
        seen = seen.unionByName(level)
    return seen
