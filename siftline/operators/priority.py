"""One order for technical findings and search opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.urls import same_boundary

# Rule categories, the first match counts; scores; what a focus takes in; caps.
CATEGORIES = [
    ("structured-data", "JSON_LD|STRUCTURED"),
    ("internal-links", "LINK|UNLINKED"),
    ("canonical", "CANONICAL"),
    ("sitemap", "SITEMAP"),
    ("metadata", "TITLE|DESCRIPTION|HEADING"),
    ("access-indexing", "ROBOTS|NOINDEX|HTTP|REDIRECT|HTTPS|HTML_NOT_OBSERVED"),
]
TECHNICAL_SCORE = {"critical": 0, "high": 1, "medium": 3, "low": 5, "info": 7}
SEARCH_SCORE = {"high": 2, "medium": 4, "low": 6}
INDEXING = ["access-indexing", "canonical", "sitemap"]
TOP, MAX_TOP, URLS, PAGES, MAX_PAGES = 10, 100, 10, 5, 20


def category(rule_id: Column) -> Column:
    out = None
    for name, pattern in CATEGORIES:
        hit = rule_id.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def score(source: Column, priority: Column) -> Column:
    of = lambda scores: F.element_at(F.create_map(*[F.lit(x) for pair in scores.items() for x in pair]), priority)
    return F.when(source == "technical", of(TECHNICAL_SCORE)).otherwise(of(SEARCH_SCORE))


def candidates(technical: DataFrame, search: DataFrame) -> DataFrame:
    """technical: site, finding_id, rule_id, severity, urls. search: site, finding_id, priority, impressions, urls. First id wins."""
    both = technical.select("site", "finding_id", F.lit("technical").alias("source"), category(F.col("rule_id")).alias("category"), F.col("severity").alias("priority"), F.lit(0.0).alias("impressions"), "urls", F.lit(0).alias("_from")).unionByName(
        search.select("site", "finding_id", F.lit("google-opportunity").alias("source"), F.lit("search-performance").alias("category"), "priority", "impressions", "urls", F.lit(1).alias("_from"))
    )
    # findings are few and narrow; of one id, the technical one comes first
    kept = both.groupBy("site", "finding_id").agg(F.min_by(F.struct(*[c for c in both.columns if c not in ("site", "finding_id", "_from")]), "_from").alias("_row"))
    return kept.select("site", "finding_id", "_row.*")


def within_focus(found: DataFrame, focus: str = "all") -> DataFrame:
    if focus == "all":
        return found
    return found.where(F.col("category").isin(INDEXING) if focus == "indexing" else F.col("category") == focus)


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each site: by score, impressions, id. URLs beyond ten are only counted."""
    if not isinstance(top, int) or isinstance(top, bool) or not 1 <= top <= MAX_TOP:
        raise ValueError(f"top must be a whole number from 1 to {MAX_TOP}")
    order = Window.partitionBy("site").orderBy(score(F.col("source"), F.col("priority")), F.desc("impressions"), "finding_id")
    # a rank filter over row_number is cut to the first rows before the shuffle
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    urls = F.array_distinct("urls")
    return first.withColumns({"additional_urls": F.greatest(F.size(urls) - URLS, F.lit(0)), "urls": F.slice(urls, 1, URLS)})


def scoped(found: DataFrame, url: Column) -> DataFrame:
    """Findings all of whose URLs lie within the URL's boundary; those without a URL don't count."""
    return found.where((F.size("urls") > 0) & F.forall("urls", lambda u: same_boundary(u, url)))


def priority_pages(found: DataFrame, limit: int = PAGES) -> DataFrame:
    """Page findings (page, priority, impressions, finding_id) -> the first pages by priority, impressions and page, with their findings."""
    if not 1 <= limit <= MAX_PAGES:
        raise ValueError(f"limit must be from 1 to {MAX_PAGES}")
    place = F.struct(F.element_at(F.create_map(*[F.lit(x) for pair in (("high", 0), ("medium", 1), ("low", 2)) for x in pair]), F.col("priority")).alias("p"), (-F.col("impressions")).alias("i"), F.col("page"))
    pages = found.where("page RLIKE '(?i)^https?://'").groupBy("page").agg(F.min(place).alias("place"), F.array_sort(F.collect_list("finding_id")).alias("finding_refs"))
    first = pages.orderBy("place").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("place")).alias("rank"), "page", "finding_refs")


def findings_of_pages(findings: DataFrame) -> DataFrame:
    """finding_id, evidence_refs -> each evidence id with the findings that cite it."""
    return findings.select("finding_id", F.explode(F.array_distinct("evidence_refs")).alias("ref")).groupBy("ref").agg(F.array_sort(F.collect_list("finding_id")).alias("finding_refs"))


def first_recommendation(findings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Each finding with the first recommendation (by ordinal) that refers to it."""
    refs = recommendations.select("ordinal", "action", F.explode("finding_refs").alias("finding_id"))
    first = refs.groupBy("finding_id").agg(F.min_by("action", "ordinal").alias("action"))
    return findings.join(first, "finding_id", "left")


def details(findings: DataFrame, prioritized: DataFrame) -> DataFrame:
    """Each finding with its place in the order, or nulls if it isn't among the first."""
    place = prioritized.select("site", "finding_id", "rank", "category", "priority", "impressions", score(F.col("source"), F.col("priority")).alias("score"))
    return findings.join(place, ["site", "finding_id"], "left")
