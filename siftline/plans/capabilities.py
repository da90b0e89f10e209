"""The capabilities a caller can invoke: names, parameters with their bounds, and functions that return named DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.periods import acquisition_periods
from siftline.functions.urls import property_covers
from siftline.operators import acquisition, crawl, page_rules, priority, search
from siftline.operators.html_facts import html_facts


class CapabilityError(ValueError):
    """An expected failure, with a code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def listed_option(value: str | None, fallback: list[str]) -> list[str]:
    """A list given as text: names between commas; "none" is an empty one, and nothing the fallback."""
    if value is None or value == "none":
        return list(fallback) if value is None else []
    names = [x for x in map(str.strip, value.split(",")) if x]
    if not names:
        raise CapabilityError("INVALID_LIST", "a list of names can't be empty")
    return names


@dataclass(frozen=True)
class Parameter:
    default: int | str
    low: int | None = None
    high: int | None = None
    choices: tuple[str, ...] = ()

    def checked(self, name: str, value: object) -> object:
        if value is None:
            return self.default
        if self.choices and value not in self.choices:
            raise CapabilityError("INVALID_PARAMETER", f"{name} must be one of {', '.join(self.choices)}")
        if self.low is not None and (not isinstance(value, int) or isinstance(value, bool) or not self.low <= value <= self.high):
            raise CapabilityError("INVALID_PARAMETER", f"{name} must be a whole number from {self.low} to {self.high}")
        return value


@dataclass(frozen=True)
class Capability:
    name: str
    title: str
    inputs: tuple[str, ...]
    run: Callable[..., dict[str, DataFrame]]
    parameters: dict[str, Parameter] = field(default_factory=dict)

    def __call__(self, inputs: dict[str, DataFrame], **given: object) -> dict[str, DataFrame]:
        if unknown := set(given) - set(self.parameters):
            raise CapabilityError("UNKNOWN_PARAMETER", f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        if missing := [x for x in self.inputs if x not in inputs]:
            raise CapabilityError("MISSING_INPUT", f"{self.name} needs {', '.join(missing)}")
        return self.run(inputs, **{k: p.checked(k, given.get(k)) for k, p in self.parameters.items()})


# Defaults and bounds.
DAYS, MIN_IMPRESSIONS = Parameter(28, 1, 366), Parameter(100, 1, 1_000_000)
LIMIT, TOP, PAGES = Parameter(25, 1, 500), Parameter(10, 1, 100), Parameter(5, 1, 20)
FOCUS = Parameter("all", choices=("all", "indexing", "access-indexing", "canonical", "sitemap", "metadata", "structured-data", "internal-links", "search-performance", "other"))
GOOGLE = Parameter("auto", choices=("auto", "off", "required"))


def _within(rows: DataFrame, period: tuple[date, date]) -> DataFrame:
    return rows.where(F.col("day").between(F.lit(period[0]), F.lit(period[1])))


def _now(inputs: dict) -> date:
    return inputs.get("now") or date.today()


def opportunities(inputs: dict, days: int, min_impressions: int) -> dict[str, DataFrame]:
    """search_rows: day, query, page, clicks, impressions, position. landing_rows: day and the landing metrics (channel_group too)."""
    periods = acquisition_periods(days, _now(inputs))
    current, previous = (search.roll_up(_within(inputs["search_rows"], periods["gsc"][p])) for p in ("current", "previous"))
    landing = _within(inputs["landing_rows"], periods["ga4"]["current"])
    if "channel_group" in landing.columns:
        landing = landing.where(search.string_filter(F.col("channel_group"), "EXACT", "Organic Search"))
    moved = search.movements(current, previous)
    overlap = search.overlaps(current, min_impressions)
    return {
        "page_findings": search.page_findings(search.candidates(current, previous, min_impressions), search.landing_outcomes(landing)), "overlaps": overlap, "overlap_findings": search.overlap_findings(overlap),
        "baseline": search.baseline(current), "winners": search.winners(moved), "losers": search.losers(moved), "previous_only": search.previous_only(current, previous),
    }


def acquisition_report(inputs: dict, days: int) -> dict[str, DataFrame]:
    periods = acquisition_periods(days, _now(inputs))
    both = lambda rows, source: _within(rows, (periods[source]["previous"][0], periods[source]["current"][1])).withColumn("period", F.when(F.col("day") >= F.lit(periods[source]["current"][0]), "current").otherwise("previous"))
    channels, searches = both(inputs["channel_rows"], "ga4"), both(inputs["search_rows"], "gsc")
    totals, now = acquisition.traffic_totals(channels), channels.where("period = 'current'")
    return {
        "traffic": totals, "traffic_change": acquisition.traffic_change(totals), "top_ai_sources": acquisition.top_ai(now, "source", "source"), "top_ai_pages": acquisition.top_ai(now, "landing_page", "page"),
        "search": acquisition.search_totals(searches), "search_opportunities": acquisition.striking_distance(searches.where("period = 'current'")),
    }


def page_audit(inputs: dict) -> dict[str, DataFrame]:
    """fetches: page_id, requested_url, final_url, status, redirects, content_type, x_robots_tag, body, disallowed."""
    pages = inputs["fetches"]
    body = F.when(page_rules.is_html(F.col("content_type")) & ~F.coalesce("disallowed", F.lit(False)), F.col("body"))
    read = pages.withColumn("facts", html_facts(body, F.col("final_url"))).drop("body")
    found = page_rules.findings(read, "page_id")
    return {"pages": read, "findings": found, "counts": page_rules.severity_counts(found, "page_id"), "recommendations": page_rules.recommendations(found)}


def site_crawl(inputs: dict, limit: int) -> dict[str, DataFrame]:
    """fetches with site; seeds: site, url; sitemap_entries: site, ordinal, url, lastmod; sites: gates of the site rules."""
    audit = page_audit(inputs)
    facts = audit["pages"]
    links = facts.select("site", F.col("requested_url").alias("page"), F.posexplode("facts.links").alias("position", "l")).where("l.kind = 'internal'").select("site", "page", "position", F.col("l.resolved_url").alias("url"))
    found = crawl.discover(inputs["seeds"], inputs["sitemap_entries"], links, limit)
    audited = found.where("audited").join(facts.withColumn("url", crawl.document_url(F.col("requested_url"))), ["site", "url"], "left")
    if "error" not in audited.columns:
        audited = audited.withColumn("error", F.lit(None).cast("string"))
    return {"discovered": found, "page_findings": audit["findings"].join(audited.select("page_id"), "page_id", "left_semi"), "site_findings": crawl.site_findings(audited, inputs["sites"]), "statuses": crawl.status_classes(audited, "site")}


def audit_opportunities(inputs: dict, days: int, min_impressions: int, pages: int) -> dict[str, DataFrame]:
    """Opportunities, and audits of the pages that come first among them."""
    out = opportunities(inputs, days, min_impressions)
    first = priority.priority_pages(out["page_findings"].withColumn("finding_id", F.col("id")), pages)
    chosen = inputs["fetches"].join(F.broadcast(first.select(F.col("page").alias("requested_url"))), "requested_url", "left_semi")  # at most 20 pages
    return {**out, "priority_pages": first, **{f"audit_{k}": v for k, v in page_audit({"fetches": chosen}).items()}}


def full_audit(inputs: dict, limit: int, top: int, focus: str, google: str, days: int, min_impressions: int) -> dict[str, DataFrame]:
    """A crawl, search evidence if it is there (or must be), and one order of all findings that lie within the site."""
    out = site_crawl(inputs, limit)
    pages = out["page_findings"].join(inputs["fetches"].select("page_id", "site"), "page_id").select("site", "finding_id", "rule_id", "severity", F.array("url").alias("urls"))
    urls = out["discovered"].select("site", crawl.page_evidence_id(F.col("url")).alias("ref"), "url")
    cited = out["site_findings"].select("site", "finding_id", "rule_id", "severity", F.explode("evidence_refs").alias("ref")).join(urls, ["site", "ref"], "left")
    sites = cited.groupBy("site", "finding_id", "rule_id", "severity").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    technical = pages.unionByName(sites)
    has = "search_rows" in inputs and "landing_rows" in inputs
    if google == "required" and not has:
        raise CapabilityError("GOOGLE_EVIDENCE_REQUIRED", "search and landing rows are required")
    searched = technical.select("site", "finding_id", F.lit("").alias("priority"), F.lit(0.0).alias("impressions"), "urls").limit(0)
    if has and google != "off":
        found = opportunities(inputs, days, min_impressions)
        out |= {f"search_{k}": v for k, v in found.items()}
        rows = found["page_findings"].select("id", "priority", "impressions", F.array("page").alias("urls")).unionByName(found["overlap_findings"].select("id", "priority", "impressions", F.transform("competing_pages", lambda p: p.page).alias("urls")))
        root = inputs["seeds"].select("site", F.col("url").alias("_root"))
        if "property" in inputs:
            root = root.where(property_covers(F.lit(inputs["property"]), F.col("_root")))
        searched = priority.scoped(rows.join(root), F.col("_root")).select("site", F.col("id").alias("finding_id"), "priority", "impressions", "urls")
    ranked = priority.ranked(priority.within_focus(priority.candidates(technical, searched), focus), top)
    return {**out, "priorities": ranked}


REGISTRY = {c.name: c for c in (
    Capability("google.opportunities", "Search opportunities of equal periods", ("search_rows", "landing_rows"), opportunities, {"days": DAYS, "min_impressions": MIN_IMPRESSIONS}),
    Capability("report.acquisition", "Traffic, AI assistants and search totals", ("channel_rows", "search_rows"), acquisition_report, {"days": DAYS}),
    Capability("site.page_audit", "Rules on stored pages", ("fetches",), page_audit),
    Capability("site.crawl", "Discovery and rules on sites", ("fetches", "seeds", "sitemap_entries", "sites"), site_crawl, {"limit": LIMIT}),
    Capability("site.audit_opportunities", "Audits of pages with search opportunities", ("search_rows", "landing_rows", "fetches"), audit_opportunities, {"days": DAYS, "min_impressions": MIN_IMPRESSIONS, "pages": PAGES}),
    Capability("site.full_audit", "Crawl and search evidence in one order", ("fetches", "seeds", "sitemap_entries", "sites"), full_audit, {"limit": LIMIT, "top": TOP, "focus": FOCUS, "google": GOOGLE, "days": DAYS, "min_impressions": MIN_IMPRESSIONS}),
)}


def describe(name: str) -> dict:
    c = REGISTRY[name]
    return {"name": c.name, "title": c.title, "inputs": list(c.inputs), "parameters": {k: {"default": p.default, "low": p.low, "high": p.high, "choices": list(p.choices)} for k, p in c.parameters.items()}}
