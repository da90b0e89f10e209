"""Deterministic rules on one page's fetch and facts: one projection makes an array of findings, and one generator rows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.urls import origin, scheme
from siftline.operators.html_facts import header_directives
from siftline.sources.logs import once

# Rules and severities in their order.
PAGE_RULES = {
    "ROBOTS_DISALLOW_GOOGLEBOT_V1": "high",
    "HTTP_CLIENT_ERROR_V1": "critical",
    "HTTP_SERVER_ERROR_V1": "high",
    "HTTP_UNEXPECTED_STATUS_V1": "medium",
    "FINAL_URL_NOT_HTTPS_V1": "medium",
    "REDIRECT_CHAIN_OBSERVED_V1": "info",
    "TITLE_NOT_OBSERVED_STATIC_HTML_V1": "medium",
    "MULTIPLE_TITLE_ELEMENTS_V1": "medium",
    "DESCRIPTION_NOT_OBSERVED_STATIC_HTML_V1": "low",
    "NOINDEX_DIRECTIVE_OBSERVED_V1": "medium",
    "MULTIPLE_CANONICAL_TARGETS_V1": "high",
    "INVALID_CANONICAL_URL_V1": "medium",
    "CANONICAL_FRAGMENT_TARGET_V1": "medium",
    "CANONICAL_OUTSIDE_HEAD_V1": "medium",
    "CROSS_ORIGIN_CANONICAL_REVIEW_V1": "low",
    "INVALID_JSON_LD_SYNTAX_V1": "medium",
    "HTML_NOT_OBSERVED_V1": "medium",
}
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def fingerprint(*values: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *values), 256), 1, length)


def is_html(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.contains("text/html") | kind.contains("application/xhtml+xml")


def html_observed(pages: DataFrame) -> Column:
    return F.col("facts").isNotNull() & is_html(F.col("content_type"))


def conditions() -> dict[str, Column]:
    """For each rule: when it finds. Columns: final_url, status, redirects, content_type, x_robots_tag, facts, disallowed."""
    f, status = F.col("facts"), F.col("status")
    html = f.isNotNull() & is_html(F.col("content_type"))
    blank = lambda values: F.forall(values, lambda v: F.trim(v) == "")  # noqa: E731  also of none at all
    head = F.filter(f.canonicals, lambda c: c.location == "head")
    targets = F.array_distinct(F.transform(head, lambda c: F.coalesce(c.resolved_url, c.raw_href)))
    noindex = F.array_contains(header_directives(F.coalesce("x_robots_tag", F.array().cast("array<string>"))), "noindex") | F.exists(f.meta_robots, lambda m: F.array_contains(m.directives, "noindex"))
    on_page = {
        "TITLE_NOT_OBSERVED_STATIC_HTML_V1": blank(f.titles),
        "MULTIPLE_TITLE_ELEMENTS_V1": F.size(f.titles) > 1,
        "DESCRIPTION_NOT_OBSERVED_STATIC_HTML_V1": blank(f.meta_descriptions),
        "NOINDEX_DIRECTIVE_OBSERVED_V1": noindex,
        "MULTIPLE_CANONICAL_TARGETS_V1": F.size(targets) > 1,
        "INVALID_CANONICAL_URL_V1": F.exists(head, lambda c: (c.raw_href == "") | c.resolved_url.isNull()),
        "CANONICAL_FRAGMENT_TARGET_V1": F.exists(head, lambda c: F.coalesce(c.resolved_url.rlike("#."), F.lit(False))),
        "CANONICAL_OUTSIDE_HEAD_V1": F.exists(f.canonicals, lambda c: c.location == "body"),
        "CROSS_ORIGIN_CANONICAL_REVIEW_V1": F.exists(head, lambda c: F.coalesce(origin(c.resolved_url) != origin(F.col("final_url")), F.lit(False))),
        "INVALID_JSON_LD_SYNTAX_V1": F.exists(f.structured_data, lambda b: ~b.valid),
    }
    fetched = {
        "HTTP_CLIENT_ERROR_V1": status.between(400, 499),
        "HTTP_SERVER_ERROR_V1": status >= 500,
        "HTTP_UNEXPECTED_STATUS_V1": (status < 200) | status.between(300, 399),
        "FINAL_URL_NOT_HTTPS_V1": scheme(F.col("final_url")) != "https",
        "REDIRECT_CHAIN_OBSERVED_V1": F.size("redirects") > 0,
        **{k: html & v for k, v in on_page.items()},
        "HTML_NOT_OBSERVED_V1": ~html,
    }
    blocked = F.coalesce(F.col("disallowed"), F.lit(False))
    # a page that robots.txt disallows isn't fetched
    return {"ROBOTS_DISALLOW_GOOGLEBOT_V1": blocked, **{k: ~blocked & v for k, v in fetched.items()}}


def findings(pages: DataFrame, *keep: str) -> DataFrame:
    """A row for each finding: keep's columns, rule_id, severity, finding_id, url."""
    rules = conditions()
    made = F.array_compact(F.array(*[F.when(rules[r], F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s in PAGE_RULES.items()]))
    judged = once(pages.withColumn("_found", made), [*keep, "requested_url", "final_url"], "_found")
    rows = judged.select(*keep, "requested_url", "final_url", F.inline("_found"))
    url = F.when(F.col("rule_id") == "ROBOTS_DISALLOW_GOOGLEBOT_V1", F.col("requested_url")).otherwise(F.col("final_url"))
    return rows.withColumn("url", url).withColumn("finding_id", F.concat(F.lit("finding_"), fingerprint(F.col("rule_id"), F.col("url")))).drop("requested_url", "final_url")


def recommendations(found: DataFrame) -> DataFrame:
    """An action for each finding."""
    return found.withColumn("action_id", F.concat(F.lit("action_"), fingerprint(F.col("finding_id"), F.col("url"))))


def severity_counts(found: DataFrame, *by: str) -> DataFrame:
    """Findings of each severity, 0 where there are none."""
    return found.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def evidence_id(kind: str, url: Column, qualifier: Column) -> Column:
    return F.concat(F.lit(f"ev_{kind}_"), fingerprint(F.lit(kind), url, qualifier))
