"""Two audit runs compared. What wasn't observed is never taken for resolved.

runs: run_id, site, url, config, partial, truncated, google_status, gsc_site, ga4_property, google_complete, and period bounds.
pages: run_id, url and fields. technical: run_id, rule_id, severity, evidence as cited (url, type). pairs: site, older, newer.
All pairs are compared at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.urls import document_url

# Rules on whole sites, and page fields compared.
SITE_RULE = r"^(?:SITEMAP_|DUPLICATE_TITLE_IN_AUDITED_SET_V1:|AUDITED_INTERNAL_LINK_TARGET_ERROR_V1|NOT_OBSERVED_IN_COMPLETE_SITEMAP_SET_V1|UNLINKED_IN_COMPLETE_STATIC_CRAWL_V1)"
FIELDS = ["final_url", "status", "html_observed", "content_hash", "title", "meta_description_observed", "noindex_observed", "canonical_targets"]


def latest(runs: DataFrame, n: int = 2) -> DataFrame:
    """The last n runs of each site, newest first."""
    order = Window.partitionBy("site").orderBy(F.desc("saved_at"), F.desc("run_id"))
    return runs.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def latest_pairs(runs: DataFrame) -> DataFrame:
    """site, older, newer, of sites with two runs."""
    pick = lambda k: F.max(F.when(F.col("recency") == k, F.col("run_id")))
    return latest(runs, 2).groupBy("site").agg(pick(2).alias("older"), pick(1).alias("newer")).where("older IS NOT NULL")


def _with_runs(pairs: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    out = pairs
    for side in ("older", "newer"):
        out = out.join(runs.select(F.col("run_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return out


def coverage(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether technical evidence can be compared, and whether both crawls are complete."""
    both = _with_runs(pairs, runs, "url", "config", "partial", "truncated")
    same = (document_url(F.col("older_url")) == document_url(F.col("newer_url"))) & F.col("older_config").isNotNull() & F.col("newer_config").isNotNull() & (F.col("older_config") == F.col("newer_config"))
    whole = lambda s: ~F.col(f"{s}_partial") & ~F.col(f"{s}_truncated")
    reasons = F.array_compact(F.array(
        F.when(~(document_url(F.col("older_url")).eqNullSafe(document_url(F.col("newer_url")))), "other target URLs"),
        F.when(F.col("older_config").isNull() | F.col("newer_config").isNull(), "no crawl configuration on record").when(F.col("older_config") != F.col("newer_config"), "other crawl configurations"),
        F.when(~whole("older"), "the older crawl is incomplete"), F.when(~whole("newer"), "the newer crawl is incomplete"),
    ))
    comparable = F.coalesce(same, F.lit(False))
    return both.select("site", "older", "newer", comparable.alias("comparable"), (comparable & whole("older") & whole("newer")).alias("complete"), reasons.alias("reasons"))


def _sides(pairs: DataFrame, rows: DataFrame, key: list[str], row: Column) -> DataFrame:
    """Full outer join of the older and the newer run's rows on key: columns o and n."""
    of = lambda side, name: pairs.join(rows.withColumn("_row", row), F.col(side) == F.col("run_id")).select("site", "older", "newer", *key, F.col("_row").alias(name))
    return of("older", "o").join(of("newer", "n"), ["site", "older", "newer", *key], "full_outer")


def page_changes(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """A row per URL: state (compared, newly_observed, not_observed_in_newer) and the fields that differ."""
    sorted_pages = pages.withColumn("canonical_targets", F.array_sort("canonical_targets"))
    both = _sides(pairs, sorted_pages, ["url"], F.struct(*FIELDS))
    state = F.when(F.col("o").isNull(), "newly_observed").when(F.col("n").isNull(), "not_observed_in_newer").otherwise("compared")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), f) for f in FIELDS]))
    return both.select("site", "older", "newer", "url", state.alias("state"), F.when(state == "compared", changed).alias("changed_fields"), "o", "n")


def technical_snapshots(findings: DataFrame, evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """findings: run_id, finding_id, rule_id, severity, evidence_refs. evidence: run_id, ref, url, type.

    -> one row per run and key: a page finding cites one page and isn't a site rule; the key is the rule and the page or subject.
    """
    cited = findings.select("run_id", "finding_id", "rule_id", "severity", F.explode("evidence_refs").alias("ref")).join(evidence, ["run_id", "ref"])
    grouped = cited.groupBy("run_id", "finding_id", "rule_id", "severity").agg(F.array_sort(F.collect_set(F.when(F.col("type") == "page", F.col("url")))).alias("pages"), F.array_sort(F.collect_set("url")).alias("all"))
    all_ = findings.select("run_id", "finding_id", "rule_id", "severity").join(grouped, ["run_id", "finding_id", "rule_id", "severity"], "left").join(runs.select("run_id", F.col("url").alias("subject")), "run_id")
    pages = F.coalesce("pages", F.array().cast("array<string>"))
    is_page = (F.size(pages) == 1) & ~F.col("rule_id").rlike(SITE_RULE)
    key = F.concat_ws("\0", "rule_id", F.when(is_page, F.get(pages, F.lit(0))).otherwise(F.coalesce("subject", F.lit("unknown-site"))))
    rows = all_.select("run_id", key.alias("key"), "finding_id", "rule_id", "severity", F.when(is_page, "page").otherwise("site").alias("scope"), F.when(F.size(pages) > 0, pages).otherwise(F.coalesce("all", pages)).alias("urls"))
    # of findings with one key the last counts
    return rows.groupBy("run_id", "key").agg(F.max_by(F.struct("finding_id", "rule_id", "severity", "scope", "urls"), "finding_id").alias("f")).select("run_id", "key", "f.*")


def compare_technical(pairs: DataFrame, snapshots: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """site, older, newer, key, rule_id, state: persistent, newly_observed, resolved or unknown (with its direction)."""
    both = _sides(pairs, snapshots, ["key"], F.struct("finding_id", "rule_id", "severity", "scope", "urls"))
    judged = both.withColumns({"f": F.coalesce("n", "o"), "other": F.when(F.col("n").isNull(), F.col("newer")).otherwise(F.col("older"))})
    judged = judged.withColumn("page", F.get("f.urls", F.lit(0))).join(coverage(pairs, runs).select("older", "newer", "complete"), ["older", "newer"])
    seen = pages.select(F.col("run_id").alias("other"), F.col("url").alias("page"), F.lit(True).alias("seen")).distinct()
    judged = judged.join(seen, ["other", "page"], "left")
    comparable = F.when(F.col("f.scope") == "page", F.coalesce("seen", F.lit(False))).otherwise(F.col("complete"))
    state = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), "persistent").when(~comparable, "unknown").when(F.col("o").isNull(), "newly_observed").otherwise("resolved")
    direction = F.when(state == "unknown", F.when(F.col("o").isNull(), "newly-observed").otherwise("no-longer-observed"))
    return judged.select("site", "older", "newer", "key", "f.rule_id", "f.scope", "f.severity", state.alias("state"), direction.alias("direction"))


def search_key(kind: Column, query: Column, page: Column, competing: Column) -> Column:
    rivals = F.array_sort(F.array_distinct(F.transform(F.coalesce(competing, F.array().cast("array<string>")), document_url)))
    return F.array_join(F.concat(F.array(kind, F.lower(F.trim(query)), F.coalesce(document_url(page), F.lit(""))), rivals), "\0")


def compare_search(pairs: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """findings: run_id, kind, query, page, competing_pages, priority. Nothing is compared unless both runs have like evidence;
    what is new or gone counts only if it is complete."""
    spans = ["gsc_days", "gsc_previous_days", "ga4_days", "ga4_previous_days"]
    both = _with_runs(pairs, runs, "google_status", "gsc_site", "ga4_property", "google_complete", *spans)
    like = F.lit(True)
    for side in ("older", "newer"):
        like = like & (F.col(f"{side}_google_status") == "included")
    for c in ("gsc_site", "ga4_property"):
        like = like & F.col(f"older_{c}").eqNullSafe(F.col(f"newer_{c}"))
    for c in spans:
        like = like & (F.col(f"older_{c}") == F.col(f"newer_{c}"))
    gated = both.select("site", "older", "newer", F.coalesce(like, F.lit(False)).alias("comparable"), (F.col("older_google_complete") & F.col("newer_google_complete")).alias("complete")).where("comparable")
    keyed = findings.withColumn("key", search_key(F.col("kind"), F.col("query"), F.col("page"), F.col("competing_pages")))
    sides = _sides(gated.select("site", "older", "newer"), keyed, ["key"], F.struct("kind", "query", "page", "priority")).join(gated.select("older", "newer", "complete"), ["older", "newer"])
    state = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), "persistent").when(F.col("complete"), F.when(F.col("o").isNull(), "newly_observed").otherwise("no_longer_observed"))
    return sides.withColumn("state", state).where("state IS NOT NULL").select("site", "older", "newer", "key", F.coalesce("n", "o").alias("f"), "state").select("site", "older", "newer", "key", "f.*", "state")
