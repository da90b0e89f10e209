"""Queries over findings: one priority order, comparison of runs, the opportunity queue and change records."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.shared import checkpointed, scratch
from siftline.operators import changes, compare, priority, queue_state, search
from siftline.plans import queries_search, queries_site
from siftline.sources import runs as saved
from siftline.sources.adapters import view, with_views

URL = "https://shop.example.com/"


def technical(s, d):
    return queries_site.found(s, d).select(F.lit("all").alias("site"), "finding_id", "rule_id", "severity", F.array("url").alias("urls"))


def search_findings(s, d):
    found = search.ranked(search.candidates(*queries_search.both(s, d)))
    return found.select(F.lit("all").alias("site"), F.concat(F.lit("finding_page_"), F.col("rank").cast("string")).alias("finding_id"), "priority", "impressions", F.array("page").alias("urls"))


def unified(s, d, focus="all", top=100):
    found = priority.within_focus(priority.candidates(technical(s, d), search_findings(s, d)), focus)
    return priority.ranked(found, top).select("rank", "finding_id", "source", "category", "priority", F.array_join("urls", " ").alias("urls"))


def scoped(s, d):
    """Findings of pages on one host, and of none on others."""
    return priority.scoped(priority.candidates(technical(s, d), search_findings(s, d)), F.lit("https://www.shop.example.com/x")).select("finding_id", "source")


def pages(s, d):
    found = search.ranked(search.candidates(*queries_search.both(s, d)))
    return priority.priority_pages(found.withColumn("finding_id", F.concat(F.lit("finding_page_"), F.col("rank").cast("string"))), 20).withColumn("finding_refs", F.concat_ws(",", "finding_refs"))


def audit(s, d):
    """Three runs of one site: runs, pages, evidence and findings."""
    rows = view(s, d, "v_run_findings")
    run = rows.select("run_no", "run_id").distinct()
    runs = run.select("run_id", F.lit("all").alias("site"), F.lit(URL).alias("url"), F.lit("limit=500").alias("config"), F.lit(False).alias("partial"), F.lit(False).alias("truncated"),
                      F.format_string("2024-01-%02dT00:00:00Z", "run_no").alias("completed_at"), F.format_string("2024-01-%02dT01:00:00Z", "run_no").alias("saved_at"))
    seen = rows.where("observed").select("run_id", "run_no", "page_id", "url").distinct()
    status = F.when((F.col("page_id") + F.col("run_no")) % 3 == 0, 404).otherwise(200)
    pages = seen.select("run_id", "url", F.col("url").alias("final_url"), status.alias("status"), F.lit(True).alias("html_observed"), F.sha2(F.concat_ws("/", "url", (F.col("run_no") * F.col("page_id") % 4).cast("string")), 256).alias("content_hash"),
                        F.lit("t").alias("title"), F.lit(None).cast("boolean").alias("meta_description_observed"), (F.col("page_id") % 2 == 0).alias("noindex_observed"), F.array(F.lit("b"), F.lit("a")).alias("canonical_targets"))
    evidence = seen.select("run_id", F.concat(F.lit("ev_"), F.col("page_id").cast("string")).alias("ref"), "url", F.lit("page").alias("type"))
    findings = rows.where("observed AND found").select("run_id", F.concat(F.lit("f_"), F.substring(F.sha2(F.concat_ws("/", "rule_id", "url"), 256), 1, 16)).alias("finding_id"), "rule_id", F.lit("medium").alias("severity"), F.array(F.concat(F.lit("ev_"), F.col("page_id").cast("string"))).alias("evidence_refs"))
    return runs, pages, evidence, findings


PAIRS = [("all", "run-1", "run-2"), ("all", "run-2", "run-3")]


def pairs(s):
    return s.createDataFrame(PAIRS, "site string, older string, newer string")


def compared(s, d):
    runs, seen, evidence, findings = audit(s, d)
    out = compare.compare_technical(pairs(s), compare.technical_snapshots(findings, evidence, runs), seen, runs)
    return out.select("older", "newer", "rule_id", F.element_at(F.split("key", "\\x00"), 2).alias("subject"), "scope", "state", "direction")


def page_changes(s, d):
    _, seen, _, _ = audit(s, d)
    return compare.page_changes(pairs(s), seen).select("older", "newer", "url", "state", F.array_join("changed_fields", ",").alias("changed_fields"))


def site_runs(s, d):
    """A run of each site for each page of v_site_fetches, not saved in the order of their numbers; many at one time."""
    rows = view(s, d, "v_site_fetches")
    return rows.select(F.concat("site", F.lit("/"), F.col("n").cast("string")).alias("run_id"), "site", "n", F.concat(F.lit("2024-01-0"), ((F.col("n") * 3 + F.col("site_no")) % 5 % 4 + 1).cast("string")).alias("saved_at"))


def latest_runs(s, d):
    return compare.latest(site_runs(s, d), 2).select("site", "run_id", "recency")


SITE_RUNS_SQL = with_views("v_site_fetches") + ", r AS (SELECT site || '/' || n AS run_id, site, site_no, n, '2024-01-0' || ((n * 3 + site_no) % 5 % 4 + 1) AS saved_at FROM v_site_fetches)"


def latest_pairs(s, d):
    return compare.latest_pairs(site_runs(s, d))


RUN_NUMBERS = {"run-1": True, "run-2": True, "run-3": False}


def search_evidence(s, d):
    """Search findings of the three runs of v_run_findings, spelled in several ways, and what the runs' evidence is: the third isn't complete."""
    rows = view(s, d, "v_run_findings").where("observed AND found")
    query = F.concat(F.lit(" "), F.when(F.col("run_no") == 2, F.upper("rule_id")).otherwise(F.col("rule_id")))
    findings = rows.select("run_id", F.lit("page_query").alias("kind"), query.alias("query"), F.concat("url", F.lit("#"), F.col("run_no").cast("string")).alias("page"), F.array().cast("array<string>").alias("competing_pages"), F.lit("medium").alias("priority"))
    runs = s.createDataFrame([(r, "included", "sc", "g", whole, 28, 28, 28, 28) for r, whole in RUN_NUMBERS.items()], "run_id string, google_status string, gsc_site string, ga4_property string, google_complete boolean, gsc_days int, gsc_previous_days int, ga4_days int, ga4_previous_days int")
    return findings, runs


def compared_search(s, d):
    out = compare.compare_search(pairs(s), *search_evidence(s, d))
    return out.select("older", "newer", "kind", "state", F.replace("key", F.lit("\0"), F.lit("|")).alias("key"))


COMPARED_SEARCH_SQL = with_views("v_run_findings") + """, f AS (SELECT DISTINCT run_no, 'page_query|' || lower(rule_id) || '|' || url AS key FROM v_run_findings WHERE observed AND found), p(o, n, complete) AS (VALUES (1, 2, true), (2, 3, false))
  SELECT 'run-' || o AS older, 'run-' || n AS newer, 'page_query' AS kind, CASE WHEN a AND b THEN 'persistent' WHEN a THEN 'no_longer_observed' ELSE 'newly_observed' END AS state, key
  FROM (SELECT o, n, complete, key, bool_or(run_no = o) AS a, bool_or(run_no = n) AS b FROM p JOIN f ON run_no IN (o, n) GROUP BY ALL) WHERE complete OR (a AND b)"""


def search_queue(s, d, upto=3):
    """The queue's search half: after the first run the item of the least id is dismissed by hand and the next one planned."""
    findings, evidence = search_evidence(s, d)
    key = compare.search_key(F.col("kind"), F.col("query"), F.col("page"), F.col("competing_pages"))
    state, syncs, outcomes = s.createDataFrame([], queue_state.STATE), s.createDataFrame([], queue_state.SYNCS), None
    none = s.createDataFrame([], "site string, older string, key string, state string")
    for k, (run_id, _) in enumerate(list(RUN_NUMBERS.items())[:upto], 1):
        run = s.createDataFrame([("all", run_id, f"2024-01-{k:02d}T00:00:00Z")], "site string, run_id string, completed_at string")
        derived = findings.where(F.col("run_id") == run_id).select(F.lit("all").alias("site"), F.lit("google").alias("source"), "kind", key.alias("comparison_key"), "priority")
        both = queue_state.pairs_to_compare(state, run)
        complete = evidence.select(F.col("run_id").alias("older"), F.lit(True).alias("comparable"))
        absent = queue_state.absent_verdicts(none, compare.compare_search(both, findings, evidence), both.join(complete, "older").select("older", "comparable"), state)
        state, syncs, outcomes = (checkpointed(x) for x in queue_state.sync(state, syncs, run, derived, absent, f"2024-01-{k:02d}T02:00:00Z"))
        if k == 1:
            for (least,), status in zip(state.select("id").orderBy("id").limit(2).collect(), ("dismissed", "planned"), strict=False):
                state = queue_state.update_status(state, least, status, f" {status} by hand ", "2024-01-01T03:00:00Z")
            state = checkpointed(state)
    return state, syncs, outcomes


def search_queue_rows(s, d):
    return search_queue(s, d)[0].select("id", "status", "status_reason", "observation_state", "occurrences", "latest_run_id", "first_seen_at", F.size("history").cast("long").alias("events"), F.element_at("history", -1).event.alias("last_event"))


SEARCH_QUEUE_SQL = with_views("v_run_findings") + """, f AS (SELECT lower(rule_id) AS rule, url, bool_or(run_no = 1) AS a, bool_or(run_no = 2) AS b, bool_or(run_no = 3) AS c FROM v_run_findings WHERE observed AND found GROUP BY 1, 2),
  i AS (SELECT *, 'opp_' || substr(sha256('opportunity-v1' || chr(0) || 'all' || chr(0) || 'google' || chr(0) || 'page_query' || chr(0) || rule || chr(0) || url), 1, 24) AS id FROM f), m AS (SELECT *, CASE WHEN a THEN row_number() OVER (PARTITION BY a ORDER BY id) END AS nth FROM i)
  SELECT id, CASE nth WHEN 1 THEN 'dismissed' WHEN 2 THEN 'planned' ELSE 'open' END AS status, CASE nth WHEN 1 THEN 'dismissed by hand' WHEN 2 THEN 'planned by hand' END AS status_reason, CASE WHEN c THEN 'present' ELSE 'unknown' END AS observation_state,
  a::BIGINT + b::BIGINT + c::BIGINT AS occurrences, CASE WHEN c THEN 'run-3' WHEN b THEN 'run-2' ELSE 'run-1' END AS latest_run_id, CASE WHEN a THEN '2024-01-01T00:00:00Z' WHEN b THEN '2024-01-02T00:00:00Z' ELSE '2024-01-03T00:00:00Z' END AS first_seen_at,
  a::BIGINT + (coalesce(nth, 9) <= 2)::BIGINT + (a OR b)::BIGINT + c::BIGINT AS events, CASE WHEN c AND (a OR b) THEN 'observed' WHEN c THEN 'created' WHEN a AND b THEN 'observed' WHEN b THEN 'created' ELSE 'not_observed' END AS last_event FROM m"""


def dry_run(s, d):
    """What the second run would do to the stored queue, and that nothing has been stored by asking."""
    folder = scratch(s, "queue")
    state, syncs, _ = search_queue(s, d, 1)
    first = queue_state.write_version(state, folder, expected=None)
    stored = queue_state.read_version(s, folder)
    run = s.createDataFrame([("all", "run-2", "2024-01-02T00:00:00Z")], "site string, run_id string, completed_at string")
    findings, _ = search_evidence(s, d)
    key = compare.search_key(F.col("kind"), F.col("query"), F.col("page"), F.col("competing_pages"))
    derived = findings.where("run_id = 'run-2'").select(F.lit("all").alias("site"), F.lit("google").alias("source"), "kind", key.alias("comparison_key"), "priority")
    nothing = s.createDataFrame([], "site string, source string, comparison_key string, latest_run_id string, verdict string")
    would = queue_state.changes(queue_state.sync(stored, syncs, run, derived, nothing, "2024-01-02T02:00:00Z")[2])
    kept = queue_state.read_version(s, folder).agg(F.count("*").alias("stored"), F.max("occurrences").alias("occurrences"))
    return would.join(kept).withColumn("same_version", F.lit(queue_state.current_version(s, folder) == first))  # one row


DRY_RUN_SQL = SEARCH_QUEUE_SQL.partition(",\n  i AS")[0] + """ SELECT 'all' AS site, count(*) FILTER (WHERE b AND NOT a) AS created, count(*) FILTER (WHERE a AND b) AS updated, 0::BIGINT AS reopened, 0::BIGINT AS verified, 0::BIGINT AS not_observed, count(*) FILTER (WHERE a AND NOT b) AS unknown, 0::BIGINT AS unchanged,
  count(*) FILTER (WHERE a) AS stored, 1::BIGINT AS occurrences, true AS same_version FROM f"""


def queue(s, d, upto=3):
    """The queue after each run of page findings, in order; each state is written before the next run."""
    runs, seen, evidence, findings = audit(s, d)
    snapshots = checkpointed(compare.technical_snapshots(findings, evidence, runs))
    state, syncs, outcomes = s.createDataFrame([], queue_state.STATE), s.createDataFrame([], queue_state.SYNCS), None
    for k in range(1, upto + 1):
        run = runs.where(F.col("run_id") == f"run-{k}").select("site", "run_id", "completed_at")
        derived = snapshots.where(F.col("run_id") == f"run-{k}").select(F.lit("all").alias("site"), F.lit("technical").alias("source"), F.col("rule_id").alias("kind"), F.col("key").alias("comparison_key"), F.col("severity").alias("priority"))
        verdict = compare.compare_technical(queue_state.pairs_to_compare(state, run), snapshots, seen, runs).where("state IN ('resolved', 'unknown')")
        absent = verdict.select("site", F.lit("technical").alias("source"), F.col("key").alias("comparison_key"), F.col("older").alias("latest_run_id"), F.col("state").alias("verdict"))
        state, syncs, outcomes = (checkpointed(x) for x in queue_state.sync(state, syncs, run, derived, absent, f"2024-01-{k:02d}T02:00:00Z"))
    return state, syncs, outcomes


def queue_rows(s, d):
    state = queue(s, d)[0]
    return state.select("kind", F.element_at(F.split("comparison_key", "\\x00"), 2).alias("url"), "id", "status", "observation_state", "occurrences", "first_seen_at", "last_seen_at", "latest_run_id", "verified_newer", F.size("history").cast("long").alias("events"))


def _queue_sql(upto=3):
    """The machine run by run over each page and rule."""
    out = with_views("v_run_findings") + """, p AS (SELECT rule_id, CASE WHEN rule_id LIKE 'SITEMAP%' THEN 'https://shop.example.com/' ELSE url END AS url, run_no, bool_or(found AND observed) AS present, bool_or(observed OR rule_id LIKE 'SITEMAP%') AS seen FROM v_run_findings GROUP BY ALL),
  s0 AS (SELECT DISTINCT rule_id, url, NULL::VARCHAR AS status, NULL::VARCHAR AS obs, 0::BIGINT AS occ, NULL::VARCHAR AS first, NULL::VARCHAR AS last, NULL::VARCHAR AS run, NULL::VARCHAR AS vnew, 0::BIGINT AS events FROM p)"""
    for k in range(1, upto + 1):
        at = f"'2024-01-{k:02d}T00:00:00Z'"
        out += f""", j{k} AS (SELECT s.*, p.present, CASE WHEN p.present THEN CASE WHEN status IS NULL THEN 'new' ELSE 'again' END WHEN status IS NULL THEN 'none'
    WHEN p.seen THEN CASE WHEN obs = 'not_observed' AND vnew IS NOT NULL THEN 'none' ELSE 'verified' END WHEN obs = 'unknown' THEN 'none' ELSE 'unknown' END AS o FROM s{k - 1} s JOIN p ON p.rule_id = s.rule_id AND p.url = s.url AND p.run_no = {k}),
  s{k} AS (SELECT rule_id, url, CASE o WHEN 'new' THEN 'open' WHEN 'again' THEN CASE WHEN status = 'verified' THEN 'open' ELSE status END WHEN 'verified' THEN 'verified' ELSE status END AS status,
    CASE WHEN present THEN 'present' WHEN o = 'verified' THEN 'not_observed' WHEN o = 'unknown' THEN 'unknown' ELSE obs END AS obs, occ + present::BIGINT AS occ, CASE WHEN o = 'new' THEN {at} ELSE first END AS first,
    CASE WHEN present THEN {at} ELSE last END AS last, CASE WHEN present THEN 'run-{k}' ELSE run END AS run, CASE WHEN present THEN NULL WHEN o = 'verified' THEN 'run-{k}' ELSE vnew END AS vnew, events + (o <> 'none')::BIGINT AS events FROM j{k})"""
    return out + """ SELECT rule_id AS kind, url, 'opp_' || substr(sha256('opportunity-v1' || chr(0) || 'all' || chr(0) || 'technical' || chr(0) || rule_id || chr(0) || url), 1, 24) AS id, status, obs AS observation_state, occ AS occurrences,
  first AS first_seen_at, last AS last_seen_at, run AS latest_run_id, vnew AS verified_newer, events FROM s""" + f"{upto} WHERE status IS NOT NULL"


KINDS = (*changes.TYPES, "rewrite")


def change_rows(s, d):
    """A record for each page: documents spelled twice, kinds and digests of which some are none, and URLs that aren't http(s)."""
    rows, n = view(s, d, "v_site_fetches"), F.col("page_id")
    urls = F.array(F.concat("url", F.lit("#1")), F.concat("url", F.lit("#2")), F.when(n % 11 == 10, F.lit("ftp://x/")).otherwise(F.concat(F.lit("https://"), "site", F.lit("/"))))
    out = rows.select(
        F.concat(F.lit("c"), n.cast("string")).alias("id"), F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("recorded_at"), F.concat(F.lit("opp_"), (n % 50).cast("string")).alias("opportunity_id"), F.concat(F.lit("https://"), "site", F.lit("/")).alias("site"),
        urls.alias("urls"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), (n % len(KINDS) + 1).cast("int")).alias("type"), F.when(n % 9 == 0, "xyz").when(n % 9 == 1, "0" * 64).alias("before_content_hash"),
    )
    return out.withColumns({c: F.lit(None).cast("string") for c in ("git_commit", "deployment_ref", "after_content_hash", "note")}).withColumn("concurrent_changes", F.array().cast("array<string>"))


def change_list(s, d):
    """The newest of one document's changes, which all pages of its site share, and of one opportunity's."""
    good, _ = changes.prepared(change_rows(s, d))
    return changes.listed(good, url="https://s0.example/#any").unionByName(changes.listed(good, opportunity_id="opp_2")).select("id", F.array_join("urls", " ").alias("urls"), "type", "additional_urls")


def change_rejects(s, d):
    return changes.prepared(change_rows(s, d))[1].select("id", F.concat_ws("; ", "problems").alias("problems"))


def change_store(s, d):
    """Half of the records are stored first, then all: those that are there stay as they are, and rejects don't get in."""
    folder, rows = scratch(s, "changes"), change_rows(s, d)
    changes.save(rows.where("recorded_at < '2024-01-15'"), folder)
    changes.save(rows.withColumn("note", F.lit("later")), folder)
    return changes.read(s, folder).select("id", "recorded_at", "type", F.size("urls").alias("documents"), "note")


CHANGES_SQL = with_views("v_site_fetches") + f""", c AS (SELECT page_id, 'c' || page_id AS id, '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS recorded_at, 'opp_' || page_id % 50 AS opportunity_id, site, url, ({list(KINDS)!r})[page_id % 8 + 1] AS type,
  concat_ws('; ', CASE WHEN page_id % 8 = 7 THEN 'unknown type' END, CASE WHEN page_id % 9 = 0 THEN 'before_content_hash is no SHA-256' END, CASE WHEN page_id % 11 = 10 THEN 'a url is not http(s)' END) AS problems,
  CASE WHEN n = 0 THEN url ELSE url || ' https://' || site || '/' END AS urls, CASE WHEN n = 0 THEN 1 ELSE 2 END AS documents FROM v_site_fetches)"""


def run_store(s, d):
    """Runs are saved twice, the second time with other texts and some new ones; then damaged copies get in beside them."""
    folder, rows = scratch(s, "runs"), site_runs(s, d)
    audits = rows.select("run_id", "saved_at", F.col("saved_at").alias("completed_at"), "site", F.lit("first").alias("config"))
    saved.save(audits.where("run_id NOT LIKE '%/4'"), folder)
    saved.save(audits.withColumn("config", F.lit("second")), folder)
    damaged = saved.as_runs(rows.where("n = 0").select(F.concat("run_id", F.lit("-bad")).alias("run_id"), "saved_at", F.col("saved_at").alias("completed_at"), "site"))
    saved.append(damaged.withColumn("audit", F.concat("audit", F.lit("}"))), folder)
    return saved.checked(saved.read(s, folder))


def stored_runs(s, d):
    return run_store(s, d).select("run_id", "site", "saved_at", F.get_json_object("audit", "$.config").alias("config"), "warning")


UNIFIED_SQL = queries_search.CANDIDATES.replace("WITH v_gsc AS", queries_site.FINDINGS_SQL + ", v_gsc AS", 1).replace("), found AS (\n  SELECT *, concat_ws", "), sfound AS (\n  SELECT *, concat_ws").replace("AS rank FROM found WHERE signals", "AS rank FROM sfound WHERE signals")
UNIFIED_SQL += r""", c AS (
  SELECT DISTINCT finding_id, 'technical' AS source, CASE WHEN regexp_matches(rule_id, 'JSON_LD|STRUCTURED') THEN 'structured-data' WHEN regexp_matches(rule_id, 'LINK|UNLINKED') THEN 'internal-links' WHEN contains(rule_id, 'CANONICAL') THEN 'canonical'
    WHEN contains(rule_id, 'SITEMAP') THEN 'sitemap' WHEN regexp_matches(rule_id, 'TITLE|DESCRIPTION|HEADING') THEN 'metadata' WHEN regexp_matches(rule_id, 'ROBOTS|NOINDEX|HTTP|REDIRECT|HTML_NOT_OBSERVED') THEN 'access-indexing' ELSE 'other' END AS category,
    severity AS priority, 0.0 AS impressions, url AS urls, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 3 WHEN 'low' THEN 5 ELSE 7 END AS score FROM found
  UNION ALL SELECT 'finding_page_' || rank, 'google-opportunity', 'search-performance', priority, impressions, page, CASE priority WHEN 'high' THEN 2 WHEN 'medium' THEN 4 ELSE 6 END FROM ranked WHERE rank <= 25)"""
_RANKED = " SELECT row_number() OVER (ORDER BY score, impressions DESC, finding_id)::INT AS rank, finding_id, source, category, priority, urls FROM c {where} QUALIFY rank <= {top}"

def priority_details(s, d):
    """Every technical finding with its place among the first 100, if it has one."""
    found = priority.candidates(technical(s, d), search_findings(s, d))
    return priority.details(technical(s, d).select("site", "finding_id", "rule_id").distinct(), priority.ranked(found, 100)).select("finding_id", "rule_id", F.col("rank").cast("double").alias("rank"), "category", F.col("score").cast("double").alias("score"))


def both_sources(s, d):
    """One queue of technical and search items: how many of each source are in which state."""
    state = queue(s, d, 2)[0].unionByName(search_queue(s, d, 2)[0])
    return state.groupBy("source", "status", "observation_state").agg(F.count("*").alias("items"))


QUERIES = {
    "w3_t10_f22_f23_unified_priority": unified,
    "p9_focus_indexing": lambda s, d: unified(s, d, "indexing", 50),
    "j17_scoped_findings": scoped,
    "t11_priority_pages": pages,
    "j9_j16_compare_technical": compared,
    "j8_u3_page_changes": page_changes,
    "w5_latest_runs": latest_runs,
    "j10_compare_search": compared_search,
    "st4_j14_queue_states": queue_rows,
    "st5_repeat_sync": lambda s, d: _repeat(s, d),
    "a20_queue_summary": lambda s, d: queue_state.summary(queue(s, d)[0]),
    "p10_t12_queue_list": lambda s, d: queue_state.listed(queue(s, d)[0], limit=100).select("id", "status", "observation_state", "last_seen_at"),
    "t13_affected": lambda s, d: queue_state.affected(queue(s, d)[2]).select("id", "outcome"),
    "w5_latest_pairs": latest_pairs,
    "st7_j14_search_queue": search_queue_rows,
    "st8_dry_run": dry_run,
    "j12_priority_details": priority_details,
    "u2_t12_both_sources": both_sources,
    "p11_t15_changes": change_list,
    "f26_change_rejects": change_rejects,
    "s18_change_store": change_store,
    "s15_s16_run_store": stored_runs,
    "t14_saved_runs": lambda s, d: saved.listed(run_store(s, d)).select("run_id", "saved_at"),
}


def _repeat(s, d):
    """Each site's run number 2 is synced; then all of its runs come: that one is a repeat, those before it are late, the others are due."""
    runs = site_runs(s, d).select("site", "run_id", F.col("saved_at").alias("completed_at"))
    first = runs.where("run_id LIKE '%/2'")
    found = first.select("site", F.lit("technical").alias("source"), F.lit("k").alias("kind"), F.lit("c").alias("comparison_key"), F.lit("high").alias("priority"))
    nothing = s.createDataFrame([], "site string, source string, comparison_key string, latest_run_id string, verdict string")
    _, syncs, _ = queue_state.sync(s.createDataFrame([], queue_state.STATE), s.createDataFrame([], queue_state.SYNCS), first, found, nothing, "2024-02-01")
    return queue_state.check_order(runs, syncs).select("site", "run_id", "action")


_STATE = _queue_sql()
ORACLES = {
    "w3_t10_f22_f23_unified_priority": UNIFIED_SQL + _RANKED.format(where="", top=100),
    "p9_focus_indexing": UNIFIED_SQL + _RANKED.format(where="WHERE category IN ('access-indexing', 'canonical', 'sitemap')", top=50),
    "j17_scoped_findings": UNIFIED_SQL + " SELECT finding_id, source FROM c WHERE regexp_matches(urls, '^https?://(www\\.)?shop\\.example\\.com/')".replace("\\\\", "\\"),
    "t11_priority_pages": queries_search.CANDIDATES + """, g AS (SELECT page, min(struct_pack(a := CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, b := -impressions, c := page)) AS place, string_agg('finding_page_' || rank, ',' ORDER BY 'finding_page_' || rank) AS finding_refs
  FROM ranked WHERE rank <= 25 GROUP BY page) SELECT row_number() OVER (ORDER BY place)::INT AS rank, page, finding_refs FROM g QUALIFY rank <= 20""",
    "j9_j16_compare_technical": with_views("v_run_findings") + f""", pairs(older, newer) AS (VALUES ('run-1', 'run-2'), ('run-2', 'run-3')), seen AS (SELECT DISTINCT run_id, url FROM v_run_findings WHERE observed),
  f AS (SELECT DISTINCT run_id, rule_id, CASE WHEN rule_id LIKE 'SITEMAP%' THEN '{URL}' ELSE url END AS subject FROM v_run_findings WHERE found AND observed),
  k AS (SELECT older, newer, rule_id, subject, bool_or(run_id = older) AS o, bool_or(run_id = newer) AS n FROM pairs JOIN f ON run_id IN (older, newer) GROUP BY ALL), j AS (SELECT k.*, rule_id LIKE 'SITEMAP%' OR s.url IS NOT NULL AS comparable FROM k LEFT JOIN seen s ON s.url = subject AND s.run_id = CASE WHEN n THEN older ELSE newer END)
  SELECT older, newer, rule_id, subject, CASE WHEN rule_id LIKE 'SITEMAP%' THEN 'site' ELSE 'page' END AS scope, CASE WHEN o AND n THEN 'persistent' WHEN NOT comparable THEN 'unknown' WHEN n THEN 'newly_observed' ELSE 'resolved' END AS state,
  CASE WHEN NOT (o AND n) AND NOT comparable THEN CASE WHEN n THEN 'newly-observed' ELSE 'no-longer-observed' END END AS direction FROM j""",
    "j8_u3_page_changes": with_views("v_run_findings") + """, pairs(older, newer) AS (VALUES ('run-1', 'run-2'), ('run-2', 'run-3')), p AS (SELECT DISTINCT run_id, run_no, url, page_id, CASE WHEN (page_id + run_no) % 3 = 0 THEN 404 ELSE 200 END AS status, run_no * page_id % 4 AS hash FROM v_run_findings WHERE observed),
  o AS (SELECT pairs.*, url, status, hash FROM pairs JOIN p ON run_id = older), n AS (SELECT pairs.*, url, status, hash FROM pairs JOIN p ON run_id = newer)
  SELECT older, newer, url, CASE WHEN o.status IS NULL THEN 'newly_observed' WHEN n.status IS NULL THEN 'not_observed_in_newer' ELSE 'compared' END AS state,
  CASE WHEN o.status IS NOT NULL AND n.status IS NOT NULL THEN concat_ws(',', CASE WHEN o.status <> n.status THEN 'status' END, CASE WHEN o.hash <> n.hash THEN 'content_hash' END) END AS changed_fields FROM o FULL JOIN n USING (older, newer, url)""",
    "w5_latest_runs": SITE_RUNS_SQL + " SELECT site, run_id, (row_number() OVER (PARTITION BY site ORDER BY saved_at DESC, run_id DESC))::INT AS recency FROM r QUALIFY recency <= 2",
    "w5_latest_pairs": SITE_RUNS_SQL + ", k AS (SELECT site, run_id, row_number() OVER (PARTITION BY site ORDER BY saved_at DESC, run_id DESC) AS recency FROM r) SELECT a.site, b.run_id AS older, a.run_id AS newer FROM k a JOIN k b ON a.site = b.site AND a.recency = 1 AND b.recency = 2",
    "j10_compare_search": COMPARED_SEARCH_SQL,
    "st7_j14_search_queue": SEARCH_QUEUE_SQL,
    "st8_dry_run": DRY_RUN_SQL,
    "j12_priority_details": UNIFIED_SQL + ", r AS (SELECT *, row_number() OVER (ORDER BY score, impressions DESC, finding_id)::INT AS rank FROM c QUALIFY rank <= 100) SELECT DISTINCT f.finding_id, f.rule_id, r.rank::DOUBLE AS rank, r.category, r.score::DOUBLE AS score FROM found f LEFT JOIN r ON r.finding_id = f.finding_id",
    "u2_t12_both_sources": "WITH q AS (" + _queue_sql(2) + "), g AS (" + SEARCH_QUEUE_SQL.rpartition("  SELECT id, CASE nth")[0] + """ SELECT b, CASE nth WHEN 1 THEN 'dismissed' WHEN 2 THEN 'planned' ELSE 'open' END AS status FROM m WHERE a OR b) SELECT 'technical' AS source, status, observation_state, count(*) AS items FROM q GROUP BY ALL
  UNION ALL SELECT 'google', status, CASE WHEN b THEN 'present' ELSE 'not_observed' END, count(*) FROM g GROUP BY ALL""",
    "st4_j14_queue_states": _STATE,
    "st5_repeat_sync": SITE_RUNS_SQL + " SELECT r.site, r.run_id, CASE WHEN r.run_id = c.run_id THEN 'repeat' WHEN c.saved_at > r.saved_at THEN 'late' ELSE 'sync' END AS action FROM r LEFT JOIN r c ON c.site = r.site AND c.n = 2",
    "a20_queue_summary": f"WITH q AS ({_STATE}) SELECT count(*) AS stored, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in queue_state.STATUS_RANK) + ", " + ", ".join(f"count(*) FILTER (WHERE observation_state = '{x}') AS {x}" for x in queue_state.OBSERVATION_RANK) + " FROM q",
    "p10_t12_queue_list": f"WITH q AS ({_STATE}) SELECT id, status, observation_state, last_seen_at FROM q WHERE status IN ('open', 'planned') AND observation_state = 'present' ORDER BY last_seen_at DESC, id LIMIT 100",
    "t13_affected": _STATE.rpartition(" SELECT rule_id AS kind")[0] + """ SELECT 'opp_' || substr(sha256('opportunity-v1' || chr(0) || 'all' || chr(0) || 'technical' || chr(0) || rule_id || chr(0) || url), 1, 24) AS id,
  CASE o WHEN 'new' THEN 'created' WHEN 'again' THEN CASE WHEN status = 'verified' THEN 'reopened' ELSE 'updated' END ELSE o END AS outcome FROM j3 WHERE o <> 'none' ORDER BY 1 LIMIT 20""",
    "p11_t15_changes": CHANGES_SQL + """, l AS (SELECT * FROM c WHERE problems = '') SELECT id, urls, type, 0 AS additional_urls FROM (SELECT * FROM l WHERE site = 's0.example' ORDER BY recorded_at DESC, id DESC LIMIT 20)
  UNION ALL SELECT id, urls, type, 0 FROM (SELECT * FROM l WHERE opportunity_id = 'opp_2' ORDER BY recorded_at DESC, id DESC LIMIT 20)""",
    "f26_change_rejects": CHANGES_SQL + " SELECT id, problems FROM c WHERE problems <> ''",
    "s18_change_store": CHANGES_SQL + " SELECT id, recorded_at, type, documents, CASE WHEN recorded_at >= '2024-01-15' THEN 'later' END AS note FROM c WHERE problems = ''",
    "s15_s16_run_store": SITE_RUNS_SQL + """ SELECT run_id, site, saved_at, CASE WHEN n = 4 THEN 'second' ELSE 'first' END AS config, NULL::VARCHAR AS warning FROM r
  UNION ALL SELECT run_id || '-bad', site, saved_at, NULL, 'run ' || run_id || '-bad is damaged' FROM r WHERE n = 0""",
    "t14_saved_runs": SITE_RUNS_SQL + " SELECT run_id, saved_at FROM (SELECT run_id, saved_at FROM r UNION ALL SELECT run_id || '-bad', saved_at FROM r WHERE n = 0) ORDER BY saved_at DESC, run_id DESC LIMIT 20",
}
