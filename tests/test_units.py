"""Cases that the driver's tables don't hold."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import urls
from siftline.functions.periods import acquisition_periods
from siftline.operators import compare, coverage, crawl, html_facts, queue_state, search
from siftline.plans import capabilities
from siftline.sources import runs, sitemaps
from siftline.sources.logs import parse_lines, read_log


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], f"v {schema}").select(column.alias("x")).first().x


def test_aliases_go_by_presence(spark):
    lines = [
        '{"path": null, "uri": "/u", "status": 200}', '{"uri": "/u", "status": "2e2", "method": ""}', '{"url": "/u", "statusCode": "abc"}', '{"url": "/u", "response": {"status": 404, "bytes": "12"}}',
        '  {"request": {"path": "/r", "headers": {"user-agent": "GPTBot"}}, "status": 200.5}', '[{"path": "/"}]', "  ", None, '{"path": "/x", "status": 200, "@timestamp": "soon", "referer": "-"}',
    ]
    rows = parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_number long, value string")).orderBy("line_number").collect()
    assert [r.ok for r in rows] == [False, True, False, True, True, False, False, False, True]
    assert rows[1].observation.method == "GET" and rows[1].observation.status == 200
    assert rows[3].observation.bytes == 12 and rows[4].observation.agent.display_name == "GPTBot"
    assert rows[8].observation.ts_raw == "soon" and rows[8].observation.ts is None and rows[8].observation.referrer is None


def test_combined_format(spark):
    text = '1.2.3.4 - u [29/Feb/2024:23:30:00 -0230] "GET /a b?x HTTP/2.0" 404 - "https://r.example/" "Mozilla (ClaudeBot)" extra'
    o = parse_lines(spark.createDataFrame([(1, text)], "line_number long, value string")).first().observation
    assert (o.path, o.status, o.bytes, o.referrer, str(o.ts)) == ("/a b?x", 404.0, None, "https://r.example/", "2024-03-01 02:00:00")
    assert o.agent.behavior == "training"


HEAD = "1.2.3.4 - - [29/Feb/2024:23:30:00 +0000]"
ACCEPTED = {
    f'{HEAD} "GET / HTTP/1.1" 200 5 "-" "x"': ("GET", "/", 200.0, 5.0, None, "x"),
    f'{HEAD} "GET / HTTP/1.1" 200 5 "" ""': ("GET", "/", 200.0, 5.0, "", ""),
    f'  {HEAD}\t"GET\t/  HTTP/1.1"  200\t-  "-"  "x"  ': ("GET", "/", 200.0, None, None, "x"),
    f'{HEAD} "GET /a "b" HTTP/1.1" 200 5 "-" "x"': ("GET", '/a "b"', 200.0, 5.0, None, "x"),
    f'{HEAD} "GET / HTTP/1.0 HTTP/1.1" 200 5 "-" "x"': ("GET", "/", 200.0, 5.0, None, "x"),
    f'{HEAD} "GET / HTTP/ HTTP/1.1" 200 5 "-" "x"': ("GET", "/", 200.0, 5.0, None, "x"),
    f'{HEAD} "GET /x HTTP/1.1" 499 many "r" "x" "more" 1 "2': ("GET", "/x", 499.0, None, "r", "x"),
    f'{HEAD} "get /[x] HTTP/3" 000 0x10 "r" "x" ': ("get", "/[x]", 0.0, None, "r", "x"),
    '::1 a b [soon [now] "GET / HTTP/1.1" 200 5 "-" "x"': ("GET", "/", 200.0, 5.0, None, "x"),
}
REFUSED = [
    "x", '"', '""""""""""', HEAD, f'{HEAD} "GET / HTTP/1.1" 200 5 "-"', f'{HEAD} "GET / HTTP/1.1" 200 5 "-" "x', f'{HEAD} "GET / HTTP/1.1" 200 5 "-" "x"y',
    f'{HEAD} "GET / HTTP/1.1" 200 5 "-" "x""', f'{HEAD} "GET / HTTP/1.1"200 5 "-" "x"', f'{HEAD} "GET / HTTP/1.1" 200 5"-" "x"', f'{HEAD} "GET / HTTP/1.1" 200 5 "-""x"',
    f'{HEAD} "GET / HTTP/1.1" 20 5 "-" "x"', f'{HEAD} "GET / HTTP/1.1" 2000 5 "-" "x"', f'{HEAD} "GET / HTTP/1.1" 2x0 5 "-" "x"', f'{HEAD} "GET / HTTP/1.1" 200 "-" "x"', f'{HEAD} "GET / HTTP/1.1" 200 5 6 "-" "x"',
    f'{HEAD} "GET /" 200 5 "-" "x"', f'{HEAD} "GET HTTP/1.1" 200 5 "-" "x"', f'{HEAD} "GET / HTTP/" 200 5 "-" "x"', f'{HEAD} " GET / HTTP/1.1" 200 5 "-" "x"', f'{HEAD} "G"T / HTTP/1.1" 200 5 "-" "x"', f'{HEAD} "-" 400 5 "-" "x"',
    f'{HEAD}"GET / HTTP/1.1" 200 5 "-" "x"', '1.2.3.4 - [t] "GET / HTTP/1.1" 200 5 "-" "x"', '1.2.3.4 - - - [t] "GET / HTTP/1.1" 200 5 "-" "x"', '1.2.3.4 - - [] "GET / HTTP/1.1" 200 5 "-" "x"', '1.2.3.4 - - t "GET / HTTP/1.1" 200 5 "-" "x"',
    '1.2.3.4 - - [a]b] "GET / HTTP/1.1" 200 5 "-" "x"', '1.2.3.4 - - [a] b "GET / HTTP/1.1" 200 5 "-" "x"',
]


def test_lines_accepted_and_refused(spark):
    texts = [*ACCEPTED, *REFUSED]
    rows = {r.line_number: r for r in parse_lines(spark.createDataFrame(list(enumerate(texts)), "line_number long, value string")).collect()}
    for n, text in enumerate(texts):
        o = rows[n].observation
        got = o and (o.method, o.path, o.status, o.bytes, o.referrer, o.user_agent)
        assert got == ACCEPTED.get(text), text
        assert rows[n].reason == (None if text in ACCEPTED else "Line is neither supported JSON nor Apache/Nginx combined format.")


def test_lines_keep_every_character(spark):
    """Those that stand between the parts of a match meanwhile, too."""
    text = '1.2.3.4 - - [29/Feb/2024:23:30:00 +0000] "GET /a\x01b\x02a\x02\x01 HTTP/1.1" 200 7 "-" "x\x02b\x01"'
    o = parse_lines(spark.createDataFrame([(1, text)], "line_number long, value string")).first().observation
    assert (o.path, o.user_agent, o.bytes, o.referrer) == ("/a\x01b\x02a\x02\x01", "x\x02b\x01", 7.0, None)


def test_fields_not_asked_for_are_not_computed(spark):
    lines = spark.createDataFrame([(1, '{"path": "/x", "status": 200, "userAgent": "GPTBot"}'), (2, "x")], "line_number long, value string")
    narrow = parse_lines(lines, ("agent",))
    assert [(r.ok, r.observation and r.observation.agent.agent_id is not None) for r in narrow.orderBy("line_number").collect()] == [(True, True), (False, None)]
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "yyyy" not in plan and "referrer" not in plan


def test_line_numbers_are_dense(spark, tmp_path):
    for name, n in (("a.log", 30_000), ("b.log", 3)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = read_log(spark, str(tmp_path)).where(F.col("line_number") != F.split("value", " ")[1].cast("long"))
        assert rows.count() == 0 and read_log(spark, str(tmp_path)).count() == 30_003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_periods():
    from datetime import date

    p = acquisition_periods(28, date(2026, 7, 30))
    assert p["ga4"] == {"current": (date(2026, 7, 2), date(2026, 7, 29)), "previous": (date(2026, 6, 4), date(2026, 7, 1))}
    assert p["gsc"]["current"] == (date(2026, 6, 30), date(2026, 7, 27))
    for bad in (0, 367, True, 1.5):
        with pytest.raises(ValueError):
            acquisition_periods(bad, date(2024, 1, 1))


def test_search_pipeline(spark):
    current = [("ai traffic", "https://a.example/pricing", 5.0, 500.0, 7.0), ("ai traffic", "https://a.example/docs", 2.0, 150.0, 12.0), ("geo", "https://a.example/geo#x", 20.0, 150.0, 3.0), ("geo", "https://A.example/geo#y", 10.0, 50.0, 3.0), (" ", "https://a.example/", 1.0, 900.0, 5.0)]
    previous = [("ai traffic", "https://a.example/pricing", 20.0, 500.0, 6.0), ("ai traffic", "https://a.example/docs", 3.0, 120.0, 11.0), ("geo", "https://a.example/geo", 10.0, 180.0, 4.0), ("lost", "https://a.example/lost", 50.0, 600.0, 2.0)]
    cur, prev = (search.roll_up(spark.createDataFrame(x, "query string, page string, clicks double, impressions double, position double")) for x in (current, previous))
    landing = spark.createDataFrame([("a.example", "/pricing?utm=x", 60.0, 50.0, 5.0, 250.0), ("A.example", "/pricing/", 40.0, 20.0, None, 0.0), ("a.example", "/zero", 0.0, 0.0, 0.0, 0.0)], "host_name string, landing_page string, sessions double, engaged_sessions double, key_events double, total_revenue double")
    outcomes = search.landing_outcomes(landing)
    found = {r.page: r for r in search.page_findings(search.candidates(cur, prev), outcomes).collect()}
    pricing = found["https://a.example/pricing"]
    assert (pricing.priority, pricing.signals, pricing.click_change, pricing.sessions, pricing.engagement_rate) == ("high", ["low_ctr", "striking_distance", "declining_clicks"], -15.0, 100.0, 0.7)
    assert len(pricing.evidence_refs) == 3 and "https://a.example/geo" not in found
    assert outcomes.where("page_key = 'a.example/zero'").first().engagement_rate is None
    assert [r["query"] for r in search.overlaps(cur).select("query").distinct().collect()] == ["ai traffic"]
    moved = search.movements(cur, prev)
    assert search.winners(moved).first().query == "geo" and search.losers(moved).first().click_change == -15.0
    assert search.previous_only(cur, prev).first().query == "lost"
    with pytest.raises(ValueError, match="sessions"):
        search.landing_outcomes(landing.drop("sessions"))


def test_paging(spark):
    rows = spark.range(1, 6).withColumnRenamed("id", "ordinal")
    for kind, most, reported, want in (("gsc", 10, None, (5, 3, False)), ("gsc", 4, None, (4, 2, True)), ("gsc", 6, None, (5, 3, False)), ("ga4", 10, 5, (5, 3, False)), ("ga4", 4, 5, (4, 2, True)), ("ga4", 5, 5, (5, 3, True))):
        seen = coverage.paged(rows, most, 2, kind, reported)[1].first()
        assert (seen.observed_rows, seen.pages_fetched, seen.truncated) == want, (kind, most)
    parts = spark.createDataFrame([("a", 1, 1, None, False, True, ["x"]), ("a", 2, 2, 0, True, False, ["x", "y"])], "s string, requested long, observed long, omitted long, truncated boolean, partial boolean, incomplete_reasons array<string>")
    assert tuple(coverage.combined(parts, ["s"]).first()) == ("a", 3, 3, None, True, True, ["x", "y"])


HTML = """<!doctype html><html lang=en><head><title>A &amp; B</title><base href="/sub/"><meta name=ROBOTS content="None"><link rel=canonical href="x#f">
<script type="application/ld+json">[{"@type":"A","z":{"@type":["B",1],"@id":"i"}}]</script><template><title>no</title></template></head>
<body><h1>Big <b>news</b></h1><a href="y#z" rel="nofollow">go <i>on</i></a><a href="mailto:q">m</a><a>none</a><a href="https://other.example">o</a><svg><title>icon</title></svg><link rel=canonical href="/late">"""


def test_html_facts():
    f = html_facts.extract(HTML, "https://a.example/p")
    assert f["titles"] == ["A & B", "icon"] and f["html_lang"] == "en" and f["headings"] == [{"level": 1, "text": "Big news"}]
    assert f["meta_robots"][0]["directives"] == ["none", "noindex", "nofollow"]
    assert [(c["resolved_url"], c["location"]) for c in f["canonicals"]] == [("https://a.example/sub/x#f", "head"), ("https://a.example/late", "body")]
    assert [(x["resolved_url"], x["kind"]) for x in f["links"]] == [("https://a.example/sub/y", "internal"), ("mailto:q", "non_http"), (None, "invalid"), ("https://other.example/", "external")]
    assert f["links_nofollow"] == 1 and f["structured_data"] == [{"valid": True, "types": ["A", "B"], "ids": ["i"]}]
    assert html_facts.extract("<a href='/'>" * 501, "https://a.example/")["links_truncated"]
    for odd in ("", "<", "<a", "<!--", "<title>", "\x00", "<script>", "</p></a></template>", "<template><template></template>x"):
        html_facts.extract(odd, "https://a.example/")


def test_sitemaps_keep_what_came_before_an_error():
    assert sitemaps.parse("<urlset><url><loc>https://a.example/1</loc></url><oops", 5)["retained_entries"] == 1
    many = "<urlset>" + "<url><loc>https://a.example/</loc></url>" * 1001 + "</urlset>"
    got = sitemaps.parse(many, 1000)
    assert (got["total_entries"], got["truncated"], got["errors"]) == (1001, True, [])


def test_normalize():
    for url, want in (("HTTP://A.Example:80/a/../b c?q=1 2#f", "http://a.example/b%20c?q=1%202"), ("https://u@a.example/", None), ("https://a.example:8443/", None), ("ftp://a.example/", None), ("https:///x", None), (None, None), ("https://a.example/./x/", "https://a.example/x/")):
        assert urls.normalize(url) == want, url
    assert urls.normalize("x", "https://a.example/y/z") == "https://a.example/y/x"


def test_crawl_caps_and_scope(spark):
    seeds = spark.createDataFrame([("s", "https://a.example/")], "site string, url string")
    listed = spark.createDataFrame([("s", 1, "https://www.a.example/w", "2024-01-01"), ("s", 2, "https://b.example/", None), ("s", 3, "https://a.example/", "2024-02-02"), ("s", 4, "https://a.example/f.pdf", None)], "site string, ordinal long, url string, lastmod string")
    links = spark.createDataFrame([("s", "https://a.example/", i, f"https://a.example/q?{i}") for i in range(9)] + [("s", "https://a.example/", 20, "https://a.example/cdn-cgi/x"), ("s", "https://a.example/q?0", 1, "https://a.example/deep")], "site string, page string, position int, url string")
    got = {r.url: r for r in crawl.discover(seeds, listed, links, 500).collect()}
    assert set(got) == {"https://a.example/", "https://www.a.example/w", "https://a.example/deep", *(f"https://a.example/q?{i}" for i in range(5))}
    assert got["https://a.example/"].sources == ["seed", "sitemap"] and got["https://a.example/"].lastmod == "2024-02-02"
    assert got["https://a.example/deep"].depth == 2
    few = crawl.discover(seeds, listed, links, 2)
    assert few.where("audited").count() == 2 and "https://a.example/deep" not in {r.url for r in few.collect()}
    with pytest.raises(ValueError):
        crawl.discover(seeds, listed, links, 501)


def test_sitemap_tree(spark):
    roots = spark.createDataFrame([("s", "https://a.example/m/i.xml", 1)], "site string, url string, ordinal int")
    kids = spark.createDataFrame([("s", "https://a.example/m/i.xml", "https://a.example/m/1.xml", 1), ("s", "https://a.example/m/i.xml", "https://a.example/2.xml", 2), ("s", "https://a.example/m/1.xml", "https://a.example/m/i.xml", 1), ("s", "https://a.example/m/1.xml", "https://a.example/m/x/3.xml", 2)], "site string, url string, child string, position int")
    assert [(r.url[-5:], r.ordinal) for r in crawl.sitemap_tree(roots, kids).orderBy("ordinal").collect()] == [("i.xml", 1), ("1.xml", 2), ("3.xml", 3)]


def run(k):
    return [("https://a.example/", f"run-{k}", f"2024-01-{k:02d}")]


def test_queue_lifecycle(spark):
    runs_schema, found_schema = "site string, run_id string, completed_at string", "site string, source string, kind string, comparison_key string, priority string"
    absent_schema = "site string, source string, comparison_key string, latest_run_id string, verdict string"
    site = "https://a.example/"
    state, syncs = spark.createDataFrame([], queue_state.STATE), spark.createDataFrame([], queue_state.SYNCS)

    def step(k, found, absent=()):
        nonlocal state, syncs
        state, syncs, out = queue_state.sync(state, syncs, spark.createDataFrame(run(k), runs_schema), spark.createDataFrame([(site, s, "k", key, "high") for s, key in found], found_schema), spark.createDataFrame([(site, *a) for a in absent], absent_schema), f"t{k}")
        state, syncs = state.checkpoint(), syncs.checkpoint()
        return {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}

    items = [("technical", "a"), ("google-opportunity", "g")]
    assert step(1, items) == {"created": 2}
    assert step(1, items) == {}
    assert step(2, items) == {"updated": 2} and {r.occurrences for r in state.collect()} == {2}
    a = state.where("comparison_key = 'a'").first().id
    state = queue_state.update_status(state, a, "planned", " soon ", "t2b").checkpoint()
    gone = [("technical", "a", "run-2", "resolved"), ("google-opportunity", "g", "run-2", "incomparable")]
    assert step(3, [], gone) == {"verified": 1, "unknown": 1}
    row = state.where("comparison_key = 'a'").first()
    assert (row.status, row.observation_state, row.verified_older, row.verified_newer, len(row.history)) == ("verified", "not_observed", "run-2", "run-3", 4)
    assert step(4, [], gone) == {"unchanged": 2}
    assert state.where("comparison_key = 'g'").first().status == "open"
    assert step(5, items) == {"reopened": 1, "updated": 1} and state.where("comparison_key = 'a'").first().status == "open"
    assert step(6, []) == {"unknown": 2}  # no comparison on record
    with pytest.raises(queue_state.OutOfOrder):
        step(2, [])
    for status, reason in (("verified", "x"), ("open", " "), ("open", "x" * 501)):
        with pytest.raises(ValueError):
            queue_state.update_status(state, a, status, reason, "t")
    with pytest.raises(LookupError):
        queue_state.update_status(state, "opp_none", "open", "x", "t")
    same = queue_state.update_status(state, a, "open", "x", "t9")
    assert same.where(F.col("id") == a).first().history[-1].event == "status_updated"


def test_history_is_bounded(spark):
    history = [("t", "observed", "r", "open", "open", str(i)) for i in range(100)]
    state = spark.createDataFrame([("opp_x", "s", "technical", "k", "c", "high", "open", None, "present", "", "", "r", 1, None, None, None, history)], queue_state.STATE)
    got = queue_state.update_status(state, "opp_x", "planned", "y", "t2").first().history
    assert len(got) == 100 and got[-1].reason == "y" and got[0].reason == "1"


def test_versions_and_runs(spark, tmp_path):
    folder = f"file://{tmp_path}/q"
    assert queue_state.read_version(spark, folder).count() == 0
    for n in (1, 2):
        queue_state.write_version(spark.createDataFrame([(f"s{n}", "r", "c", "y")], queue_state.SYNCS), folder)
    assert queue_state.read_version(spark, folder, queue_state.SYNCS).first().site == "s2"
    audits = spark.createDataFrame([("r1", "2", "1", "S", 5)], "run_id string, saved_at string, completed_at string, site string, n int")
    for rows in (audits, audits.withColumn("n", F.lit(6))):
        runs.save(rows, f"file://{tmp_path}/runs")
    got = runs.checked(runs.read(spark, f"file://{tmp_path}/runs")).collect()
    assert len(got) == 1 and '"n":5' in got[0].audit and got[0].warning is None
    with pytest.raises(ValueError, match="cookie"):
        runs.as_runs(audits.withColumn("http", F.struct(F.lit("x").alias("cookie"))))


def test_coverage_of_comparison(spark):
    base = {"site": "s", "url": "https://a.example/", "config": "c", "partial": False, "truncated": False}
    rows = [{**base, "run_id": "1"}, {**base, "run_id": "2", "url": "https://a.example/#x"}, {**base, "run_id": "3", "partial": True}, {**base, "run_id": "4", "config": None}]
    table = spark.createDataFrame(rows, "site string, url string, config string, partial boolean, truncated boolean, run_id string")
    pairs = spark.createDataFrame([("s", "1", x) for x in "234"], "site string, older string, newer string")
    got = {r.newer: (r.comparable, r.complete, len(r.reasons)) for r in compare.coverage(pairs, table).collect()}
    assert got == {"2": (True, True, 0), "3": (True, False, 1), "4": (False, False, 1)}


def test_registry(spark):
    assert capabilities.describe("site.crawl")["parameters"]["limit"]["high"] == 500
    crawl_it = capabilities.REGISTRY["site.crawl"]
    with pytest.raises(capabilities.CapabilityError) as e:
        crawl_it({}, limit=5)
    assert e.value.code == "MISSING_INPUT"
    with pytest.raises(capabilities.CapabilityError):
        crawl_it({x: None for x in crawl_it.inputs}, limit=0)


def test_full_audit(spark):
    body = '<html><head><title>T</title></head><body><a href="/b">b</a></body></html>'
    schema = "site string, page_id long, requested_url string, final_url string, status int, redirects array<struct<url:string>>, content_type string, x_robots_tag array<string>, body string, disallowed boolean"
    fetches = spark.createDataFrame([("s", i, f"https://a.example/{p}", f"https://a.example/{p}", st, [], "text/html", [], body, False) for i, (p, st) in enumerate([("", 200), ("b", 404)])], schema)
    inputs = {
        "fetches": fetches, "seeds": spark.createDataFrame([("s", "https://a.example/")], "site string, url string"), "sitemap_entries": spark.createDataFrame([], "site string, ordinal long, url string, lastmod string"),
        "sites": spark.createDataFrame([("s", "https://a.example/", False, 0, True, ["ev_sitemap_x"])], "site string, root string, sitemap_complete boolean, valid_sitemaps int, crawl_complete boolean, bad_sitemaps array<string>"),
    }
    out = capabilities.REGISTRY["site.full_audit"](inputs, top=50)
    rules = {r.rule_id.split(":")[0] for r in out["site_findings"].collect()}
    assert rules == {"SITEMAP_FETCH_OR_PARSE_INCOMPLETE_V1", "DUPLICATE_TITLE_IN_AUDITED_SET_V1", "AUDITED_INTERNAL_LINK_TARGET_ERROR_V1"}
    ranked = out["priorities"].orderBy("rank").collect()
    assert ranked[0].priority == "critical" and len({r.finding_id for r in ranked}) == len(ranked)
    with pytest.raises(capabilities.CapabilityError):
        capabilities.REGISTRY["site.full_audit"](inputs, google="required")


def test_store_has_one_writer_and_few_versions(spark, tmp_path):
    folder, row = f"file://{tmp_path}/q", lambda n: spark.createDataFrame([(f"s{n}", "r", "c", "y")], queue_state.SYNCS)
    first = queue_state.write_version(row(0), folder, expected=None)
    with pytest.raises(queue_state.Conflict):
        queue_state.write_version(row(1), folder, expected=None)
    with queue_state.locked(spark, folder), pytest.raises(queue_state.Conflict):
        queue_state.write_version(row(2), folder)
    assert queue_state.current_version(spark, folder) == first
    for n in range(3, 8):
        last = queue_state.write_version(row(n), folder, expected=queue_state.current_version(spark, folder))
    assert queue_state.read_version(spark, folder, queue_state.SYNCS).first().site == "s7" and queue_state.current_version(spark, folder) == last
    assert sum(p.name.startswith("v-") for p in (tmp_path / "q").iterdir()) == queue_state.KEEP and not (tmp_path / "q/LOCK").exists()


def test_listed_option():
    assert capabilities.listed_option(None, ["a"]) == ["a"] and capabilities.listed_option("none", ["a"]) == [] and capabilities.listed_option(" x, ,y ", []) == ["x", "y"]
    with pytest.raises(capabilities.CapabilityError):
        capabilities.listed_option(" , ", [])


def test_public_names():
    import siftline

    assert all(hasattr(siftline, name) for name in siftline.__all__) and siftline.traffic.counters


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from siftline.functions.shared import shared_root

    context = N(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://a:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(N(conf={}, sparkContext=context))


def test_site_findings_cut_long_evidence(spark):
    """45 pages on one title and one sitemap: 20 and 40 are cited, in page order, and all are counted; the html is read once."""
    from siftline.plans import queries_site

    rows = spark.range(45).select(F.lit("s").alias("site"), F.concat(F.lit("https://s.example/"), "id").alias("url"), F.col("id").alias("ordinal"), F.array(F.lit("sitemap")).alias("sources"), F.concat(F.lit("https://s.example/"), "id").alias("final_url"), F.lit(200).alias("status"),
                                  F.array(F.struct(F.lit("https://s.example/").alias("url"), F.lit(301).alias("status"), F.lit("x").alias("location"))).alias("redirects"), F.array().cast("array<string>").alias("x_robots_tag"), html_facts.html_facts(F.lit("<title>T</title>"), F.lit("https://s.example/")).alias("facts"), F.lit(None).cast("string").alias("error"))
    sites = spark.createDataFrame([("s", "https://s.example/", True, 1, True, [])], "site string, root string, sitemap_complete boolean, valid_sitemaps int, crawl_complete boolean, bad_sitemaps array<string>")
    got = {r.rule_id.split(":")[0]: r for r in crawl.site_findings(rows, sites).collect()}
    assert set(got) == {"SITEMAP_URL_REDIRECTS_V1", "DUPLICATE_TITLE_IN_AUDITED_SET_V1", "UNLINKED_IN_COMPLETE_STATIC_CRAWL_V1"}
    assert {k: (r.pages, len(r.evidence_refs)) for k, r in got.items()} == {"SITEMAP_URL_REDIRECTS_V1": (45, 40), "DUPLICATE_TITLE_IN_AUDITED_SET_V1": (45, 20), "UNLINKED_IN_COMPLETE_STATIC_CRAWL_V1": (45, 40)}
    first = rows.orderBy("ordinal").limit(2).select(crawl.page_evidence_id(F.col("url")).alias("ref")).collect()
    assert got["SITEMAP_URL_REDIRECTS_V1"].evidence_refs[:2] == [r.ref for r in first]
    plan = queries_site.site_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # it lies before the narrow table


def test_logs_within_a_root(spark, tmp_path):
    root = tmp_path / "root"
    (root / "in").mkdir(parents=True)
    (root / "in/a.log").write_text("x\n")
    (tmp_path / "secret.log").write_text("y\n")
    (root / "in/way").symlink_to(tmp_path)
    assert [r.value for r in read_log(spark, "in/a.log", str(root)).collect()] == ["x"]
    for path in ("../secret.log", "in/way/secret.log", str(tmp_path / "secret.log")):
        with pytest.raises(ValueError, match="outside"):
            read_log(spark, path, str(root))


def test_runs_that_are_too_large_or_come_twice(spark, tmp_path, monkeypatch):
    folder, names = f"file://{tmp_path}/runs", "run_id string, saved_at string, completed_at string, site string, text string"
    monkeypatch.setattr(runs, "MAX_BYTES", 1000)
    rows = [("a", "2", "2", "s", "later"), ("a", "1", "1", "s", "first"), ("b", "1", "1", "s", "x" * 2000), ("c", "1", "1", "s", "y")]
    rejects = runs.save(spark.createDataFrame(rows, names), folder)
    assert [(r.run_id, r.bytes > 1000) for r in rejects.collect()] == [("b", True)]
    stored = {(r.run_id, r.saved_at) for r in runs.read(spark, folder).collect()}
    assert stored == {("a", "1"), ("c", "1")} and runs.read(spark, folder).count() == 2


def test_changes_of_one_id_in_a_batch(spark, tmp_path):
    from siftline.operators import changes

    row = lambda at, note: ("c1", at, "opp_1", "s", ["https://s.example/"], "content", None, None, None, None, note, None)
    for _ in range(2):
        assert changes.save(spark.createDataFrame([row("2", "later"), row("1", "first"), row("1", "first")], changes.CHANGES), f"file://{tmp_path}/c").count() == 0
    assert [r.note for r in changes.read(spark, f"file://{tmp_path}/c").collect()] == ["first"]


def test_a_dead_writers_lock(spark, tmp_path, monkeypatch):
    folder, row = f"file://{tmp_path}/q", spark.createDataFrame([("s", "r", "c", "y")], queue_state.SYNCS)
    queue_state.write_version(row, folder)
    (tmp_path / "q/LOCK").write_text("")
    with pytest.raises(queue_state.Conflict):
        queue_state.write_version(row, folder)
    monkeypatch.setattr(queue_state, "LEASE_MS", -1000)
    assert queue_state.write_version(row, folder) == queue_state.current_version(spark, folder)
