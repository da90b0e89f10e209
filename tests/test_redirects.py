"""Chains of stored responses against following them one by one."""

import random

from siftline.functions.urls import normalize
from siftline.operators import redirects

ROW = "url string, status int, location string"


def slow(rows, most=5):
    table = {}
    for url, status, location in rows:
        if url is not None and (url not in table or (status, location is not None, location) < (table[url][0], table[url][1] is not None, table[url][1])):
            table[url] = (status, location)
    bare = lambda u: u.split("/")[2].removeprefix("www.")
    out = {}
    for start in table:
        at, seen, hops = start, set(), []
        while True:
            if at in seen:
                out[start] = (None, None, None, "REDIRECT_LOOP")
                break
            seen.add(at)
            if at not in table:
                out[start] = (None, None, None, "FETCH_FAILED")
                break
            status, location = table[at]
            if status not in redirects.STATUSES or location is None:
                out[start] = (at, status, hops, None)
                break
            target = normalize(location, at)
            error = "REDIRECT_LIMIT_EXCEEDED" if len(hops) >= most else "INVALID_REDIRECT" if target is None else None
            error = error or ("HTTPS_DOWNGRADE_BLOCKED" if at.startswith("https:") and target.startswith("http:") else "CROSS_HOST_REDIRECT_BLOCKED" if bare(at) != bare(target) else None)
            if error:
                out[start] = (None, None, None, error)
                break
            hops = [*hops, (at, status, target)]
            at = target
    return out


def got(rows):
    return {r.requested_url: (r.final_url, r.status, r.redirects and [tuple(h) for h in r.redirects] if r.error is None and r.redirects else ([] if r.error is None else None), r.error) for r in rows.collect()}


def test_chains_of_every_length(spark):
    at = lambda n: f"https://a.example/{n}"
    for most in (1, 5, 6):
        rows = [(at(n), 301, at(n + 1)) for n in range(12)] + [(at(12), 200, None)]
        assert got(redirects.followed(spark.createDataFrame(rows, ROW), most)) == slow(rows, most)
        for size in range(1, 9):  # loops
            rows = [(at(n), 302, at((n + 1) % size)) for n in range(size)] + [(at(100), 302, at(0))]
            if size in (1, 2, 5, 6, 7, 8):
                assert got(redirects.followed(spark.createDataFrame(rows, ROW), most)) == slow(rows, most)


def test_odd_locations(spark):
    at = "https://www.a.example/x"
    rows = [(at, 301, "../y?q=a b"), ("https://www.a.example/y?q=a%20b", 307, "//a.example/z#part"), ("https://a.example/z", 304, "/never"), ("https://b.example/", 303, None), ("https://c.example/", 301, "ftp://c.example/"), ("https://d.example/", 308, "http://d.example/")]
    rows += [("https://e.example/", 302, "https://f.example/"), ("https://g.example/", 301, "/gone"), ("https://h.example/", 301, "HTTPS://H.example:443/i"), ("https://h.example/i", 200, None), (None, 301, at), ("https://b.example/", 200, None), ("https://k.example/", None, "/x")]
    want = slow([r for r in rows if r[1] is not None]) | {"https://k.example/": ("https://k.example/", None, [], None)}
    assert got(redirects.followed(spark.createDataFrame(rows, ROW))) == want
    assert want[at][0] == "https://a.example/z" and len(want[at][2]) == 2


def test_random_graphs_and_a_target_of_many(spark):
    rng = random.Random(4)
    rows = [(f"https://a.example/{n}", rng.choice([200, 301, 302, 404]), rng.choice([None, f"https://a.example/{rng.randrange(320)}", "/0"])) for n in range(300)]
    assert got(redirects.followed(spark.createDataFrame(rows, ROW))) == slow(rows)


def test_empty(spark):
    assert redirects.followed(spark.createDataFrame([], ROW)).count() == 0
