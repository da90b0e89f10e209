"""Decisions by the trie against a regular expression for each URL and rule."""

import random
import re

from siftline.sources import robots


def slow(rules, target):
    found = []
    for directive, path, line in rules:
        bare = path.removesuffix("$")
        pattern = "^" + ".*".join(map(re.escape, bare.split("*"))) + ("$" if path.endswith("$") else "")
        if re.search(pattern, target):
            found.append((-len(path.replace("*", "")), directive != "allow", line, directive, path))
    return min(found, default=None)


def word(rng, n):
    return "".join(rng.choices("ab/", k=rng.randint(0, n)))


def test_the_trie():
    rng = random.Random(1)
    for _ in range(300):
        rules = [(rng.choice(["allow", "disallow"]), "/" + word(rng, 4) + rng.choice(["", "*", "$", "*" + word(rng, 3), "*" + word(rng, 2) + "$", "**" + word(rng, 2) + "*", "*$", "a.b?c"]), n) for n in range(rng.randint(0, 12))]
        own = robots.Rules(rules)
        for target in ["/", "", "/a.b?c", *("/" + word(rng, 9) for _ in range(20))]:
            assert own.best(target) == slow(rules, target), (rules, target)


def test_ten_thousand_rules(spark):
    rng = random.Random(2)
    rules = [(rng.choice(["allow", "disallow"]), f"/{rng.randrange(3000)}/{rng.choice(['', 'x', 'x*y', 'z$', '*/q'])}", n + 2) for n in range(10_000)]
    body = "User-agent: *\n" + "\n".join(f"{d}: {p}" for d, p, _ in rules)
    files = spark.createDataFrame([("big", body), ("none", "Sitemap: x")], "site string, body string")
    targets = [f"/{rng.randrange(3300)}/{rng.choice(['', 'x', 'xay', 'z', 'zz', 'a/q'])}" for _ in range(3000)]
    urls = spark.createDataFrame([(site, f"u{n}", t, n) for site in ("big", "none", "unknown") for n, t in enumerate(targets)] + [("big", "null", None, -1)], "site string, url string, target string, extra int")
    was, robots.SLICE = robots.SLICE, 500
    try:
        decided = robots.decide(urls, files)
        plan = decided._jdf.queryExecution().executedPlan().toString()
        rows = decided.collect()
    finally:
        robots.SLICE = was
    assert "RLIKE" not in plan and "FlatMapCoGroupsInPandas" in plan and len(rows) == urls.count()
    for r in rows:
        best = slow(rules, r.target) if r.site == "big" and r.target is not None and r.extra < 60 else None
        if r.site != "big" or r.target is None:
            assert (r.decision, r.directive) == ("allowed", None)
        elif r.extra < 60:
            assert (r.directive, r.rule_path, r.rule_line) == ((best[3], best[4], best[2]) if best else (None, None, None))
