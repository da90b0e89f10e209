"""Nothing that grows with the input is broadcast, and a report's rows are made once."""

import pytest

from siftline.sources import report_pages
from siftline.sources.adapters import view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["v_gsc", "v_ga4"])
def test_growing_tables_are_not_broadcast(spark, name):
    assert "Broadcast" not in view(spark, SF, name)._jdf.queryExecution().executedPlan().toString()


def test_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(1, 101).selectExpr("id AS ordinal", "'q' AS query", "1.0 AS clicks").mapInPandas(counted, "ordinal long, query string, clicks double")
    report_pages.write(rows, f"file://{tmp_path}/r", ["query"], ["clicks"], 30)
    assert made.value == 100 and report_pages.scan(spark, f"file://{tmp_path}/r").count() == 100


def test_urls_are_taken_apart_after_the_first_sums(spark):
    """A join on page must not bring the URL's expressions down to the single rows."""
    import re

    from siftline.operators import search

    rows = spark.createDataFrame([("q", "https://A.example/x#1", 1.0, 2.0, 3.0), (" q", "https://a.example/x", 1.0, 2.0, 5.0)] * 3, "query string, page string, clicks double, impressions double, position double")
    rolled = search.roll_up(rows)
    assert [tuple(r) for r in rolled.collect()] == [("q", "https://a.example/x", ["https://A.example/x#1", "https://a.example/x"], 6.0, 12.0, 0.5, 4.0)]
    moved = search.movements(rolled, search.roll_up(rows))
    plan = moved._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:+|-]*", line)[0])
    sums = [depth(x) for x in plan if " Aggregate " in f" {x}" and "raw" in x and "collect_set" not in x]
    assert sums and not [x for x in plan if "RLIKE" in x and depth(x) > max(sums)]
