"""Report pages: the same rows as filters over the table, fewer pages opened, coverage as paging gives it."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import coverage, search
from siftline.sources import report_pages

ROWS = "ordinal long, page string, query string, clicks double, impressions double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(n, f"https://a.example/{n // 10:03}", None if n % 7 == 0 else f"q{n % 5}", float(n % 4), float(n)) for n in range(1, 96)], ROWS)


@pytest.fixture(scope="module")
def folder(rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('report')}/r"
    report_pages.write(rows, path, ["page", "query"], ["clicks", "impressions"], 20, reasons=("sampled",))
    return path


def plain(df):
    return sorted(tuple(r) for r in df.select("page", "query", "clicks", "impressions").collect())


def opened(df):
    return df.rdd.getNumPartitions()


def test_rows_and_schema(spark, rows, folder):
    found = report_pages.scan(spark, folder)
    assert [f.simpleString() for f in found.schema] == ["page:string", "query:string", "clicks:double", "impressions:double"]
    assert plain(found) == plain(rows.fillna("")) and opened(found) == 5


@pytest.mark.parametrize("operator", search.FILTER_OPERATORS)
@pytest.mark.parametrize(("column", "value"), [("page", "https://a.example/003"), ("query", "q2"), ("query", "")])
def test_operators(spark, rows, folder, operator, column, value):
    found = report_pages.scan(spark, folder).where(report_pages.condition(F.col(column), operator, value))
    assert plain(found) == plain(rows.fillna("").where(search.search_filter(F.col(column), operator, value)))


@pytest.mark.parametrize(("text", "pages"), [
    ("page = 'https://a.example/003'", 1), ("impressions >= 81", 1), ("impressions < 15 AND clicks = 2", 1), ("page IN ('https://a.example/000', 'https://a.example/009')", 2), ("page LIKE 'https://a.example/00%' AND impressions > 55", 3),
    ("page LIKE '%/007'", 5), ("query = 'q9'", 0), ("clicks <> 1", 5), ("query IS NULL", 0), ("impressions BETWEEN 30 AND 45", 2), ("page = 'x' OR impressions = 3", 5),
])
def test_pages_not_opened(spark, rows, folder, text, pages):
    found = report_pages.scan(spark, folder).where(text)
    # without pages Spark has one empty partition
    assert plain(found) == plain(rows.fillna("").where(text)) and opened(found) == max(pages, 1)


def test_the_plan_has_no_filter_left(spark, folder):
    plan = lambda text: report_pages.scan(spark, folder).where(text)._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan("page = 'x' AND query LIKE 'a%'") and ") Filter " in plan("page RLIKE 'x'")


@pytest.mark.parametrize(("max_rows", "size", "count"), [(50, 20, 95), (60, 20, 95), (95, 20, 95), (100, 20, 95), (1000, 19, 95), (7, 20, 95), (100, 20, 0), (40, 20, 40)])
def test_coverage_as_by_paging(spark, rows, tmp_path, max_rows, size, count):
    some = rows.where(F.col("ordinal") <= count)
    for name, reported in (("a", None), ("b", count), ("c", 200)):
        path = f"file://{tmp_path}/{name}"
        report_pages.write(some, path, ["page", "query"], ["clicks", "impressions"], size, reported, ("sampled",))
        mine = report_pages.coverage(spark, path, max_rows).first().asDict()
        kept, want = coverage.paged(some, max_rows, size, reported=reported, reasons=("sampled",))
        want = want.first().asDict()
        page_size = mine.pop("page_size")
        assert page_size == size
        if want.pop("page_size") == size:  # a cap below the size asks for smaller pages
            assert mine == {k: want[k] for k in mine}
        assert report_pages.scan(spark, path, max_rows).count() == kept.count()


def test_no_report(spark, tmp_path):
    with pytest.raises(Exception, match="No such file|does not exist|not found|cannot be|Cannot"):
        report_pages.scan(spark, f"file://{tmp_path}/none").count()
