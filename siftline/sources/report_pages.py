"""Stored report pages as a data source: a partition a page, filters in the reader, and pages that are never opened.

A report is kept as its source gave it, in pages: ``pages/offset=N/`` holds one document, with the headers of its columns and rows of values, and ``index/`` a
line for each page with its offset, its count of rows, the count that the source reported, why it may be incomplete, and the least and largest value of each
column. ``write`` makes both from rows and their ordinals; no page holds more than its size.

``scan`` gives the rows. Its schema is that of the headers. The row cap ends the read where paging would end: at the page that reaches it, or behind the first
short page. Of the pages before that, those whose index shows that no row can pass the filters are not opened, and in the others rows are dropped
before they leave the reader. Equality, comparisons, membership, prefixes, suffixes, containment and their negations are pushed; patterns stay with Spark.

``coverage`` tells of the pages that paging asks for, whatever the filters: rows, pages, truncation, reasons.

Cases: a dimension is never null ("" stands for a missing one, 0 for a missing metric); a report without rows has one page; a folder without a
report is an error. Files are reached by pyarrow's file systems (local, HDFS, object stores), as this reader runs in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from siftline.functions.shared import stored
from siftline.functions.ship import ship
from siftline.sources.runs import as_json

FORMAT, PUSHDOWN = "siftline_report", "spark.sql.python.filterPushdown.enabled"
#: Rows handed to Spark at a time.
BATCH = 4096


def write(rows: DataFrame, folder: str, dimensions: list[str], metrics: list[str], page_size: int, reported: int | None = None, reasons: tuple[str, ...] = ()) -> None:
    """rows (ordinal from 1, dimensions, metrics) as pages of page_size. reported: the source's own count; reasons: why it may be incomplete."""
    names = [*dimensions, *metrics]
    values = F.struct("ordinal", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in dimensions], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in metrics])
    paged = rows.select((F.floor((F.col("ordinal") - 1) / page_size) * page_size).cast("long").alias("offset"), values.alias("r"))
    least = [f(f"r.{c}").alias(f"{k}_{c}") for c in names for k, f in (("low", F.min), ("high", F.max))]
    # a page is bounded by its size, so its rows may be one list
    pages = stored(paged.groupBy("offset").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("r")).alias("rows"), *least), "pages")
    headers = [F.array(*[F.lit(c) for c in x]).cast("array<string>") for x in (dimensions, metrics)]
    cells = F.transform("rows", lambda r: F.array(*[r[c].cast("string") for c in names]))
    document = pages.select("offset", F.lit(page_size).alias("page_size"), headers[0].alias("dimensions"), headers[1].alias("metrics"), cells.alias("rows"))
    as_json(document.withColumn("start", F.col("offset"))).withColumn("offset", F.get_json_object("json", "$.start")).write.partitionBy("offset").text(f"{folder}/pages")
    known = F.lit(reported).cast("long").alias("reported")
    said = F.array(*[F.lit(r) for r in reasons]).cast("array<string>").alias("reasons")
    stats = [F.struct(*[F.col(f"{k}_{c}").alias(c) for c in names]).alias(k) for k in ("low", "high")]
    index = pages.select("offset", "n", F.lit(page_size).alias("page_size"), known, said, headers[0].alias("dimensions"), headers[1].alias("metrics"), *(stats if names else []))
    if pages.isEmpty():
        index = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("n"), F.lit(page_size).alias("page_size"), known, said, headers[0].alias("dimensions"), headers[1].alias("metrics"))
    as_json(index).write.text(f"{folder}/index")


def _lines(folder: str) -> Iterator[dict]:
    files, path = arrow_fs.FileSystem.from_uri(folder)
    for info in files.get_file_info(arrow_fs.FileSelector(path)):
        if info.base_name.startswith("part-"):
            with files.open_input_stream(info.path) as data:
                yield from (json.loads(line) for line in data.read().splitlines() if line)


def _index(folder: str) -> list[dict]:
    return sorted(_lines(f"{folder}/index"), key=lambda p: p["offset"])


def asked(index: list[dict], max_rows: int) -> list[dict]:
    """The pages that paging reads: up to the cap, and to the first short one."""
    out = []
    for page in index:
        if page["offset"] >= max_rows or page["offset"] != sum(p["n"] for p in out):
            break
        out.append(page)
        if page["n"] < page["page_size"]:
            break
    return out


#: For each filter: whether a value passes it, and whether a page whose values lie from low to high may hold one that does.
KINDS = {
    EqualTo: (lambda v, x: v == x, lambda low, high, x: low <= x <= high), EqualNullSafe: (lambda v, x: v == x, lambda low, high, x: x is not None and low <= x <= high),
    GreaterThan: (lambda v, x: v > x, lambda low, high, x: high > x), GreaterThanOrEqual: (lambda v, x: v >= x, lambda low, high, x: high >= x),
    LessThan: (lambda v, x: v < x, lambda low, high, x: low < x), LessThanOrEqual: (lambda v, x: v <= x, lambda low, high, x: low <= x),
    In: (lambda v, x: v in x, lambda low, high, x: any(y is not None and low <= y <= high for y in x)),
    StringStartsWith: (lambda v, x: v.startswith(x), lambda low, high, x: low[: len(x)] <= x <= high[: len(x)]),
    StringEndsWith: (lambda v, x: v.endswith(x), None), StringContains: (lambda v, x: x in v, None),
    IsNotNull: (lambda v, x: True, None), IsNull: (lambda v, x: False, lambda low, high, x: False),
}


def _taken_apart(f: Filter) -> tuple[type, bool, str, object] | None:
    """kind, negated, column and value of a filter that can be pushed."""
    inner, negated = (f.child, True) if isinstance(f, Not) else (f, False)
    column = getattr(inner, "attribute", None)
    if type(inner) not in KINDS or column is None or len(column) != 1:
        return None
    return type(inner), negated, column[0], getattr(inner, "value", None)


class ReportReader(DataSourceReader):
    def __init__(self, folder: str, max_rows: int, schema: StructType):
        self.folder, self.max_rows, self.names, self.kinds = folder, max_rows, schema.names, [f.dataType.simpleString() for f in schema]
        self.pushed: list[tuple[type, bool, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = _taken_apart(f)
            if found is None:
                yield f
            else:
                self.pushed.append(found)

    def _may(self, page: dict) -> bool:
        if not page["n"]:
            return False
        for kind, negated, column, value in self.pushed:
            test = KINDS[kind][1]
            if test is None:
                continue
            low, high = page["low"][column], page["high"][column]
            if negated:
                if kind is EqualTo and low == high == value:
                    return False
            elif not test(low, high, value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(page["offset"]) for page in asked(_index(self.folder), self.max_rows) if self._may(page)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        for page in _lines(f"{self.folder}/pages/offset={partition.value}"):
            place = {c: i for i, c in enumerate([*page["dimensions"], *page["metrics"]])}
            numbers = set(page["metrics"])
            cells = {c: [float(r[i]) if c in numbers else r[i] for r in page["rows"][: self.max_rows - partition.value]] for c, i in place.items()}
            keep = range(len(next(iter(cells.values()), [])))
            for kind, negated, column, value in self.pushed:
                passes, own = KINDS[kind][0], cells[column]
                keep = [i for i in keep if passes(own[i], value) is not negated]
            for at in range(0, len(keep), BATCH):
                some = keep[at : at + BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([cells[c][i] for i in some], pa.float64() if k == "double" else pa.string()) for c, k in zip(self.names, self.kinds, strict=True)], self.names)


class ReportSource(DataSource):
    """Options: path, max_rows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        page = _index(self.options["path"])[0]
        return ", ".join([*(f"`{c}` string" for c in page["dimensions"]), *(f"`{c}` double" for c in page["metrics"])])

    def reader(self, schema: StructType) -> ReportReader:
        return ReportReader(self.options["path"], int(self.options.get("max_rows", 50_000)), schema)


def scan(spark: SparkSession, folder: str, max_rows: int = 50_000) -> DataFrame:
    """The report's rows up to max_rows. Filters are pushed where the session has ``PUSHDOWN`` set; this sets it where the session says nothing."""
    ship(spark)
    if spark.conf.get(PUSHDOWN, None) in (None, "false") and not spark.sparkContext.getConf().contains(PUSHDOWN):
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ReportSource)
    return spark.read.format(FORMAT).option("path", folder).option("max_rows", max_rows).load()


def condition(column: Column, operator: str, value: str) -> Column:
    """``operators.search.search_filter`` for a column without nulls, in the form that can be pushed."""
    plain = {"equals": column == value, "contains": column.contains(value), "includingRegex": column.rlike(value), "notEquals": column != value, "notContains": ~column.contains(value), "excludingRegex": ~column.rlike(value)}
    if operator not in plain:
        raise ValueError(f"unknown operator {operator}")
    return plain[operator]


def coverage(spark: SparkSession, folder: str, max_rows: int = 50_000) -> DataFrame:
    """One row about the pages that paging asks for: requested_rows, observed_rows, pages_fetched, page_size, truncated, incomplete_reasons."""
    index = _index(folder)
    read = asked(index, max_rows)
    n, size, reported = min(sum(p["n"] for p in read), max_rows), read[0]["page_size"], read[0].get("reported")
    # after full pages one more is asked for, unless the cap or the reported count is reached
    again = n % size == 0 and n < max_rows and not (reported is not None and n >= reported)
    truncated = n == max_rows or (reported is not None and n < reported)
    reasons = [*dict.fromkeys(r for p in read for r in p["reasons"]), *([f"row cap reached: {max_rows}"] if truncated else [])]
    pages = -(-n // size) + again
    row = (max_rows, n, pages, size, truncated, reasons)
    return spark.createDataFrame([row], "requested_rows long, observed_rows long, pages_fetched long, page_size long, truncated boolean, incomplete_reasons array<string>")
