"""Coverage: how much of a source was read, and why that isn't all. Unknown stays null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page sizes and the default cap of the two report sources.
MAX_PAGE = {"ga4": 250_000, "gsc": 25_000}
PAGE = {"ga4": 10_000, "gsc": 25_000}
MAX_ROWS = 50_000


def _positive(value: int, name: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValueError(f"{name} must be a positive whole number")
    return value


def paged(rows: DataFrame, max_rows: int = MAX_ROWS, page_size: int | None = None, kind: str = "gsc", reported: int | None = None, reasons: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows by their ordinal (from 1) as pages would return them, up to the cap; and one row of coverage.

    Reading stops at a short page or, if the source reports its count, when that is reached. A capped source is truncated if the
    last page was full; one that reports more rows than were read is truncated in any case.
    """
    size = min(_positive(page_size or PAGE[kind], "page_size"), MAX_PAGE[kind], _positive(max_rows, "max_rows"))
    kept = rows.where(F.col("ordinal") <= max_rows)
    n = F.count("*")
    known_end = n >= reported if reported is not None else F.lit(False)
    # after full pages one more is asked for, unless the cap or the reported count is reached
    again = (n % size == 0) & (n < max_rows) & ~known_end
    pages = (F.ceil(n / size) + again.cast("int")).cast("long")
    truncated = n == max_rows
    if reported is not None:
        truncated = truncated | (n < reported)
    said = F.concat(F.array(*[F.lit(r) for r in dict.fromkeys(reasons)]).cast("array<string>"), F.when(truncated, F.array(F.lit(f"row cap reached: {max_rows}"))).otherwise(F.array().cast("array<string>")))
    found = kept.agg(F.lit(max_rows).alias("requested_rows"), n.alias("observed_rows"), pages.alias("pages_fetched"), F.lit(size).alias("page_size"), truncated.alias("truncated"), said.alias("incomplete_reasons"))
    return kept, found.withColumn("partial", F.size("incomplete_reasons") > 0)


def ga4_reasons(thresholded: Column, other_row: Column) -> Column:
    """Why an analytics answer may be incomplete."""
    return F.array_compact(F.array(F.when(thresholded, "the source applied thresholds"), F.when(other_row, "the source put rows together in an (other) row")))


def gsc_reasons(data_state: Column, first_incomplete_date: Column, first_incomplete_hour: Column) -> Column:
    named = lambda c, text: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(text), c))
    return F.array_compact(F.array(
        F.when(data_state != "final", F.concat(F.lit("dataState="), data_state, F.lit(" can include incomplete data"))),
        named(first_incomplete_date, "first incomplete date: "), named(first_incomplete_hour, "first incomplete hour: "),
    ))


def combined(parts: DataFrame, by: list[str]) -> DataFrame:
    """Coverage of several sources as one: sums (omitted is null if any is unknown), either flag, and all reasons once."""
    known = F.count("omitted") == F.count("*")
    totals = parts.groupBy(*by).agg(
        F.sum("requested").alias("requested"), F.sum("observed").alias("observed"), F.when(known, F.sum("omitted")).alias("omitted"), F.bool_or("truncated").alias("truncated"), F.bool_or("partial").alias("partial"),
    )
    # each reason goes on once for each key, so that no list grows with the rows
    said = parts.select(*by, F.explode("incomplete_reasons").alias("_reason")).distinct().groupBy(*by).agg(F.array_sort(F.collect_set("_reason")).alias("incomplete_reasons"))
    said = said.withColumnsRenamed({c: f"_{c}" for c in by})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return totals.join(said, on, "left").select(*totals.columns, F.coalesce("incomplete_reasons", F.array().cast("array<string>")).alias("incomplete_reasons"))
