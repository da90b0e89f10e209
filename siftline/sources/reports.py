"""Report sources as landing tables: self-describing analytics rows, search rows, inventories and stored fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.urls import boundary_host, document_url, host, scheme
from siftline.sources.logs import NUMBER

GA4 = "dimension_headers array<string>, metric_headers array<string>, row struct<dimension_values:array<string>,metric_values:array<string>>"
GSC = "keys array<string>, clicks double, impressions double, ctr double, position double"
FETCHES = """run_id string, requested_url string, final_url string, status int, redirects array<struct<url:string,status:int,location:string>>, content_type string,
content_length bigint, content_encoding string, x_robots_tag array<string>, body string, byte_length bigint, body_read string, sha256 string, duration_ms bigint,
error_code string, error_message string"""
# Names of analytics dimensions and metrics, and of the columns made of them.
DIMENSIONS = {"hostName": "host_name", "landingPagePlusQueryString": "landing_page", "sessionDefaultChannelGroup": "channel_group", "sessionSource": "source", "sessionMedium": "medium"}
METRICS = {"sessions": "sessions", "totalUsers": "total_users", "engagedSessions": "engaged_sessions", "keyEvents": "key_events", "totalRevenue": "total_revenue"}


def number_or_zero(text: Column) -> Column:
    """A spelled number, hexadecimal included; 0 for anything else, infinities and null."""
    t = F.trim(text)
    value = F.when(t.rlike(NUMBER), t.try_cast("double")).when(t.rlike("^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substring(t, F.lit(3), F.length(t)), 16, 10).cast("double"))
    return F.coalesce(F.when(F.abs(value) < float("inf"), value), F.lit(0.0))


def analytics_rows(raw: DataFrame, dimensions: tuple[str, ...], metrics: tuple[str, ...], strict: bool = False) -> DataFrame:
    """Values by the names in the headers. A name that is missing gives "" or 0, or with strict an error when the row is read."""
    pad = lambda values, names: F.slice(F.concat(F.coalesce(values, F.array().cast("array<string>")), F.array_repeat(F.lit(""), F.size(names))), F.lit(1), F.size(names))
    named = raw.withColumns({
        "_d": F.map_from_arrays("dimension_headers", pad(F.col("row.dimension_values"), F.col("dimension_headers"))),
        "_m": F.map_from_arrays("metric_headers", pad(F.col("row.metric_values"), F.col("metric_headers"))),
    })

    def value(of: str, name: str) -> Column:
        found = F.try_element_at(of, F.lit(name))
        return F.when(~F.map_contains_key(of, name), F.raise_error(F.lit(f"the report lacks the header {name}"))).otherwise(found) if strict else found

    columns = [F.coalesce(value("_d", n), F.lit("")).alias(DIMENSIONS[n]) for n in dimensions] + [number_or_zero(value("_m", n)).alias(METRICS[n]) for n in metrics]
    kept = [c for c in raw.columns if c not in ("dimension_headers", "metric_headers", "row")]
    return named.select(*kept, *columns)


def search_rows(raw: DataFrame) -> DataFrame:
    """Positional keys as query and page."""
    key = lambda n: F.coalesce(F.get("keys", F.lit(n)), F.lit(""))
    kept = [c for c in raw.columns if c != "keys"]
    return raw.select(*kept, key(0).alias("query"), key(1).alias("page"))


def inventory(accounts: DataFrame) -> DataFrame:
    """account, name, properties array<struct<property,name>> -> a row for each property; accounts without one give none."""
    return accounts.select("account", F.col("name").alias("account_name"), F.inline("properties")).withColumnRenamed("name", "property_name")


def digested(fetches: DataFrame) -> DataFrame:
    """Byte length and digest of bodies that were read."""
    return fetches.withColumns({"byte_length": F.octet_length("body").cast("bigint"), "sha256": F.sha2("body", 256)})


def redirects_admissible(requested: Column, redirects: Column, most: int = 5) -> Column:
    """No more than allowed, each to the same boundary, none from https to http, and none to a document seen before."""
    chain = F.concat(F.array(requested), F.transform(redirects, lambda r: r.location))
    steps = F.arrays_zip(F.slice(chain, F.lit(1), F.size(chain) - 1).alias("a"), F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))).alias("b"))
    fine = F.forall(steps, lambda s: F.coalesce((boundary_host(host(s.a)) == boundary_host(host(s.b))) & scheme(s.b).isin("http", "https") & ~((scheme(s.a) == "https") & (scheme(s.b) == "http")), F.lit(False)))
    documents = F.transform(chain, document_url)
    return (F.size(redirects) <= most) & fine & (F.size(F.array_distinct(documents)) == F.size(documents))


def first_of_each(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Of rows with one key the first counts: an aggregate, so that no key's rows are sorted."""
    cells = [c for c in rows.columns if c not in (key, ordinal)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cells), ordinal).alias("_row"), F.min(ordinal).alias(ordinal)).select(key, ordinal, "_row.*")
