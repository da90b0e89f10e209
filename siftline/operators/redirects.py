"""Redirect chains of stored fetches: where each URL ends, for all URLs at once.

A fetch is one response. A chain is followed by pointer doubling: every URL knows its first hops and where these end, and a round joins that end with what
the end itself knows, so the known hops double and a chain of at most ``most`` takes about log2(most) joins, however many URLs there are. Then
each chain is judged by itself, in the order in which a client meets the cases: a URL that it has seen, one that wasn't fetched, a
response that is final, one redirect too many, and those that aren't followed.

Cases: of several fetches of one URL, that with the least status and location counts; a location that can't be resolved isn't followed
(INVALID_REDIRECT); a redirect status without a location is a final response; null URLs give no row; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.shared import checkpointed
from siftline.functions.ship import ship
from siftline.functions.urls import boundary_host, host, normalize, origin, scheme

# Statuses that redirect, how many are followed, and the codes of chains that don't end.
STATUSES, MOST = (301, 302, 303, 307, 308), 5
LOOP, LIMIT, DOWNGRADE, CROSS_HOST, FAILED, INVALID = "REDIRECT_LOOP", "REDIRECT_LIMIT_EXCEEDED", "HTTPS_DOWNGRADE_BLOCKED", "CROSS_HOST_REDIRECT_BLOCKED", "FETCH_FAILED", "INVALID_REDIRECT"
#: Locations that need no repair: absolute ones, and paths.
CLEAN, CLEAN_PATH = r"^https?://[a-z0-9.-]+/[A-Za-z0-9/_~-]*(\?[A-Za-z0-9=&_~-]*)?$", r"^/[A-Za-z0-9_~-][A-Za-z0-9/_~-]*(\?[A-Za-z0-9=&_~-]*)?$"
HOP = "struct<url:string,status:int,location:string>"


@F.pandas_udf(T.StringType())
def _resolved(location: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalize(x, b) for x, b in zip(location, base, strict=True)], dtype=object)


def resolved(fetches: DataFrame) -> DataFrame:
    """fetches (url, status, location) with target, the URL that location names; only locations that need repair leave the JVM."""
    ship(fetches.sparkSession)
    kind = F.when(F.col("location").isNull(), "none").when(F.col("location").rlike(CLEAN), "whole").when(F.col("location").rlike(CLEAN_PATH), "path").otherwise("odd")
    rows = fetches.withColumn("_kind", kind)
    plain = rows.where("_kind <> 'odd'").withColumn("target", F.when(F.col("_kind") == "whole", F.col("location")).when(F.col("_kind") == "path", F.concat(origin(F.col("url")), "location")))
    odd = rows.where("_kind = 'odd'").withColumn("target", _resolved("location", "url"))
    return plain.unionByName(odd).drop("_kind")


def _first_hops(fetches: DataFrame) -> DataFrame:
    """url, hops (none or one), end (where they lead, if on), status, stop (why they don't go on)."""
    redirects = F.col("status").isin(*STATUSES) & F.col("location").isNotNull()
    blocked = (
        F.when(F.col("target").isNull(), INVALID)
        .when((scheme(F.col("url")) == "https") & (scheme(F.col("target")) == "http"), DOWNGRADE)
        .when(boundary_host(host(F.col("url"))) != boundary_host(host(F.col("target"))), CROSS_HOST)
    )
    stop = F.when(~F.coalesce(redirects, F.lit(False)), "final").otherwise(blocked)
    hop = F.array(F.struct("url", F.col("status").cast("int").alias("status"), F.col("target").alias("location")).cast(HOP))
    rows = fetches.withColumn("stop", stop)
    return rows.select("url", F.when(F.col("stop").isNull(), hop).otherwise(F.slice(hop, 1, 0)).alias("hops"), F.when(F.col("stop").isNull(), F.col("target")).alias("end"), F.when(F.col("stop").isNotNull(), F.col("status")).alias("status"), "stop")


def _doubled(rows: DataFrame) -> DataFrame:
    """Each chain with the hops that its end knows of."""
    behind = rows.select(F.col("url").alias("_url"), F.col("hops").alias("_hops"), F.col("end").alias("_end"), F.col("status").alias("_status"), F.col("stop").alias("_stop"))
    met = rows.join(behind, F.col("end") == F.col("_url"), "left")
    on = F.col("end").isNotNull()
    return met.select(
        "url", F.when(on & F.col("_url").isNotNull(), F.concat("hops", "_hops")).otherwise(F.col("hops")).alias("hops"), F.col("_end").alias("end"),
        F.when(on, F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(on, F.when(F.col("_url").isNull(), FAILED).otherwise(F.col("_stop"))).otherwise(F.col("stop")).alias("stop"),
    )


def _seen_again(visited: Column) -> Column:
    """The first place, from 0, of a URL that stands further ahead as well; null if there is none."""
    places = F.sequence(F.lit(0), F.size(visited) - 1)
    return F.get(F.filter(places, lambda i: F.array_position(visited, F.get(visited, i)) <= i), F.lit(0))


def followed(fetches: DataFrame, most: int = MOST) -> DataFrame:
    """fetches: url (as normalized), status, location -> requested_url, final_url, status, redirects, error (null: the chain ends)."""
    one = fetches.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct(F.col("status").cast("int").alias("status"), "location")).alias("f")).select("url", "f.status", "f.location")
    rows = checkpointed(_first_hops(resolved(one)))
    known = 1
    while known < most + 1:
        rows, known = checkpointed(_doubled(rows)), 2 * known
    visited = F.concat(F.array("url"), F.transform("hops", lambda h: h.location))
    again, hops = _seen_again(visited), F.size("hops")
    error = (
        F.when(again <= most, LOOP)
        .when(F.col("stop") == FAILED, F.when(hops > most, LIMIT).otherwise(FAILED))
        .when(F.col("stop") == "final", F.when(hops > most, LIMIT))
        .otherwise(F.when((hops >= most) | F.col("stop").isNull(), LIMIT).otherwise(F.col("stop")))
    )
    judged = rows.withColumn("error", error)
    fine = F.col("error").isNull()
    return judged.select(
        F.col("url").alias("requested_url"), F.when(fine, F.coalesce(F.element_at(F.when(hops > 0, F.col("hops")), -1).location, F.col("url"))).alias("final_url"), F.when(fine, F.col("status")).alias("status"),
        F.when(fine, F.col("hops")).alias("redirects"), "error",
    )
