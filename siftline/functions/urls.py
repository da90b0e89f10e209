"""URLs: keys and predicates as SQL expressions, for URLs that need no repair; a normalizer for those that may."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.ship import ship

MAX_URL = 2048
PARTS = r"(?i)^\s*([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?\s*$"
DEFAULT_PORT = {"http": "80", "https": "443"}
#: Where a relative URL is read when there is no page: no host has this name.
NOWHERE = "https://nowhere.invalid"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 3))


def path(url: Column) -> Column:
    """The path, "/" if empty."""
    p = F.regexp_extract(url, PARTS, 5)
    return F.when(url.rlike(PARTS), F.when(p == "", "/").otherwise(p)).otherwise("")


def port(url: Column) -> Column:
    """The port if it isn't the scheme's own, or an empty string."""
    p = F.regexp_extract(url, PARTS, 4)
    s = scheme(url)
    return F.when(((s == "http") & (p == "80")) | ((s == "https") & (p == "443")), "").otherwise(p)


def origin(url: Column) -> Column:
    p = port(url)
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(p == "", "").otherwise(F.concat(F.lit(":"), p)))


def document_url(url: Column) -> Column:
    """Without the fragment; scheme and host in lower case, an empty path as "/". Anything else keeps what stands before "#"."""
    clean = url.rlike(r"(?i)^https?://[^/?#@\s]+([/?#]|$)") & url.rlike(PARTS)
    whole = F.concat(origin(url), path(url), F.regexp_extract(url, PARTS, 6))
    return F.when(clean, whole).otherwise(F.split(url, "#")[0])


def page_key(url: Column, explicit_host: Column | None = None) -> Column:
    """Host and path without closing slashes; the query is left out, and the path keeps its case."""
    full = url.rlike(PARTS)
    at = F.when(full, F.regexp_extract(url, PARTS, 5)).otherwise(F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^(?!/)", "/"))
    opaque = r"(?i)^[a-z][a-z0-9+.-]*:(?!//)([^?#]*)"
    at = F.when(url.rlike(opaque), F.regexp_extract(url, opaque, 1)).otherwise(at)
    at = F.replace(F.regexp_replace(at, "/+$", ""), F.lit(" "), F.lit("%20"))
    name = F.when(full, host(url)).otherwise("")
    if explicit_host is not None:
        name = F.coalesce(F.nullif(F.lower(F.trim(explicit_host)), F.lit("")), name)
    return F.concat(name, F.when(at == "", "/").otherwise(at))


def boundary_host(name: Column) -> Column:
    """Lower case, without one leading "www."."""
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def same_boundary(a: Column, b: Column) -> Column:
    """The first an http(s) URL, and both on one host but for "www."."""
    return F.coalesce(a.rlike(r"(?i)^https?://[^/?#\s]") & b.rlike(PARTS) & (boundary_host(host(a)) == boundary_host(host(b))), F.lit(False))


def property_covers(prop: Column, url: Column) -> Column:
    """A domain property covers its host and those below it, a URL property what begins with it."""
    domain = F.lower(F.regexp_replace(prop, "^sc-domain:", ""))
    by_domain = (host(url) == domain) | F.endswith(host(url), F.concat(F.lit("."), domain))
    return F.coalesce(F.when(prop.startswith("sc-domain:"), by_domain).otherwise(F.startswith(document_url(url), document_url(prop))), F.lit(False))


# Extensions of files that are not pages, and utility paths.
ASSET_PATTERN = r"(?i)\.(?:avif|bmp|css|csv|docx?|eot|gif|ico|jpe?g|js|json|mp3|mp4|mov|otf|pdf|png|pptx?|rar|rss|svg|tar|tiff?|ttf|txt|webm|webp|woff2?|xlsx?|xml|zip)$"
UTILITY_PATTERN = r"(?i)^/(?:cdn-cgi|api/auth)(?:/|$)"


def in_scope(url: Column, seed: Column) -> Column:
    """A page to audit: http(s), not too long, default port, no credentials, within the seed's boundary."""
    plain = (F.length(url) <= MAX_URL) & url.rlike(r"(?i)^https?://[^/?#@\s]+([/?#]|$)") & (port(url) == "")
    return F.coalesce(plain, F.lit(False)) & same_boundary(url, seed)


def is_page(url: Column, seed: Column) -> Column:
    """Not a file of another kind, and not a utility path; the seed may be the latter."""
    p = path(url)
    return ~p.rlike(ASSET_PATTERN) & (~p.rlike(UTILITY_PATTERN) | document_url(url).eqNullSafe(document_url(seed)))


def link_kind(resolved: Column, page: Column) -> Column:
    return (
        F.when(resolved.isNull(), "invalid")
        .when(~scheme(resolved).isin("http", "https"), "non_http")
        .when(origin(resolved) == origin(page), "internal")
        .otherwise("external")
    )


# IPv4 blocks that are not public (first octet, and the second from and to), and IPv6 prefixes that aren't.
PRIVATE_V4 = [
    (0, 0, 255), (10, 0, 255), (127, 0, 255), (100, 64, 127), (169, 254, 254), (172, 16, 31), (192, 0, 0), (192, 2, 2), (192, 88, 88),
    (192, 168, 168), (198, 18, 19), (198, 51, 51), (203, 0, 0), (224, 0, 255),
]
PRIVATE_V6 = r"^(?:::1?$|fc|fd|fe[89ab]|ff|2001:db8|64:ff9b:)"
MAPPED_V4 = r"^::ffff:(\d+\.\d+\.\d+\.\d+)$"
MAPPED_HEX = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
V6 = r"^(?=.*:.*:)(?:[0-9a-f]{0,4}:){1,7}(?:[0-9a-f]{0,4}|\d+\.\d+\.\d+\.\d+)$"


def _public_v4(address: Column) -> Column:
    quad = F.transform(F.split(address, r"\."), lambda x: F.when(x.rlike(r"^(?:0|[1-9]\d{0,2})$"), x.cast("int")))
    good = (F.size(quad) == 4) & F.forall(quad, lambda x: x.isNotNull() & (x <= 255))
    a, b = F.get(quad, F.lit(0)), F.get(quad, F.lit(1))
    private = a >= 224
    for first, low, high in PRIVATE_V4:
        private = private | ((a == first) & (b >= low) & (b <= high))
    return F.coalesce(good & ~private, F.lit(False))


def is_public_address(address: Column) -> Column:
    """Of an IPv4 or IPv6 address; anything else isn't public."""
    v6 = F.split(F.lower(address), "%")[0]
    hex_part = lambda n: F.conv(F.regexp_extract(v6, MAPPED_HEX, n), 16, 10).cast("int")
    as_v4 = F.concat_ws(".", *[x.cast("string") for n in (1, 2) for x in (F.shiftright(hex_part(n), 8), hex_part(n).bitwiseAND(F.lit(255)))])
    mapped = F.when(v6.rlike(MAPPED_V4), F.regexp_extract(v6, MAPPED_V4, 1)).when(v6.rlike(MAPPED_HEX), as_v4)
    public_v6 = v6.rlike(V6) & ~v6.rlike(PRIVATE_V6) & (mapped.isNull() | _public_v4(mapped))
    return F.coalesce(F.when(F.contains(address, F.lit(":")), public_v6).otherwise(_public_v4(address)), F.lit(False))


def normalize(url: str | None, base: str | None = None) -> str | None:
    """An http(s) URL without credentials and fragment on its default port, in one spelling; null for any other."""
    if url is None or len(url) > MAX_URL:
        return None
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        if parts.scheme not in ("http", "https") or not parts.hostname or parts.username is not None or parts.password is not None:
            return None
        if parts.port not in (None, int(DEFAULT_PORT[parts.scheme])) or re.search(r"[\s<>^`{|}\\]", parts.hostname):
            return None
        name = parts.hostname if parts.hostname.isascii() else parts.hostname.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    out: list[str] = []
    pieces = re.sub(r"\\", "/", parts.path).split("/")[1:]
    for i, piece in enumerate(pieces):
        plain = piece.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(piece)
            continue
        if i == len(pieces) - 1:
            out.append("")
    text = "/" + "/".join(out)
    query = "?" + quote(parts.query, safe="!$&'()*+,;=:@/?%[]\\^`{|}~-._") if parts.query else ""
    return f"{parts.scheme}://{f'[{name}]' if ':' in name else name}{quote(text, safe="!$&'()*+,;=:@/%[]^|~-._")}{query}"


@F.pandas_udf(T.StringType())
def _normalize(urls: pd.Series) -> pd.Series:
    return urls.map(normalize, na_action="ignore")


def normalize_url(url: Column) -> Column:
    ship(SparkSession.active())
    return _normalize(url)
