"""Facts of static HTML documents, as one nested struct per document. An Arrow UDF: no built-in function reads HTML.

The standard tokenizer feeds a small state machine that knows where the head ends and which elements hold no content of their
own (template, noscript, script, style). It doesn't build a tree: elements closed by implication are closed where their kind
ends or the text does.
"""

from __future__ import annotations

import hashlib
import json
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from siftline.functions.ship import ship

# Caps on links, characters of a text, and JSON-LD values.
MAX_LINKS, MAX_TEXT, MAX_VALUES = 500, 2000, 100
HEAD_TAGS = {"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template", "basefont", "bgsound", "noframes"}
SILENT = {"script", "style", "noscript", "template", "svg"}
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[,\s]+")

def tokens(value: str) -> list[str]:
    """Directives in order, each once; "none" also means noindex and nofollow."""
    found = [t for t in TOKEN.split(value.lower()) if t]
    if "none" in found:
        found += ["noindex", "nofollow"]
    return list(dict.fromkeys(found))


def _clean(pieces: list[str]) -> str:
    return SPACE.sub(" ", " ".join(pieces)).strip()


def _resolve(href: str, base: str, keep_fragment: bool) -> str | None:
    if not href:
        return None
    try:
        url = urljoin(base, href)
        parts = urlsplit(url)
        if parts.scheme in ("http", "https"):
            if not parts.hostname:
                return None
            parts.port  # noqa: B018  raises if it is no port
            netloc = parts.netloc.lower() if "@" not in parts.netloc else parts.netloc
            netloc = re.sub(r":80$" if parts.scheme == "http" else r":443$", "", netloc)
            url = parts._replace(netloc=netloc, path=(parts.path or "/").replace(" ", "%20")).geturl()
    except ValueError:
        return None
    return url if keep_fragment else urldefrag(url)[0]


def origin(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc.lower()}"


def json_ld(raw: str) -> tuple[dict, object]:
    """Whether a block is JSON, with its types and ids wherever they stand; and its value, or a digest if it isn't."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        value = json.loads(raw, parse_constant=refuse)
    except (ValueError, RecursionError):
        return {"valid": False, "types": [], "ids": []}, {"invalid": hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()}
    found: dict[str, dict[str, None]] = {"@type": {}, "@id": {}}
    waiting = [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, list):
            waiting += reversed(item)
        elif isinstance(item, dict):
            for key, seen in found.items():
                own = item.get(key)
                seen.update(dict.fromkeys(x for x in (own if isinstance(own, list) else [own]) if isinstance(x, str)))
            waiting += reversed(list(item.values()))
    return {"valid": True, "types": list(found["@type"])[:MAX_VALUES], "ids": list(found["@id"])[:MAX_VALUES]}, value


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lang = self.base = None
        self.in_head, self.seen_html, self.seen_base = True, False, False
        self.titles, self.descriptions, self.robots, self.canonicals, self.headings = [], [], [], [], []
        self.links, self.total, self.nofollow, self.blocks, self.visible = [], 0, 0, [], []
        self.open: list[tuple[str, list[str]]] = []  # elements whose text is wanted
        self.silent: list[str] = []

    def _collect(self, tag: str) -> list[str]:
        pieces: list[str] = []
        self.open.append((tag, pieces))
        return pieces

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if "template" in self.silent or "noscript" in self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            return
        get = {k.lower(): v or "" for k, v in reversed(attrs)}
        if tag not in HEAD_TAGS:
            self.in_head = False
        if tag == "html" and self.lang is None:
            self.lang = get.get("lang", "").strip() or None
        elif tag == "base" and self.base is None:
            self.base = get.get("href", "").strip() or None
        elif tag == "title":
            self.titles.append(self._collect(tag))
        elif tag == "meta":
            name, content = get.get("name", "").strip().lower(), get.get("content", "").strip()
            if name == "description":
                self.descriptions.append(content[:MAX_TEXT])
            elif name in ("robots", "googlebot"):
                self.robots.append({"name": name, "directives": tokens(content)})
        elif tag == "link" and "canonical" in tokens(get.get("rel", "")):
            self.canonicals.append((get.get("href", "").strip(), "head" if self.in_head else "body"))
        elif re.fullmatch("h[1-6]", tag):
            for n in range(1, 7):
                self._close(f"h{n}")
            self.headings.append((int(tag[1]), self._collect(tag)))
        elif tag == "script" and get.get("type", "").strip().lower() == "application/ld+json":
            self.blocks.append(self._collect(tag))
        elif tag == "a":
            self._close("a")
            self.total += 1
            rel = tokens(get.get("rel", ""))
            self.nofollow += "nofollow" in rel
            if len(self.links) < MAX_LINKS:
                self.links.append((get.get("href", "").strip(), rel, self._collect(tag)))
        if tag in SILENT:
            self.silent.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "svg":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        elif "template" in self.silent or "noscript" in self.silent:
            return
        self._close(tag)

    def handle_data(self, data: str) -> None:
        raw = self.silent and self.silent[-1] in ("script", "style")
        if self.in_head and not self.silent and data.strip() and not any(tag == "title" for tag, _ in self.open):
            self.in_head = False
        if "template" in self.silent:
            return
        for tag, pieces in self.open:
            if not raw or tag == "script":
                pieces.append(data)
        if not self.silent:
            self.visible.append(data)


def extract(html: str, final_url: str) -> dict:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    base = _resolve(reader.base, final_url, True) if reader.base else None
    base = base or final_url
    own = origin(final_url)
    links = []
    for href, rel, pieces in reader.links:
        url = _resolve(href, base, False)
        kind = "invalid" if url is None else "non_http" if urlsplit(url).scheme not in ("http", "https") else "internal" if origin(url) == own else "external"
        links.append({"raw_href": href[:MAX_TEXT], "resolved_url": url, "text": _clean(pieces)[:MAX_TEXT], "rel": rel, "kind": kind})
    blocks = [json_ld("".join(pieces)) for pieces in reader.blocks]
    facts = {
        "html_lang": reader.lang, "base_href": reader.base, "titles": [_clean(t)[:MAX_TEXT] for t in reader.titles],
        "meta_descriptions": reader.descriptions, "meta_robots": reader.robots,
        "canonicals": [{"raw_href": h, "resolved_url": _resolve(h, base, True), "location": at} for h, at in reader.canonicals],
        "headings": [{"level": n, "text": _clean(t)[:MAX_TEXT]} for n, t in reader.headings], "links_total": reader.total, "links_nofollow": reader.nofollow,
        "links_truncated": reader.total > len(links), "links": links, "structured_data": [b for b, _ in blocks],
    }
    # what a visitor or a crawler reads: scripts don't count, the order of JSON keys doesn't either
    meaning = {k: v for k, v in facts.items() if k not in ("base_href", "links_total", "links_nofollow", "links_truncated", "structured_data")}
    meaning |= {"url": urldefrag(final_url)[0], "visible": _clean(reader.visible), "data": [v for _, v in blocks]}
    facts["content_hash"] = hashlib.sha256(json.dumps(meaning, sort_keys=True, ensure_ascii=True).encode()).hexdigest()
    return facts


def _strings() -> pa.DataType:
    return pa.list_(pa.string())


def _structs(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


ARROW_FACTS = pa.struct([
    ("html_lang", pa.string()), ("base_href", pa.string()), ("titles", _strings()), ("meta_descriptions", _strings()),
    ("meta_robots", _structs(name=pa.string(), directives=_strings())), ("canonicals", _structs(raw_href=pa.string(), resolved_url=pa.string(), location=pa.string())),
    ("headings", _structs(level=pa.int32(), text=pa.string())), ("links_total", pa.int64()), ("links_nofollow", pa.int64()), ("links_truncated", pa.bool_()),
    ("links", _structs(raw_href=pa.string(), resolved_url=pa.string(), text=pa.string(), rel=_strings(), kind=pa.string())),
    ("structured_data", _structs(valid=pa.bool_(), types=_strings(), ids=_strings())), ("content_hash", pa.string()),
])


@F.arrow_udf(from_arrow_type(ARROW_FACTS))
def _extract(html: pa.Array, final_url: pa.Array) -> pa.Array:
    rows = [None if h is None or u is None else extract(h, u) for h, u in zip(html.to_pylist(), final_url.to_pylist(), strict=True)]
    return pa.array(rows, type=ARROW_FACTS)


def html_facts(html: Column, final_url: Column) -> Column:
    ship(SparkSession.active())
    return _extract(html, final_url)


def directive_tokens(value: Column) -> Column:
    """The same as tokens(), as an expression."""
    found = F.filter(F.split(F.lower(value), r"[,\s]+"), lambda t: t != "")
    more = F.when(F.array_contains(found, "none"), F.array(F.lit("noindex"), F.lit("nofollow"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, more))


def header_directives(x_robots: Column) -> Column:
    """Of X-Robots-Tag headers, without a prefix that names Googlebot or all."""
    return directive_tokens(F.array_join(F.transform(x_robots, lambda v: F.regexp_replace(v, r"(?i)^\s*(?:googlebot|\*):\s*", "")), ","))


def heading_counts(headings: Column) -> list[Column]:
    at = lambda n: lambda h: h.level == n  # noqa: E731  a second argument would be the index
    return [F.size(F.filter(headings, at(n))).cast("long").alias(f"h{n}") for n in range(1, 7)]


def link_counts(facts: Column) -> list[Column]:
    unique = lambda kind: F.size(F.array_distinct(F.transform(F.filter(facts.links, lambda x: x.kind == kind), lambda x: x.resolved_url))).cast("long")
    return [facts.links_total.alias("links_total"), unique("internal").alias("unique_internal"), unique("external").alias("unique_external"), facts.links_nofollow.alias("links_nofollow"), facts.links_truncated.alias("links_truncated")]


def structured_counts(blocks: Column) -> list[Column]:
    types = F.slice(F.array_distinct(F.flatten(F.transform(blocks, lambda b: b.types))), 1, MAX_VALUES)
    return [F.size(F.filter(blocks, lambda b: b.valid)).cast("long").alias("valid_blocks"), F.size(F.filter(blocks, lambda b: ~b.valid)).cast("long").alias("invalid_blocks"), types.alias("types")]


def first_title(titles: Column) -> Column:
    """The first that isn't blank, or null."""
    return F.get(F.filter(F.transform(titles, lambda t: F.trim(t)), lambda t: t != ""), F.lit(0))
