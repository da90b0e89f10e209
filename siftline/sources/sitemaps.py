"""Sitemaps: XML (urlset, sitemapindex, any prefix, CDATA) or text, as one nested struct per document. An Arrow UDF over expat,
which keeps what stood before an error."""

from __future__ import annotations

import re
from urllib.parse import urlsplit
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from siftline.functions.ship import ship

MAX_ERRORS = 10
_ENTRY = pa.list_(pa.struct([("loc", pa.string()), ("lastmod", pa.string())]))
ARROW_SITEMAP = pa.struct([("format", pa.string()), ("kind", pa.string()), ("urls", _ENTRY), ("child_sitemaps", _ENTRY), ("total_entries", pa.int64()), ("retained_entries", pa.int64()), ("truncated", pa.bool_()), ("errors", pa.list_(pa.string())), ("warnings", pa.list_(pa.string()))])


def _result(form: str, kind: str, urls: list, children: list, total: int, errors: list[str], warnings: list[str]) -> dict:
    kept = len(urls) + len(children)
    return {
        "format": form, "kind": kind, "urls": urls, "child_sitemaps": children, "total_entries": total, "retained_entries": kept, "truncated": total > kept,
        "errors": list(dict.fromkeys(errors))[:MAX_ERRORS], "warnings": list(dict.fromkeys(warnings)),
    }


def parse_text(text: str, most: int) -> dict:
    urls, errors, total = [], [], 0
    for n, raw in enumerate(re.split(r"\r?\n", text), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        parts = urlsplit(line) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", line) else None
        if parts is None:
            errors.append(f"line {n} is no absolute URL")
        elif parts.scheme not in ("http", "https"):
            errors.append(f"line {n} is neither HTTP nor HTTPS")
        elif not parts.netloc:
            errors.append(f"line {n} is no absolute URL")
        else:
            total += 1
            if len(urls) < most:
                urls.append({"loc": parts._replace(path=parts.path or "/").geturl(), "lastmod": None})
    return _result("text", "urlset", urls, [], total, errors, ["text sitemaps have no dates"])


class _Document:
    def __init__(self, most: int):
        self.most, self.root, self.stack, self.total = most, None, [], 0
        self.entry: dict | None = None
        self.field: str | None = None
        self.text, self.found, self.errors, self.doctype = "", [], [], False

    def start(self, name: str, _: dict) -> None:
        name = name.lower().rpartition(":")[2]
        parent = self.stack[-1] if self.stack else None
        self.root = self.root or name
        if name in ("url", "sitemap") and len(self.stack) > 0 and parent == self.root:
            self.entry = {"kind": name, "loc": None, "lastmod": None}
        elif self.entry and parent == self.entry["kind"] and name in ("loc", "lastmod"):
            self.field, self.text = name, ""
        self.stack.append(name)

    def data(self, text: str) -> None:
        if self.field:
            self.text += text

    def end(self, name: str) -> None:
        name = name.lower().rpartition(":")[2]
        if self.field == name:
            self.entry[name] = self.text.strip() or None
            self.field = None
        elif self.entry and name == self.entry["kind"]:
            if self.entry["loc"] is None:
                self.errors.append(f"{name} entry {self.total + 1} has no loc")
            else:
                self.total += 1
                if len(self.found) < self.most:
                    self.found.append(self.entry)
            self.entry = None
        self.stack.pop()

    def has_doctype(self, *_: object) -> None:
        self.doctype = True


def parse(text: str, most: int) -> dict:
    if not text.strip().startswith("<"):
        return parse_text(text, most)
    doc, parser = _Document(most), expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = doc.start, doc.end, doc.data, doc.has_doctype
    try:
        parser.Parse(text.strip().encode("utf-8", "replace"), True)
    except expat.ExpatError as broken:
        doc.errors.append(f"XML error in line {broken.lineno}: {expat.ErrorString(broken.code)}")
    if doc.doctype:
        doc.errors.append("a DOCTYPE declaration isn't accepted")
    kind = doc.root if doc.root in ("urlset", "sitemapindex") else "unsupported"
    of = {k: [{"loc": e["loc"], "lastmod": e["lastmod"]} for e in doc.found if e["kind"] == k] for k in ("url", "sitemap")}
    warnings = []
    if kind == "unsupported":
        doc.errors.append(f"unsupported root element: {doc.root or 'none'}")
    if kind == "urlset" and of["sitemap"]:
        warnings.append("sitemap entries in a urlset were left out")
    if kind == "sitemapindex" and of["url"]:
        warnings.append("page entries in a sitemapindex were left out")
    return _result("xml", kind, of["url"] if kind == "urlset" else [], of["sitemap"] if kind == "sitemapindex" else [], doc.total, doc.errors, warnings)


@F.arrow_udf(from_arrow_type(ARROW_SITEMAP))
def _parse(body: pa.Array, most: pa.Array) -> pa.Array:
    return pa.array([None if b is None else parse(b, m) for b, m in zip(body.to_pylist(), most.to_pylist(), strict=True)], type=ARROW_SITEMAP)


def parse_sitemap(body: Column, most: int = 10_000) -> Column:
    ship(SparkSession.active())
    return _parse(body, F.lit(most))
