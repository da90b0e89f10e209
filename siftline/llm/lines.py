"""Line dedup by distinct-site spread. DataFrame functions only.

A line is text between newlines, compared after trimming white space; blank lines never count. For each line hash, a
HyperLogLog sketch of the sites (``source``) that hold it is merged by aggregation. Estimates far from ``min_sites`` decide
at once; lines within ``band`` of it get an exact distinct count. Lines on ``min_sites`` sites or more are boilerplate. So are lines
of more than ``LONG`` characters, about 20 words, on ``LONG_SITES`` or more, as these don't meet by chance. They are taken out of every document but one, that with the smallest (doc_id, source) among those holding the line, so that no
text is lost altogether.

Scale: lines travel as hashes of 63 bits, once for each document and line, and are combined before the shuffle; texts are
shuffled once, by doc_id, to meet the hashes of their own boilerplate. No task gathers what one line holds: a line in a third
of all documents is one group of a partially aggregated sum and a side of a join that can be split.

Cases: a null text stays null (no lines); a null source is no site; an empty text is one blank line; repeated rows count as
one document; a document left without lines keeps its row with an empty text; an empty table gives an empty result; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.logs import once

from .common import table, written

MIN_SITES, LONG_SITES, LONG = 10, 3, 120
#: Standard errors of a sketch with 2**10 registers are near 3 %; the band is far wider.
LOG_K, BAND = 10, 0.25
#: Hashes that a document loses, up to which each of its lines looks through all of them.
FEW = 64
SPACE = " \t\r\x0b\x0c"


def line_hash(line: Column) -> Column:
    """63 bits, and whether the line is long in the last one. Null for blank lines."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(bare != "", F.xxhash64(bare).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(bare) > LONG).cast("long")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, long_sites: int = LONG_SITES) -> DataFrame:
    """(doc_id, site, h) -> h of the boilerplate lines and keeper, the (doc_id, site) that keeps each."""
    enough = F.when(F.col("h").bitwiseAND(F.lit(1)) == 1, min(long_sites, min_sites)).otherwise(min_sites)
    spread = lines.groupBy("h").agg(
        F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.min("site").alias("low"), F.max("site").alias("high"), F.min(F.struct("doc_id", "site")).alias("keeper")
    )
    # the extremes alone rule out the lines of a single site, which are nearly all
    likely = spread.where("low < high").select("h", F.hll_sketch_estimate("sketch").alias("estimate"), "keeper")
    likely = written(likely.where(F.col("estimate") >= enough * (1 - band)), "spread")
    near = likely.where(F.col("estimate") < enough * (1 + band)).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= enough)
    sure = likely.where(F.col("estimate") >= enough * (1 + band)).select("h", "keeper")
    return likely.join(exact.select("h"), "h", "left_semi").select("h", "keeper").unionByName(sure)


def _sited(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("source").alias("site"), F.col("source").isNotNull().alias("known"), F.split("text", "\n").alias("lines"))


def marked(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, long_sites: int = LONG_SITES) -> DataFrame:
    """docs' columns in the struct ``document``, the hashes of the lines it loses in ``lost``, and the lines left in ``kept`` (null both: it loses none)."""
    sited = _sited(docs)
    held = F.array_distinct(F.filter(F.transform("lines", line_hash), lambda h: h.isNotNull()))
    lines = written(
        sited.select("doc_id", F.when(F.col("known"), F.col("site")).alias("site"), F.explode(held).alias("h")), "lines"
    )
    keepers = boilerplate(lines, min_sites, band, long_sites)
    losing = lines.join(keepers, "h").where(~F.struct("doc_id", "site").eqNullSafe(F.col("keeper")))
    lost = losing.groupBy(F.col("doc_id").alias("_id"), F.col("site").alias("_site")).agg(F.collect_set("h").alias("lost"))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        F.col("doc_id").alias("_doc"), F.when(F.col("source").isNotNull(), F.xxhash64("source")).alias("_at"),
    )
    met = whole.join(lost, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_at").eqNullSafe(F.col("_site")), "left")
    tabled = once(met.select("document", "lost", F.when(F.size("lost") > FEW, _by_bits(F.col("lost"))).alias("table")), ["document", "lost"], "table")
    return once(tabled.withColumn("kept", F.when(F.col("lost").isNotNull(), _kept(F.col("document.text")))), ["document", "lost"], "kept")


def _place(h: Column, level: int) -> Column:
    """Six bits of a hash, the first ones at level 0."""
    return F.shiftrightunsigned(h, 58 - 6 * level).bitwiseAND(F.lit(63)).cast("int")


def _by_bits(hashes: Column) -> Column:
    """Hashes in 64 arrays of 64 arrays by their first twelve bits: a lookup sees the few that share these, however many there are."""
    places = F.sequence(F.lit(0), F.lit(63))
    first = F.transform(places, lambda a: F.filter(hashes, lambda h: _place(h, 0) == a))
    return F.transform(first, lambda own: F.transform(places, lambda b: F.filter(own, lambda h: _place(h, 1) == b)))


def _kept(text: Column) -> Column:
    """The lines of text whose hashes aren't in ``lost``, or in ``table`` if there are many."""
    own = lambda h: F.element_at(F.element_at("table", _place(h, 0) + 1), _place(h, 1) + 1)
    among = lambda h: F.when(F.col("table").isNull(), F.array_contains("lost", h)).otherwise(F.array_contains(own(h), h))
    hashed = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), line_hash(x).alias("h")))
    return F.transform(F.filter(hashed, lambda x: x.h.isNull() | ~among(x.h)), lambda x: x.line)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs' rows and columns, with boilerplate lines taken out of text."""
    text = F.when(F.col("lost").isNull(), F.col("document.text")).otherwise(F.array_join("kept", "\n"))
    return marked(docs, **options).select(*[(text if c == "text" else F.col(f"document.`{c}`")).alias(c) for c in docs.columns])


def op4_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, lines, removed, text (what is left)."""
    docs = marked(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    lines = F.coalesce(F.size(F.split("document.text", "\n")), F.lit(0))
    return docs.select(
        F.col("document.doc_id").alias("doc_id"),
        F.when(F.col("document.text").isNull(), 0).otherwise(lines).cast("long").alias("lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(lines - F.size("kept")).cast("long").alias("removed"),
        F.when(F.col("lost").isNull(), F.col("document.text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )


#: The same in DuckDB, over documents.
OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, n, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
    FROM documents WHERE text IS NOT NULL)
), boilerplate AS (
  SELECT bare, arg_min(source, doc_id) AS keeper_source, min(doc_id) AS keeper
  FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= CASE WHEN length(bare) > 120 THEN 3 ELSE 10 END
), left_over AS (
  SELECT l.doc_id, count(*)::BIGINT AS lines, count(b.bare) FILTER (WHERE l.doc_id <> b.keeper)::BIGINT AS removed,
    string_agg(line, chr(10) ORDER BY n) FILTER (WHERE b.bare IS NULL OR l.doc_id = b.keeper) AS text
  FROM lines l LEFT JOIN boilerplate b ON l.bare = b.bare GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(lines, 0) AS lines, coalesce(removed, 0) AS removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text
FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id
"""
