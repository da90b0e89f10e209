"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, and connected components.

Fingerprint: texts are lower-cased for A-Z only and cut into words; each run of three words, joined by spaces, is a shingle
(all words, if fewer; none: fingerprint zero); a bit is set if over half of the shingles' XXH64 (seed 42) have it.

Links: equal texts meet first, as equal fingerprints, so a group of copies is one row from there on. Four blocks of 16 bits:
two fingerprints that differ in at most two bits agree in at least two of the blocks, so each of the six pairs of blocks is a
join key of 32 bits. Buckets of up to ``most`` fingerprints are joined with themselves and pairs verified by Hamming distance.
In a larger bucket, no pairs are made: each fingerprint stands under itself and its neighbours at one bit, and two are within
two bits exactly if they share such a key. At most 65 fingerprints can share one, and each is linked to the smallest. That
gives the same components in linear space, with no cap.

Components: large-star and small-star steps alternate on the edges until nothing changes; each step is an aggregation and a
join, and is written to the shared folder. Nothing is collected on the driver.

Cases: null and empty texts, and those without words, have fingerprint zero and link like any other; long texts are hashed in
blocks; repeated rows are documents of their own with equal results; a null doc_id never becomes a component's id unless the
group has no other; an empty table gives an empty result; ``nearest_groups`` reads doc_id and text only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, scratch, ship, table, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes above 127 belong to words, so the pattern works on UTF-8 as it does on text.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, SEED, BLOCK = 3, 42, 1 << 16
NEAR = 2
#: Pairs of the four 16-bit blocks, as masks.
BLOCKS = [0xFFFF << s for s in (0, 16, 32, 48)]
MASKS = [a | b for i, a in enumerate(BLOCKS) for b in BLOCKS[i + 1 :]]
MOST = 64


def fingerprint(text: str | None) -> int:
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    width = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that connect what is linked: every edge is a link."""
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))) for m in MASKS])).alias("mask", "key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    # a bucket of one has no links; only the others go on, and the shuffle of keyed is shared by both uses
    bucketed = written(keyed.join(sizes, ["mask", "key"]), "buckets")
    light = bucketed.where(F.col("n") <= most).select("mask", "key", "fp")
    pairs = light.alias("l").join(light.alias("r"), ["mask", "key"]).where("l.fp < r.fp AND bit_count(l.fp ^ r.fp) <= %d" % NEAR)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    ball = bucketed.where(F.col("n") > most).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("centre"))
    nearest = ball.groupBy("centre").agg(F.min("fp").alias("first"), F.count("*").alias("n")).where("n > 1")
    stars = ball.join(nearest, "centre").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Edges (a, b) -> (node, root): the smallest node that each node reaches."""
    spark = edges.sparkSession
    keep: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        keep.append(path := scratch(spark, "edges"))
        df.write.parquet(path)
        for old in keep[:-2]:
            drop_folder(spark, old)
        del keep[:-2]
        return spark.read.schema(df.schema).parquet(path)

    # (big, small): every node points at smaller ones
    current = put(edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).where("big <> small").distinct())
    before = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("small").alias("big"), F.col("big").alias("small")))
        low = both.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low")).select("node", F.least("node", "low").alias("low"))
        # large star: a node's larger neighbours go to the smallest it sees
        large = current.join(low, F.col("small") == F.col("node")).select("big", F.col("low").alias("small")).where("big <> small").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low"))
        moved = large.join(least, F.col("big") == F.col("node")).select(F.col("small").alias("big"), F.col("low").alias("small"))
        current = put(moved.unionByName(least.select(F.col("node").alias("big"), F.col("low").alias("small"))).where("big <> small").distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return current.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("root"))


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that a row reaches over links."""
    prints = written(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp"), **options))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("class"))
    smallest = classes.groupBy("class").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "class").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs' rows and columns, of each group only those of the document with the smallest doc_id; one row, if repeated."""
    chosen = near_groups(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").cast("long").alias("_doc"))
    met = rows.join(chosen, F.col("_doc").eqNullSafe(F.col("_id")))
    return met.dropDuplicates(["_doc"]).select("document.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
