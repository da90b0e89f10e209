"""A deterministic sharded WARC writer, and the reader of what it wrote.

Records are sorted by (page_id, payload digest) and cut into shards of about ``shard_bytes`` of payload: running sums of bytes along
that order, in two levels, give each shard's first key, whatever the ids' range and gaps and however Spark deals out the rows, so the
same table always gives the same files. One key per shard reaches the driver. A shard is written by one task as a stream: a file is
closed when its compressed size passes ``roll_bytes``, and the next begins. Unless told otherwise, a shard is a 64th of the table,
from 32 MiB to 2 GiB, and files roll at a 16th of a shard, up to 128 MiB compressed. Headers, record ids and digests are made anew
from the payload, with fixed dates and gzip times.

Commit: a task writes under a temporary name of its own attempt and returns manifest rows. These are written as a table
first, so a repeated task changes nothing; then each listed file is renamed to its final name, and the manifest follows under
its final name last. A folder without a manifest is not an archive.

Equal payloads: the record with the largest page_id is the response, the others are revisits that name it. Which these are is
found from (page_id, digest) alone, read once and kept as a table; the payloads are shuffled once, for the sort.

Cases: a null html is an empty payload; a null url is an empty target; null page_ids sort first, are responses only if no other
record has the payload, and come back null; of rows equal in page_id and payload the first is the response and the rest revisit
it; long payloads are one record each; an empty table gives an empty archive; columns besides page_id, url and html aren't
stored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, ship, table, written

DATE = "2024-01-01T00:00:00Z"
#: Shards of a table, their bytes of payload, and rolls of a shard.
SHARDS, LEAST, MOST, ROLLS = 64, 32 << 20, 2 << 30, 16
NAMESPACE = uuid.UUID("5b1f9f4e-6f4c-5a3e-9d7b-2f6a1c0d8e11")
MANIFEST = "shard long, part long, temporary string, name string, records long, bytes long, sha1 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CHUNK = 1 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, nth: int = 0) -> bytes:
    """One record, uncompressed. Revisits keep the full payload's digest and length, not the payload."""
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, nth)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate(LINES)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Page-ID: {'' if page_id is None else page_id}",
        f"Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


#: A header is one line.
LINES = {10: "%0A", 13: "%0D"}


def member(data: bytes) -> bytes:
    """A gzip member without a time, so that equal records are equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Files of one shard, one after another, under temporary names."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.attempt = shard, roll_bytes, uuid.uuid4().hex
        self.part, self.out, self.rows = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"_temporary/{self.attempt}-{self.part:05d}.warc.gz"
            self.fs.create_dir(posixpath.join(self.base, "_temporary"), recursive=True)
            self.out, self.bytes, self.records, self.sha1 = self.fs.open_output_stream(posixpath.join(self.base, self.temporary), compression=None), 0, 0, hashlib.sha1()
        self.out.write(data)
        self.sha1.update(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.part, self.temporary, f"{self.shard:06d}-{self.part:05d}.warc.gz", self.records, self.bytes, self.sha1.hexdigest()))
            self.part, self.out = self.part + 1, None


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, refers, nth = None, None, {}, 0
        for batch in batches:
            for shard, page, digest, refers_to, html, url in zip(*(batch.column(c) for c in ("shard", "page_id", "digest", "refers_to", "html", "url")), strict=True):
                page, digest = page.as_py(), digest.as_py()
                if files is None or files.shard != shard.as_py():
                    if files:
                        files.close()
                        yield _manifest(files.rows)
                    files = _Roller(folder, shard.as_py(), roll_bytes)
                if (page, digest) != key:
                    key, refers, nth = (page, digest), None, 0
                if refers_to.is_valid:  # the row that names this page's response comes before the page itself
                    refers = refers_to.as_py()
                    continue
                # a repeat of a response revisits it
                to = refers if refers is not None else page if nth else None
                files.add(member(record(page, url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), to, nth)))
                nth += 1
        if files:
            files.close()
            yield _manifest(files.rows)

    return run


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    return pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(names)}, schema=pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in MANIFEST.split(", ")]))


def _rename(folder: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for rows in parts:
            for temporary, name in zip(rows.temporary, rows.name, strict=True):
                source, target = posixpath.join(base, temporary), posixpath.join(base, name)
                if fs.get_file_info(source).type != pafs.FileType.NotFound:  # else an earlier attempt has moved it
                    fs.move(source, target)
            yield rows

    return run


def sort_key(page_id: Column, digest: Column) -> Column:
    """Text in the order of (page_id, nulls first, digest): the id's bits with the sign's turned round, so that none overflows."""
    bits = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(bits, F.lit("")), F.lit("/"), digest)


def firsts(names: DataFrame, shard_bytes: int) -> list[str]:
    """names: key, bytes -> the first key of each shard, in order. Rows of one key stay together."""
    sized = names.groupBy("key").agg(F.sum("bytes").alias("bytes"))
    ranged = written(sized.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("bytes").alias("bytes"))  # a row for each task
    parts = parts.select("part", F.coalesce(F.sum("bytes").over(earlier().orderBy("part")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("bytes").over(earlier("part").orderBy("key")), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(parts, "part")
    shard = F.floor((F.col("inside") + F.col("before")) / shard_bytes)
    return sorted(r["first"] for r in placed.groupBy(shard.alias("shard")).agg(F.min("key").alias("first")).collect())


def shard_of(key: Column, keys: list[str]) -> Column:
    """The place, from 0, of the last of the sorted keys that isn't after key: first among every n-th of them, then from there on."""
    n = max(1, math.isqrt(len(keys)))
    listed = lambda some: F.split(F.lit("|".join(some)), r"\|")  # noqa: E731  one literal, however many keys
    upto = lambda some: F.size(F.filter(some, lambda x: x <= key)) - 1
    coarse = F.greatest(upto(listed(keys[::n])), F.lit(0))
    return (coarse * n + F.greatest(upto(F.slice(listed(keys), coarse * n + 1, F.lit(n))), F.lit(0))).cast("long")


def write_archive(pages: DataFrame, folder: str, roll_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files into folder, and return the manifest."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    key = sort_key(F.col("page_id"), F.col("digest"))
    known = written(rows.select("page_id", "digest", key.alias("key"), F.octet_length("html").cast("long").alias("bytes")), "names")
    if shard_bytes is None:
        shard_bytes = min(MOST, max(LEAST, (known.agg(F.sum("bytes")).first()[0] or 0) // SHARDS))
    keys = firsts(known, shard_bytes) or [""]
    names = known.select("page_id", "digest")
    last = names.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "refers_to")
    revisits = names.join(last, F.col("digest") == F.col("of")).where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).select("page_id", "digest", "refers_to").distinct()
    # the names of responses travel with the pages, so that these are shuffled once
    mixed = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits, allowMissingColumns=True)
    dealt = mixed.withColumn("shard", shard_of(key, keys)).repartitionById(len(keys), F.col("shard").cast("int"))
    ordered = dealt.sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").asc_nulls_last(), "url").select("shard", "page_id", "digest", "refers_to", "html", "url")
    plan = f"{folder}/_plan"
    ordered.mapInArrow(_write(folder, roll_bytes or max(1, shard_bytes // ROLLS)), MANIFEST).write.parquet(plan)
    planned = spark.read.schema(MANIFEST).parquet(plan)
    # a file's name is the manifest's last word: the table appears when all files stand
    planned.mapInPandas(_rename(folder), MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(stream, size: int = CHUNK) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, parts, data = zlib.decompressobj(31), [], stream.read(size)
    while data:
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data if unpacker.eof else b""
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
        if not data:
            data = stream.read(size)
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """Headers in lower case, block and payload of one record; its digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest_of(payload)}":
        raise ValueError(f"damaged payload {fields.get('warc-record-id')}")
    return fields | {"block": block, "payload": payload}


def _read(folder: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in RECORD.split(", ")]
        number = lambda x: int(x) if x else None
        for rows in parts:
            for name in rows.name:
                found: list[tuple] = []
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for data in members(stream):
                        r = parse(data)
                        length = len(r["payload"]) if r["warc-type"] == "response" else int(r["payload-length"])
                        found.append((number(r["page-id"]), length, r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], number(r.get("refers-to-page-id"))))
                        if len(found) >= 10_000:
                            yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            found = []
                yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    return run


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the files that the manifest lists."""
    ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = manifest.select("name").repartition(max(1, manifest.count()))
    return files.mapInPandas(_read(folder), RECORD)


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder)


#: The records' values in DuckDB, over pages. DuckDB has no base32: five bits at a time from the hex digits.
OP2_SQL = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM hashed
), coded AS (
  SELECT *, list_aggregate([
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1]
    for i in range(32)], 'string_agg', '') AS payload_digest FROM named
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM coded
"""
