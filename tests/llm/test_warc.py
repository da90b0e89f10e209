import bisect
import collections
import gzip
import hashlib
import random
import urllib.parse
from pathlib import Path

import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from siftline.llm import warc

PAGES = "page_id long, url string, html string, digest string, shard int"


def pages(spark):
    rows = [(i, f"https://a.example/{i}", f"<p>{i % 7}</p>" * (1 + i % 3), "x", 1) for i in range(100)]
    rows += [(200, None, None, None, None), (201, "u\r\nX: y", "", None, None), (202, "u", "é😀" * 20_000, None, None), (None, "n", "no id", None, None), (None, "n", "<p>1</p>", None, None), (7, "again", rows[7][2], None, None), (7, "again", "other", None, None)]
    return spark.createDataFrame(rows, PAGES)


def files(folder):
    return sorted(Path(urllib.parse.urlparse(folder).path).glob("*.warc.gz"))


def test_oracle(spark):
    same(warc.op2_warc_writer(spark, "/root/testdata/sf0.01").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), connect("/root/testdata/sf0.01"), warc.OP2_SQL)


@pytest.mark.parametrize("roll, shard", [(1 << 27, 1 << 25), (600, 900)])
def test_round_trip(spark, tmp_path, roll, shard):
    source, folder = pages(spark), f"file://{tmp_path}/w"
    manifest = warc.write_archive(source, folder, roll, shard).collect()
    got = warc.read_archive(spark, folder).collect()
    rows = source.collect()
    assert len(got) == len(rows)
    last = {}
    for r in rows:
        if r.page_id is not None:
            last[r.html or ""] = max(last.get(r.html or "", r.page_id), r.page_id)
    want = []
    seen = set()
    for r in rows:
        raw = (r.html or "").encode()
        to = last.get(r.html or "")
        first = (r.page_id, r.html) not in seen
        seen.add((r.page_id, r.html))
        response = to is None or r.page_id == to and first
        want.append((r.page_id, len(raw), warc.digest_of(raw), "response" if response else "revisit", None if response else to))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert {f.name: (f.stat().st_size, hashlib.sha1(f.read_bytes()).hexdigest()) for f in files(folder)} == {m.name: (m.bytes, m.sha1) for m in manifest}
    assert sum(m.records for m in manifest) == len(rows)
    if roll < 1000:
        assert len(manifest) > 5 and max(m.bytes for m in manifest if m.records > 1) < roll + 1000
    order = [p for f in files(folder) for p in page_order(f)]
    assert order == sorted(order)
    # the same table gives the same bytes
    again = f"file://{tmp_path}/again"
    warc.write_archive(source.repartition(5), again, roll, shard)
    assert [f.read_bytes() for f in files(again)] == [f.read_bytes() for f in files(folder)]


def page_order(file):
    with gzip.open(file) as f:
        text = f.read().split(b"\r\n")
    return [int(x[9:] or -1) for x in text if x.startswith(b"Page-ID: ")]


def test_any_ids_and_rolls(spark, tmp_path):
    """The least and the greatest ids, one far off the rest, and shards of several files with the parameters of production."""
    rng = random.Random(3)
    ids = [-(1 << 63), -9, 0, (1 << 63) - 1, 1 << 60, None, *range(100, 460)]
    rows = [(i, "u", rng.randbytes(120_000).hex(), None, None) for i in ids]
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archive(spark.createDataFrame(rows, PAGES).repartition(7), folder).collect()
    shards = collections.Counter(m.shard for m in manifest)
    assert len(shards) == 3 and min(shards.values()) >= 3, shards  # 88 MB in shards of 32 MiB
    got = {r.page_id: r for r in warc.read_archive(spark, folder).collect()}
    assert set(got) == set(ids) and all(r.payload_bytes == 240_000 for r in got.values())
    order = [p for f in files(folder) for p in page_order(f)]
    assert order == [-1, *sorted(i for i in ids if i is not None)]  # no id comes first


@pytest.mark.parametrize("n", [1, 2, 3, 10, 57])
def test_shard_of(spark, n):
    keys = sorted(f"{i * 7:05d}" for i in range(n))
    got = spark.range(0, 430).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k")).withColumn("s", warc.shard_of(F.col("k"), keys)).collect()
    assert all(r.s == bisect.bisect_right(keys, r.k) - 1 for r in got)


def test_renaming_twice_is_harmless(spark, tmp_path):
    import pandas as pd

    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary/x").write_bytes(b"1")
    part = pd.DataFrame({"temporary": ["_temporary/x"], "name": ["a"]})
    for _ in range(2):
        list(warc._rename(f"file://{tmp_path}")(iter([part])))
    assert (tmp_path / "a").read_bytes() == b"1"


def test_damage_is_noticed():
    good = warc.record(1, "u", b"payload", None)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload", b"Payload"), good[:-2], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    assert warc.write_archive(spark.createDataFrame([], PAGES), folder).count() == 0 and warc.read_archive(spark, folder).count() == 0
