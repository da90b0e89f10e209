import hashlib
import zlib

import numpy as np
import pytest
from fixtures import empty_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import mjpeg


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_round_trip(payload):
    raw = mjpeg.padded(payload)
    assert len(raw) % 576 == 0 and raw.startswith(payload) and set(raw[len(payload) :]) <= {255} and len(raw) - len(payload) <= 576
    images = mjpeg.encode_frames(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 576))
    found, fps = mjpeg.images_of(mjpeg.avi(images))
    assert found == images and fps == 25 and mjpeg.decode_frames(found).tobytes() == raw


def slow_decode(image):
    """One bit at a time, from the tables in the image itself."""
    at, table, scan = 2, {}, None
    while scan is None:
        marker, length = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + length]
        if marker == 0xC4:
            code, place = 0, 17
            for n in range(16):
                for _ in range(body[1 + n]):
                    table[n + 1, code] = body[place]
                    code, place = code + 1, place + 1
                code <<= 1
        if marker == 0xC3:
            assert body[0] == 8 and body[1:5] == (18).to_bytes(2, "big") + (32).to_bytes(2, "big")
        at += 2 + length
        if marker == 0xDA:
            scan = image[at:-2].replace(b"\xff\x00", b"\xff")
    bits = iter("".join(f"{b:08b}" for b in scan))
    out = np.zeros((18, 32), dtype=int)
    for y in range(18):
        for x in range(32):
            code, n = 0, 0
            while (n, code) not in table or n == 0:
                code, n = code << 1 | int(next(bits)), n + 1
            size = table[n, code]
            extra = int("".join(next(bits) for _ in range(size)) or "0", 2)
            d = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
            out[y, x] = d + (out[y, x - 1] if x else out[y - 1, 0] if y else 128)
    return out.astype(np.uint8).tobytes()


def test_the_coding_is_the_standards():
    rng = np.random.default_rng(2)
    frames = np.stack([rng.integers(0, 256, 576), np.zeros(576), np.full(576, 255), np.tile([0, 255], 288), np.arange(576) % 256]).astype(np.uint8)
    for frame, image in zip(frames, mjpeg.encode_frames(frames), strict=True):
        assert slow_decode(image) == frame.tobytes()


def test_damage_is_noticed():
    image = mjpeg.encode_frames(np.zeros((1, 576), dtype=np.uint8))[0]
    file = mjpeg.avi([image])
    for bad in (b"", file[:40], file.replace(b"idx1", b"idx2"), b"RIFX" + file[4:], file.replace(b"00dc", b"01dc", 1)):
        with pytest.raises(ValueError):
            mjpeg.images_of(bad)
    for bad in (b"x", image[:-2], image[:60] + image[70:], image[:40] + image[-2:], image.replace(b"\xff\xc3", b"\xff\xc0")):
        with pytest.raises(ValueError):
            mjpeg.decode_frames([bad])


def test_shots():
    calm, other = np.zeros((6, 576), dtype=np.uint8), np.full((5, 576), 200, dtype=np.uint8)
    assert mjpeg.shots(mjpeg.histograms(np.concatenate([calm, other, calm]))) == [0, 6, 11]
    assert mjpeg.shots(mjpeg.histograms(calm[:1])) == [0]


def test_features_and_clips(spark):
    docs = odd_documents(spark)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(r.text)
    ship = mjpeg.media(docs)
    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(mjpeg._features, mjpeg.FEATURES).collect()
    assert len(rows) == docs.count()
    by_payload = {}
    for r in rows:
        raws = [(t or "").encode() for t in ids[r.doc_id]]
        assert r.n_bytes in map(len, raws) and r.payload_sha256 in {hashlib.sha256(mjpeg.padded(x)).hexdigest() for x in raws}
        assert r.tail_crc32 in {zlib.crc32(mjpeg.padded(x)[-32:]) for x in raws}
        by_payload.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_payload.values())
    assert {r.media_sha256 for r in rows} == {hashlib.sha256(r.media).hexdigest() for r in ship.collect()}
    clips = mjpeg.clips(ship.unionByName(spark.createDataFrame([(77, None)], "doc_id long, media binary")))
    total = clips.groupBy().agg(F.sum("frames")).first()[0]
    assert total == sum(r.payload_bytes // 576 for r in rows) and clips.where("end_s <= start_s OR doc_id = 77").count() == 0
    assert mjpeg.media(empty_documents(spark)).count() == 0
