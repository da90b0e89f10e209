"""AVI motion-JPEG: a lossless writer and reader, and shots by adaptive histogram differences.

Frames are 8-bit grey, 32 x 18 samples, and are coded as lossless JPEG (process 14, SOF3): each sample as its difference from
the one to the left (in the first column, the one above; at first, 128), by a fixed Huffman table of categories. Each is an
intra frame in a '00dc' chunk of an AVI file; the index (idx1) is what the reader goes by. Frames are coded and decoded
many at a time: step k treats sample k of every frame in the batch, so Python works per sample place and not per sample.

Shots: each frame's grey histogram is compared with that of the frame before (half the sum of absolute differences, as a share
of the samples). A cut is where the difference passes the mean of the ``memory`` differences before by ``factor`` deviations,
and ``floor`` at least. Each shot is a clip with its first frame, frames, and times at ``FPS``.

Cases: null and empty texts give one frame of bytes 255; long texts are coded in blocks of frames; equal texts give equal
files; repeated rows give equal rows; an empty table gives no rows; columns besides doc_id and text aren't read. Files that are
not AVI, are cut short, or have other sizes or coding raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

WIDTH, HEIGHT, FPS = 32, 18, 25
UNIT, PAD = WIDTH * HEIGHT, 255
#: Code lengths of the difference categories 0 to 8, for text: neighbours are letters or a letter and a blank.
LENGTHS = (3, 5, 4, 3, 2, 4, 5, 2, 5)
#: Frames coded at a time.
BLOCK = 8192
MEMORY, FACTOR, FLOOR, BINS = 8, 2.0, 0.15, 16


def _canonical(lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """By code length: how many (from 1 to 16), the categories in order, and each category's code."""
    order = sorted(range(len(lengths)), key=lambda c: (lengths[c], c))
    codes, code, last = [0] * len(lengths), 0, 0
    for c in order:
        code <<= lengths[c] - last
        codes[c], code, last = code, code + 1, lengths[c]
    return [lengths.count(n) for n in range(1, 17)], order, codes


def _header() -> bytes:
    counts, order, _ = _canonical(LENGTHS)
    frame = struct.pack(">BHHB3B", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    huffman = bytes([0, *counts, *order])
    scan = bytes([1, 1, 0, 1, 0, 0])  # predictor 1: the sample to the left
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return b"\xff\xd8" + segment(0xC3, frame) + segment(0xC4, huffman) + segment(0xDA, scan)


HEADER, EOI = _header(), b"\xff\xd9"


def _differences(frames: np.ndarray) -> np.ndarray:
    """(frames, HEIGHT, WIDTH) -> differences in coding order, one row for each frame."""
    x = frames.astype(np.int32)
    left = np.empty_like(x)
    left[:, :, 1:] = x[:, :, :-1]
    left[:, 1:, 0] = x[:, :-1, 0]
    left[:, 0, 0] = 128
    return (x - left).reshape(len(x), -1)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """(n, UNIT) samples -> n JPEG images."""
    d = _differences(samples.reshape(-1, HEIGHT, WIDTH))
    size = np.abs(d)
    category = np.zeros_like(d)
    for n in range(8):
        category += size >= 1 << n
    lengths, codes = np.array(LENGTHS), np.array(_canonical(LENGTHS)[2])
    bits = lengths[category] + category
    value = (codes[category] << category) | np.where(d < 0, d + (1 << category) - 1, d)
    ends = np.cumsum(bits, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    width = int(n_bytes.max()) + 4
    out = np.zeros((len(d), width), dtype=np.uint8)
    rows = np.arange(len(d)) * width
    flat = out.reshape(-1)
    for k in range(UNIT):
        # at most 13 bits from any place in a byte lie in three bytes, which no other sample of this step shares
        start = ends[:, k] - bits[:, k]
        word = value[:, k] << (24 - (start & 7) - bits[:, k])
        at = rows + (start >> 3)
        flat[at] |= (word >> 16).astype(np.uint8)
        flat[at + 1] |= (word >> 8 & 255).astype(np.uint8)
        flat[at + 2] |= (word & 255).astype(np.uint8)
    spare = (n_bytes << 3) - ends[:, -1]
    flat[rows + n_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)  # the last byte is filled with ones
    return [HEADER + out[i, : n_bytes[i]].tobytes().replace(b"\xff", b"\xff\x00") + EOI for i in range(len(d))]


def _entropy(image: bytes) -> bytes:
    """The coded samples of a JPEG image, after a look at its segments."""
    if image.startswith(HEADER):
        at = len(HEADER)
    elif image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    else:
        at, seen = 2, {}
        while True:
            if at + 4 > len(image) or image[at] != 0xFF:
                raise ValueError("damaged JPEG segments")
            marker, length = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
            seen[marker] = image[at : at + 2 + length]
            at += 2 + length
            if marker == 0xDA:
                break
        if any(v not in HEADER for k, v in seen.items() if k in (0xC4, 0xDA) or 0xC0 <= k <= 0xCF) or not {0xC3, 0xC4, 0xDA} <= seen.keys():
            raise ValueError("a JPEG coding that this reader does not know")
    if image[-2:] != EOI:
        raise ValueError("a JPEG image is cut short")
    return image[at:-2].replace(b"\xff\x00", b"\xff")


def _lookup() -> np.ndarray:
    """The next 5 bits -> 16 * category + code length."""
    most = max(LENGTHS)
    out = np.full(1 << most, -1, dtype=np.int32)
    for c, (length, code) in enumerate(zip(LENGTHS, _canonical(LENGTHS)[2], strict=True)):
        out[code << (most - length) : (code + 1) << (most - length)] = 16 * c + length
    return out


LOOKUP = _lookup()


def decode_frames(images: list[bytes]) -> np.ndarray:
    """n JPEG images -> (n, UNIT) samples."""
    coded = [_entropy(x) for x in images]
    lengths = np.array([len(x) for x in coded], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(coded) + bytes(4), dtype=np.uint8).astype(np.int64)
    # every three bytes from each place as one number
    data = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    place, limit = starts * 8, (starts + lengths) * 8
    out = np.empty((UNIT, len(coded)), dtype=np.int32)
    top = len(data) - 1
    for k in range(UNIT):
        word = data[np.minimum(place >> 3, top)] << (place & 7) & 0xFFFFFF
        entry = LOOKUP[word >> (24 - max(LENGTHS))]
        if (entry < 0).any():
            raise ValueError("damaged JPEG samples")
        length, category = entry & 15, entry >> 4
        extra = word >> (24 - length - category) & ((1 << category) - 1)
        out[k] = np.where(extra < (1 << category) >> 1, extra - (1 << category) + 1, extra)
        place = place + length + category
    if (place > limit).any() or (limit - place > 7).any():
        raise ValueError("damaged JPEG samples")
    d = out.T.reshape(-1, HEIGHT, WIDTH)
    first = np.cumsum(d[:, :, 0], axis=1) + 128
    d[:, :, 0] = first
    return np.cumsum(d, axis=2).reshape(len(coded), UNIT).astype(np.uint8)


def padded(payload: bytes) -> bytes:
    return payload + bytes([PAD]) * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(images: list[bytes]) -> bytes:
    """Images as an AVI file with an index."""
    largest = max(map(len, images))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(images), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(images), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    lists = lambda kind, body: _chunk(b"LIST", kind + body)
    head = lists(b"hdrl", _chunk(b"avih", main) + lists(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    sizes = np.array([len(x) for x in images], dtype="<u4")
    index = np.zeros((len(images), 4), dtype="<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    taken = 8 + sizes.astype(np.int64) + (sizes & 1)
    index[:, 2] = 4 + np.cumsum(taken) - taken  # from the word 'movi'
    movie = lists(b"movi", b"".join(_chunk(b"00dc", x) for x in images))
    body = b"AVI " + head + movie + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise ValueError("an AVI chunk is cut short")
        yield bytes(data[at : at + 4]), at + 8, size
        at += 8 + size + (size & 1)


def images_of(data: bytes) -> tuple[list[bytes], float]:
    """The images that an AVI file's index lists, and the frames a second."""
    view = memoryview(data)
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    index, movie, fps = None, None, None
    for name, at, size in _chunks(view, 12, 8 + int.from_bytes(data[4:8], "little")):
        kind = bytes(view[at : at + 4])
        if name == b"LIST" and kind == b"hdrl":
            fps = 1e6 / next(int.from_bytes(view[a : a + 4], "little") for n, a, _ in _chunks(view, at + 4, at + size) if n == b"avih")
        elif name == b"LIST" and kind == b"movi":
            movie = at
        elif name == b"idx1":
            index = np.frombuffer(view[at : at + size], dtype="<u4").reshape(-1, 4)
    if index is None or movie is None or fps is None:
        raise ValueError("an AVI file without an index")
    out = []
    for name, _, offset, size in index.tolist():
        at = movie + offset
        if name.to_bytes(4, "little") != data[at : at + 4] or size != int.from_bytes(view[at + 4 : at + 8], "little"):
            raise ValueError("the AVI index does not fit the frames")
        out.append(data[at + 8 : at + 8 + size])
    return out, fps


def histograms(frames: np.ndarray) -> np.ndarray:
    bins = (frames.astype(np.int64) * BINS >> 8) + np.arange(len(frames))[:, None] * BINS
    return np.bincount(bins.reshape(-1), minlength=len(frames) * BINS).reshape(-1, BINS)


def shots(hist: np.ndarray) -> list[int]:
    """The first frame of each shot."""
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * UNIT)
    if not len(d):
        return [0]
    # mean and deviation of the differences since MEMORY frames before
    total, square = (np.concatenate(([0.0], np.cumsum(x))) for x in (d, d * d))
    at = np.arange(len(d))
    low = np.maximum(0, at - MEMORY)
    n = np.maximum(1, at - low)
    mean = (total[at] - total[low]) / n
    deviation = np.sqrt(np.maximum(0, (square[at] - square[low]) / n - mean * mean))
    return [0, *(np.nonzero(d > np.maximum(FLOOR, mean + FACTOR * deviation))[0] + 1).tolist()]


CLIPS = "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double"


def _each(texts: list[str]) -> Iterator[tuple[bytes, bytes, bytes, np.ndarray]]:
    """For each text: its bytes, the AVI file, the payload read back from it, and its frames' histograms."""
    waiting: list[bytes] = []

    def flush() -> Iterator[tuple[bytes, bytes, bytes, np.ndarray]]:
        units = [padded(x) for x in waiting]
        frames = np.frombuffer(b"".join(units), dtype=np.uint8).reshape(-1, UNIT)
        images = [x for k in range(0, len(frames), BLOCK) for x in encode_frames(frames[k : k + BLOCK])]
        files, at = [], 0
        for u in units:
            files.append(avi(images[at : at + len(u) // UNIT]))
            at += len(u) // UNIT
        del images, frames
        stored = [images_of(x)[0] for x in files]
        flat = [x for s in stored for x in s]
        back = np.concatenate([decode_frames(flat[k : k + BLOCK]) for k in range(0, len(flat), BLOCK)])
        hist, at = histograms(back), 0
        for raw, file, own in zip(waiting, files, stored, strict=True):
            yield raw, file, back[at : at + len(own)].tobytes(), hist[at : at + len(own)]
            at += len(own)

    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        waiting.append(raw)
        size += len(raw) + UNIT
        if size > BLOCK * UNIT:
            yield from flush()
            waiting, size = [], 0
    if waiting:
        yield from flush()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, file, back, hist in _each([x.as_py() for x in batch.column("text")]):
            cuts = shots(hist)
            mark = zlib.crc32(hist.astype("<u4").tobytes() + np.array(cuts, dtype="<u4").tobytes())
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"frames={len(hist)};shots={len(cuts)};crc={mark:08x}"))
        names = [c.split()[0] for c in FEATURES.split(", ")]
        columns = [batch.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, (_, file, _, _) in zip(batch.column("doc_id").to_pylist(), _each([x.as_py() for x in batch.column("text")]), strict=True):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "media": pa.array([file], pa.binary())})


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CLIPS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    for batch in batches:
        rows = []
        for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            if not media.is_valid:
                continue
            images, fps = images_of(media.as_py())
            hist = np.concatenate([histograms(decode_frames(images[k : k + BLOCK])) for k in range(0, len(images), BLOCK)])
            cuts = [*shots(hist), len(hist)]
            rows += [(doc, i, a, b - a, a / fps, b / fps) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def media(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text stored as an AVI file."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_files, "doc_id long, media binary")


def clips(files: DataFrame) -> DataFrame:
    """doc_id and media (AVI; null: no clips) -> a row for each shot."""
    ship(files.sparkSession)
    return files.select("doc_id", "media").mapInArrow(_clips, CLIPS)


def op7_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_features, FEATURES)
