"""Byte-level BPE by tree reduction: texts are encoded in halves, and neighbours are joined at their boundary.

Two things cut a text: a pattern into words, and merges by rank each word into tokens. Both can be computed for halves and joined.

Words. ``Words`` of a stretch of text is the pattern's matches there. A match depends on what follows up to two characters beyond its end
only, so in a left half all matches that end at least two characters before the boundary are final. From the end of the last of these the
pattern is run again over the boundary until a match begins where a match of the right half begins; from there on both agree, since
matches depend on what follows alone.

Tokens. A sequence of tokens is what the merges give for its bytes if each two neighbours, encoded by themselves, stay these two tokens:
in the whole, the first merge over a boundary between two of them would happen in the pair just as well, for until then both sides went the
same way as there. So two encoded halves are joined by encoding a window around the boundary, one token of each side at first, again; when the window's first
token and the one before it, and its last and the one behind it, are such pairs, all outside is final. If not, that side of the window doubles.
A word that is a token as a whole is that token, as in the library's own encoder.

Decoding maps ids to bytes and concatenates halves up the same kind of tree.

A worker keeps the words that it has met with their ids, up to ``MOST`` bytes of them. No row is shuffled.

Cases: null and empty texts have no ids and decode to no bytes; long texts and words are encoded whole, in time that grows with their length times its
logarithm; equal rows give equal results; an empty table gives an empty result; ids outside the vocabulary are an error in decoding; ``encoded`` keeps
doc_id and reads text only.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a leaf of the tree over a text, bytes of a leaf of that over a word, ids of a leaf in decoding.
LEAF, PART, IDS = 8192, 256, 4096
#: Words of up to so many bytes are merged by looking through the list; a rank that no pair has.
SHORT, NONE = 64, 1 << 60
#: Bytes of words that a worker keeps, and words.
MOST, WORDS = 64 << 20, 1_000_000


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Words, as bytes, to ids by rank, and back."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.apart = functools.lru_cache(1 << 16)(self._apart)

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves: always the neighbours of lowest rank, the first of equals, until none can be merged."""
        if len(data) > SHORT:
            return self._merged(data)
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            at = pairs.index(low)
            new = parts[at] + parts[at + 1]
            parts[at : at + 2] = [new]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + new, NONE)
            if at < len(pairs):
                pairs[at] = get(new + parts[at + 1], NONE)
        return [self.ranks[p] for p in parts]

    def _merged(self, data: bytes) -> list[int]:
        """The same for more bytes: a heap of the neighbours, and links between what is left."""
        get, n = self.ranks.get, len(data)
        ends, before = [*range(1, n + 1)], [*range(-1, n)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = ends[at]
            if not at < middle < end or ends[middle] != end:
                continue  # one of the two has been merged since
            ends[at], ends[middle] = end, 0
            if end < n:
                before[end] = at
                if (r := get(data[at : ends[end]])) is not None:
                    heapq.heappush(heap, (r, at, ends[end]))
            if at and (r := get(data[before[at] : end])) is not None:
                heapq.heappush(heap, (r, before[at], end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : ends[at]]])
            at = ends[at]
        return out

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        return self.merged(self.bytes[left] + self.bytes[right]) == [left, right]

    def tree(self, data: bytes) -> list[int]:
        """Ids of data: those of its halves, joined."""
        if len(data) <= PART:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self.tree(data[:middle]), self.tree(data[middle:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            before, after = left[: len(left) - i], right[j:]
            inside = b"".join(map(self.bytes.__getitem__, left[len(left) - i :] + right[:j]))
            window = self.merged(inside)
            first, last = not before or self.apart(before[-1], window[0]), not after or self.apart(window[-1], after[0])
            if first and last:
                return before + window + after
            i, j = i if first else 2 * i, j if last else 2 * j

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        return self.tree(word) if whole is None else [whole]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= IDS:
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class Encoder:
    """Texts to ids: a tree over the text, with the words by number and the ids of each in one row of arrays."""

    def __init__(self, merges: Merges, pattern: str, most: int = MOST):
        self.merges, self.most = merges, most
        self.find = regex.compile(pattern)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []
        self.size = 0
        # of the words that have ids: where they start in flat, and how many they are
        self.start, self.count, self.flat = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def _number(self, found: list[str]) -> np.ndarray:
        numbers = self.numbers
        try:
            return np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found))
        except KeyError:
            for word in found:
                if word not in numbers:
                    numbers[word] = len(self.words)
                    self.words.append(word)
                    self.size += len(word)
            return np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found))

    def _split(self, text: str, start: int, end: int) -> np.ndarray:
        """The words of text[start:end] by number."""
        if end - start <= LEAF:
            return self._number(self.find.findall(text[start:end]))
        middle = (start + end) // 2
        return self._join(text, middle, end, self._split(text, start, middle), self._split(text, middle, end))

    def _join(self, text: str, middle: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        kept, at = len(left), middle
        while kept and at > middle - 2:  # the match that ends at ``at`` isn't final
            kept -= 1
            at -= len(self.words[left[kept]])
        new, skipped, begins = [], 0, middle
        while True:
            while begins < at and skipped < len(right):
                begins += len(self.words[right[skipped]])
                skipped += 1
            if begins == at or at == end:
                break
            word = self.find.match(text, at, end).group()
            new.append(word)
            at += len(word)
        return np.concatenate([left[:kept], self._number(new), right[skipped:]])

    def _fill(self) -> None:
        """Ids of the words that have none yet."""
        new = [self.merges.encode(w.encode("utf-8", "surrogatepass")) for w in self.words[len(self.start) :]]
        if new:
            counts = np.array([len(x) for x in new], dtype=np.int64)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, np.array([i for x in new for i in x], dtype=np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        waiting: list[np.ndarray] = []

        def flush() -> None:
            self._fill()
            for words in waiting:
                count = self.count[words]
                ends = np.cumsum(count)
                out.append(self.flat[np.repeat(self.start[words] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int32))
            waiting.clear()

        for text in texts:
            waiting.append(self._split(text, 0, len(text)))
            if self.size > self.most or len(self.words) > WORDS:
                flush()
                self._clear()
        flush()
        return out


@functools.cache
def merges(path: str) -> Merges:
    """One for each worker process, kept from task to task."""
    return Merges(read_ranks(path))


@functools.cache
def encoder(path: str, cut: str) -> Encoder:
    return Encoder(merges(path), cut)


def _encode(path: str, cut: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, cut)
        for batch in batches:
            ids = own.encode([x or "" for x in batch.column("text").to_pylist()])
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.zeros(0, dtype=np.int32)])))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merges(path)
        for batch in batches:
            ids = batch.column("ids")
            data = [own.decode(ids[i].values.to_numpy()) if ids[i].is_valid else None for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "data"), pa.array(data, pa.binary())], [*(n for n in batch.schema.names if n != "data"), "data"])

    return run


def encoded(docs: DataFrame, path: str | None = None, cut: str | None = None) -> DataFrame:
    """doc_id and ids of every whole text."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path or ranks_path(), cut or pattern()), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and data: the bytes that ids stand for; null for null ids."""
    ship(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decode(path or ranks_path()), "doc_id long, ids array<int>, data binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decoded(encoded(table(spark, sf_dir, "documents")))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
