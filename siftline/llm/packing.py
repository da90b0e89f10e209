"""Packing token sequences by best-fit decreasing.

Texts are tokenized once. A document's ids, with the end id, are first cut into full windows; what is left over is one piece
shorter than a window. Pieces are dealt by hash into groups of about ``group_pieces``; in a group, pieces go longest first to
the open window with the least room that still takes them. A segment tree over the remaining capacities 1 to ``window`` finds
that window: a leaf counts the open windows with so much room, and the search is for the first non-empty leaf at or right of
the piece's length.

Groups are sized from the count of pieces, and the hash is of all that is known of a piece, so documents that share an id, or have
none, are dealt out too: a task holds a bounded number of short rows at any scale. Only lengths and checksums are shuffled, never texts or ids.

Cases: a null or empty text is the end id alone; the longest texts are cut like any other; repeated rows are packed once each;
ties go by doc_id, start, checksum and size; an empty table gives an empty result; ``pack`` reads doc_id and text only.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, written

WINDOW, END_ID, GROUP_PIECES = 4096, 2, 8192
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that close words; an apostrophe may begin a piece of its own.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Between words that are encoded together.
MARK = "\x01"
MARKED = f" {MARK} "


class _Numbered(dict):
    """Words by number; a word not met before gets the next one and waits in new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordTokens:
    """Ids of texts by a tokenizer that drops white space, so each run of other characters is encoded by itself and kept.

    Runs seen before are looked up; new ones are encoded many at a time, with marks between them.
    Text of Latin-1 characters is lower-cased first, as the tokenizer would, so that fewer runs are new. When the store holds
    more than ``most`` runs, those met only once are dropped.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # the same model without the steps that leave words of lower-case letters as they are
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.mark_ids: dict[str, np.ndarray] = {}
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.at = _Numbered()
        self.ids, self.used = np.empty(1 << 16, dtype=np.uint32), 0
        self.starts, self.lengths, self.met = (np.zeros(1 << 14, dtype=np.int64) for _ in range(3))

    def _shrink(self) -> None:
        keep = np.nonzero(self.met[: len(self.at)] > 1)[0][: self.most // 2]
        words = list(self.at)
        lengths = self.lengths[keep]
        ends = np.cumsum(lengths)
        ids = self._ids_at(keep)
        self._clear()
        self.at.update(zip([words[i] for i in keep.tolist()], range(len(keep)), strict=True))
        self.ids, self.used = np.append(ids, np.empty(1 << 16, dtype=np.uint32)), len(ids)
        self.starts, self.lengths, self.met = (np.append(x, np.zeros(1 << 14, dtype=np.int64)) for x in (ends - lengths, lengths, 0 * lengths))

    def _learn(self) -> None:
        """Ids of the new words. Those of letters and closing marks are put together from the word and the marks."""
        n, new = len(self.at) - len(self.at.new), self.at.new
        plain, other, joined, bases, marks = [], [], [], [], []
        for i, word in enumerate(new):  # bases not met before join the list as it is read
            base = word.rstrip(MARKS)
            if not (base.isalpha() and base.islower() and max(base) < "\u0100"):
                other.append(i)
            elif len(base) == len(word):
                plain.append(i)
            else:
                joined.append(i)
                bases.append(self.at[base])
                marks.append(word[len(base) :])
        self.at.new = []
        while len(self.at) > len(self.starts):
            self.starts, self.lengths, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met))
        for which, encode in ((plain, self._plain), (other, self._others)):
            for k in range(0, len(which), 8192):
                some = which[k : k + 8192]
                ids, counts = encode([new[i] for i in some])
                self._store(n + np.array(some), ids, counts[: len(some)])
        if joined:
            for mark in set(marks) - self.mark_ids.keys():
                self.mark_ids[mark] = np.array(self.tokenizer.encode(mark, add_special_tokens=False).ids, dtype=np.uint32)
            tails = [self.mark_ids[m] for m in marks]
            first, tail = self.lengths[bases], np.array([len(t) for t in tails])
            of_base = np.repeat(np.tile([True, False], len(joined)), np.stack([first, tail], axis=1).reshape(-1))
            ids = np.empty(len(of_base), dtype=np.uint32)
            ids[of_base] = self._ids_at(np.array(bases))
            ids[~of_base] = np.concatenate(tails)
            self._store(n + np.array(joined), ids, first + tail)

    def _store(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        need = self.used + len(ids)
        while need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : need] = ids
        self.lengths[at], self.starts[at] = counts, self.used + np.cumsum(counts) - counts
        self.used = need

    def _ids_at(self, at: np.ndarray) -> np.ndarray:
        """The ids of words by number, one after another."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(lengths.sum())]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters, one after another, and how many each has: each word is one word end."""
        (found,) = self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.uint32)
        ends = np.nonzero(self.ends[ids])[0] + 1
        return ids, np.diff(ends, prepend=0)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for other words. A mark between blanks is one id of its own; words that hold it are encoded apart."""
        found = np.array(self.tokenizer.encode(MARKED.join(w if MARK not in w else "" for w in words), add_special_tokens=False).ids, dtype=np.uint32)
        own = found != self.mark
        ids, counts = found[own], np.bincount(np.cumsum(~own)[own], minlength=len(words))
        for i in [i for i, w in enumerate(words) if MARK in w]:
            alone = self.tokenizer.encode(words[i], add_special_tokens=False).ids
            ids, counts[i] = np.insert(ids, counts[:i].sum(), alone), len(alone)
        return ids, counts

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > self.most:
            self._shrink()
        words, until = [], []
        for text in texts:
            words += OTHER.findall(text) if ODD.search(text) else _lowered(text).split()
            until.append(len(words))
        at = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        del words
        if self.at.new:
            self._learn()
        self.met[: len(self.at)] += np.bincount(at, minlength=len(self.at))
        lengths = self.lengths[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return np.split(self._ids_at(at), ends[until[:-1]]) if texts else []


#: str.split() also splits at these, which the tokenizer takes as characters.
ODD = re.compile("[\x1c-\x1f]")
OTHER = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SPACE = re.compile("[\t-\r ]")
#: Characters encoded at a time.
PART = 1 << 20


def _lowered(text: str) -> str:
    """In Latin-1, lower case is one letter for one; elsewhere it is left to the tokenizer, as is text with special tokens."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


@functools.cache
def word_tokens(path: str) -> WordTokens:
    """One store for each worker process, kept from task to task."""
    return WordTokens(path)


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts, cut before white space."""
    start = 0
    while len(text) - start > PART and (cut := SPACE.search(text, start + PART)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _ids(tokens: WordTokens, texts: Iterator[str]) -> Iterator[np.ndarray]:
    waiting: list[str] = []
    size = 0
    for text in texts:
        if len(text) > PART:
            yield from tokens.encode_all(waiting)
            waiting, size = [], 0
            yield np.concatenate([tokens.encode_all([x])[0] for x in _parts(text)])
            continue
        waiting.append(text)
        size += len(text)
        if size > PART:
            yield from tokens.encode_all(waiting)
            waiting, size = [], 0
    yield from tokens.encode_all(waiting)


def _cut(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc, own in zip(batch.column("doc_id").to_pylist(), _ids(tokens, (x.as_py() or "" for x in batch.column("text"))), strict=True):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for k, v in (("doc_id", doc), ("start", start), ("length", len(piece)), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", len(ids))):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(piece.astype(np.int32))
            columns = {k: pa.array(v, pa.int64()) for k, v in out.items() if k != "ids"}
            if with_ids:
                columns["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: its place in the document, length, checksum, and the ids themselves if asked for."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(_cut(path or tokenizer_path(), window, end_id, with_ids), PIECES + ", ids array<int>" * with_ids)


class OpenWindows:
    """Windows by room left: counts in a segment tree, and a stack of windows at each leaf."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.stacks: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.stacks.setdefault(room, []).append(window)
            self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least length, and that room."""
        at, tree = length + self.leaves, self.tree
        while not tree[at]:  # up to the first subtree to the right that holds a window
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:  # down to its first leaf
            at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.stacks[room].pop(), room


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """For lengths in falling order: each one's window, from 0, and offset there."""
    opened, count, out = OpenWindows(window), 0, []
    for length in lengths:
        found = opened.take(length)
        if found is None:
            found, count = (count, window), count + 1
        at, room = found
        out.append((at, window - room))
        opened.put(room - length, at)
    return out


def _pack(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True], kind="stable")
        placed = np.array(best_fit(rows["length"].tolist(), window), dtype=np.int64).reshape(-1, 2)
        return rows.assign(sequence_id=(int(key[0]) << 32) + placed[:, 0], offset=placed[:, 1]).drop(columns="group")

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row per piece: where it lies in its document, and in which sequence and where there it is packed."""
    cut = written(pieces(docs, path, window, end_id), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "doc_tokens"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_pack(window), PACKED)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
