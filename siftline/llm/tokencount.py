"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Pieces and their log-probabilities make a unigram model: a piece of rank r in the vocabulary file has probability in
proportion to 1 / (r + RANK_OFFSET) (Zipf's law; nothing is trained), and single characters outside the vocabulary have
``UNKNOWN``. A pre-token is a white-space-delimited word with the vocabulary's word mark in front.

For each pre-token, two forward scores run over its prefixes: the best segmentation's (Viterbi; its number of pieces is the
token count) and the sum over all segmentations, with the expected number of pieces. Both depend on the prefix alone, so
distinct pre-tokens are put in a trie, each node is computed once from its ancestors, and terminals store the counts. The trie is
a worker's own and lasts from task to task; when it passes ``most`` nodes it starts anew. No row is shuffled.

Cases: null and empty texts have no tokens; long texts are looked at in parts; ties between segmentations go to fewer pieces;
repeated rows give equal rows; an empty table gives an empty result; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

VOCABULARY = "piece_bpe_32k.model"
RANK_OFFSET, UNKNOWN, WORD_MARK = 10, -30.0, "▁"
COUNTS = "doc_id long, words long, tokens long, expected_tokens double, log_score double"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(path: str) -> dict[str, float]:
    """Normal pieces of a vocabulary file in its order -> log-probability."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    total = math.log(sum(1 / (r + RANK_OFFSET) for r in range(len(names))))
    return {name: -math.log(r + RANK_OFFSET) - total for r, name in enumerate(names)}


BASE = 0x5851F42D4C957F2D


class Counter:
    """Counts of pre-tokens. New words enter the trie together; their new nodes are computed level by level, all of a level at once.

    A string's key is the polynomial of its code points modulo 2**64, so a piece that ends at a node is found by the keys of the node
    and of the ancestor before the piece.
    """

    def __init__(self, pieces: dict[str, float], most: int = 2_000_000):
        self.most, self.longest = most, max(map(len, pieces))
        self.power = np.array([pow(BASE, n, 1 << 64) for n in range(self.longest + 1)], dtype=np.uint64)
        by_length: list[dict[int, float]] = [{} for _ in range(self.longest + 1)]
        for piece, score in pieces.items():
            key = 0
            for c in piece:
                key = (key * BASE + ord(c) + 1) % (1 << 64)
            by_length[len(piece)][key] = score
        # sorted keys and scores of each length
        self.pieces = [(np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)])) for d in by_length]
        self._clear()

    def _clear(self) -> None:
        # node 0 is the empty prefix
        self.code, self.parent, self.depth = [0], [0], [0]
        self.children: dict[int, int] = {}
        self.terminal: dict[str, int] = {}
        self.done = 1
        self.up, self.key = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint64)
        self.best, self.count, self.total, self.expected = np.zeros(1), np.zeros(1, dtype=np.int64), np.zeros(1), np.zeros(1)

    def _insert(self, word: str) -> None:
        node, children = 0, self.children
        for c in map(ord, WORD_MARK + word):
            after = children.get(node << 21 | c)
            if after is None:
                after = children[node << 21 | c] = len(self.code)
                self.code.append(c)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
            node = after
        self.terminal[word] = node

    def _compute(self) -> None:
        """Scores of the nodes that have none."""
        n, old = len(self.code), self.done
        grow = lambda x: np.concatenate([x, np.zeros(n - old, dtype=x.dtype)])
        self.up, self.key, self.best, self.count, self.total, self.expected = map(grow, (self.up, self.key, self.best, self.count, self.total, self.expected))
        self.up[old:] = self.parent[old:]
        code, depth = np.array(self.code[old:], dtype=np.uint64), np.array(self.depth[old:])
        order = np.argsort(depth, kind="stable")
        cuts = np.nonzero(np.diff(depth[order]))[0] + 1
        with np.errstate(over="ignore"):
            for level in np.split(order, cuts):
                nodes = level + old
                above = self.up[nodes]
                self.key[nodes] = self.key[above] * np.uint64(BASE) + code[level] + np.uint64(1)
                best, count = self.best[above] + UNKNOWN, self.count[above] + 1
                top, whole, expected = (np.full(len(nodes), x) for x in (-np.inf, 0.0, 0.0))
                start = nodes
                for length in range(1, min(self.longest, int(depth[level[0]])) + 1):
                    start = self.up[start]
                    keys, scores = self.pieces[length]
                    if not len(keys):
                        continue
                    wanted = self.key[nodes] - self.key[start] * self.power[length]
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = np.nonzero(keys[at] == wanted)[0]
                    if not len(hit):
                        continue
                    score, before = scores[at[hit]], start[hit]
                    new, pieces = self.best[before] + score, self.count[before] + 1
                    better = (top[hit] == -np.inf) | (new > best[hit]) | (new == best[hit]) & (pieces < count[hit])
                    best[hit[better]], count[hit[better]] = new[better], pieces[better]
                    part = self.total[before] + score
                    high = np.maximum(top[hit], part)
                    was, now = np.exp(top[hit] - high), np.exp(part - high)
                    expected[hit] = expected[hit] * was + (self.expected[before] + 1) * now
                    whole[hit] = whole[hit] * was + now
                    top[hit] = high
                none = whole == 0  # no piece ends here: a character outside the vocabulary
                top[none], whole[none], expected[none] = self.total[above[none]] + UNKNOWN, 1, self.expected[above[none]] + 1
                self.best[nodes], self.count[nodes] = best, count
                self.total[nodes], self.expected[nodes] = top + np.log(whole), expected / whole
        self.done = n

    def counts(self, words: list[str]) -> np.ndarray:
        """For each word: tokens, expected tokens and log of the summed score."""
        if len(self.code) > self.most:
            self._clear()
        known = self.terminal
        for word in dict.fromkeys(words):
            if word not in known:
                self._insert(word)
        if len(self.code) > self.done:
            self._compute()
        at = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        return np.stack([self.count[at], self.expected[at], self.total[at]], axis=1)


@functools.cache
def counter(path: str) -> Counter:
    """One for each worker process, kept from task to task."""
    return Counter(pieces_of(path))


#: Words counted at a time.
PART = 1 << 20


def _sums(own: Counter, texts: Iterator[str]) -> Iterator[tuple[int, int, float, float]]:
    """Words, tokens, expected tokens and log score of each text; many short texts, or parts of a long one, at a time."""
    words, until = [], []

    def flush() -> Iterator[tuple[int, int, float, float]]:
        values = np.concatenate([np.zeros((1, 3)), own.counts(words)])
        for a, b in zip([0, *until], until, strict=False):
            yield b - a, int(values[a + 1 : b + 1, 0].sum()), round(math.fsum(values[a + 1 : b + 1, 1]), 6), round(math.fsum(values[a + 1 : b + 1, 2]), 6)

    for text in texts:
        new = text.split()
        if len(new) > PART:
            parts = [own.counts(new[k : k + PART]) for k in range(0, len(new), PART)]
            yield from flush()
            words, until = [], []
            yield len(new), int(sum(p[:, 0].sum() for p in parts)), *(round(math.fsum(x for p in parts for x in p[:, i]), 6) for i in (1, 2))
            continue
        words += new
        until.append(len(words))
        if len(words) > PART:
            yield from flush()
            words, until = [], []
    yield from flush()


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            rows = list(_sums(own, (x.as_py() or "" for x in batch.column("text"))))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [c.split()[0] for c in COUNTS.split(", ")])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, words, tokens (of the best segmentation), expected_tokens and log_score (over all segmentations)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count(path or vocabulary_path()), COUNTS)


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
