"""Language of words and documents by a linear-chain conditional random field.

A word is a run of letters, in lower case. Its features are its n-grams of one to four letters with the word's ends (those at an
end are the affixes), hashed into ``HASHED`` rows, and its entry in a lexicon of the words that the sample has ``FREQUENT`` times
or more. The field has a weight for each feature and language, and one for each pair of neighbouring labels; both are learned
by gradient ascent on the likelihood, by forward-backward, from sequences of which half switch language at some word.

A document's words are labelled by forward-backward over the whole text. It is cut into segments only for speed: the product of
a segment's matrices carries messages across, which is exact. The document's language is that with the largest mean
probability over its words, and this mean is the score.

Sample: up to ``DOCS`` documents of each language, those of the least hash, and of each a window of ``CHARS`` characters at a place
set by the hash. It is all that reaches the driver, whatever the corpus. Every language is learned; every text is labelled whole.

Cases: null and empty texts, and those without a letter, are ``und`` with score 0; with no labelled documents, all are; if none of
their texts has a letter, all languages are as likely, and the first one is told; null
langs and null doc_ids don't teach; ties go to the language first in code point order; repeated rows get equal rows; an empty
table gives an empty result; columns besides doc_id, text and (for learning) lang aren't read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, table

DOCS, CHARS = 200, 1500
HASHED, FREQUENT = 1 << 16, 5
SEQUENCE, SEGMENT = 48, 128
#: A document of an even mix of two languages scores about 0.5; below this, words agree on nothing.
LEAST = 0.4
EPOCHS, PARTS, RATE, DECAY = 5, 8, 0.4, 1e-6
#: Characters whose words are labelled at a time.
AT_ONCE = 1 << 18
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
BASE = 0x5851F42D4C957F2D


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def codes(text: str) -> np.ndarray:
    """The lower-cased text as code points, 0 for all but letters."""
    x = np.frombuffer(unicodedata.normalize("NFC", text.lower()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[x], x, 0).astype(np.uint64)


@dataclass
class Words:
    """Words of several texts: for each, rows of the weight table and where the next word's begin; and words per text."""

    rows: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    per_text: np.ndarray
    at: np.ndarray
    length: np.ndarray


def words_of(texts: list[np.ndarray]) -> Words:
    """texts: as by codes(). Two blanks go before each text and one after it."""
    sizes = np.array([len(t) + 3 for t in texts], dtype=np.int64)
    c = np.zeros(int(sizes.sum()) + 3, dtype=np.uint64)
    begins = np.cumsum(sizes) - sizes + 3
    for b, t in zip(begins.tolist(), texts, strict=True):
        c[b : b + len(t)] = t
    letter = c != 0
    first = np.nonzero(letter[1:] & ~letter[:-1])[0] + 1
    last = np.nonzero(letter[:-1] & ~letter[1:])[0] + 1  # the place after the word
    per_text = np.bincount(np.searchsorted(begins, first, side="right") - 1, minlength=len(texts)) if len(first) else np.zeros(len(texts), dtype=np.int64)
    length = last - first
    # the places of each word and the blank after it
    starts = np.cumsum(length + 1) - length - 1
    place = np.repeat(first - starts, length + 1) + np.arange(int((length + 1).sum()))
    inside = place - np.repeat(first, length + 1)
    n1, n2, n3, n4 = c[place], c[place - 1], c[place - 2], c[place - 3]
    m = [np.uint64(x) for x in MIX]
    null = HASHED
    cut = np.uint64(64 - (HASHED.bit_length() - 1))
    with np.errstate(over="ignore"):
        two = n1 * m[0] + n2 * m[1]
        three = two + n3 * m[2]
        row = lambda h, ok: np.where(ok, ((h ^ (h >> np.uint64(29))) * m[3] >> cut).astype(np.int64), null)
        rows = np.stack([row(n1 * m[2], n1 > 0), row(two, inside >= 0), row(three, inside >= 1), row(three * m[1] + n4 * m[2], inside >= 2)], axis=1)
        powers = _powers(int(length.max()) + 1 if len(length) else 1)
        keys = np.add.reduceat((n1 + np.uint64(1)) * powers[inside], starts) if len(starts) else np.zeros(0, dtype=np.uint64)
    return Words(rows.astype(np.int32), starts, keys, per_text, first - (np.repeat(begins, per_text) if len(first) else 0), length)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out[0] = 1
        out[1:] = np.uint64(BASE)
        return np.multiply.accumulate(out)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # a row for each hash, and one of zeros
    lexicon: np.ndarray  # sorted keys
    entries: np.ndarray  # a row for each, and one of zeros
    moves: np.ndarray

    def entry(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lexicon, keys)
        known = np.append(self.lexicon, np.uint64(0))[at] == keys
        return np.where(known & (at < len(self.lexicon)), at, len(self.lexicon))

    def scores(self, w: Words) -> np.ndarray:
        """A row of scores for each word."""
        if not len(w.starts):
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        at = self.weights[w.rows[:, 0]]
        for k in range(1, w.rows.shape[1]):
            at += self.weights[w.rows[:, k]]
        return np.add.reduceat(at, w.starts, axis=0) + self.entries[self.entry(w.keys)]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def messages(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the words of several sequences, one after another -> for each word what comes from before, itself included, and
    from behind, each up to a factor; the words' own factors, and those of the moves."""
    n, k = scores.shape
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    step = np.exp(moves - moves.max())
    lengths = lengths[lengths > 0]
    parts = -(-lengths // segment)
    owner = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(lengths) - lengths, parts) + nth * segment
    size = np.minimum(segment, np.repeat(lengths, parts) - nth * segment)
    order = np.argsort(-size, kind="stable")  # at each step, those that go on are the first
    begin, size, nth, owner = begin[order], size[order], nth[order], owner[order]
    active = np.searchsorted(-size, -np.arange(1, segment + 1), side="right")
    before = np.full((len(size), k), 1.0 / k)  # the message into a segment's first word
    after = np.ones((len(size), k))  # and that into its last
    if parts.max() > 1:
        index = np.empty((len(lengths), int(parts.max())), dtype=np.int64)
        index[owner, nth] = np.arange(len(size))
        whole = np.zeros((len(size), k, k))
        whole[:, np.arange(k), np.arange(k)] = psi[begin]
        for t in range(1, segment):
            m = active[t]
            if not m:
                break
            whole[:m] = _scaled((whole[:m] @ step) * psi[begin[:m] + t][:, None, :])
        for j in range(1, int(parts.max())):
            on = np.nonzero(parts > j)[0]
            i, at = index[on, j - 1], index[on, j]
            before[at] = _scaled((before[i][:, None, :] @ whole[i])[:, 0] @ step)
        for j in range(int(parts.max()) - 2, -1, -1):
            on = np.nonzero(parts > j + 1)[0]
            i, at = index[on, j + 1], index[on, j]
            after[at] = _scaled((whole[i] @ after[i][:, :, None])[:, :, 0] @ step.T)
    forward = np.empty_like(psi)
    for t in range(segment):
        m = active[t]
        if not m:
            break
        come = before[:m] if t == 0 else forward[begin[:m] + t - 1] @ step
        forward[begin[:m] + t] = _scaled(come * psi[begin[:m] + t])
    behind, back = np.empty_like(psi), after[:, :]
    for t in range(segment - 1, -1, -1):
        m = active[t]
        if not m:
            continue
        at = begin[:m] + t
        go = size[:m] > t + 1
        # a segment's last word takes the message from outside, the others that from the word after
        inner = np.where(go[:, None], (psi[np.minimum(at + 1, n - 1)] * back[:m]) @ step.T, after[:m])
        back = back.copy()
        behind[at] = back[:m] = _scaled(inner)
    return forward, behind, psi, step


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Scores of the words of several sequences, one after another -> each word's probabilities, by forward-backward."""
    if not len(scores):
        return np.zeros(scores.shape)
    forward, behind, _, _ = messages(scores, lengths, moves, segment)
    return _scaled(forward * behind)


def expected(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's probabilities, the places of words with another behind them, and how often each move is to be expected."""
    forward, behind, psi, step = messages(scores, lengths, moves)
    first = np.setdiff1d(np.arange(len(scores) - 1), np.cumsum(lengths) - 1)
    pairs = _scaled(forward[first][:, :, None] * step * (psi * behind)[first + 1][:, None, :])
    return _scaled(forward * behind), first, pairs.sum(axis=0)


def learn(sample: list[tuple[str, str]], seed: int = 7) -> Model:
    """(lang, text) -> the field."""
    langs = sorted({lang for lang, _ in sample})
    k = len(langs)
    rng = np.random.default_rng(seed)
    runs: list[tuple[int, np.ndarray]] = []
    for lang, text in sample:
        x = codes(text)
        gaps = np.nonzero((x[1:] == 0) & (x[:-1] != 0))[0] + 1  # where a word has just ended
        cuts = [0, *gaps[SEQUENCE // 2 :: SEQUENCE // 2].tolist(), len(x)]
        runs += [(langs.index(lang), x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if (x[a:b] != 0).any()]
    if not runs:  # nothing to learn from: all languages are as likely
        return Model(langs, np.zeros((HASHED + 1, k), dtype=np.float32), np.zeros(0, dtype=words_of([codes("a")]).keys.dtype), np.zeros((1, k), dtype=np.float32), np.zeros((k, k)))
    # each sequence is two runs: of one language or, every other time, of any two
    order = rng.permutation(len(runs)).tolist()
    same: dict[int, list[int]] = {}
    pairs: list[tuple[int, int]] = []
    for i, r in enumerate(order):
        if i % 2:
            pairs.append((r, order[int(rng.integers(len(order)))]))
        else:
            same.setdefault(runs[r][0], []).append(r)
    for members in same.values():
        pairs += [(a, members[(i + 1) % len(members)]) for i, a in enumerate(members)]
    pairs = [pairs[i] for i in rng.permutation(len(pairs))]
    w = words_of([x for pair in pairs for x in (runs[pair[0]][1], runs[pair[1]][1])])
    label = np.repeat([runs[r][0] for pair in pairs for r in pair], w.per_text)
    lengths = w.per_text.reshape(-1, 2).sum(axis=1)
    keys, times = np.unique(w.keys, return_counts=True)
    model = Model(langs, np.zeros((HASHED + 1, k), dtype=np.float32), keys[times >= FREQUENT], None, np.zeros((k, k)))
    model.entries = np.zeros((len(model.lexicon) + 1, k), dtype=np.float32)
    squares = [np.full(x.shape, 1e-3) for x in (model.weights, model.entries, model.moves)]
    ends = np.cumsum(lengths)
    row_ends = np.append(w.starts, len(w.rows))
    for _ in range(EPOCHS):
        for part in np.array_split(np.arange(len(lengths)), min(PARTS, len(lengths))):
            low, high = int(ends[part[0]] - lengths[part[0]]), int(ends[part[-1]])
            if low == high:
                continue
            own = Words(w.rows[row_ends[low] : row_ends[high]], w.starts[low:high] - row_ends[low], w.keys[low:high], lengths[part], None, None)
            scores = model.scores(own)
            gamma, inner, joint = expected(scores, lengths[part], model.moves)
            slope = -gamma
            slope[np.arange(high - low), label[low:high]] += 1
            spread = np.repeat(slope, np.diff(np.append(own.starts, len(own.rows))), axis=0)
            by_row = np.stack([sum(np.bincount(own.rows[:, j], spread[:, i], HASHED + 1) for j in range(own.rows.shape[1])) for i in range(k)], axis=1)
            by_row[HASHED] = 0
            entry = model.entry(own.keys)
            by_entry = np.stack([np.bincount(entry, slope[:, i], len(model.entries)) for i in range(k)], axis=1)
            by_entry[-1] = 0
            # moves: observed pairs less expected ones
            seen = np.bincount(label[low:high][inner] * k + label[low:high][inner + 1], minlength=k * k).reshape(k, k)
            for x, g, s in zip((model.weights, model.entries, model.moves), (by_row, by_entry, seen - joint), squares, strict=True):
                g = g / (high - low) - DECAY * x
                s += g * g
                x += (RATE * g / np.sqrt(s)).astype(x.dtype)
    return model


def chosen(*key: Column) -> Column:
    """A number from 0 to 1 for each key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)


def sample_of(docs: DataFrame, docs_each: int = DOCS, chars: int = CHARS) -> list[tuple[str, str]]:
    """A bounded sample of the documents that may teach: (lang, a window of the text). Of each language, those of the least hash."""
    teach = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    counts = teach.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language, as the model has a column
    if not counts:
        return []
    # twice what is wanted, so that the exact cut below sees few rows
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * docs_each / r["n"]))]), F.col("lang"))
    place = chosen(F.col("doc_id"), F.col("text"))
    start = F.floor(chosen(F.lit("w"), F.col("doc_id"), F.col("text")) * F.greatest(F.lit(0), F.length("text") - chars)).cast("int")
    drawn = teach.where(F.col("text").isNotNull() & (place < share)).select("doc_id", "lang", place.alias("place"), F.substring("text", start + 1, F.lit(chars)).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))
    rows = drawn.withColumn("nth", nth).where(F.col("nth") <= docs_each).select("doc_id", "lang", "text").collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def _batches(texts: Iterable[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts as codes, of about AT_ONCE characters together, and the first one's place."""
    some, size, at = [], 0, 0
    for i, text in enumerate(texts):
        some.append(codes(text or ""))
        size += len(some[-1])
        if size > AT_ONCE:
            yield at, some
            some, size, at = [], 0, i + 1
    if some:
        yield at, some


def languages(model: Model | None, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
    """Each text's language and score."""
    lang, score = [], []
    for _, some in _batches(texts):
        w = words_of(some)
        mean = np.zeros((len(some), len(model.langs) if model else 1))
        has = w.per_text > 0
        if model and has.any():
            gamma = marginals(model.scores(w), w.per_text, model.moves)
            mean[has] = np.add.reduceat(gamma, (np.cumsum(w.per_text) - w.per_text)[has], axis=0) / w.per_text[has][:, None]
        best = mean.argmax(axis=1)
        top = mean[np.arange(len(some)), best]
        lang += [model.langs[b] if t > 0 else "und" for b, t in zip(best.tolist(), top.tolist(), strict=True)]
        score += np.clip(top, 0, 1).tolist()
    return lang, score


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = languages(model, (x.as_py() for x in batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def _spans(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for first, some in _batches((x.as_py() for x in batch.column("text"))):
                w = words_of(some)
                gamma = marginals(model.scores(w), w.per_text, model.moves)
                best, at = gamma.argmax(axis=1), 0
                for i, n in enumerate(w.per_text.tolist()):
                    own = best[at : at + n]
                    cuts = [0, *(np.nonzero(np.diff(own))[0] + 1).tolist(), n] if n else [0]
                    rows += [(ids[first + i], a, b - a, model.langs[own[a]], float(gamma[at + a : at + b, own[a]].mean())) for a, b in zip(cuts, cuts[1:], strict=False)]
                    at += n
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "first_word", "words", "lang", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """Runs of words of one language: doc_id, first_word, words, lang, score (their mean probability)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_spans(model), "doc_id long, first_word long, words long, lang string, score double")


def _known(model: Model | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = languages(model, (x.as_py() for x in batch.column("text")))
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return run


def known(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """docs' rows and columns, but for those without a language or whose score is below least. Nothing is shuffled."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_known(model, least), docs.schema)


def learned(docs: DataFrame) -> Model | None:
    sample = sample_of(docs)
    return learn(sample) if sample else None


def op10_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs, learned(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
