"""A quality classifier by co-training on two views of a document.

The content view is the text's byte pairs, hashed into ``CONTENT`` shares. The page view is the row's other columns, source,
language and length, each alone and in pairs, hashed into ``PAGE`` marks; it doesn't see the text. Each view has a logistic
regression. Over ``ROUNDS`` rounds, each view's most confident documents without a label, as many of either class as its share
among the labels asks for, become labelled examples for the other view. At last, both views are calibrated together on labelled
documents that were held back (a logistic regression on the two scores), and every document is scored.

Every document without a label is scored in each round, in a map; what a view passes on are ``EACH_ROUND`` documents of ``POOL``,
so it grows with the corpus (all of ``EACH_ROUND`` up to ``POOL`` documents). A round's choice is a function of its weights and
bounds alone, so past rounds are done again in the map instead of kept.

Bounds: only rows with a label are sampled for a fit, by hashes: about ``LABELLED`` given labels and ``TAUGHT`` passed on by a view
in a round, those of the least hash; their features are all that reaches the driver. Labels chosen are broadcast, as they are bounded.

Cases: a null text is empty; null sources, languages and lengths are values of their own, and a table without n_chars counts as one of nulls; null labels and labels without a document don't
teach; repeated labels are averaged and ties count as good; without labels of both classes every score is the share of good ones
(0.5 if there are none); repeated rows get equal rows; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, written

LABELLED, POOL, ROUNDS, EACH_ROUND, TAUGHT = 3000, 4000, 5, 200, 1000
SURE = 2  # the least logit, of either sign, that is passed on
CONTENT, PAGE = 1024, 256
META = ("source", "lang", "n_chars")
HELD_BACK = 4  # every fourth labelled document calibrates
KEEP = 0.5
SCORES = "doc_id long, content_score double, page_score double, score double, keep boolean"
#: Bytes counted at a time.
PART = 1 << 20


def content_view(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs: of length 1, or 0 for less than two bytes."""
    x = np.frombuffer(raw, dtype=np.uint8)
    counts = np.zeros(CONTENT)
    for at in range(0, max(0, len(x) - 1), PART):
        part = x[at : at + PART + 1].astype(np.uint32)
        counts += np.bincount(((part[:-1] << 8 | part[1:]) * np.uint32(2654435761)) >> np.uint32(22), minlength=CONTENT)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def page_view(source: str | None, lang: str | None, size: int | None) -> np.ndarray:
    """Marks of the values and of their pairs. Lengths count by their power of two; a null is a value of its own, unlike any text."""
    own = [f"{k}={'' if x is None else f':{x}'}" for k, x in (("source", source), ("lang", lang), ("size", size if size is None else max(size, 0).bit_length()))]
    out = np.zeros(PAGE, dtype=np.float32)
    for mark in (*own, *("/".join(x) for x in itertools.combinations(own, 2))):
        out[zlib.crc32(mark.encode("utf-8", "surrogatepass")) % PAGE] += 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, decay: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights, the constant last, by accelerated gradient ascent from start."""
    x, y = np.column_stack([x, np.ones(len(x), dtype=x.dtype)]), y.astype(x.dtype)
    w = v = np.zeros(x.shape[1], dtype=x.dtype) if start is None else start
    rate = x.dtype.type(4 / (np.linalg.norm(x, axis=1).max() ** 2 + decay))
    shrink = np.full(len(w), decay, dtype=x.dtype)
    shrink[-1] = 0
    for t in range(steps):
        new = v + rate * (x.T @ (y - sigmoid(x @ v)) / len(x) - shrink * v)
        w, v = new, new + x.dtype.type(t / (t + 3)) * (new - w)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    content: np.ndarray | None
    page: np.ndarray | None
    both: np.ndarray  # weights of the two views' logits, and a constant

    def scores(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Columns: the content view's, the page view's and the combined probability."""
        if self.content is None:
            return np.repeat(sigmoid(self.both[-1:])[None], len(content), axis=0).repeat(3, axis=1)
        a, b = logits(content, self.content), logits(page, self.page)
        return sigmoid(np.column_stack([a, b, logits(np.column_stack([a, b]), self.both)]).astype(np.float64))


def fitted(content: np.ndarray, page: np.ndarray, label: np.ndarray, rounds: int, teach) -> Model:
    """label: 1 good, 0 bad, for rows in a fixed order. teach(weights, share of good ones) gives, for each view, what it passes on
    in this round: the rows' content view, page view and labels."""
    good = label.mean() if len(label) else 0.5
    if good in (0, 1) or not len(label):
        return Model(None, None, np.array([0, 0, np.log((good + 1e-9) / (1 - good + 1e-9))]))
    held, first = np.arange(len(label))[::HELD_BACK], np.delete(np.arange(len(label)), np.s_[::HELD_BACK])
    if len(set(label[first])) < 2 or len(set(label[held])) < 2:  # too few to hold any back
        held = first = np.arange(len(label))
    views = (content, page)
    known = [(x[first], label[first].astype(float)) for x in views]  # of each view: rows and their labels
    weights: list = [None, None]
    for round_ in range(rounds + 1):
        weights = [logistic(x, y, w, steps=80 if round_ else 200) for (x, y), w in zip(known, weights, strict=True)]
        if round_ == rounds:
            break
        for i, (*rows, y) in enumerate(teach(weights, good)):
            known[1 - i] = (np.concatenate([known[1 - i][0], rows[1 - i]]), np.concatenate([known[1 - i][1], y]))
    pair = np.column_stack([logits(x[held], w) for x, w in zip(views, weights, strict=True)])
    return Model(*weights, logistic(pair, label[held].astype(float), decay=1e-4, steps=300))


def cotrain(content: np.ndarray, page: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, each_round: int = EACH_ROUND) -> Model:
    """fitted() on what is in memory. label: 1 good, 0 bad, -1 none. Rows in a fixed order."""
    free = np.nonzero(label < 0)[0]

    def teach(weights: list, good: float) -> list:
        nonlocal free
        ups, downs = round(each_round * good), each_round - round(each_round * good)
        given = []
        for x, w in zip((content, page), weights, strict=True):
            z = logits(x[free], w)
            order = np.argsort(z, kind="stable")
            low, high = order[:downs], order[::-1][:ups]
            # only what the view is sure of is passed on
            low, high = free[low[z[low] < -SURE]], free[high[z[high] > SURE]]
            given.append((np.concatenate([low, high]), np.repeat([0.0, 1.0], [len(low), len(high)])))
        free = np.setdiff1d(free, np.concatenate([rows for rows, _ in given]))
        return [(content[rows], page[rows], y) for rows, y in given]

    known = label >= 0
    return fitted(content[known], page[known], label[known], rounds, teach)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _views(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("good"), pa.array([x.tobytes() for x in rows[0]], pa.binary()), pa.array([x.tobytes() for x in rows[1]], pa.binary())],
            ["key", "good", "content", "page"],
        )


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column("text")]
    page = [page_view(*x) for x in zip(*(batch.column(c).to_pylist() for c in META), strict=True)]
    return np.array([content_view(r) for r in raw]).reshape(-1, CONTENT), np.array(page).reshape(-1, PAGE)


def _passed(z: list[np.ndarray], bounds: list) -> np.ndarray:
    """For each row and view: 0 or 1, the label that the view passes on; -1: none."""
    return np.column_stack([np.where(x < low, 0, np.where(x > high, 1, -1)) for x, (low, high) in zip(z, bounds, strict=True)])


def _sure(past: list, weights: list):
    """key and both views' logits of the documents that no past round (weights, bounds) has passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                views = _views(batch)
                z = lambda own: [logits(x, w).astype(np.float64) for x, w in zip(views, own, strict=True)]
                free = np.ones(batch.num_rows, dtype=bool)
                for own, bounds in past:
                    free &= (_passed(z(own), bounds) < 0).all(axis=1)
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(free)) for x in (batch.column("key"), *map(pa.array, z(weights)))], ["key", "z0", "z1"])

    return run


def _score(model: Model, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                s = model.scores(*_views(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s[:, i]) for i in range(3)), pa.array(s[:, 2] >= keep)], [c.split()[0] for c in SCORES.split(", ")])

    return run


def _read(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("text", "source", "lang")], length.cast("long").alias("n_chars"))


def _gathered(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, both views and good of bounded rows, on the driver, in the order of their keys."""
    found = rows.select("key", "good", "text", *META).mapInArrow(_features, "key long, good int, content binary, page binary").orderBy("key").limit(most).toArrow()
    keys = np.array(found["key"].to_pylist(), dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    matrix = lambda c, n: np.frombuffer(b"".join(found[c].to_pylist()), dtype=np.float32).reshape(-1, n)[order]
    return keys[order], matrix("content", CONTENT), matrix("page", PAGE), np.array(found["good"].to_pylist(), dtype=int)[order]


def learned(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, taught: int = TAUGHT) -> Model:
    """labels: (doc_id, good 0 or 1)."""
    ship(docs.sparkSession)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = lambda most, n: int((1 << 30) * min(1.0, most / max(1, n)))
    known = labels.where(F.col("good").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.where(place < share(labelled, known.count())).groupBy("doc_id").agg((F.avg("good") >= 0.5).cast("int").alias("good")).orderBy(place, "doc_id").limit(2 * labelled)
    # a row is known by a hash of all that is read of it, as doc_id may be null or repeated; chosen is bounded, so it may be broadcast
    rows = _read(docs).withColumn("key", F.xxhash64("doc_id", "text", *META))
    _, *views, label = _gathered(rows.join(F.broadcast(chosen), "doc_id"), 4 * labelled)
    free = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    past: list = []

    def teach(weights: list, good: float) -> list:
        seen = written(free.select("key", "text", *META).mapInArrow(_sure(list(past), weights), "key long, z0 double, z1 double"), "logits")
        n = seen.count()
        # each class's most confident, in proportion to the corpus: the bounds are quantiles of all free documents' logits
        each = EACH_ROUND * max(1.0, n / pool) / max(1, n)
        at = [float(min(1.0, each * (1 - good))), float(max(0.0, 1 - each * good))]
        found = seen.agg(*[F.percentile_approx(f"z{i}", at, 100_000).alias(f"z{i}") for i in range(2)]).first() if n else ([0, 0], [0, 0])
        # just beyond the quantile, so that it is among them; only what the view is sure of is passed on
        bounds = [(min(-SURE, np.nextafter(low, np.inf)), max(SURE, np.nextafter(high, -np.inf))) for low, high in found]
        past.append((weights, bounds))
        out = []
        for i, (low, high) in enumerate(bounds):
            z = F.col(f"z{i}")
            passed = seen.where((z < float(low)) | (z > float(high))).select("key", (z > 0).cast("int").alias("good")).distinct()
            # labelled by now: a sample of them is enough for the fit
            some = passed.orderBy(F.xxhash64("key", F.lit("taught")), "key").limit(taught)
            keys, content, page, y = _gathered(rows.join(F.broadcast(some), "key"), 4 * taught)
            once = np.unique(keys, return_index=True)[1]
            out.append((content[once], page[once], y[once].astype(float)))
        return out

    return fitted(*views, label, rounds, teach)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    ship(docs.sparkSession)
    return _read(docs).mapInArrow(_score(model, keep), SCORES)


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), F.col("quality").alias("good"))
    return score(docs, learned(docs, labels))
