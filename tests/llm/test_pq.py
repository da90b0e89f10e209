import hashlib
import math

import numpy as np
import pytest
from oracle import connect, same

from siftline.llm import pq, queries

SF = "/root/testdata/sf0.001"


def slow(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, label, whole vector) -> sorted (vec_id, code, error, label_error), and the codebooks' digest."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = len(rows[0][2])
    rows = [r for r in rows if len(r[2]) == dims]
    ends = [dims * p // parts for p in range(parts + 1)]
    books = [[r[2][ends[p] : ends[p + 1]] for r in rows[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((square(r[2][ends[p] : ends[p + 1]], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for r in rows]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [r[2][ends[p] : ends[p + 1]] for r, f in zip(rows, found, strict=True) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for r, e in zip(rows, errors, strict=True):
        labels[r[1]] = labels.get(r[1], 0) + e
    text = ",".join(str(v) for p in books for e in p for v in e)
    return sorted(((r[0], bytes(i for _, i in f).hex(), e, labels[r[1]]) for r, f, e in zip(rows, found, errors, strict=True)), key=str), hashlib.sha256(text.encode()).hexdigest()


def check(spark, vectors, **options):
    """vectors: (vec_id, label, components times 1024 or anything else)."""
    scaled = [(i, None if v is None else [None if x is None else x / 1024 for x in v], label, 7) for i, label, v in vectors]
    rows = spark.createDataFrame(scaled, "vec_id long, embedding array<double>, label int, error int").repartition(3)
    got, books = pq.compressed(rows, **options)
    fine = [(i, label, [math.floor(x) for x in v]) for i, label, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want, digest = slow(fine, **options)
    assert sorted(map(tuple, got.select("vec_id", "code", "error", "label_error").collect()), key=str) == want
    assert books.digest() == digest


def test_against_every_distance(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, int(i % 3), (rng.normal(size=10) * 100).tolist()) for i in range(150)], entries=9)  # parts of unequal length


def test_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 5 == 0 else i % 2, rng.integers(0, 3, 8).tolist()) for i in range(200)]  # most distances are equal to others
    check(spark, rows, entries=12)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1, rng.normal(size=4).tolist()) for i in range(20)]
    rows += [(20, 1, None), (21, None, [1.0, None, 2.0, 3.0]), (22, 1, [1.0, float("nan"), 2.0, 3.0]), (23, 1, [float("inf")] * 4), (24, 2, [1.0, 2.0])]
    rows += [(3, 1, rows[3][2]), (3, 2, [5.0, 6.0, 7.0, 8.0]), (None, None, [1.0, 2.0, 3.0, 4.0]), (None, 5, [1.0, 2.0, 3.0, 4.0])]
    check(spark, rows, entries=6)
    check(spark, rows)  # fewer vectors than entries


def test_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0, [float(x) for x in rng.integers(-(1 << 28), 1 << 28, 8)]) for i in range(40)]
    check(spark, rows, entries=7)
    with pytest.raises(Exception, match="too large"):
        check(spark, [(0, 0, [1e30, 0.0, 0.0, 0.0])])


def test_bounds_hold():
    """After each round all bounds hold, codes are the nearest entries, and something is pruned."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-2000, 2000, (20, 8))
    x = centres[rng.integers(0, 20, 400)] + rng.integers(-30, 30, (400, 8))
    books = pq.Codebooks([x[:20].tolist()], int(np.abs(x).max()))
    code, error, upper, lower = books.first(0, x)
    kept = 0
    for _ in range(4):
        new = [(x[code == i].sum(axis=0) // (code == i).sum() if (code == i).any() else e).tolist() for i, e in enumerate(books.parts[0])]
        after = pq.Codebooks([new], books.largest)
        code, error, upper, lower = after.next(0, x, code, upper, lower, books.moved(after)[0])
        books = after
        true = ((x[:, None, :] - books.parts[0][None]) ** 2).sum(axis=2)
        assert (code == true.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= true[np.arange(len(x)), code]).all()
        assert ((lower.astype(np.int64) << books.unit) ** 2 <= true).all()
        assert ((error < 0) | (error == true[np.arange(len(x)), code])).all()
        kept += int((error < 0).sum())
    assert kept > 400


def test_empty(spark):
    got, books = pq.compressed(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert got.count() == 0 and books is None


def test_query(spark):
    same(queries.QUERIES["op13_elkan_codes"](spark, SF), connect(SF), queries.ORACLES["op13_elkan_codes"])
