import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from siftline.llm import knn


def brute(data, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in data if i != q and len(y) == len(x))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_oracle(spark):
    same(knn.op1_voronoi_knn(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), knn.OP1_SQL)


@pytest.mark.parametrize("sizes", [{}, {"per_pivot": 40, "block": 30, "group": 12}, {"per_pivot": 7, "max_pivots": 9, "block": 5, "group": 3}])
def test_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 4)) * 4
    data = [(i, [int(v) for v in np.floor(64 * (centres[i % 6] + 0.2 * rng.normal(size=4)))]) for i in range(300)]
    data += [(1000 + i, [7, 7, 7, 7]) for i in range(150)]  # one vector, many times
    data += [(2000, [1, 2]), (2020, [3, 4]), (2040, [-1, 5]), (3000, [0, 0, 0, 0]), (4000, [9])]
    data += [data[0], data[300]]  # repeated rows
    frame = spark.createDataFrame(data, "vec_id long, v array<long>")
    queries = [d for d in data if d[0] % 20 == 0]
    assert rows(knn.top_k(frame, frame.where("vec_id % 20 = 0").distinct(), k=5, **sizes)) == brute(data, sorted({(i, tuple(v)) for i, v in queries}), 5)


def test_pruning_drops_vectors(spark):
    """Far clusters are not sent to a group that they can't matter to."""
    x = np.array([[100, 0], [101, 1], [-500, 0], [-501, 1]], dtype=float)
    import pandas as pd

    part = pd.DataFrame({"vec_id": range(4), "v": list(x), "cell": 0, "norm": np.linalg.norm(x, axis=1)})
    sent = pd.concat(list(knn._targets([(0, np.array([100.0, 0.0]), 2.0, 9000.0)])(iter([part]))))
    assert sent.vec_id.tolist() == [0, 1]


def test_large_numbers(spark):
    data = [(i, [(1 << 30) + i, (1 << 30) - 3 * i]) for i in range(40)]
    frame = spark.createDataFrame(data, "vec_id long, v array<long>")
    assert rows(knn.top_k(frame, frame.where("vec_id = 20"), k=3)) == brute(data, [data[20]], 3)


def test_odd_vectors(spark):
    values = [(0, [0.5, -0.01]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.0, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(values, "vec_id long, embedding array<float>").select("vec_id", knn.whole(F.col("embedding")).alias("v"))
    assert [r.v for r in frame.orderBy("vec_id").collect()] == [[64, 64], [32, -1], None, None, None, None, None, [0, 0]]
    empty = frame.where("false")
    assert knn.top_k(empty, empty).count() == 0


def test_large_components(spark):
    """Beyond what doubles tell apart, scores are exact; beyond a long they are an error, not another number."""
    big = 2.0**24
    rows = spark.createDataFrame([(i, [big + i, -big]) for i in range(30)], "vec_id long, embedding array<double>")
    v = {i: (int(64 * (big + i)), int(-64 * big)) for i in range(30)}
    vectors = rows.select("vec_id", knn.whole(rows.embedding).alias("v"))
    got = {(r.query_id, r.vec_id): r.score for r in knn.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()}
    assert got and all(score == sum(a * b for a, b in zip(v[q], v[x])) for (q, x), score in got.items()) and max(got.values()) > 1 << 60
    for size, text in ((2.0**50, "long"), (1e18, "too large")):
        rows = spark.createDataFrame([(i, [size, size]) for i in range(2)], "vec_id long, embedding array<double>")
        vectors = rows.select("vec_id", knn.whole(rows.embedding).alias("v"))
        with pytest.raises(Exception, match=text):
            knn.top_k(vectors, vectors).collect()
