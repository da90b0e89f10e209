"""Exact top-k search by a Voronoi join.

Vectors are whole numbers, floor(64 * x), and the score is the inner product, so results are exact. Data and queries are
grouped by the nearest of a bounded number of pivots. Summaries per cell (its largest distance to the pivot, and its least
k + 1 distances) give each query group a score that at least k of its candidates are sure to reach; with it, a vector x is
sent to a query group g only if

    p_g . x + R_g |x|  >=  that score        (p_g: the group's pivot, R_g: its radius)

since no query of g scores higher with x. A unit of work is a query group against a block of a cell: both are cut by a
hash to ``TILE_BYTES`` of numbers, whatever one cell holds, and solved by matrix products. Where nothing prunes, a vector is sent
once for as many queries as a tile holds, and a query once for as many vectors. Each unit returns the k best of each
query, and these are merged by a window over the query.

Only pivots and summaries, whose size depends on ``max_pivots`` and k alone, reach the driver. Vectors with few dimensions or
clear clusters are pruned hard; for random directions in 64 dimensions no bound can prune, and every unit is solved.

Cases: vectors null, empty or with null or non-finite components take no part, as data or queries; components beyond 62 bits, and scores that no
long can tell, raise; large ones are multiplied as whole numbers of any size; queries and candidates of
other dimensions don't meet; ties go to the smaller vec_id; null vec_ids take no part; repeated rows are candidates of their
own, but no row meets its own vec_id; fewer candidates give fewer rows; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, table, written

K, EVERY, SCALE = 20, 20, 64
#: Rows to a pivot, pivots at most, and bytes of either side's matrix in a unit of work.
PER_PIVOT, MAX_PIVOTS, TILE_BYTES = 8192, 256, 8 << 20
#: Scores computed at a time.
SCORES = 1 << 21
#: Sums of products below this are exact as doubles; larger ones are computed as whole numbers.
EXACT = 1 << 53


def whole(vector: Column) -> Column:
    """floor(64 * x) of each component; null if the vector takes no part."""
    fine = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double stops at the ends of a long
    number = lambda x: F.when(F.abs(x) < 1 << 62, F.floor(x)).otherwise(F.raise_error("a component is too large for whole numbers of 62 bits"))
    return F.when(fine, F.transform(vector, lambda x: number(x.cast("double") * SCALE)))


def _exact(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Inner products of large numbers."""
    a, b = (np.array(x.tolist(), dtype=object) for x in (a, b))
    out = a @ b.T
    if (abs(out) >= 1 << 63).any():
        raise OverflowError("a score does not fit a long")
    return out.astype(np.int64)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _cells(pivots: np.ndarray):
    """Nearest pivot, distance to it and length; ties go to the first pivot."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square = (pivots * pivots).sum(axis=1)
        for rows in parts:
            if len(rows):
                x = _matrix(rows.v)
                away = np.maximum(0, (x * x).sum(axis=1)[:, None] + square - 2 * x @ pivots.T)
                cell = away.argmin(axis=1)
                yield rows.assign(cell=cell.astype(np.int32), away=np.sqrt(away[np.arange(len(x)), cell]), norm=np.sqrt((x * x).sum(axis=1)))

    return run


def _least(k: int):
    """The least k distances of each cell in a partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"cell": pd.Series(dtype="int32"), "away": pd.Series(dtype="float64")})
        for rows in parts:
            kept = pd.concat([kept, rows]).sort_values("away", kind="stable").groupby("cell").head(k)
        yield kept.astype({"cell": "int32", "away": "float64"})

    return run


def _targets(groups: list[tuple[int, np.ndarray, float, float]]):
    """Each vector once for each query group that it may matter to. groups: number, pivot, radius, sure score."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if not len(rows):
                continue
            x, norm = _matrix(rows.v), rows.norm.to_numpy()
            for number, pivot, radius, sure in groups:
                near = x @ pivot + radius * norm >= sure - 1e-6 * (1 + abs(sure))
                if near.any():
                    yield rows.loc[near, ["vec_id", "v", "cell"]].assign(grp=np.int32(number))

    return run


def _solve(k: int):
    def run(key: tuple, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(queries) or not len(data):
            return empty
        data = data.sort_values("vec_id", kind="stable")
        ids, x = data.vec_id.to_numpy(), _matrix(data.v)
        out = []
        part = max(16, SCORES // len(data))
        for at in range(0, len(queries), part):
            some = queries.iloc[at : at + part]
            asked = _matrix(some.v)
            if np.abs(asked).max() * np.abs(x).max() * x.shape[1] < EXACT:
                scores, none = asked @ x.T, -np.inf
            else:
                scores, none = _exact(some.v, data.v), np.iinfo(np.int64).min
            scores[some.vec_id.to_numpy()[:, None] == ids] = none
            if scores.shape[1] > k:
                # all that reach the k-th score, ties included, are sorted; ids rise, so a stable sort settles ties
                edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                row, col = np.nonzero((scores >= edge[:, None]) & (scores > none))
            else:
                row, col = np.nonzero(scores > none)
            found = scores[row, col]
            order = np.lexsort((ids[col], -found, row))
            row, col, found = row[order], col[order], found[order]
            starts = np.searchsorted(row, np.arange(len(some)))
            best = np.arange(len(row)) - starts[row] < k
            out.append(pd.DataFrame({"query_id": some.vec_id.to_numpy()[row[best]], "vec_id": ids[col[best]], "score": found[best].astype(np.int64)}))
        return pd.concat(out)

    return run


def top_k(data: DataFrame, queries: DataFrame, k: int = K, max_pivots: int = MAX_PIVOTS, per_pivot: int = PER_PIVOT, block: int | None = None, group: int | None = None) -> DataFrame:
    """data and queries: (vec_id long, v array<long>) -> query_id, rank, vec_id, score."""
    spark = data.sparkSession
    ship(spark)
    schema = "query_id long, vec_id long, score long"
    sizes = {r["d"]: (r["n"], r["q"]) for r in data.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).join(queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("q")), "d").collect()}
    found = spark.createDataFrame([], schema)
    for d, (n, q) in sorted(sizes.items()):
        one = lambda df, d=d: df.where(F.size("v") == d)
        tile = max(256, TILE_BYTES // (8 * d))
        found = found.unionByName(_search(one(data), one(queries), n, q, k, max_pivots, per_pivot, block or tile, group or tile))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(data: DataFrame, queries: DataFrame, n: int, q: int, k: int, max_pivots: int, per_pivot: int, block: int, group: int) -> DataFrame:
    wanted = min(max_pivots, max(1, -(-n // per_pivot)))
    # pivots: the vectors of least hash, told apart by value
    chosen = data.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(wanted).collect()
    pivots = np.array([r["v"] for r in chosen], dtype=np.float64)
    celled = "vec_id long, v array<long>, cell int, away double, norm double"
    points = written(data.mapInPandas(_cells(pivots), celled), "cells")
    # few queries need few groups
    own = pivots[: max(1, -(-q // group))]
    asked = written(queries.mapInPandas(_cells(own), celled), "query-cells")
    least = points.select("cell", "away").mapInPandas(_least(k + 1), "cell int, away double")
    nearest = least.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("away"))).where(F.col("n") <= k + 1)
    near = [(r["cell"], r["away"]) for r in nearest.select("cell", "away").collect()]
    cells, away = np.array([c for c, _ in near], dtype=int), np.array([a for _, a in near])
    counts = points.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    reach = dict(points.groupBy("cell").agg(F.max("away").alias("reach")).collect())
    groups, pairs = [], []
    for r in asked.groupBy("cell").agg(F.max("away").alias("radius"), F.max("norm").alias("norm")).orderBy("cell").collect():
        pivot, radius, norm = own[r["cell"]], r["radius"], r["norm"]
        spread = radius * np.linalg.norm(pivots, axis=1)
        # q . x >= q . p - |q| d >= p_g . p - R_g |p| - |q| d; one of the k + 1 may be the query itself
        sure = np.sort((pivots @ pivot - spread)[cells] - norm * away)[::-1]
        sure = float(sure[k]) if len(sure) > k else -np.inf
        groups.append((r["cell"], pivot, radius, sure))
        most = pivots @ pivot + spread
        pairs += [(int(r["cell"]), int(c)) for c, far in reach.items() if most[c] + norm * far >= sure - 1e-6 * (1 + abs(sure))]
    # data: each vector to the groups it may matter to, in blocks of its cell; queries: to the blocks of the cells they may need
    slices = asked.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias("slices")).withColumnRenamed("cell", "grp")
    sent = points.mapInPandas(_targets(groups), "vec_id long, v array<long>, cell int, grp int")
    dealt = (
        sent.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .join(slices, "grp").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    )
    needed = data.sparkSession.createDataFrame(pairs, "grp int, cell int").join(counts, "cell")
    ask = (
        asked.select("vec_id", "v", F.col("cell").alias("grp")).join(slices, "grp")
        .withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"))
        .join(needed, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    on = ["cell", "block", "grp", "slice"]
    ask, dealt = (x.select("vec_id", "v", *on) for x in (ask, dealt))
    return ask.groupBy(*on).cogroup(dealt.groupBy(*on)).applyInPandas(_solve(k), "query_id long, vec_id long, score long")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), whole(F.col("embedding")).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    vectors = written(vectors, "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0)).withColumn("rank", F.col("rank").cast("int"))


#: The same in DuckDB, over embeddings: every pair, then the best.
OP1_SQL = r"""
WITH whole AS (
  SELECT vec_id, len(embedding) AS d, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole x ON q.vec_id % 20 = 0 AND q.d = x.d AND q.vec_id <> x.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
