"""Compression of vectors to codes: product quantization, its codebooks trained by Elkan's Lloyd rounds in whole numbers.

Components become floor(1024 * x); a vector is cut into four consecutive parts, each with a codebook of up to 256 entries. A round
assigns every part to its nearest entry (squared distance, ties to the lower index), then moves each entry to the floor of its
parts' mean.

Bounds. With every vector, a table in the shared folder keeps for each part an upper bound of the distance to its entry and, for each
entry, a lower bound of the distance to it. Both are whole numbers: the root of an exact squared distance, rounded up or down. After
entries have moved, the upper bound grows and the lower ones shrink by the distance moved, rounded up. An entry is left out only
if it is strictly farther: its lower bound, or half the distance between it and the part's entry, is above the upper bound. What is left is
computed exactly, so ties are seen as such and go to the lower index. Lower bounds are kept in 16 bits, in units of a power
of two that the largest component gives.

A round is a map over that table, which writes the next one, and an aggregation of sums and counts, combined before it is shuffled;
the codebooks, whose size depends on entries and dimensions alone, are all that reaches the driver. A lost executor's part is
read again from the table.

Exactness: squared distances are computed as doubles where all terms stay below 2**53, otherwise as whole numbers of any size; sums
as decimals of 38 digits. Components beyond 62 bits, and an error above 2**63 - 1, which no long can tell, raise.

Cases: vectors that are null or hold null or non-finite components are dropped, as are those whose length isn't that of the first
kept one; parts differ by one in length where four doesn't divide it; null vec_ids come after all others among the first entries,
equal ones by vector; fewer than 256 vectors give as many entries, equal ones may stay unused; repeated rows count again; null labels are one
label; an empty table gives an empty result; columns besides vec_id, embedding and label aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, scratch, ship, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Terms of a squared distance below this are exact as doubles.
EXACT = 1 << 53
#: Rows worked on at a time, exact distances computed at a time, lower bounds' largest number.
SLICE, PAIRS, TOP = 1024, 1 << 16, 0xFFFF
#: Labels with at least this share of the rows meet their sums by broadcast: there are at most as many.
HOT = 256


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector is dropped."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double stops at the ends of a long
    number = lambda x: F.when(F.abs(x) < 1 << 62, F.floor(x)).otherwise(F.raise_error("a component is too large for whole numbers of 62 bits"))
    return F.when(fine, F.transform(vector, lambda x: number(x.cast("double") * scale)))


def _root(x: np.ndarray, up: bool) -> np.ndarray:
    """Whole roots of whole squares, rounded up or down."""
    if x.dtype == object:
        return np.array([math.isqrt(v - 1) + 1 if up and v else math.isqrt(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    r += (r + 1) * (r + 1) <= x
    return r + (r * r < x) if up else r


class Codebooks:
    """The entries of each part, as whole numbers, and what the bounds need of them."""

    def __init__(self, parts: list[list[list[int]]], largest: int):
        self.largest = largest
        dims = max((len(e) for p in parts for e in p), default=0)
        self.plain = 4 * dims * (largest + 1) ** 2 < EXACT
        kind = np.int64 if self.plain else object
        self.parts = [np.array(p, dtype=kind).reshape(len(p), -1) for p in parts]
        # a unit of the lower bounds: all distances in 16 bits
        self.unit = max(0, (2 * (largest + 1) * (math.isqrt(max(dims, 1)) + 1)).bit_length() - 16)
        # between entries, rounded down
        self.between = [_root(self._squares(p, p), up=False) for p in self.parts]

    def _squares(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances of all x to all entries, exact."""
        if self.plain:
            a, b = x.astype(np.float64), entries.astype(np.float64)
            return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
        return ((x[:, None, :] - entries[None]) ** 2).sum(axis=2) if x.shape[1] else np.zeros((len(x), len(entries)), dtype=object)

    def _pairs(self, x: np.ndarray, entries: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = [((x[rows[k : k + PAIRS]] - entries[of[k : k + PAIRS]]) ** 2).sum(axis=1) for k in range(0, len(rows), PAIRS)]
        return np.concatenate(out) if out else np.zeros(0, dtype=x.dtype)

    def first(self, part: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """code, squared distance, upper and lower bounds, without any bounds before."""
        squares = self._squares(x, self.parts[part])
        code = squares.argmin(axis=1)  # the first of equals
        error = squares[np.arange(len(x)), code]
        return code, error, _root(error, up=True), self._packed(_root(squares, up=False))

    def _packed(self, lower: np.ndarray) -> np.ndarray:
        return np.minimum(np.maximum(lower, 0) >> self.unit, TOP).astype(np.uint16)

    def next(self, part: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same with bounds from before the entries moved by ``moved``; the squared distance is -1 where none was needed."""
        entries, between, every = self.parts[part], self.between[part], np.arange(len(x))
        upper = upper + moved[code]
        lower = np.maximum((lower.astype(np.int64) << self.unit) - moved[None, :], 0)
        error = np.full(len(x), -1, dtype=x.dtype)

        def left(rows: np.ndarray) -> np.ndarray:
            """Which entries may be as near as the rows' own."""
            u = upper[rows][:, None]
            near = (lower[rows] <= u) & (between[code[rows]] <= 2 * u)
            near[np.arange(len(rows)), code[rows]] = False
            return near

        rows = np.flatnonzero(left(every).any(axis=1))
        error[rows] = self._pairs(x, entries, rows, code[rows])
        upper[rows] = _root(error[rows], up=True)
        lower[rows, code[rows]] = _root(error[rows], up=False)
        near = left(rows)
        at, of = np.nonzero(near)
        squares = self._pairs(x, entries, rows[at], of)
        lower[rows[at], of] = _root(squares, up=False)
        # the nearest, the lowest index among equals: the old entry stands in line with the others
        at, of, squares = np.concatenate([at, np.arange(len(rows))]), np.concatenate([of, code[rows]]), np.concatenate([squares, error[rows]])
        order = np.lexsort((of, squares, at)) if squares.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], squares[i], of[i])), dtype=np.int64)
        firsts = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
        code = code.copy()
        code[rows], error[rows] = of[firsts], squares[firsts]
        upper[rows] = _root(error[rows], up=True)
        return code, error, upper, self._packed(lower)

    def exact(self, part: int, x: np.ndarray, code: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Squared distances where there are none yet."""
        rows = np.flatnonzero(error < 0)
        error[rows] = self._pairs(x, self.parts[part], rows, code[rows])
        return error

    def moved(self, after: Codebooks) -> list[np.ndarray]:
        """How far each entry is from here to ``after``, rounded up."""
        return [_root(((a - b) ** 2).sum(axis=1), up=True) for a, b in zip(self.parts, after.parts, strict=True)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.parts for v in p.ravel().tolist()).encode()).hexdigest()


def cuts(dims: int, parts: int = PARTS) -> list[int]:
    return [dims * p // parts for p in range(parts + 1)]


STATE = "vec_id long, label_key string, v array<long>, codes array<int>, upper array<long>, lower binary"
FINAL = "vec_id long, label_key string, code string, error long"


def _assign(books: Codebooks, moved: list[np.ndarray] | None, ends: list[int], last: bool):
    kind = books.parts[0].dtype

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, ends[-1]).astype(kind)
            found = []
            if moved is None:
                found = [books.first(p, v[:, ends[p] : ends[p + 1]]) for p in range(len(ends) - 1)]
            else:
                codes, upper = (batch.column(c).flatten().to_numpy().reshape(n, -1) for c in ("codes", "upper"))
                held = np.array([np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column("lower")]).reshape(n, len(ends) - 1, -1)
                found = [books.next(p, v[:, ends[p] : ends[p + 1]], codes[:, p].astype(np.int64), upper[:, p], held[:, p], moved[p]) for p in range(len(ends) - 1)]
            codes = np.stack([f[0] for f in found], axis=1)
            if last:
                error = sum(books.exact(p, v[:, ends[p] : ends[p + 1]], codes[:, p], f[1]) for p, f in enumerate(found))
                names = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), pa.array(names), pa.array(error.tolist(), pa.int64())], ["vec_id", "label_key", "code", "error"])
            else:
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().tolist(), t))
                lower = np.stack([f[3] for f in found], axis=1).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label_key"), batch.column("v"), lists(codes, pa.int32()), lists(np.stack([f[2] for f in found], axis=1), pa.int64()), pa.array([x.tobytes() for x in lower], pa.binary())],
                    ["vec_id", "label_key", "v", "codes", "upper", "lower"],
                )

    return run


def _means(state: DataFrame, books: Codebooks, ends: list[int]) -> list[list[list[int]]]:
    """Each entry's floor of the mean of its parts; an unused one stays. One row an entry comes back."""
    new = [p.tolist() for p in books.parts]
    wide = max(b - a for a, b in zip(ends, ends[1:], strict=False))
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col("codes")[p].alias("entry"), F.slice("v", ends[p] + 1, ends[p + 1] - ends[p]).alias("x")) for p in range(len(ends) - 1)])
    sums = [F.sum(F.get("x", F.lit(i)).cast("decimal(28,0)")).alias(f"s{i}") for i in range(wide)]
    for row in state.select(F.explode(parts).alias("p")).select("p.*").groupBy("part", "entry").agg(F.count("*").alias("n"), *sums).collect():
        new[row.part][row.entry] = [int(row[f"s{i}"]) // row.n for i in range(ends[row.part + 1] - ends[row.part])]
    return new


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, Codebooks | None]:
    """Rows vec_id, label_key and v of equal length -> vec_id, label_key, code and error, and the final codebooks; None if there are none."""
    spark = vectors.sparkSession
    ship(spark)
    largest = vectors.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(min(entries, 256)).select("v").collect()
    if not first:
        return None, None
    ends = cuts(len(first[0].v), parts)
    books = Codebooks([[list(r.v[ends[p] : ends[p + 1]]) for r in first] for p in range(parts)], int(largest or 0))
    state, before, moved = vectors, None, None
    for _ in range(rounds):
        path = scratch(spark, "bounds")
        state.select("vec_id", "label_key", "v", *(["codes", "upper", "lower"] if moved is not None else [])).mapInArrow(_assign(books, moved, ends, last=False), STATE).write.parquet(path)
        if before:
            drop_folder(spark, before)
        state, before = spark.read.schema(STATE).parquet(path), path
        after = Codebooks(_means(state, books, ends), books.largest)
        books, moved = after, books.moved(after)
    return state.mapInArrow(_assign(books, moved, ends, last=True), FINAL), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows (label_key, error, ...) and label_error, the sum over equal keys, nulls together. Sums of hot keys are broadcast, of which there are at most ``HOT``."""
    sums = rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    least = F.lit(rows.count() / HOT)
    keyed = sums.select(F.col("label_key").alias("key"), "label_error", "rows")
    hot = F.broadcast(keyed.where(F.col("rows") >= least).drop("rows"))
    same = F.col("label_key").eqNullSafe(F.col("key"))
    cold = rows.join(hot.drop("label_error"), same, "left_anti").join(keyed.where(F.col("rows") < least).drop("rows"), same)
    return rows.join(hot, same).unionByName(cold).drop("key")


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """Rows vec_id, embedding and label -> vec_id, code, error and label_error, and the codebooks."""
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label_key"), whole(F.col("embedding"), scale).alias("v")).where("v IS NOT NULL")
    path = scratch(spark, "vectors")
    kept.write.parquet(path)
    kept = spark.read.schema("vec_id long, label_key string, v array<long>").parquet(path)
    length = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    final, books = trained(kept.where(F.size("v") == length[0]), parts, entries, rounds) if length else (None, None)
    if final is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long"), None
    path = scratch(spark, "codes")
    final.write.parquet(path)
    return with_label_error(spark.read.schema(FINAL).parquet(path)).drop("label_key"), books


def op13_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    return found.withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))


def _sql() -> str:
    """The same in DuckDB, over embeddings: every distance of every round."""
    ctes = [r"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS MATERIALIZED (
  SELECT vec_id, place, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS t(p)
), c0 AS MATERIALIZED (SELECT p, place AS e, x FROM parts WHERE place < 256)"""]
    for r in range(ROUNDS + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, s.p, s.x, min(struct_pack(d := list_dot_product(s.x, s.x) - 2 * list_dot_product(s.x, c.x) + list_dot_product(c.x, c.x), e := c.e)) AS best
  FROM parts s JOIN c{r} c ON c.p = s.p GROUP BY ALL)""")
        if r < ROUNDS:
            ctes.append(f"""m{r} AS MATERIALIZED (
  SELECT p, e, list(mean ORDER BY i) AS x FROM (
    SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS mean FROM a{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY p, best.e, i) GROUP BY p, e
), c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e)""")
    ctes.append(f"""coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e::INT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})""")
    return "WITH " + ", ".join(ctes) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


OP13_SQL = _sql()
