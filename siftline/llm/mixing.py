"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each document's expected copies are its source's target over its source's size. Within a source the documents stand in a
fixed order (size class, chunk, size, id, hash of the text), the expected copies are summed along it, one random offset per source is added,
and a document is emitted once for each integer boundary that the running sum crosses. Ordering by size makes the words
taken follow the target closely: neighbours in the order are of like size. Big documents come first; what they take by chance more
or less than their part is made up by the expected copies of the others.

A source may hold any share of the rows. The running sum is therefore in two levels: sums inside chunks of about
``rows_per_chunk`` documents or fewer long ones, then a running sum over the chunks. Chunks go by a hash of id and text, so documents
without an id are dealt out like any others. All sums are over whole numbers, so reruns agree exactly.

Cases: a null text has size 0; a null source is a source of its own, after all others; sources of size 0 get target 0 and
no copies; repeated rows are documents of their own; an empty table gives an empty result. ``mixed`` reads doc_id, source
and text only; ``mix`` passes every column through, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unit_hash, word_count, written

#: Expected copies are whole multiples of 2**-32.
ONE = 1 << 32
WEIGHTS = (5, 2, 1)
SEED = "mix-2024:"
#: A chunk has about so many words at most, so that its texts fit a task.
WORDS_PER_CHUNK = 1 << 22
#: A document of more than this part of its source's target is big.
BIG = 50


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size) -> with target. Weights repeat over the sources in code point order, null last.

    Targets share ``share`` of all sizes by weight and stop at ``most`` times the source's size; what is over is shared
    again by weight. That comes to filling all sources to one level (target per weight): sorted by most * size / weight, a
    prefix of the sources is full, and the others stand at the level which spends the rest. One row per source is sorted in
    one task here, never documents.
    """
    up, down = share
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long"))
    full = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    rest = F.sum("source_size").over(everything) * up - spent * down
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    big = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two may pass 2**63
    return (
        ranked.withColumns({"_rest": rest, "_left": weights_left})
        .withColumn("_full", (F.col("source_size") * most * down).cast("decimal(19,0)") * big("_left") <= big("weight") * big("_rest"))
        .withColumn("_first", F.row_number().over(full))
        # the first source that is not full sets the level of all that follow
        .withColumn("_at", F.min(F.when(~F.col("_full"), F.struct("_first", "_rest", "_left"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("_at").isNull() | (F.col("_first") < F.col("_at._first")), (F.col("source_size") * most).cast("double")).otherwise(
                (F.col("weight") * F.col("_at._rest")).cast("double") / (F.col("_at._left") * down).cast("double")
            ),
        )
        .select("source", "source_size", "weight", "target")
    )


KEY = ["_source", "_big", "_class"]


def _same(columns: list[str]) -> Column:
    """The columns equal those of the same names with "_of" behind."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(c).eqNullSafe(F.col(f"{c}_of")) if c == "_source" else F.col(c) == F.col(f"{c}_of"))
    return out


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_of" for c in columns})


def _classed(sized: DataFrame, rates: DataFrame) -> DataFrame:
    rated = rates.withColumnRenamed("source", "_source")
    big = F.col("size") * BIG > F.col("target")
    return sized.join(rated, F.col("source").eqNullSafe(F.col("_source"))).withColumns({"_big": big, "_class": F.length(F.bin("size"))})


def tag_of(text: Column) -> Column:
    """What tells documents without an id, or with the same one, apart."""
    return F.md5(F.coalesce(text, F.lit("")))


def _chunked(classed: DataFrame, parts: DataFrame, seed: str) -> DataFrame:
    chunk = unit_hash(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("_tag")), seed) % F.col("_parts")
    return classed.join(_named(parts, KEY), _same(KEY)).withColumn("_chunk", chunk).drop("_parts", *[f"{c}_of" for c in KEY])


def layout(sized: DataFrame, rates: DataFrame, rows_per_chunk: int = 8192, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """From doc_id, source and size alone: chunks of each class, and the rows before each chunk. Both are small tables of their own,
    so that a pass over texts meets them by a join that moves no text."""
    enough = F.greatest(F.ceil(F.count("*") / rows_per_chunk), F.ceil(F.sum("size") / WORDS_PER_CHUNK))
    classed = _classed(sized.select("doc_id", "_tag", "source", "size"), rates)
    parts = written(classed.groupBy(*KEY).agg(enough.cast("long").alias("_parts")), "parts")
    earlier = Window.partitionBy("_source", "_big").orderBy("_class", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = _chunked(classed, parts, seed).groupBy(*KEY, "_chunk").agg(F.count("*").alias("_rows"))
    return parts, written(rows.select(*KEY, "_chunk", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")), "starts")


def copies_of(rows: DataFrame, rates: DataFrame, parts: DataFrame, starts: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, _tag, source, size and any columns whose names don't begin with "_" -> without _tag, with source_size, target, copies.

    rates: source, source_size, target, big_rate and small_rate, the expected copies of either kind in units of 2**-32.
    """
    chunked = _chunked(_classed(rows, rates), parts, seed)
    place = [*KEY, "_chunk"]
    met = chunked.join(_named(starts, place), _same(place))
    row = F.row_number().over(Window.partitionBy(*place).orderBy("size", "doc_id", "_tag")) + F.col("_before")
    offset = unit_hash(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), seed)
    copies = crossed(row, F.when(F.col("_big"), F.col("big_rate")).otherwise(F.col("small_rate")), offset)
    return met.withColumn("copies", copies).select(*[c for c in rows.columns if c != "_tag"], "source_size", "target", "copies")


def source_rates(sized: DataFrame, targets: DataFrame, most: int = 2, **options) -> DataFrame:
    """Expected copies. Big documents, of over 1 / BIG of their source's target, all have the same; what they take more or less
    than their part of the target is spread over the small ones, so that one long text doesn't decide how near the target is."""
    unit = lambda words, of: F.floor(F.least(F.greatest(F.coalesce(F.try_divide(words, of), F.lit(0.0)), F.lit(0.0)), F.lit(float(most))) * ONE).cast("long")
    first = written(targets, "targets").select("source", "source_size", "target", unit(F.col("target"), F.col("source_size")).alias("big_rate")).withColumn("small_rate", F.lit(0).cast("long"))
    big = sized.join(first.select(F.col("source").alias("_s"), F.col("target").alias("_t")), F.col("source").eqNullSafe(F.col("_s"))).where(F.col("size") * BIG > F.col("_t")).select("doc_id", "_tag", "source", "size")
    taken = copies_of(big, first, *layout(big, first, **options)).groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("copies") * F.col("size")).alias("_taken"), F.sum("size").alias("_size"))
    met = first.join(taken, F.col("source").eqNullSafe(F.col("_s")), "left")
    rest = unit(F.col("target") - F.coalesce("_taken", F.lit(0)), F.col("source_size") - F.coalesce("_size", F.lit(0)))
    return met.select("source", "source_size", "target", "big_rate", rest.alias("small_rate"))


def crossed(row: Column, rate: Column, offset: Column) -> Column:
    """Integer boundaries between the running sums before and after a row: both are row * rate + offset in units of 2**-32.

    The product may pass 2**63. So the rate's whole part is added apart, and the row is taken as 2**24 * high + low: with
    a = high * part, the sum is (a >> 8) whole copies and (a & 255) * 2**24 + low * part + offset units of 2**-32.
    """
    part = rate.bitwiseAND(F.lit(ONE - 1))

    def below(r: Column) -> Column:
        a = F.shiftright(r, 24) * part
        rest = a.bitwiseAND(F.lit(255)) * (1 << 24) + r.bitwiseAND(F.lit((1 << 24) - 1)) * part + offset
        return F.shiftright(a, 8) + F.shiftright(rest, 32)

    return (F.shiftright(rate, 32) + below(row.cast("long")) - below(row.cast("long") - 1)).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def sizes_and_rates(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size of each document, and the rates of each source, as tables. The texts are scanned once."""
    sized = written(docs.select("doc_id", tag_of(F.col("text")).alias("_tag"), "source", word_count(F.col("text")).alias("size")), "sizes")
    return sized, written(source_rates(sized, source_targets(source_sizes(sized)), **options), "rates")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sized, rates = sizes_and_rates(docs, **options)
    return copies_of(sized, rates, *layout(sized, rates, **options)).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: docs' rows and columns, each row as often as it is taken. The texts are shuffled once."""
    sized, rates = sizes_and_rates(docs, **options)
    whole = docs.select("doc_id", tag_of(F.col("text")).alias("_tag"), "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    taken = copies_of(whole, rates, *layout(sized, rates, **options)).where("copies > 0")
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("document.*")


def op9_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same in DuckDB, over documents.
OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tag, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sources
), filling AS (
  SELECT *, row_number() OVER w AS first,
    3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
  FROM ranked WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST)
), level AS (
  SELECT first, rest, left_ FROM filling WHERE NOT 4 * source_size * left_ <= weight * rest ORDER BY first LIMIT 1
), targets AS (
  SELECT f.source, f.source_size,
    CASE WHEN l.first IS NULL OR f.first < l.first THEN (2 * f.source_size)::DOUBLE
         ELSE (f.weight * l.rest)::DOUBLE / (2 * l.left_)::DOUBLE END AS target
  FROM filling f LEFT JOIN level l ON true
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(least(greatest(target / source_size, 0.0), 2.0) * 4294967296.0)::BIGINT ELSE 0 END AS rate FROM targets
), classed AS (
  SELECT s.*, r.source_size, r.target, r.rate, s.size * 50 > r.target AS big, length(bin(s.size)) AS class,
    ('0x' || substr(md5('mix-2024:' || coalesce(s.doc_id::VARCHAR, '') || '/' || tag), 1, 8))::BIGINT AS hash,
    ('0x' || substr(md5('mix-2024:' || coalesce('s' || s.source, 'n')), 1, 8))::BIGINT AS u
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
), parts AS (
  SELECT source, big, class, greatest(ceil(count(*) / 8192), ceil(sum(size) / 4194304))::BIGINT AS parts FROM classed GROUP BY ALL
), placed AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.source, c.big ORDER BY c.class, hash % parts, size, doc_id NULLS FIRST, tag) AS n
  FROM classed c JOIN parts p ON c.source IS NOT DISTINCT FROM p.source AND c.big = p.big AND c.class = p.class
), large AS (
  SELECT *, ((n::HUGEINT * rate + u) // 4294967296 - ((n - 1)::HUGEINT * rate + u) // 4294967296)::BIGINT AS copies FROM placed WHERE big
), spent AS (
  SELECT source, sum(copies * size)::BIGINT AS taken, sum(size)::BIGINT AS size FROM large GROUP BY 1
), others AS (
  SELECT r.source, CASE WHEN r.source_size - coalesce(s.size, 0) > 0
    THEN floor(least(greatest((r.target - coalesce(s.taken, 0)) / (r.source_size - coalesce(s.size, 0)), 0.0), 2.0) * 4294967296.0)::BIGINT ELSE 0 END AS small_rate
  FROM rated r LEFT JOIN spent s ON r.source IS NOT DISTINCT FROM s.source
), counted AS (
  SELECT doc_id, size, source_size, target, copies FROM large
  UNION ALL SELECT doc_id, size, source_size, target, ((n::HUGEINT * small_rate + u) // 4294967296 - ((n - 1)::HUGEINT * small_rate + u) // 4294967296)::BIGINT
  FROM placed p JOIN others o ON p.source IS NOT DISTINCT FROM o.source WHERE NOT big
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""
