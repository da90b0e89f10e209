"""Phrase collocations: phrases of a few words that occur together more often than their parts suggest.

Texts are lower-cased for A-Z, split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at blanks and tabs. Everything is
counted by language.

1. Equal pieces of a language become one row with a multiplicity: copies and boilerplate are counted once from there on.
2. Each part of the pieces has its weighted n-grams added up by duckdb, ``CHUNK`` bytes of pieces at a time, and sends every hash
   bucket one sorted, compressed block. A phrase that is frequent everywhere reaches its bucket once for each block, so no phrase is
   hot; its bucket is a hash of all of it.
3. Each bucket's blocks go into duckdb and are added up there with ``MEMORY`` of memory, however large the bucket: beyond it, duckdb spills to
   the worker's temporary folder, as Spark's own sorts do; that ends with the task. Phrases of fewer than ``least`` occurrences end here: a part of a
   candidate occurs at least as often as the candidate.
4. Each cut of a candidate asks for the counts of its two parts. Requests are shuffled to the parts' counts, once for each part and
   salt, and the answers back to the requests of that salt; a word that is part of very many candidates is spread over all tasks.
5. Phrases inside longer ones are told of the largest of these by an aggregation; ranks are cut before they are shuffled.

Scores are quotients of whole numbers, computed as decimals of 38 digits: exact, and an error instead of a wrong value for counts
above 10**16.

Cases: a null language is ``und``, as is that name itself; null and empty texts have no pieces, a piece without words goes;
long texts and pieces are taken whole; repeated rows count again; ties go by count, then by phrase in UTF-8 order; an empty
table gives an empty result; only text and lang are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, table, written

LONGEST, LEAST, INSIDE, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Bytes of pieces whose n-grams are added up before they are sent, and the memory of one duckdb.
CHUNK, MEMORY = 4 << 20, "300MB"
#: Parts of a language that are ranked by themselves first.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = ["lang", "words", "phrases", "f"]
COUNTS = "lang string, phrase string, words int, f long"


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by single blanks) and m, how often it occurs."""
    text = F.regexp_replace(F.translate("text", UPPER, LOWER), r"\x09[\x20\x09]*|\x20[\x20\x09]+", " ")
    cut = F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]+"))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.select("lang", cut.alias("piece")).select("lang", F.trim("piece").alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _duckdb(folder: str):
    import duckdb

    db = duckdb.connect()
    for setting in (f"memory_limit = '{MEMORY}'", "threads = 1", f"temp_directory = '{folder}'", "preserve_insertion_order = false"):
        db.execute(f"SET {setting}")
    return db


def _grams(longest: int) -> str:
    """SQL: the n-grams of the rows of ``pieces`` that begin in the first ``starts`` words, with their weights."""
    of = lambda k: "||' '||".join(f"ws[i+{j}]" if j else "ws[i]" for j in range(k))
    parts = (f"SELECT lang, {k} AS words, {of(k)} AS phrase, m FROM (SELECT lang, m, ws, unnest(range(1, least(starts, len(ws) - {k - 1}) + 1)) AS i FROM split WHERE len(ws) >= {k})" for k in range(1, longest + 1))
    return "WITH split AS MATERIALIZED (SELECT lang, m, starts, string_split(piece, ' ') AS ws FROM pieces) " + " UNION ALL ".join(parts)


def _bounded(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.Table]:
    """The pieces in tables of about CHUNK bytes; a longer one is cut, and its cuts overlap by the n-grams that begin before them."""
    held: list[tuple[str, str, int, int]] = []
    size = 0
    table = lambda: pa.table(dict(zip(("lang", "piece", "m", "starts"), map(list, zip(*held, strict=True)), strict=True)))
    for batch in batches:
        for lang, piece, m in zip(*(batch.column(c).to_pylist() for c in ("lang", "piece", "m")), strict=True):
            if len(piece) > CHUNK:
                words = piece.split(" ")
                step = max(1, len(words) * CHUNK // (2 * len(piece)))
                cuts = [(" ".join(words[at : at + step + longest - 1]), step) for at in range(0, len(words), step)]
            else:
                cuts = [(piece, len(piece))]
            for cut, starts in cuts:
                held.append((lang, cut, m, starts))
                size += len(cut)
                if size > CHUNK:
                    yield table()
                    held, size = [], 0
    if held:
        yield table()


def _packed(block: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(block)
    return sink.getvalue().to_pybytes()


def _blocks(buckets: int, longest: int):
    import duckdb

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder, _duckdb(folder) as db:
            sums = f"SELECT (hash(lang, phrase) % {buckets})::INT AS bucket, lang, words::INT AS words, phrase, sum(m)::BIGINT AS f FROM ({_grams(longest)}) GROUP BY ALL"
            sql = f"{sums} ORDER BY bucket, lang, words, phrase"

            def counted(some: pa.Table) -> Iterator[pa.RecordBatch]:
                db.register("pieces", some)
                try:
                    found = db.sql(sql).to_arrow_table().combine_chunks()
                except duckdb.OutOfMemoryException:
                    if some.num_rows < 2:
                        raise
                    found = None
                finally:
                    db.unregister("pieces")
                if found is None:
                    half = some.num_rows // 2
                    yield from counted(some.slice(0, half))
                    yield from counted(some.slice(half))
                elif found.num_rows:
                    yield from _runs(found)

            for some in _bounded(batches, longest):
                yield from counted(some)

    return run


def _runs(found: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket, lang and words -> a block for each bucket, with a row for each lang and words.

    Phrases are joined by line ends, which no piece holds: neighbours in order compress well, and no offsets are sent.
    """
    bucket, lang, words, phrase, f = (pa.concat_arrays(c.chunks) for c in found.columns)
    marks = [bucket.to_numpy(), lang.dictionary_encode().indices.to_numpy(), words.to_numpy()]
    starts = np.flatnonzero(np.logical_or.reduce([np.diff(x, prepend=-1) != 0 for x in marks]))
    ends = pa.array([*starts, len(bucket)], pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, phrase), "\n")
    rows = pa.RecordBatch.from_arrays([lang.take(starts), words.take(starts), joined, pa.ListArray.from_arrays(ends, f)], GRAMS)
    own = bucket.to_numpy()[starts]
    at = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
    for start, end in zip(at, [*at[1:], len(own)], strict=True):
        part = rows.slice(start, end - start)
        block = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], GRAMS)  # without the rest of the columns
        yield pa.RecordBatch.from_arrays([pa.array([own[start]], pa.int32()), pa.array([_packed(block)], pa.binary())], ["bucket", "block"])


def _sums(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder, _duckdb(folder) as db:
            db.execute("CREATE TABLE grams (lang VARCHAR, words INT, phrase VARCHAR, f BIGINT)")
            for batch in batches:
                for block in batch.column("block"):
                    db.register("block", pa.ipc.open_stream(block.as_buffer()).read_all())
                    db.execute("INSERT INTO grams SELECT lang, words, unnest(string_split(phrases, chr(10))), unnest(f) FROM block")
                    db.unregister("block")
            # the words of each language in this bucket, the rare ones too, as a row without a phrase
            totals = "SELECT lang, NULL::VARCHAR AS phrase, 1 AS words, sum(f)::BIGINT AS f FROM grams WHERE words = 1 GROUP BY lang"
            sums = f"SELECT lang, phrase, words, sum(f)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(f) >= {least}"
            for query in (totals, sums):
                yield from db.sql(query).to_arrow_reader(10_000)

    return run


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, buckets: int | None = None) -> DataFrame:
    """lang, phrase, words and f of all phrases of up to ``longest`` words with f >= least; f of a null phrase adds up to a language's words."""
    spark = docs.sparkSession
    ship(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pieces(docs).mapInArrow(_blocks(buckets, longest), "bucket int, block binary")
    return written(blocks.repartitionById(buckets, "bucket").mapInArrow(_sums(least), COUNTS), "counts")


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each phrase of two words or more, with a, and of its lowest-scoring cut l, r and score."""
    salts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.split("phrase", " ")
    part = lambda start, length, k, left: F.struct(F.array_join(F.slice(words, start, length), " ").alias("part"), k.alias("k"), F.lit(left).alias("left"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array(part(F.lit(1), k, k, True), part(k + 1, F.col("words") - k, k, False))))
    candidates = counts.where("phrase IS NOT NULL AND words > 1").withColumnRenamed("f", "a")
    requests = written(candidates.select("lang", "phrase", "words", "a", F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt"), F.explode(cuts).alias("x")).select("lang", "phrase", "words", "a", "salt", "x.*"), "requests")
    asked = requests.select("lang", "part", "salt").distinct()
    known = counts.where("phrase IS NOT NULL").select("lang", F.col("phrase").alias("part"), "f")
    answered = requests.join(asked.join(known, ["lang", "part"]), ["lang", "part", "salt"])
    sides = answered.groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    exact = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    score = F.expr(f"CAST({scale} AS DECIMAL(7,0)) * ({exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    lowest = sides.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def contained(counts: DataFrame, inside: int = INSIDE) -> DataFrame:
    """lang and phrase of candidates that lie in a longer one with at least ``inside`` percent of their own count."""
    candidates = counts.where("phrase IS NOT NULL AND words > 1")
    words = F.split("phrase", " ")
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), starts))
    longer = candidates.where("words > 2").select("lang", F.explode(within).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return candidates.join(longer, ["lang", "phrase"]).where(100 * F.col("most") >= inside * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n and score."""
    found = counts(docs, longest, least, buckets)
    kept = scored(found).join(contained(found, inside), ["lang", "phrase"], "left_anti")
    # a language's best are among the best of its parts, so that no task ranks one language's phrases alone
    by = [F.desc("score"), F.desc("a"), "phrase"]
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    totals = found.where("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same in DuckDB, over documents: all phrases at once.
OP11_SQL = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM cut
), grams AS (
  SELECT lang, 1 AS words, ws[i] AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split)
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM split)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
), f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), cuts AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, words)) AS k FROM f WHERE words > 1 AND f >= 10
), lefts AS MATERIALIZED (
  SELECT c.*, x.f AS l FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
), parts AS (
  SELECT c.*, y.f AS r, 1000000::HUGEINT * a * a // (l::HUGEINT * y.f) AS score FROM lefts c JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')
), lowest AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM lowest WHERE words = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM lowest WHERE words = 3) GROUP BY ALL
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer t ON t.lang = s.lang AND t.phrase = s.phrase WHERE t.most IS NULL OR 100 * t.most < 50 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
