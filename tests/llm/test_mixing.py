from fixtures import empty_documents, odd_documents
from oracle import connect, same
from pyspark.sql import functions as F

from siftline.llm import mixing


def filled(sizes, weights, total, most):
    """Targets by handing the excess on until none is left."""
    target, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = total
    while open_:
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] >= most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            rest -= target[i]
        open_ = [i for i in open_ if i not in over]
    return target


def test_oracle(spark):
    same(mixing.op9_systematic_mixing(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), mixing.OP9_SQL)


def test_targets(spark):
    for sizes in ([10, 1000, 50, 7, 300, 0], [1, 1], [0, 0], [5], [10**12, 3 * 10**12, 10**10]):
        rows = [(f"s{i}" if i else None, n) for i, n in enumerate(sizes)]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        order = sorted(range(len(sizes)), key=lambda i: (i == 0, f"s{i}"))  # null is last
        want = filled([sizes[i] for i in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(sizes), 2)
        for i, w in zip(order, want, strict=True):
            assert abs(got[rows[i][0]] - w) <= 1e-6 * max(1, w), sizes


def test_boundaries(spark):
    rows = [(n, rate, off) for n in (1, 2, 3, 10**9, 5 * 10**12) for rate in (0, 1, (1 << 32) - 1, 1 << 32, 5 << 31, 2 << 32, 6442450943) for off in (0, 1, (1 << 32) - 1)]
    got = spark.createDataFrame(rows, "n long, rate long, off long").withColumn("c", mixing.crossed(F.col("n"), F.col("rate"), F.col("off"))).collect()
    for r in got:
        assert r.c == (r.n * r.rate + r.off) // 2**32 - ((r.n - 1) * r.rate + r.off) // 2**32


def test_taken_is_near_the_target(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 300).cast("int")).alias("text"))
    rows = mixing.mixed(docs, rows_per_chunk=100)
    for r in rows.groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target + 600 and r.over <= 0
    again = mixing.mixed(docs.repartition(3), rows_per_chunk=100)
    assert rows.exceptAll(again).count() == 0


def test_mix_gives_whole_rows(spark):
    docs = odd_documents(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = mixing.mixed(docs).agg(F.sum("copies"), F.count("*")).first()
    assert out.count() == counts[0] and counts[1] == docs.count()
    assert out.join(docs.select("doc_id", "text"), ["doc_id", "text"], "left_anti").where("doc_id IS NOT NULL AND text IS NOT NULL").count() == 0
    assert mixing.mix(empty_documents(spark)).count() == 0 and mixing.mixed(empty_documents(spark)).count() == 0
