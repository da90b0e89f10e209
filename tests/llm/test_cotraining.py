import numpy as np
import pandas as pd
from fixtures import empty_documents, odd_documents
from pyspark.sql import functions as F

from siftline.llm import cotraining

SF = "/root/testdata/sf0.01"


def test_accuracy(spark):
    rows = cotraining.op3_cotraining(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    both = rows.merge(labels, on="doc_id")
    assert len(rows) == 1000 and (both.keep == (both.quality == 1)).mean() > 0.95
    assert both[both.quality == 1].keep.mean() > 0.98


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    model = cotraining.learned(docs, labels.where("doc_id % 3 <> 0"))
    held = cotraining.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert (held.keep == (held.good == 1)).mean() > 0.93


def test_views_teach_each_other():
    """With few labels, examples from the other view help."""
    rng = np.random.default_rng(0)
    n = 2000
    y = rng.integers(0, 2, n)
    a, b = (np.float32(1.3 * (2 * y - 1)[:, None] * rng.random((n, 6)) + rng.normal(size=(n, 6))) for _ in range(2))
    label = np.full(n, -1)
    label[:24] = y[:24]
    alone = cotraining.cotrain(a, b, label, rounds=0).scores(a, b)
    taught = cotraining.cotrain(a, b, label, rounds=5).scores(a, b)
    accuracy = lambda s: ((s > 0.5) == y[:, None])[24:].mean(axis=0)
    assert (accuracy(taught)[:2] >= accuracy(alone)[:2] - 0.01).all() and accuracy(taught)[2] > 0.85


def test_rounds_by_brute_force(spark, monkeypatch):
    """The same rounds with all documents in memory, each view's most confident found by sorting."""
    monkeypatch.setattr(cotraining, "EACH_ROUND", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("good")).where("doc_id % 4 = 0")
    model = cotraining.learned(docs, labels, pool=300, rounds=3)

    rows = cotraining._read(docs).withColumn("key", F.xxhash64("doc_id", "text", "source", "lang", "n_chars")).toPandas().sort_values("key").reset_index(drop=True)
    label = rows.merge(labels.toPandas().groupby("doc_id").good.mean().reset_index(), on="doc_id", how="left").good.to_numpy()
    content = np.array([cotraining.content_view((t or "").encode()) for t in rows.text])
    page = np.array([cotraining.page_view(s, g, None if pd.isna(n) else int(n)) for s, g, n in zip(rows.source, rows.lang, rows.n_chars, strict=True)])
    given = np.nonzero(~np.isnan(label))[0]
    held, first = given[::4], np.delete(given, np.s_[::4])
    lists = [(list(first), list(label[first])), (list(first), list(label[first]))]
    free, share, views, weights = set(np.nonzero(np.isnan(label))[0].tolist()), np.mean(label[given] >= 0.5), (content, page), [None, None]
    for round_ in range(4):
        weights = [cotraining.logistic(x[own], np.array(y), w, steps=80 if round_ else 200) for x, (own, y), w in zip(views, lists, weights, strict=True)]
        if round_ == 3:
            break
        passed = []
        for x, w in zip(views, weights, strict=True):
            order = sorted((float(z), i) for i, z in zip(sorted(free), cotraining.logits(x[sorted(free)], w).astype(np.float64), strict=True))
            each = 40 * max(1.0, len(free) / 300) / len(free)
            low = order[max(0, int(np.ceil(min(1.0, each * (1 - share)) * len(order))) - 1)][0]
            high = order[max(0, int(np.ceil(max(0.0, 1 - each * share) * len(order))) - 1)][0]
            passed.append({i: float(z > 0) for z, i in order if z <= low and z < -2 or z >= high and z > 2})
        for side, found in enumerate(passed):
            lists[1 - side][0].extend(sorted(found))
            lists[1 - side][1].extend(found[i] for i in sorted(found))
            free -= set(found)
    assert passed[0] and len(free) < np.isnan(label).sum()
    pair = np.column_stack([cotraining.logits(x[held], w) for x, w in zip(views, weights, strict=True)])
    brute = cotraining.Model(*weights, cotraining.logistic(pair, label[held], decay=1e-4, steps=300))
    assert np.allclose(brute.scores(content, page), model.scores(content, page), atol=1e-4)


def test_views_are_separate(spark):
    """The page view doesn't depend on the text, nor the content view on anything else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    batch = lambda df: cotraining._read(df).toArrow().to_batches()[0]
    plain, other, moved = batch(docs), batch(docs.withColumn("text", F.lit("x"))), batch(docs.withColumn("source", F.lit("y")))
    assert (cotraining._views(plain)[1] == cotraining._views(other)[1]).all() and (cotraining._views(plain)[0] == cotraining._views(moved)[0]).all()
    assert len(batch(docs.drop("n_chars"))) == len(plain)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (3, 1), (None, 1), (999, 0)], "doc_id long, good int")
    rows = cotraining.score(docs, cotraining.learned(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert cotraining.score(empty_documents(spark), cotraining.learned(docs, labels)).count() == 0


def test_one_class_or_none(spark):
    docs = odd_documents(spark)
    for labels, want in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        model = cotraining.learned(docs, spark.createDataFrame(labels, "doc_id long, good int"))
        assert all(abs(r.score - want) < 1e-6 for r in cotraining.score(docs, model).limit(5).collect())
    assert cotraining.learned(empty_documents(spark), spark.createDataFrame([], "doc_id long, good int")).content is None


def test_search_covers_all_documents(spark, monkeypatch):
    """Every document without a label is scored in each round until a view passes it on, also far beyond the pool."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    seen = []

    def kept(df, what):
        seen.append(df.count())
        return df

    monkeypatch.setattr(cotraining, "written", kept)
    cotraining.learned(docs, labels, pool=50, rounds=2)
    assert len(seen) == 2
    assert seen[0] == docs.join(labels.where("good IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti").count() > 50
    # in proportion: EACH_ROUND of 50 is all that the views are sure of, more than EACH_ROUND by far
    assert seen[0] - seen[1] > 0
