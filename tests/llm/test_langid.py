import itertools
import zlib

import numpy as np
import pytest
from fixtures import empty_documents, odd_documents

from siftline.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_marginals_by_brute_force(segment):
    rng = np.random.default_rng(4)
    k, lengths = 3, np.array([5, 1, 0, 6])
    scores, moves = rng.normal(size=(lengths.sum(), k)) * 3, rng.normal(size=(k, k))
    got, at = langid.marginals(scores, lengths, moves, segment), 0
    for n in lengths:
        own, total = scores[at : at + n], np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            v = np.exp(sum(own[i, path[i]] for i in range(n)) + sum(moves[path[i], path[i + 1]] for i in range(n - 1)))
            for i in range(n):
                total[i, path[i]] += v
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True)) if n else True
        at += n


def test_gradient_by_brute_force():
    """Expected moves against all paths, and the slope of the likelihood that learning climbs."""
    rng = np.random.default_rng(5)
    k, lengths = 3, np.array([4, 1, 5])
    scores, moves = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k)) * 2
    gamma, first, joint = langid.expected(scores, lengths, moves)
    want, at = np.zeros((k, k)), 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=n))
        v = np.array([np.exp(sum(scores[at + i, p[i]] for i in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        for p, share in zip(paths, v / v.sum(), strict=True):
            for a, b in itertools.pairwise(p):
                want[a, b] += share
        at += n
    assert np.allclose(joint, want) and np.allclose(gamma, langid.marginals(scores, lengths, moves)) and first.tolist() == [0, 1, 2, 5, 6, 7, 8]

    def total(m):  # the log of the sum over all paths
        out, at = 0.0, 0
        for n in lengths:
            x = scores[at]
            for i in range(1, n):
                x = np.log(np.exp(x[:, None] + m).sum(axis=0)) + scores[at + i]
            out, at = out + np.log(np.exp(x).sum()), at + n
        return out

    for a, b in itertools.product(range(k), repeat=2):
        d = np.zeros((k, k))
        d[a, b] = 1e-5
        assert abs((total(moves + d) - total(moves - d)) / 2e-5 - joint[a, b]) < 1e-6


def test_learned_moves(model):
    """Neighbours are mostly of one language, so staying weighs more than any other move."""
    assert (np.argmax(model.moves, axis=1) == np.arange(len(model.langs))).all()


def test_words():
    w = langid.words_of([langid.codes(x) for x in ("Ab cd1e!", "", "--", "É")])
    assert w.per_text.tolist() == [3, 0, 0, 1] and w.length.tolist() == [2, 2, 1, 1] and w.at.tolist() == [0, 3, 6, 0]
    same = langid.words_of([langid.codes("x AB"), langid.codes("ab")])
    assert same.keys[1] == same.keys[2] and same.keys[0] != same.keys[1]


@pytest.fixture(scope="module")
def model(spark):
    return langid.learned(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    rows = langid.op10_crf_langid(spark, SF).toPandas().set_index("doc_id")
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.index]).all()
    held = rows[rows.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.98 and held.score.between(0, 1).all()


def test_held_out_rows_do_not_teach(spark):
    """Whatever they hold: texts and languages that only they have are neither in the sample nor among the languages."""
    rows = [(i, ("held " if zlib.crc32(str(i).encode()) % 3 == 1 else "free ") * 9 + str(i), "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else "yy") for i in range(300)]
    sample = langid.sample_of(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sample and {lang for lang, _ in sample} == {"yy"} and all("held" not in text for _, text in sample)


def test_sample(spark):
    """Every language has its part, however many there are; a repeated id doesn't fill it; reruns agree."""
    rows = [(i, f"text {i}", f"l{i % 90:02d}") for i in range(4000)] + [(2, f"again {i}", "l02") for i in range(500)] + [(None, "x", "l03"), (7, None, "l04"), (8, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sample_of(docs, docs_each=10)
    counts = {x: sum(lang == x for lang, _ in sample) for x in {lang for lang, _ in sample}}
    assert len(counts) == 90 and max(counts.values()) == 10 and sample == langid.sample_of(docs.repartition(5), docs_each=10)


def test_code_switching(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    parts = [docs[docs.lang == x].text.iloc[5].split()[:60] for x in ("en", "de", "en")]
    mixed = spark.createDataFrame([(1, " ".join(w for p in parts for w in p))], "doc_id long, text string")
    found = langid.spans(mixed, model).orderBy("first_word").collect()
    assert [r.lang for r in found if r.words > 10] == ["en", "de", "en"]


def test_odd_documents(spark, model):
    docs = odd_documents(spark)
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    unread = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unread == {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und") and all(0 < r.score <= 1 for r in rows if r.lang_pred != "und")
    kept = langid.known(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    assert langid.predict(empty_documents(spark), model).count() == 0 and langid.learned(empty_documents(spark)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_teachers_without_a_letter(spark, tmp_path):
    """Documents teach, but there is nothing to learn from: by op10's own path and by the pipeline's first stage."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for texts in ((["123 456", ""], ["", "!!"]), ([None, ""], [" ", "\n"])):
        rows = [(i, x, lang, "s", 1) for lang, own in zip(("en", "de"), texts, strict=True) for i, x in enumerate(own * 3)] + [(50, "words here", None, "s", 1)]
        folder = str(tmp_path / str(texts[0][0]))
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        got = langid.op10_crf_langid(spark, folder).collect()
        assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id == 50} == {(50, "de", 0.5)} and {r.lang_pred for r in got if r.doc_id != 50} == {"und"}
        kept = corpus_pipeline.language_id(spark, spark.read.schema(schema).parquet(f"{folder}/documents.parquet"), folder)
        assert [r.doc_id for r in kept.collect()] == [50]
    assert langid.learn([("en", "")]).langs == ["en"]


def test_long_texts_do_not_depend_on_their_parts(spark, model, monkeypatch):
    text = " ".join(spark.read.parquet(f"{SF}/documents.parquet").limit(30).toPandas().text)
    whole = langid.languages(model, [text])
    monkeypatch.setattr(langid, "SEGMENT", 7)
    assert langid.languages(model, [text])[0] == whole[0]
