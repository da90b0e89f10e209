import re
from collections import Counter

from fixtures import empty_documents, odd_documents
from oracle import connect, same

from siftline.llm import collocations, queries

SF = "/root/testdata/sf0.001"


def slow(docs, longest=3, least=10, inside=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    lost = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= inside * f[lang, words[i : i + k]]:
                    lost.add((lang, words[i : i + k]))
    out = []
    for lang in n:
        rows = []
        for (own, words), a in candidates.items():
            if own == lang and (own, words) not in lost:
                score, _, left, right = min((1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
                rows.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


def pairs(docs):
    return [(r.lang, r.text) for r in docs.select("lang", "text").collect()]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert got(collocations.collocations(docs)) == slow(pairs(docs))
    assert collocations.collocations(empty_documents(spark)).count() == 0


def test_every_knob(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 200)  # many blocks a bucket
    texts = [("en", "New York City, new  york\tcity; new york! the of the of THE of"), (None, "a b c d a b c d a b"), ("und", "a b c d.a b\x0bc"), ("en", "x" * 3000 + " new york city")] * 5
    docs = spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string")
    for options in ({}, {"least": 1}, {"least": 3, "longest": 4}, {"inside": 90, "least": 2, "top": 3}):
        assert got(collocations.collocations(docs, buckets=3, **options)) == slow(texts, **options)


def test_a_word_in_a_third_of_all_phrases(spark):
    texts = [("en", " . ".join(f"the w{i}" for i in range(300)))] * 12
    docs = spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string")
    assert got(collocations.collocations(docs)) == slow(texts)


def test_large_counts(spark):
    """a * a passes 64 bits; the score is exact all the same."""
    big = 9_876_543_210_123
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 11)], "lang string, phrase string, words int, f long")
    row = collocations.scored(counts).first()
    assert (row.l, row.r, row.score) == (big + 7, big + 11, 1_000_000 * big * big // ((big + 7) * (big + 11)))


def test_query(spark):
    same(queries.QUERIES["op11_collocations"](spark, SF), connect(SF), queries.ORACLES["op11_collocations"])
