import math

from fixtures import empty_documents, odd_documents

from siftline.llm import tokencount

PIECES = {"▁": -1.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -3.0, "▁ab": -4.0, "ba": -3.5, "bab": -4.0, "é": -1.5}


def segmentations(word, pieces):
    """All of them; a character that ends no piece stands alone."""
    if not word:
        yield 0.0, 0
        return
    ends = [n for n in range(1, len(word) + 1) if word[-n:] in pieces]
    for n in ends or [1]:
        for score, count in segmentations(word[:-n], pieces):
            yield score + (pieces[word[-n:]] if ends else tokencount.UNKNOWN), count + 1


def brute(word, pieces):
    every = list(segmentations("▁" + word, pieces))
    best = max(every, key=lambda x: (round(x[0], 9), -x[1]))
    total = sum(math.exp(s) for s, _ in every)
    return best[1], sum(math.exp(s) * n for s, n in every) / total, math.log(total)


def test_by_all_segmentations():
    words = ["a", "ab", "abab", "babab", "éab", "xab", "abx", "b", "aaaabbbb", "xyz", "▁a", "ab"]
    for most in (2_000_000, 5):
        counter = tokencount.Counter(PIECES, most)
        for word in words:
            got, want = counter.counts([word])[0], brute(word, PIECES)
            assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9 and abs(got[2] - want[2]) < 1e-9, word
    together = tokencount.Counter(PIECES).counts(words)
    assert [int(x) for x in together[:, 0]] == [brute(w, PIECES)[0] for w in words]


def test_prefixes_are_shared():
    counter = tokencount.Counter(PIECES)
    counter.counts(["abc", "abd", "ab"])
    assert len(counter.code) == 1 + len("▁abcd")


def test_documents(spark):
    docs = odd_documents(spark)
    rows = {r.doc_id: r for r in tokencount.token_counts(docs.where("doc_id <> 5")).collect()}
    counter = tokencount.Counter(tokencount.pieces_of(tokencount.vocabulary_path()))
    for r in docs.where("doc_id <> 5").collect():
        words = (r.text or "").split()
        got = rows[r.doc_id]
        want = counter.counts(words)
        assert (got.words, got.tokens) == (len(words), int(want[:, 0].sum()) if words else 0)
        assert abs(got.expected_tokens - want[:, 1].sum()) < 1e-3 and got.expected_tokens >= got.words
    assert tokencount.token_counts(empty_documents(spark)).count() == 0


def test_parts(monkeypatch):
    counter = tokencount.Counter(PIECES)
    texts = ["ab " * 25, "", "a b", "x"]
    whole = list(tokencount._sums(counter, iter(texts)))
    monkeypatch.setattr(tokencount, "PART", 3)
    assert list(tokencount._sums(counter, iter(texts))) == whole
