import hashlib
import random

import pytest
import tiktoken
from fixtures import empty_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import bytebpe, queries
from siftline.llm.common import table

SF = "/root/testdata/sf0.001"
RANKS = bytebpe.read_ranks(bytebpe.ranks_path())
LIBRARY = tiktoken.Encoding("own", pat_str=bytebpe.pattern(), mergeable_ranks=RANKS, special_tokens={})
#: The library with a pattern that takes any text as one word.
WHOLE = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=RANKS, special_tokens={})
MERGES = bytebpe.Merges(RANKS)
ALPHABETS = ["ab", "abcdefghijklmnopqrstuvwxyz", "x", " ", "=-", "éüñ中文字😀a ", "the and ing of er"]


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(1, 700))) for _ in range(n)]


def test_tree_of_a_word(monkeypatch):
    for part in (1, 7, bytebpe.PART):  # joins at every byte, and of long parts
        monkeypatch.setattr(bytebpe, "PART", part)
        for word in words(part, 60):
            assert MERGES.encode(word.encode()) == WHOLE.encode_ordinary(word)


@given(st.text(max_size=60), st.sampled_from([1, 2, 3, 8]))
@settings(max_examples=200, deadline=None)
def test_tree_of_a_text(text, leaf):
    text = text.encode("utf-8", "replace").decode()
    was, bytebpe.LEAF = bytebpe.LEAF, leaf
    try:
        ids = bytebpe.Encoder(MERGES, bytebpe.pattern()).encode([text, "", text])
    finally:
        bytebpe.LEAF = was
    assert ids[0].tolist() == ids[2].tolist() == LIBRARY.encode_ordinary(text) and ids[1].tolist() == []
    assert MERGES.decode(ids[0]) == text.encode()


def test_boundaries_between_blanks_and_marks():
    rng = random.Random(9)
    own = bytebpe.Encoder(MERGES, bytebpe.pattern())
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "re", "1", "23", "?", "!!", "é", "中", "　", "\x1c", "\x85", "don't", "'ll"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 300))) for _ in range(60)]
    was = bytebpe.LEAF
    try:
        for bytebpe.LEAF in (2, 3, 5, 17):
            assert [x.tolist() for x in own.encode(texts)] == [LIBRARY.encode_ordinary(x) for x in texts]
    finally:
        bytebpe.LEAF = was


def test_words_are_forgotten():
    own = bytebpe.Encoder(MERGES, bytebpe.pattern(), most=50)
    texts = words(3, 20)
    assert [x.tolist() for x in own.encode(texts)] == [LIBRARY.encode_ordinary(x) for x in texts]


def test_long_decoding(monkeypatch):
    monkeypatch.setattr(bytebpe, "IDS", 3)
    text = "Hello wörld, " * 50
    ids = bytebpe.Encoder(MERGES, bytebpe.pattern()).encode([text])[0]
    assert MERGES.decode(ids) == text.encode()


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = bytebpe.decoded(bytebpe.encoded(docs)).collect()
    want = sorted((str(r.doc_id), tuple(LIBRARY.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.data)) for r in rows) == want
    assert bytebpe.decoded(bytebpe.encoded(empty_documents(spark))).count() == 0


def test_decoding_alone(spark):
    rows = bytebpe.decoded(spark.createDataFrame([(1, [64, 65]), (2, []), (3, None)], "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.data and bytes(r.data) for r in rows} == {1: MERGES.bytes[64] + MERGES.bytes[65], 2: b"", 3: None}
    with pytest.raises(Exception, match="KeyError"):
        bytebpe.decoded(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>")).collect()


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = queries.QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
