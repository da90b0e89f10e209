import random
import zlib

import numpy as np
import pytest
from fixtures import empty_documents, odd_documents
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftline.llm import packing

PATH = packing.tokenizer_path()
TOKENIZER, WORDS = Tokenizer.from_file(PATH), packing.WordTokens(PATH, most=300)
NEAR = st.text(alphabet="abTHEé'.,!-<|>$ \n12ßÄÉ\x01\x1c", max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(NEAR, st.text(max_size=30), st.sampled_from(["don't.", "<|endoftext|>.", "it's!", "x.'ll", "SE!!", "mit&&&", "İΣ ΑΣ."])), max_size=6))
@example(["a\x01b \x01 c", "<|ENDOFTEXT|> É", "a\x1cb"])
def test_tokens_are_the_tokenizers(texts):
    for text, ids in zip(texts, WORDS.encode_all(texts), strict=True):
        assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "PART", 100)
    text = " ".join(random.Random(1).choices(["one", "two.", "trois,", "\n"], k=500)) + "y" * 300
    (ids,) = packing._ids(WORDS, iter([text]))
    assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def brute_best_fit(lengths, window):
    rooms, used, out = [], [], []
    for n in lengths:
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if not fits:
            rooms.append(window)
            used.append(0)
            fits = [len(rooms) - 1]
        i = min(fits, key=lambda i: rooms[i])
        out.append((used[i], rooms[i]))
        rooms[i] -= n
        used[i] += n
    return out, sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    got = packing.best_fit(lengths, 64)
    want, rooms = brute_best_fit(lengths, 64)
    assert [o for _, o in got] == [o for o, _ in want]
    filled = {}
    for (w, _), n in zip(got, lengths, strict=True):
        filled[w] = filled.get(w, 0) + n
    assert sorted(64 - x for x in filled.values()) == rooms


@pytest.mark.parametrize("group", [5, 8192])
def test_pack(spark, group):
    docs = odd_documents(spark)
    rows = packing.pack(docs, window=64, group_pieces=group).toPandas()
    want = []
    for r in docs.collect():
        ids = [*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 2]
        for k in range(0, len(ids), 64):
            want.append((r.doc_id, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], dtype="<u4").tobytes()), len(ids)))
    got = [tuple(None if x != x else x for x in t) for t in rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)]
    assert sorted(map(str, want)) == sorted(str(tuple(None if v is None else int(v) for v in t)) for t in got)
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 64


def test_empty(spark):
    assert packing.pack(empty_documents(spark)).count() == 0


def test_ids(spark):
    row = packing.pieces(spark.createDataFrame([(1, "Hello, world")], "doc_id long, text string"), with_ids=True).first()
    assert row.ids == [*TOKENIZER.encode("Hello, world", add_special_tokens=False).ids, 2]
