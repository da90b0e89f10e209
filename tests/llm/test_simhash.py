import re

import numpy as np
import xxhash
from fixtures import empty_documents, odd_documents

from siftline.llm import simhash


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_roots(prints):
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    docs = odd_documents(spark)
    got = {(r.doc_id, r.fp) for r in simhash.fingerprints(docs).collect()}
    assert got == {(r.doc_id, signed(slow_fingerprint(r.text))) for r in docs.collect()}


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(25):  # chains and clusters around random centres
        x = int(rng.integers(0, 1 << 63)) | int(rng.integers(0, 2)) << 63
        for _ in range(12):
            prints.add(x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
    prints |= {0, (1 << 64) - 1, 1, 1 << 63, (1 << 63) | 1}
    want = slow_roots(list(prints))
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for most in (64, 1):  # by pairs, and by neighbours at one bit
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, most)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
        theirs = {}
        for p in prints:
            theirs.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_groups(spark):
    docs = odd_documents(spark)
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == docs.count()
    want = slow_roots({r.fp % (1 << 64) for r in rows})
    for r in rows:
        ids = [x.doc_id for x in rows if want[x.fp % (1 << 64)] == want[r.fp % (1 << 64)] and x.doc_id is not None]
        assert r.component_id == min(ids, default=None)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in rows})
    assert simhash.near_groups(empty_documents(spark)).count() == 0 and simhash.one_of_each(empty_documents(spark)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 301)) and roots[1001] == 1000
