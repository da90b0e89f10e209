import random

import numpy as np
from fixtures import empty_documents, odd_documents

from siftline.llm import near, simhash

DOCS = "doc_id long, text string"


def near_copies(seed=7, bases=12, copies=5, words=120):
    """Texts with copies of which each has some words replaced, so that similarities lie around 0.8."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = []
    for _ in range(bases):
        base = [word() for _ in range(words)]
        texts.append(base)
        for k in range(copies):
            other = list(base)
            for at in rng.sample(range(words), k):
                other[at] = word()
            texts.append(other)
    return [" ".join(x) for x in texts]


def similarity(a, b):
    runs = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    a, b = runs(a.lower()), runs(b.lower())
    return len(a & b) / len(a | b)


def slow_groups(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_groups_by_brute_force(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    root = slow_groups(texts)
    assert 12 < len(set(root)) < len(texts)
    assert sorted(r.doc_id for r in near.one_of_each(docs).collect()) == sorted(set(root))
    # op6's links at two bits leave most of them
    assert simhash.one_of_each(docs).count() > 1.5 * len(set(root))


def test_large_buckets(spark):
    """A group far above the limit for all pairs: hubs and parts connect it."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(150):
        other = list(base)
        other[rng.randrange(150)] = f"x{i}"
        texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    pairs = near.candidates(near.shingled(docs.selectExpr("*", "0L AS mark"))).count()
    assert [r.doc_id for r in near.one_of_each(docs).collect()] == [0] and pairs < 150 * 149 / 3


def test_large_groups_by_brute_force(spark):
    """Groups above the limits, around the similarity, so that a hub alone leaves members out."""
    rng = random.Random(11)
    texts = []
    for b in range(2):
        base = [f"b{b}w{i}" for i in range(200)]
        for k in range(70):
            other = list(base)
            for at in rng.sample(range(200), k % 8):
                other[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    root = slow_groups(texts)
    assert 2 < len(set(root)) < 100
    rows = near.shingled(docs.selectExpr("*", "0L AS mark"))
    hubs = near.similar(rows.select("class", "shingles").dropDuplicates(["class"]), near.candidates(rows, 4))
    hubs = {r.node for r in simhash.components(hubs).collect()}
    assert sorted(r.doc_id for r in near.one_of_each(docs, most=4).collect()) == sorted(set(root))
    linked = {r["class"] for r in rows.collect() if root.count(root[r.doc_id]) > 1}
    assert len(hubs) < len(linked)


def test_all_pairs_of_all_buckets(spark):
    """Families with families inside, far above the limit: the same components as all pairs that share a bucket."""
    rng = random.Random(13)
    texts = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(150)]
        for s in range(4):
            branch = list(base)
            for at in rng.sample(range(150), 3 * s):
                branch[at] = f"s{s}y{at}"
            for k in range(25):
                other = list(branch)
                for at in rng.sample(range(150), k % 7):
                    other[at] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(other + [f"z{rng.randrange(10**6)}" for _ in range(k % 5)]))
    rows = near.shingled(spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "0L AS mark"))
    found = {r["class"]: (r.bands, set(r.shingles)) for r in rows.collect()}
    edges = [(a, b) for a in found for b in found if a < b and any(x == y for x, y in zip(found[a][0], found[b][0])) and 5 * len(found[a][1] & found[b][1]) >= 4 * len(found[a][1] | found[b][1])]
    root = {c: c for c in found}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {c: low if r == high else r for c, r in root.items()}
    for most in (2, 16):
        mine = {r["class"]: r.root for r in near.groups(rows, most).collect()}
        assert len(set(root.values())) > 5
        same = lambda x: sorted(sorted(c for c in x if x[c] == r) for r in set(x.values()))
        assert same(mine) == same(root)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert near.one_of_each(empty_documents(spark)).count() == 0


def test_shared_and_missing_ids(spark):
    """Different texts under one id, or under none, all stay, and which row stays is fixed."""
    rows = [(None, "one text alone"), (None, "another text alone"), (7, "first of seven"), (7, "second of seven"), (7, "second of seven"), (8, "second of seven"), (None, "second of seven")]
    want = {(None, "one text alone"), (None, "another text alone"), (7, "first of seven"), (7, "second of seven")}
    for some in (rows, rows[::-1]):
        kept = near.one_of_each(spark.createDataFrame(some, DOCS)).collect()
        assert {(r.doc_id, r.text) for r in kept} == want and len(kept) == 4


def test_fingerprints_link_first(spark):
    """SimHash proposes each pair within two bits, or a way between them; a pair that isn't similar enough goes by its shingles."""
    texts = near_copies(seed=5, bases=6, copies=3, words=1500)
    rows = near.shingled(spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "0L AS mark"))
    prints = {r["class"]: r.fp for r in rows.collect()}
    want = {(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2}
    got = {(r.a, r.b) for r in near.fingerprint_pairs(rows).collect()}
    assert want and got <= want and len({prints[c] for c in prints}) > 5
    root = lambda edges: {r.node: r.root for r in simhash.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert root(got) == root(want)
    found = {(r.a, r.b) for r in near.similar(rows.select("class", "shingles"), near.fingerprint_pairs(rows)).collect()}
    assert found and found <= got


def odd_passages(count=120, seed=17):
    """Texts of one base, each with some of a few odd passages, so that large buckets hold many that are similar to few."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(240)]
    passages = [[f"p{p}w{i}" for i in range(14)] for p in range(12)]
    texts = []
    for i in range(count):
        other = list(base) + [f"t{i}"]
        for p in rng.sample(range(12), 4):
            at = 15 * p
            other[at : at + 14] = passages[p]
        texts.append(" ".join(other))
    return texts


def test_large_buckets_make_no_pairs(spark, monkeypatch):
    """No table after the buckets has more rows than they have, and the groups are those of all pairs that share a bucket."""
    texts = odd_passages()
    rows = near.shingled(spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "0L AS mark"))
    found = {r["class"]: (r.bands, set(r.shingles)) for r in rows.collect()}
    root = {c: c for c in found}
    for a in found:
        for b in found:
            if a < b and any(x == y for x, y in zip(found[a][0], found[b][0])) and 9 * len(found[a][1] & found[b][1]) >= 4 * (len(found[a][1]) + len(found[b][1])):
                low, high = sorted((root[a], root[b]))
                root = {c: low if r == high else r for c, r in root.items()}
    made, whole = [], near.written

    def counted(df, what):
        made.append((what, (out := whole(df, what)).count()))
        return out

    monkeypatch.setattr(near, "written", counted)
    mine = {r["class"]: r.root for r in near.groups(rows, 4).collect()}
    same = lambda x: sorted(sorted(c for c in x if x[c] == r) for r in set(x.values()))
    assert same(mine) == same(root) and 1 < len(set(root.values())) < len(texts)
    members = next(n for what, n in made if what == "buckets")
    assert members > 500 and max(n for _, n in made) <= members


def test_tiles(spark, monkeypatch):
    """However members are cut into tiles, each two that aren't both with the hub meet once, and the groups are the same."""
    rows = near.shingled(spark.createDataFrame(list(enumerate(odd_passages(60))), DOCS).selectExpr("*", "0L AS mark"))
    same = lambda x: sorted(sorted(r["class"] for r in x if r.root == c) for c in {r.root for r in x})
    want = same(near.groups(rows, 4).collect())
    members = spark.createDataFrame([(0, 0, c, 100 + c, 0 if c < 12 else c) for c in range(40)], "band int, key long, class long, n int, c long")
    for tile in (1, 7):
        monkeypatch.setattr(near, "TILE", tile)
        monkeypatch.setattr(near, "UNIT", 512)
        assert same(near.groups(rows, 4).collect()) == want
        units = {}
        for r in near._units(members, members.where("class = 3")).collect():
            units.setdefault(str(r.unit), []).append((r["class"], r.side))
        met = [tuple(sorted((x, y))) for u in units.values() for x, s in u for y, t in u if (s, t) == (0, 1) or s == t == 2 and x < y]
        need = {(x, y) for x in range(40) for y in range(x + 1, 40) if y >= 12 and 5 * (100 + x) >= 4 * (100 + y)}
        assert len(met) == len(set(met)) and need <= set(met)


def test_in_common(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-40, 40, k).astype(np.int32)) for k in (1, 5, 30, 60, 60, 90)]
    for columns in (7, 4096):
        monkeypatch.setattr(near, "COLUMNS", columns)
        got = near.in_common(sets, np.array([0, 2, 4, 5]), np.array([1, 3]))
        assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in (1, 3)] for i in (0, 2, 4, 5)]


def test_connecting():
    rng = np.random.default_rng(4)
    found = rng.random((40, 40)) < 0.02
    found |= found.T
    c = rng.integers(0, 30, 40)
    edges = near.connecting(found, c, c)
    label = {x: x for x in range(30)}
    for i, j in np.argwhere(found):
        low, high = sorted((label[c[i]], label[c[j]]))
        label = {x: low if r == high else r for x, r in label.items()}
    mine = {x: x for x in range(30)}
    for i, j in edges:
        assert found[i, j]
        low, high = sorted((mine[c[i]], mine[c[j]]))
        mine = {x: low if r == high else r for x, r in mine.items()}
    assert mine == label and len(edges) < 30
