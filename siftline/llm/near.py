"""Near-duplicate documents for the pipeline: runs of five words, Jaccard similarity of at least 0.8, connected components.

SimHash comes first, as in op6: a fingerprint of each set of shingles, pigeonhole blocks, links at two bits, each verified on the shingles
themselves, components. At a similarity of 0.8 fingerprints differ in about ten of 64 bits, too many for pigeonhole blocks, so what the
links leave apart are candidates by MinHash bands, verified likewise.

Shingles: words as in op6 (lower-cased for A-Z, cut at ASCII white space); each run of five is a 32-bit hash, all words if there
are fewer. Texts with equal shingles are one class from the start, so a group of copies is one row from there on; texts without
words are such a class.

Candidates: ``BANDS`` bands of ``ROWS`` minima. Two texts of similarity s share a bucket with probability 1 - (1 - s^5)^20: 0.9996
at 0.8. What shares a bucket is compared, exactly, without making all pairs of a group:

1. All of a bucket that still holds two components are compared with its hub, the member with most mates. Links join components.
2. Where it then still does and has up to ``MOST`` members, all that aren't connected with each other are.
3. Larger ones are cut into tiles of up to ``TILE`` members and about ``UNIT`` shingles, those connected with the hub apart from the others. Two tiles are a unit, unless both are of the
   hub's component or of lengths that rule the similarity out. A task holds one unit, counts what all its members have in common by products of matrices, and returns
   links that connect what is similar, two a member at most: pairs are no rows anywhere.

So a group of near copies costs a row a member in the first step, and all pairs of all buckets have been compared, ruled out or connected. What stays apart from a large
bucket's hub meets the bucket's other members in the end, a row for each member and ``TILE`` of the others.

Cases: null, empty and blank texts are copies of each other; rows that share a doc_id, or have none, but differ in text both
stay; an empty table gives an empty result; long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written
from .simhash import LOWER, SEED, WORDS, components
from .simhash import links as simhash_links

SHINGLE, BANDS, ROWS, MOST = 5, 20, 5, 16
#: Members of a tile and shingles of it, and shingles whose holders are multiplied at a time.
TILE, UNIT, COLUMNS = 256, 1 << 18, 4096
#: Rows of a batch, and shingles, that are worked on at a time.
SLICE, PART = 500, 2048
_rng = np.random.default_rng(20)
FACTORS, SHIFTS, PLACES = (_rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, SHINGLE))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the text's runs of five words, sorted."""
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return np.array([], dtype=np.uint32)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in words], dtype=np.uint64)
    width = min(SHINGLE, len(words))
    runs = sum(hashes[i : len(hashes) - width + 1 + i] * PLACES[i] for i in range(width))
    return np.unique((_mixed(runs) >> np.uint64(32)).astype(np.uint32))


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    spread = _mixed(own.astype(np.uint64))
    for at in range(0, len(spread), PART):
        np.minimum(least, (spread[at : at + PART, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in least.reshape(BANDS, ROWS)], dtype=np.uint64).view(np.int64)


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingles, as in op6: a bit is set if over half of the shingles' hashes have it."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), PART):
        spread = _mixed(own[at : at + PART].astype(np.uint64)).astype(">u8")
        counts += np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(own)).tobytes(), "big")


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array([], dtype=kind), *parts])))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            sets = [shingles(x.as_py()) for x in batch.column("text")]
            classes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(classes), pa.array([len(x) for x in sets], pa.int32()), pa.array(np.array([fingerprint(x) for x in sets], dtype=np.uint64).view(np.int64)), _lists([bands(x) if len(x) else np.array([], dtype=np.int64) for x in sets], np.int64), _lists([x.view(np.int32) for x in sets], np.int32)],
                ["doc_id", "mark", "class", "n", "fp", "bands", "shingles"],
            )


def shingled(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text, mark): doc_id, mark, class (equal shingles), n, fp, bands, shingles, and a number of its own."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "mark")
    found = rows.mapInArrow(_shingled, "doc_id long, mark long, class long, n int, fp long, bands array<long>, shingles array<int>")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "shingles")


def fingerprint_pairs(firsts: DataFrame) -> DataFrame:
    """Rows of different classes (class, fp) -> distinct pairs (a, b) with a < b that stand for op6's links: of equal fingerprints with the smallest
    class among them, and of fingerprints within two bits between these smallest ones."""
    smallest = written(firsts.groupBy("fp").agg(F.min("class").alias("one")), "fingerprints")
    near = simhash_links(smallest.select("fp"))
    side = lambda x: smallest.select(F.col("fp").alias(x), F.col("one").alias(f"of_{x}"))
    linked = near.join(side("a"), "a").join(side("b"), "b").select(F.col("of_a").alias("x"), F.col("of_b").alias("y"))
    equal = firsts.join(smallest, "fp").where(F.col("class") != F.col("one")).select(F.col("one").alias("x"), F.col("class").alias("y"))
    return linked.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _buckets(firsts: DataFrame) -> DataFrame:
    keyed = firsts.select("class", "n", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    return written(keyed.join(sizes, ["band", "key"]), "buckets")


def _hubs(members: DataFrame, most: int) -> DataFrame:
    """The hubs of each bucket of members (band, key, size, class, n, c): all of a small one, of a larger one that with most mates in all buckets."""
    weights = members.groupBy("class").agg(F.sum("size").alias("weight"))
    order = Window.partitionBy("band", "key").orderBy(F.desc("weight"), "class")
    first = members.join(weights, "class").withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(most, 1))
    return first.where((F.col("size") <= most) | (F.col("place") == 1)).drop("place", "weight")


def _met(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), with their components ca and cb, of members and hubs of one bucket, whose sizes allow the similarity."""
    near = "l.c <> h.c AND 5 * least(l.n, h.n) >= 4 * greatest(l.n, h.n)"
    pairs = members.alias("l").join(hubs.alias("h"), ["band", "key"]).where(near)
    sides = [F.struct(F.col(f"{x}.class").alias("class"), F.col(f"{x}.c").alias("c")) for x in "lh"]
    both = pairs.select(F.array_sort(F.array(*sides)).alias("x"))
    return both.select(F.col("x")[0]["class"].alias("a"), F.col("x")[1]["class"].alias("b"), F.col("x")[0]["c"].alias("ca"), F.col("x")[1]["c"].alias("cb")).distinct()


def _members(buckets: DataFrame) -> DataFrame:
    return buckets.select("band", "key", "size", "class", "n", F.col("class").alias("c"))


def candidates(firsts: DataFrame, most: int = MOST, buckets: DataFrame | None = None) -> DataFrame:
    """Rows of different classes (class, n, bands) -> distinct pairs (a, b) with a < b: those of the first round."""
    members = _members(_buckets(firsts) if buckets is None else buckets)
    return _met(members, _hubs(members, most)).select("a", "b")


def similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is at least 0.8, by the classes' shingles."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias(f"of_{x}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    # of n and m shingles, i in common: i / (n + m - i) >= 4 / 5
    return pairs.join(side("a"), "a").join(side("b"), "b").where(9 * common >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _apart(members: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """members with their components as they are after roots, of buckets that hold two components."""
    now = members.select("band", "key", "class", "n", "c")
    if roots is not None:
        now = written(now.join(roots, F.col("c") == F.col("node"), "left").select("band", "key", "class", "n", F.coalesce("root", "c").alias("c")), "now")
    mixed = now.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").drop("low", "high")
    return now.join(mixed, ["band", "key"]).select("band", "key", "size", "class", "n", "c")


def _units(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Members (band, key, class, n, c) of large buckets -> a row for each unit that one is in: unit, side (0, 1; 2: both), class, c."""
    home = members.join(hubs.select("band", "key", "class"), ["band", "key", "class"]).select("band", "key", F.col("c").alias("of_hub"))
    sided = members.join(home, ["band", "key"]).withColumn("home", F.col("c") == F.col("of_hub"))
    before = Window.partitionBy("band", "key", "home").orderBy("n", "class").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.sum(F.col("n").cast("long") + UNIT // TILE).over(before)
    tile = F.struct("home", F.floor((weight - 1) / UNIT).alias("at"))
    tiled = written(sided.withColumn("tile", tile).select("band", "key", "tile", "class", "n", "c"), "tiles")
    tiles = tiled.groupBy("band", "key", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    near = "l.tile <= r.tile AND NOT (l.tile.home AND r.tile.home) AND 5 * l.high >= 4 * r.low AND 5 * r.high >= 4 * l.low"
    pairs = tiles.alias("l").join(tiles.alias("r"), ["band", "key"]).where(near)
    pairs = pairs.select("band", "key", F.struct("band", "key", F.col("l.tile").alias("l"), F.col("r.tile").alias("r")).alias("unit"))
    sides = F.when(F.col("unit.l") == F.col("unit.r"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    listed = pairs.select("band", "key", "unit", F.explode(sides).alias("side")).withColumn("tile", F.when(F.col("side") == 1, F.col("unit.r")).otherwise(F.col("unit.l")))
    return tiled.join(listed, ["band", "key", "tile"]).select("unit", "side", "class", "c")


def in_common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each of the left sets shares with each of the right ones, other than itself; left and right are places in sets."""
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), held > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    for start in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[row[part], column[part] - start] = 1
        common += (has[left] @ has[right].T).astype(np.int64)
    return common


def connecting(found: np.ndarray, own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Places (row, column) of found that connect all that found does, given the components of rows and columns: one for each component and round."""
    own, other, chosen = own.copy(), other.copy(), []
    while (open_ := found & (own[:, None] != other[None, :])).any():
        rows = np.flatnonzero(open_.any(axis=1))
        for i in rows[np.unique(own[rows], return_index=True)[1]]:
            j = open_[i].argmax()
            if own[i] != other[j]:
                chosen.append((int(i), int(j)))
                low, high = sorted((own[i], other[j]))
                own[own == high], other[other == high] = low, low
    return chosen


def _compared(unit: pa.Table) -> pa.Table:
    """A unit's links (a, b, ca, cb), as many as connect its members."""
    sets = [x.values.to_numpy() for x in unit.column("shingles")]
    side, name, c = (unit.column(x).to_numpy() for x in ("side", "class", "c"))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    n = np.array([len(x) for x in sets])
    found = 9 * in_common(sets, left, right) >= 4 * (n[left][:, None] + n[right][None, :])
    edges = [(left[i], right[j]) for i, j in connecting(found, c[left], c[right])]
    ends = [sorted([(name[i], c[i]), (name[j], c[j])]) for i, j in edges]
    columns = ([a[0] for a, b in ends], [b[0] for a, b in ends], [a[1] for a, b in ends], [b[1] for a, b in ends])
    return pa.table([pa.array(x, pa.int64()) for x in columns], ["a", "b", "ca", "cb"])


def compared(members: DataFrame, hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of large buckets and their hubs -> links (a, b, ca, cb) that connect all members whose similarity is at least 0.8."""
    ship(members.sparkSession)
    units = _units(members, hubs).join(sets, "class")
    return units.groupBy("unit").applyInArrow(_compared, "a long, b long, ca long, cb long").distinct()


def links(rows: DataFrame, most: int = MOST) -> DataFrame:
    """shingled()'s rows -> edges (a, b) between classes whose similarity is at least 0.8, which connect all that share a bucket."""
    chosen = rows.groupBy("class").agg(F.min("row").alias("row")).select("row")
    firsts = written(rows.select("row", "class", "n", "fp", "bands").join(chosen, "row"), "firsts")
    buckets = _buckets(firsts)
    # one row for each class that shares a bucket, for all rounds: shingles are shuffled once, and a group of copies sends them once
    by_print = written(fingerprint_pairs(firsts), "pairs")
    wanted = buckets.select("class").unionByName(by_print.select(F.explode(F.array("a", "b")).alias("class"))).distinct()
    needed = firsts.select("row", "class").join(wanted, "class").select("row")
    sets = written(rows.select("row", "class", "shingles").join(needed, "row").select("class", "shingles"), "sets")

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The links among pairs, and the components that they make of those before; None if there are no links."""
        pairs = written(pairs, "pairs")
        new = written(pairs.join(similar(sets, pairs.select("a", "b")), ["a", "b"]), "edges")
        return new.select("a", "b"), None if new.isEmpty() else components(new.select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    # SimHash first: what its links connect needs no pairs in the buckets
    found, roots = linked(by_print.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    members = written(_apart(_members(buckets), roots), "members")
    hubs = written(_hubs(members, 0), "hubs")
    new, roots = linked(_met(members, hubs))
    found = found.unionByName(new)
    members = written(_apart(members, roots), "members")
    small = members.where(F.col("size") <= most)
    new, roots = linked(_met(small, small.drop("size")))
    found = found.unionByName(new)
    large = written(_apart(members.where(F.col("size") > most), roots), "members")
    return found.unionByName(written(compared(large, hubs, sets).select("a", "b"), "edges"))


def groups(rows: DataFrame, most: int = MOST) -> DataFrame:
    """class and root, equal for classes that links connect, for every class of shingled()'s rows."""
    roots = components(links(rows, most))
    return rows.select("class").distinct().join(roots, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root"))


def one_of_each(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs' rows and columns, of each group one row: that with the smallest doc_id (null last), then with the smallest hash."""
    # a row is known by its doc_id and a hash of all its columns, as doc_id may be null or repeated
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = shingled(docs.select("doc_id", "text", mark.alias("mark")))
    named = groups(rows, most).select(F.col("class").alias("_class"), "root")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    firsts = rows.groupBy("class").agg(least.alias("first")).join(named, F.col("class") == F.col("_class"))
    chosen = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").cast("long").alias("_doc"), mark.alias("_own"))
    met = whole.join(chosen, (F.col("_own") == F.col("_mark")) & F.col("_doc").eqNullSafe(F.col("_id")))
    # what is left of a mark are equal rows
    return met.dropDuplicates(["_doc", "_own"]).select("document.*")
