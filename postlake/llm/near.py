"""Near copies by shared shingles, found exactly by a prefix join.

A text is the set of its word shingles' hashes; texts with equal sets are one, told by the set's digest (``fp``). Two sets of which the
shared part is at least ``least`` have an element in common within each one's front: the first n - ceil(least * n) + 1 of its n elements in an
order that all texts share. So texts meet by the elements of their fronts, and nothing that meets the threshold is left out. The order is that
of the hashes, except that elements found in many fronts come last; which they are decides speed only.

No pair of a large bucket is a row. First SimHash's links, and in the buckets of frequent elements each text with one of them
(its bucket's leader), are confirmed by the sets themselves, and what they connect becomes a group. Then the texts of frequent elements are dealt out as
tiles, and a row for each two tiles: what still leads from one group to another is compared within a task, all with all, and leaves as a forest of links.
Only pairs that meet in small buckets are rows. They are counted by the elements which both fronts hold: sets share at most these and what lies behind the
front of one, so few pairs are left to look at. These are confirmed too, the likeliest first, then all others. What chains of near copies connect is one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, forget, groups
from .components import components

SHINGLE, SEED = 5, 42
#: Fronts that hold an element from which on it is frequent, and the most of them that come last in the order.
OFTEN, LISTED = 64, 1 << 20
#: Times that fronts are taken anew for frequent elements, and rounds of leaders and of the likeliest pairs; then all others are looked at.
AGAIN, LEADERS, LIKELIEST = 2, 3, 2
#: Texts and bytes of their sets in a tile, about, and the most bits of a set's mark.
TILE, TILE_BYTES, MARK = 1024, 8 << 20, 1 << 13
#: Texts that frequent elements connect are compared all with all unless their pairs are so many times those of the elements' buckets.
WIDER = 4
#: Room for rounding: bounds let this much more through, never less.
ROOM = 1e-6


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted set of hashes of a text's word shingles: of the whole if it has fewer words, none of a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    h = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    return np.unique(np.array([h(b" ".join(words[i : i + shingle]), seed) for i in range(len(words) - shingle + 1)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes of two sets as a part of all of theirs; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(own: np.ndarray) -> int:
    """What stands for a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.astype("<u8").tobytes())).view(np.int64))


def length(n: int, least: float) -> int:
    """Elements of a front of a set of ``n``."""
    return min(n, n - math.ceil(least * n - ROOM) + 1)


def front(own: np.ndarray, least: float, late: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first elements of a sorted set in the order of all texts; ``late`` are sorted elements and their ranks behind all others."""
    n = length(len(own), least)
    if late is None or not len(late[0]) or not len(own):
        return own[:n]
    at = np.minimum(np.searchsorted(late[0], own), len(late[0]) - 1)
    rank = np.where(late[0][at] == own, late[1][at], -1)
    return own[np.argsort(rank, kind="stable")[:n]]


def sketches(docs: DataFrame, least: float, simhash: Callable[[str | None], int]) -> DataFrame:
    """(doc_id, fp, bits, n, front) of each row: its set's digest, its SimHash, its set's size and front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                texts = b.column(1).slice(s, 256).to_pylist()
                sets = [shingles(t) for t in texts]
                bits = np.array([simhash(t) for t in texts], np.uint64).view(np.int64)
                columns = [b.column(0).slice(s, 256), pa.array([digest(x) for x in sets], pa.int64()), pa.array(bits), pa.array([len(x) for x in sets], pa.int32()), pa.array([front(x, least).view(np.int64) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "bits", "n", "front"])

    return _texts(docs).mapInArrow(run, "doc_id long, fp long, bits long, n int, front array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, column: str, kind: str, make: Callable[[np.ndarray], object]) -> DataFrame:
    """(fp, n, column) of what ``make`` gives for the sets of ``wanted(doc_id, fp)``, read from the texts anew."""
    arrow = pa.list_(pa.int64()) if kind == "array<long>" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 64):
                fps, sizes, out = [], [], []
                for fp, t in zip(b.column(0)[s : s + 64].to_pylist(), b.column(1)[s : s + 64], strict=True):
                    own = shingles(t.as_py())
                    if digest(own) == fp:  # an id may have several texts
                        fps.append(fp)
                        sizes.append(len(own))
                        out.append(make(own))
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(out, arrow)], ["fp", "n", column])

    made = cut(_texts(docs).join(wanted, "doc_id").select("fp", "text").mapInArrow(run, f"fp long, n int, {column} {kind}"))
    return made if made.groupBy("fp").count().where("count > 1").isEmpty() else made.dropDuplicates(["fp"])


def fronts(docs: DataFrame, distinct: DataFrame, least: float, often: int = OFTEN) -> tuple[DataFrame, DataFrame]:
    """(token, fp, n, m) of the elements that ``m`` > 1 fronts hold, and their counts (token, m); ``distinct(fp, doc_id, n, front)``."""
    own, listed, made = distinct.select("fp", "n", "front"), {}, []
    for again in range(AGAIN + 1):
        rows = own.select(F.explode("front").alias("token"), "fp", "n")
        shared = cut(rows.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"))
        hot = shared.where(F.col("m") > often)
        new = [r.token for r in hot.orderBy(F.desc("m"), "token").limit(LISTED).collect() if r.token not in listed] if again < AGAIN else []
        if not new:
            break
        for token in reversed(new):
            listed[token] = len(listed)
        values = np.array(list(listed), np.int64).view(np.uint64)
        order = np.argsort(values)
        late = docs.sparkSession.sparkContext.broadcast((values[order], np.array(list(listed.values()), np.int64)[order]))
        touched = cut(rows.join(hot.select("token"), "token", "left_semi").select("fp").distinct())
        anew = _sets(docs, distinct.join(touched, "fp", "left_semi").select("doc_id", "fp"), "front", "array<long>", lambda own, late=late: front(own, least, late.value).view(np.int64))
        now = cut(own.join(touched, "fp", "left_anti").unionByName(anew))
        for done in (*made, shared, touched, anew):
            if hasattr(done, "_cut"):
                forget(done)
        own, made = now, [now]
    buckets = cut(rows.join(shared, "token"))
    for done in made:
        forget(done)
    return buckets, shared


def looked_at(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, holds) of ``pairs(a, b)``, by ``sets(fp, set)``."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = ((np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) for x, y in zip(b.column(2), b.column(3), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([similarity(x, y) >= least for x, y in given], pa.bool_())], ["a", "b", "holds"])

    x, y = sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), sets.select(F.col("fp").alias("b"), F.col("set").alias("y"))
    return cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long, holds boolean"))


def _grouped(rows: DataFrame, good: DataFrame, column: str = "fp", root: str = "root") -> DataFrame:
    """``rows`` with the group of ``column``: the root of what ``good(node, root)`` connects, else itself."""
    own = good.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(own, column, "left").withColumn(root, F.coalesce("_root", F.col(column))).drop("_root")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")])


def tile_links(large: DataFrame, sets: DataFrame, roots: DataFrame, least: float, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Links (a, b) of near copies that connect, with the groups of ``roots(node, root)``, all near copies that meet in a bucket of ``large(token, fp)``.

    Texts that frequent elements connect lie together once, not once for each element, unless that makes far more pairs. A tile holds sets of like size, and either
    only texts of its bucket's largest group or only others; sizes too far apart, and two tiles of one group, are not compared.
    """
    family = cut(components(large.select(F.col("token").alias("a"), F.col("fp").alias("b"))))
    known = large.join(family.select(F.col("node").alias("fp"), F.col("root").alias("family")), "fp")
    per_token = known.groupBy("token").agg(F.min("family").alias("family"), F.count("*").cast("double").alias("m"))
    by_token = per_token.groupBy("family").agg(F.sum(F.col("m") * F.col("m")).alias("met"))
    members = known.select("family", "fp").distinct()
    size = members.groupBy("family").agg(F.count("*").cast("double").alias("m"))
    whole = cut(by_token.join(size, "family").select("family", (F.col("m") * F.col("m") <= WIDER * F.col("met")).alias("whole")))
    keyed = members.join(whole.where("whole"), "family").select(F.col("family").alias("key"), "fp").union(known.join(whole.where("not whole"), "family").select("token", "fp"))
    keyed = cut(_grouped(keyed, roots).join(sets.select("fp", "n"), "fp"))
    of_root = keyed.groupBy("key", "root").agg(F.count("*").alias("m"))
    first = of_root.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.count("*").alias("n_roots")).where("n_roots > 1")
    several = keyed.join(first, "key").select("key", "fp", "root", "n", (F.col("root") == F.col("largest")).alias("inside"), F.floor(3 * F.log2("n")).alias("size"))
    at = ["key", "inside", "size"]
    parts = several.groupBy(at).agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(8 * F.sum("n") / tile_bytes)).alias("parts"))
    placed = cut(several.join(parts, at).withColumn("tile", F.struct("inside", "size", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))).select("key", "tile", "fp", "root", "n"))
    tiles = cut(placed.groupBy("key", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("low_root"), F.max("root").alias("high_root")))
    x, y = (tiles.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "lo", "hi", "low_root", "high_root")]) for s in "xy")
    sized = (F.col("lo_x") * least <= F.col("hi_y") + ROOM) & (F.col("lo_y") * least <= F.col("hi_x") + ROOM)
    one = F.least("low_root_x", "low_root_y") == F.greatest("high_root_x", "high_root_y")
    pairs = cut(x.join(y, "key").where((F.col("tile_x") <= F.col("tile_y")) & sized & ~one).select("key", "tile_x", "tile_y", F.monotonically_increasing_id().alias("pair")))
    sides = pairs.select("key", "pair", F.col("tile_x").alias("tile"), F.lit(0).cast("long").alias("side")).union(pairs.where("tile_x <> tile_y").select("key", "pair", "tile_y", F.lit(1).cast("long")))
    dealt = sides.join(placed, ["key", "tile"]).join(sets.select("fp", "set"), "fp").select("pair", "side", "fp", "root", "set")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 1):
            side, fp, root = (g.column(i).to_numpy() for i in (1, 2, 3))
            own = [np.frombuffer(x.as_py(), "<u8") for c in g.column(4).chunks for x in c]
            first = int((side == 0).sum())
            links = close_sets(own, root, least, first if first < len(side) else None)
            yield pa.RecordBatch.from_arrays([pa.array([fp[i] for i, _ in links], pa.int64()), pa.array([fp[j] for _, j in links], pa.int64())], ["a", "b"])

    found = cut(dealt.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(compared, "a long, b long"))
    for x in (family, whole, keyed, placed, tiles, pairs):
        forget(x)
    return found


def marks(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: whether an odd number of its elements falls on the bit. Rows differ in no more bits than sets in elements."""
    bits = 1 << min(MARK.bit_length() - 1, max(8, (4 * max(map(len, sets))).bit_length()))
    odd = np.array([np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1 for s in sets])
    return np.packbits(odd, axis=1).view(np.uint64)


def close_sets(sets: list[np.ndarray], groups_of: np.ndarray, least: float, cut_at: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what is close and in unlike groups: among all sets, or (``cut_at``) between those before that place and those from it on."""
    n = len(sets)
    sizes, bits = np.array([len(s) for s in sets], np.int64), marks(sets)
    label, out = np.unique(groups_of, return_inverse=True)[1], []
    for i in range(n if cut_at is None else cut_at):
        s = i + 1 if cut_at is None else cut_at
        apart = s + np.flatnonzero(label[s:] != label[i])
        apart = apart[np.minimum(sizes[apart], sizes[i]) >= least * np.maximum(sizes[apart], sizes[i]) - ROOM]
        wrong = np.bitwise_count(bits[apart] ^ bits[i]).sum(axis=1, dtype=np.int64)
        ok = wrong <= (1 - least) / (1 + least) * (sizes[apart] + sizes[i]) + ROOM
        for j in apart[ok][np.argsort(wrong[ok], kind="stable")].tolist():
            if label[j] != label[i] and similarity(sets[i], sets[j]) >= least:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def near_links(docs: DataFrame, distinct: DataFrame, first: DataFrame, least: float, often: int = OFTEN) -> DataFrame:
    """Links (a, b) that connect exactly what chains of near copies connect, each of them one of these.

    ``distinct(fp, doc_id, n, front)`` has a row for each set and a document that has it; ``first(a, b)`` are pairs to look at before all others.
    """
    buckets, shared = fronts(docs, distinct, least, often)
    of = distinct.select("fp", "doc_id")
    large = cut(buckets.where(F.col("m") > often).select("token", "fp"))
    first = cut(_ordered(first).distinct())
    ends = lambda pairs: pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp")))
    wanted = cut(of.join(large.select("fp").union(ends(first)).distinct(), "fp", "left_semi"))
    sets = _sets(docs, wanted, "set", "binary", lambda own: own.astype("<u8").tobytes())

    held = cut(looked_at(first, sets, least).where("holds").select("a", "b"))
    roots = cut(components(held))
    for i in range(LEADERS):
        # each text of a frequent element's bucket with the bucket's leader, if that is of another group; of its leaders that of most buckets
        own = _grouped(large, roots)
        order = F.struct(F.xxhash64("fp", F.lit(i)), F.col("fp").alias("b"), F.col("root").alias("other"))
        leader = own.groupBy("token").agg(F.min(order).alias("x")).select("token", "x.b", "x.other")
        pairs = own.join(leader, "token").where("root <> other").groupBy(F.col("fp").alias("a"), "b").count()
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
        tried = looked_at(_ordered(pairs).distinct(), sets, least)
        if tried.where("holds").isEmpty():
            forget(tried)
            break
        held, roots, done = *_more(held, tried), (held, roots)
        for x in (*done, tried):
            forget(x)
    # the rest of the large buckets, tile by tile
    found = tile_links(large, sets, roots, least)
    lots = cut(large.groupBy("fp").agg(F.count("*").alias("lots")))
    if not found.isEmpty():
        held, roots, done = *_more(held, found.withColumn("holds", F.lit(True))), (held, roots)
        for x in done:
            forget(x)
    for x in (large, found, *([sets] if hasattr(sets, "_cut") else [])):
        forget(x)

    # pairs of texts of several groups that meet in a small bucket: all elements of small buckets that a pair's fronts share are counted, and frequent ones bounded
    own = _grouped(buckets.where(F.col("m") <= often).select("token", "fp", "n"), roots).join(lots, "fp", "left")
    own = cut(own.select("token", "fp", "n", "root", F.coalesce("lots", F.lit(0)).alias("lots")))
    sides = [own.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "n", "root", "lots")]) for x in "ab"]
    small, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    pairs = sides[0].join(sides[1], "token").where((F.col("fp_a") < F.col("fp_b")) & (F.col("root_a") != F.col("root_b")) & (small >= least * most - ROOM))
    pairs = pairs.groupBy(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"), "n_a", "n_b", "lots_a", "lots_b").agg(F.count("*").alias("k"))
    behind = F.ceil(F.lit(least) * most - ROOM) - 1 + F.least("lots_a", "lots_b")  # what lies behind the longer front, and frequent elements
    enough = F.col("k") + behind >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - ROOM
    pairs = cut(pairs.where(enough).select("a", "b", "k"))
    for x in (own, lots, buckets, shared):
        forget(x)

    wanted = cut(of.join(ends(pairs).distinct(), "fp", "left_semi"))
    sets = _sets(docs, wanted, "set", "binary", lambda own: own.astype("<u8").tobytes())
    for i in range(LIKELIEST + 1):
        if pairs.isEmpty():
            break
        best = pairs.select("a", "b")
        if i < LIKELIEST:
            both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "k"))
            best = _ordered(both.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))).distinct()
        tried = looked_at(best, sets, least)
        if i == LIKELIEST:
            held = held.union(tried.where("holds").select("a", "b"))
            break
        held, roots, done = *_more(held, tried), (held, roots, pairs)
        left = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = cut(_grouped(_grouped(left, roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b").select("a", "b", "k"))
        for x in (*done, tried):
            forget(x)
    return held


def _more(held: DataFrame, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that hold with those of ``tried`` that do, and their groups."""
    held = cut(held.union(tried.where("holds").select("a", "b")))
    return held, cut(components(held))
