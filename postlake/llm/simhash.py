"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in ``radius`` bits at most agree in at least one of ``radius + 1`` bit
blocks, so a bucket for each block and value holds both. Within a bucket distinct fingerprints are
sorted by population count, cut into tiles and compared by numpy exclusive-or and bit counts; tile
pairs whose population counts differ by more than the radius are skipped, as such fingerprints cannot
be close. A small bucket is compared whole by one task; a larger one is dealt out as tiles, and each
pair of its tiles is a row of its own, so no task ever holds a large bucket.
Links leave a comparison as a spanning forest: components, not all pairs, are what is asked for.

``one_of_near`` serves a filter of near copies by similarity: five-word shingles, and links that are confirmed by them. Links of few bits come first;
the prefix join of ``near`` finds all others, however far apart their fingerprints are.

Rows without a doc_id have a fingerprint and no component; rows that repeat one are rows each. Texts without words share
the fingerprint zero. A text of any length is one row: its shingles are hashed and counted a bounded number at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, forget, groups
from .components import components
from .near import digest, near_links, shingles, sketches

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Near copies by similarity: shared share of both documents' shingles.
SIMILARITY = 0.8
#: Of samples of bits, which no query uses any more: radius, and the share found of pairs so far apart.
WIDE, FAR, RECALL = 12, 11, 0.95
#: Fingerprints that a sample of bits leaves together, about.
TOGETHER = 32
#: Fingerprints of a tile, and of the largest bucket that one task compares.
TILE, BUCKET = 1024, 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the word shingles, repeats included; a bit is set if over half of their hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if n <= shingle:
        return h(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts, n = np.zeros(64, np.int64), n - shingle + 1
    for i in range(0, n, 1 << 16):
        s, e = starts[i : min(n, i + (1 << 16))].tolist(), ends[i + shingle - 1 :].tolist()
        some = np.array([h(line[a:b], seed) for a, b in zip(s, e, strict=False)], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long. A null text has no words: fp is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int, levels: tuple[int, ...] = ()) -> tuple[list[int], list[int]]:
    """Links that connect what is within ``radius`` bits, between two sets or (right None) within one; both sorted by population count.

    With ``levels``, smaller radii, what they connect is linked first.
    """
    all_fp = left if right is None else np.concatenate((left, right))
    label = np.arange(len(all_fp))
    tiles = [(o + i, min(len(side), i + tile) + o) for o, side in ((0, left), (len(left), right)) if side is not None for i in range(0, len(side), tile)]
    cut_at = len(left)
    ones = np.bitwise_count(all_fp).astype(np.int64)
    out_a, out_b = [], []
    pairs = ((s, e, t, u, within) for within in (*levels, radius) for x, (s, e) in enumerate(tiles) for t, u in tiles[x:])
    for s, e, t, u, within in pairs:
        if right is not None and (s >= cut_at or t < cut_at):
            continue
        if ones[t] - ones[e - 1] > within or ones[s] - ones[u - 1] > within:
            continue
        close = np.bitwise_count(all_fp[s:e, None] ^ all_fp[None, t:u]) <= within
        for i in np.flatnonzero(close.sum(axis=1) > (s == t)).tolist():
            near = t + np.flatnonzero(close[i])
            apart = near[label[near] != label[s + i]]
            while len(apart):
                j = int(apart[0])
                out_a.append(s + i)
                out_b.append(j)
                label[label == label[j]] = label[s + i]
                apart = apart[label[apart] != label[s + i]]
    signed = all_fp.view(np.int64)
    return signed[out_a].tolist(), signed[out_b].tolist()


def shortest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect what is within ``radius`` bits, the shortest that do."""
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    i, j = np.nonzero(np.triu(apart <= radius, 1))
    order = np.argsort(apart[i, j], kind="stable")
    root, out_a, out_b = list(range(len(fps))), [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out_a.append(a)
            out_b.append(b)
            if len(out_a) == len(fps) - 1:
                break
    signed = fps.view(np.int64)
    return signed[out_a].tolist(), signed[out_b].tolist()


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def samples(n: int, far: int = FAR, recall: float = RECALL, together: int = TOGETHER) -> list[list[int]]:
    """Places of bits that are looked at together: so many that ``n`` fingerprints fall into small buckets, so often that pairs ``far`` apart meet."""
    bits = min(32, max(8, math.ceil(math.log2(max(n, 1) / together))))
    agree = math.comb(64 - far, bits) / math.comb(64, bits)
    rng = np.random.default_rng(9)
    return [sorted(rng.choice(64, bits, replace=False).tolist()) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - agree)))]


def blocked(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, ones, block, value): the fingerprint in blocks of bits, of which close ones share at least one."""
    n_blocks = radius + 1
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << (e - s)) - 1)) for s, e in zip(edges, edges[1:], strict=False)]
    return fps.select("fp", F.bit_count("fp").alias("ones"), F.posexplode(F.array(*blocks)).alias("block", "value"))


def close_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly what chains of fingerprints within ``radius`` bits connect. ``fps(fp)`` has no repeats."""
    rows = blocked(fps, radius)
    large = rows.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    dealt = cut(rows.join(large, ["block", "value"], "left"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups(batches, 2):
            if g.num_rows > 1:
                fp = np.sort(g.column(3).to_numpy().view(np.uint64))
                ordered = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
                x, y = forest(ordered, None, radius, tile)
                a += x
                b += y
            if len(a) > 50_000:
                yield _links(a, b)
                a, b = [], []
        yield _links(a, b)

    found = dealt.where("n is null").select("block", "value", "ones", "fp").repartition("block", "value").sortWithinPartitions("block", "value", "ones").mapInArrow(small, "a long, b long")

    # a large bucket: tiles of one population count each, and a row for each pair of tiles within the radius
    per_count = dealt.where("n is not null").groupBy("block", "value", "ones").agg(F.count("*").alias("m"))
    made = cut(dealt.where("n is not null").join(per_count, ["block", "value", "ones"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("m") / tile))).groupBy("block", "value", "ones", "part").agg(F.collect_list("fp").alias("fps")))
    # tile numbers meet first; their fingerprints are fetched once the pairs are spread
    tiles = made.withColumn("tile", F.struct("block", "value", "ones", "part"))
    one = tiles.select("block", "value", "ones", "part", "tile")
    other = one.select("block", "value", F.col("ones").alias("ones2"), F.col("part").alias("part2"), F.col("tile").alias("tile2"))
    pairs = one.join(other, ["block", "value"]).where((F.col("ones2") - F.col("ones")).between(0, radius) & ((F.col("ones2") > F.col("ones")) | (F.col("part2") >= F.col("part"))))
    first = pairs.select("tile", "tile2").join(tiles.select("tile", "fps"), "tile")
    pairs = first.join(tiles.select(F.col("tile").alias("tile2"), F.col("fps").alias("fps2")), "tile2").select("fps", "fps2", (F.col("tile") == F.col("tile2")).alias("same")).repartition(F.xxhash64("tile", "tile2"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(*batch.columns, strict=True):
                left, right = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                yield _links(*forest(left, None if same.as_py() else right, radius, tile))

    return found.union(pairs.mapInArrow(pair, "a long, b long"))


def _near_links(distinct: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of ``distinct(fp, bits, least, n, front)``: SimHash's as far as the shingles confirm them, and all others by the shingles."""
    same = cut(distinct.groupBy("bits").agg(F.min("fp").alias("b")))
    found = close_links(same.select(F.col("bits").alias("fp")))
    links = distinct.join(same, "bits").select(F.col("fp").alias("a"), "b")
    for end in ("a", "b"):
        found = found.join(same.select(F.col("bits").alias(end), F.col("b").alias(f"of_{end}")), end)
    links = cut(links.union(found.select("of_a", "of_b")))
    good = near_links(docs, distinct.select("fp", F.col("least").alias("doc_id"), "n", "front"), links, least)
    forget(links)
    forget(same)
    return good


def _classes(docs: DataFrame, radius: int, shingle: int, seed: int, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of each fingerprint with a doc_id.

    Components are of pairs (smallest doc_id, fingerprint), so their smallest pair holds the id that is asked for and no
    aggregate over a component is needed. With ``least``, a text's fingerprint is the digest of its shingles.
    """
    if least is None:
        fp = cut(fingerprints(docs, shingle, seed))
        distinct = cut(fp.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
        links = close_links(distinct.select("fp"), radius)
    else:
        fp = cut(sketches(docs, least, lambda t: fingerprint(t, shingle, seed)))
        distinct = cut(fp.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("bits").alias("bits"), F.min("n").alias("n"), F.first("front").alias("front")))
        links = _near_links(distinct, docs, least)
    node = distinct.select(F.col("fp"), F.struct("least", "fp").alias("node"))
    for end in ("a", "b"):
        links = links.join(node.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), end)
    roots = components(links.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    named = node.join(roots.select(F.col("node.fp").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "node"))
    return fp.select("doc_id", "fp"), cut(named.select("fp", F.col("root.fp").alias("root"), F.col("root.least").alias("component_id")))


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links of ``radius`` bits at most reach. Copies share a
    fingerprint and are compared once. Rows without a doc_id keep their fingerprint and have no component.
    """
    fp, classes = _classes(docs, radius, shingle, seed)
    out = fp.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_near(docs: DataFrame, least: float = SIMILARITY, radius: int = WIDE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Of each group of documents that chains of near copies connect the one with the smallest doc_id, and all rows without a doc_id.

    A near copy shares ``least`` of both texts' five-word shingles, whatever their fingerprints (of ``shingle`` words) are: ``radius`` is taken for
    older callers and leaves nothing out. Copies of a row go, unlike texts of one id stay. Texts without words are copies of each other. Long texts are one row each, and hashed whole.
    """
    return one_of_each(docs, radius, shingle, seed, least)


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, least: float | None = None) -> DataFrame:
    """The documents whose doc_id is the smallest of their component, one row for each doc_id and component, and all rows without a doc_id.

    With ``least``, links hold only between texts that share so much of their shingles.
    """
    fp, classes = _classes(docs, radius, shingle, seed, least)
    own = fp.where("doc_id is not null").join(classes, "fp").where("doc_id = component_id")
    rows = docs.where("doc_id is not null")
    # ids of rows with unlike fingerprints, if there are any: such rows are told apart by them
    many = cut(fp.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id"))
    kept = own.select("doc_id").distinct()
    if many.isEmpty():
        named = rows.join(kept, "doc_id").dropDuplicates(["doc_id"]).select(docs.columns)
        return named.unionByName(docs.where("doc_id is null"))
    named = rows.join(kept.join(many, "doc_id", "left_anti"), "doc_id").dropDuplicates(["doc_id"]).select(docs.columns)
    first = own.join(many, "doc_id", "left_semi").groupBy("doc_id", "root").agg(F.min("fp").alias("fp"))
    held = rows.join(many, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [digest(shingles(t.as_py())) for t in b.column(2)] if least is not None else np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["row", "doc_id", "fp"])

    schema = held.select("row", "doc_id", F.lit(0).cast("long").alias("fp")).schema
    apart = held.mapInArrow(run, schema).join(first, ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"]).select("row.*")
    return named.unionByName(apart).unionByName(docs.where("doc_id is null"))
