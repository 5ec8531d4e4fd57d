"""Near copies by similarity: leaders against brute force, recall of pairs, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import near, simhash


def jaccard(a: str | None, b: str | None, k: int = 5) -> float:
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_documents(spark, docs):
    """What goes is a near copy of what stays, and nearly all near copies go."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in simhash.one_of_near(docs).collect()}
    groups = chained(texts)
    lost = set(texts) - kept
    assert lost and all(sum(x in kept for x in g) >= 1 for g in groups) and kept >= {min(g) for g in groups}
    assert all(any(x in g and len(g) > 1 for g in groups) for x in lost)  # what goes has a near copy
    assert len(lost) >= 0.9 * (len(texts) - len(groups))


def chained(texts: dict) -> list[set]:
    """Groups that chains of near copies connect, by comparing all with all."""
    group = {i: {i} for i in texts}
    for a in texts:
        for b in texts:
            if a < b and group[a] is not group[b] and jaccard(texts[a], texts[b]) >= simhash.SIMILARITY:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return list({id(g): g for g in group.values()}.values())


def changed(words: list[str], share: float, rng) -> str:
    """A copy in which so many of the words at random places are others, in runs so that few shingles are touched."""
    out = list(words)
    start = int(rng.integers(0, max(1, len(out) - int(share * len(out)))))
    for i in range(start, start + int(share * len(out))):
        out[i] = f"new{rng.integers(1_000_000)}"
    return " ".join(out)


def test_recall_at_the_limit(spark):
    """Pairs whose similarity lies between 0.8 and 1, and as many between 0.5 and 0.75, which stay."""
    rng = np.random.default_rng(5)
    rows, near, apart = [], [], []
    for i in range(0, 600, 2):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(60, 400)))]
        share = rng.uniform(0.005, 0.085) if i % 4 else rng.uniform(0.18, 0.3)
        rows += [(i, " ".join(words)), (i + 1, changed(words, share, rng))]
        j = jaccard(rows[-2][1], rows[-1][1])
        (near if j >= 0.8 else apart).append(i + 1)
    kept = {r.doc_id for r in simhash.one_of_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(near) > 100 and len(apart) > 100
    found = sum(x not in kept for x in near)
    assert found >= 0.9 * len(near)
    assert set(apart) <= kept and {i for i, _ in rows if i % 2 == 0} <= kept


def test_a_chain(spark):
    """Documents that drift apart are one group by their chain; a link that doesn't hold is none, however close the fingerprints."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(5):
        words[i * 20 : i * 20 + 8] = [f"v{i}{j}" for j in range(8)]
        rows.append((i, " ".join(words)))
    far = " ".join(f"w{i}" if i % 9 else f"z{i}" for i in range(200))
    rows.append((9, far))
    assert jaccard(rows[0][1], rows[4][1]) < 0.8 <= min(jaccard(rows[i][1], rows[i + 1][1]) for i in range(4)) and jaccard(rows[0][1], far) < 0.5
    kept = sorted(r.doc_id for r in simhash.one_of_near(spark.createDataFrame(rows, "doc_id long, text string"), radius=40).collect())
    assert kept == [0, 9]


def test_closest_first():
    fps = np.array([0b0, 0b1, 0b111111, 0b1111111], np.uint64)
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    a, b = simhash.forest(fps[order], None, 14, 2, (1, 3))
    assert {frozenset(x) for x in zip(a, b, strict=True)} >= {frozenset((0, 1)), frozenset((63, 127))} and len(a) == 3
    rng = np.random.default_rng(2)
    some = rng.integers(0, 1 << 12, 60).astype(np.uint64)
    some = np.unique(some)
    a, b = simhash.shortest(some, 6)
    # as heavy as the lightest links that connect, found by growing one tree after the other
    apart = np.bitwise_count(some[:, None] ^ some[None, :]).astype(int)
    seen, weight = {0}, 0
    while len(seen) < len(some):
        w, j = min((apart[i, j], j) for i in seen for j in range(len(some)) if j not in seen)
        assert w <= 6
        seen, weight = seen | {j}, weight + w
    assert len(a) == len(some) - 1 and sum(bin(x ^ y).count("1") for x, y in zip(a, b, strict=True)) == weight


def test_a_large_group(spark):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in range(300)]
    rows = [(i, changed(words, 0.02, rng)) for i in range(400)] + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(80))) for i in range(100)]
    kept = {r.doc_id for r in simhash.one_of_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {1000 + i for i in range(100)} <= kept and 0 in kept and len(kept) <= 100 + 4


def test_odd_rows(odd, empty, spark):
    kept = simhash.one_of_near(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in rows]
    assert None in ids and ids.count(5) == 0 and ids.count(1) == 1 and ids.count(3) == 1 and 4 not in ids and 8 not in ids and {6, 7} <= set(ids)
    assert simhash.one_of_near(empty).count() == 0
    same = [(5, "one text that is here on its own and long"), (5, "quite another one of the same id and long"), (5, "quite another one of the same id and long"), (4, None), (3, ""), (2, "short"), (9, "short"), (8, "shorter")]
    got = sorted(map(str, (tuple(r) for r in simhash.one_of_near(spark.createDataFrame(same, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [same[0], same[1], same[4], same[5], same[7]]))


@pytest.mark.parametrize(("n", "least"), [(1, 8), (1000, 8), (1_000_000, 14), (10**12, 32)])
def test_samples(n, least):
    places = simhash.samples(n)
    assert all(len(p) == len(set(p)) and len(p) >= least and 0 <= min(p) and max(p) < 64 for p in places) and len({len(p) for p in places}) == 1
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        wrong = set(rng.choice(64, simhash.FAR, replace=False).tolist())
        met += any(not wrong & set(p) for p in places)
    assert met >= 0.88 * 300


@pytest.mark.parametrize("often", [2, 64])
def test_no_pair_is_left_out(spark, often):
    """All pairs from 0.8 on are linked, however far apart their fingerprints are, in small groups, large ones and beside a passage that all hold."""
    rng = np.random.default_rng(12)
    shared, rows = [f"s{i}" for i in range(30)], []
    for i in range(0, 240, 2):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(12, 60)))] + (shared if i % 3 == 0 else [])
        rows += [(i, " ".join(words)), (i + 1, changed(words, rng.uniform(0.02, 0.12), rng))]
    base = [f"b{i}" for i in range(150)]
    rows += [(1000 + i, changed(base, rng.uniform(0.02, 0.12), rng)) for i in range(90)]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sketched = near.sketches(df, 0.8, simhash.fingerprint)
    distinct = sketched.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("front").alias("front")).cache()
    none = spark.createDataFrame([], "a long, b long")
    id_of = {r.fp: r.doc_id for r in distinct.collect()}
    found = [(id_of[r.a], id_of[r.b]) for r in near.near_links(df, distinct, none, 0.8, often).collect()]
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in found)
    found += [(r.doc_id, id_of[r.fp]) for r in sketched.collect()]  # equal sets are one
    assert {frozenset(g) for g in linked(texts, found)} == {frozenset(g) for g in chained(texts)}
    wide = [a for a in range(0, 240, 2) if jaccard(texts[a], texts[a + 1]) >= 0.8 and (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[a + 1])).bit_count() > simhash.WIDE]
    kept = {r.doc_id for r in simhash.one_of_near(df).collect()}
    assert wide and kept == {min(g) for g in chained(texts)}


def linked(texts: dict, links: list) -> list[set]:
    group = {i: {i} for i in texts}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return list({id(g): g for g in group.values()}.values())


def test_fronts_of_alike_sets_meet():
    """Of any two sets from the threshold on the fronts share an element, whichever elements come last."""
    rng = np.random.default_rng(3)
    for _ in range(2000):
        n = int(rng.integers(1, 40))
        own = np.unique(rng.integers(0, 60, n).astype(np.uint64))
        other = np.unique(np.concatenate((own[rng.random(len(own)) < 0.95], rng.integers(0, 60, int(rng.integers(0, 4))).astype(np.uint64))))
        late = np.unique(rng.integers(0, 60, 20).astype(np.uint64))
        ranks = rng.permutation(len(late))
        if near.similarity(own, other) >= 0.8 and len(other):
            assert set(near.front(own, 0.8, (late, ranks)).tolist()) & set(near.front(other, 0.8, (late, ranks)).tolist())
    assert [near.length(n, 0.8) for n in (0, 1, 5, 10)] == [0, 1, 2, 3]


def test_no_pair_of_a_large_group_is_a_row(spark, monkeypatch):
    """No table between the steps grows with the square of a group of which most pairs lie below 0.8."""
    rng = np.random.default_rng(15)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, changed(base, 0.06, rng)) for i in range(400)]
    texts, counts, cut = dict(rows), [], near.cut
    some = [(a, b) for a in range(100) for b in range(a)]
    assert sum(jaccard(texts[a], texts[b]) < 0.8 for a, b in some) > 0.8 * len(some)

    def counted(df):
        made = cut(df)
        counts.append(made.count())
        return made

    monkeypatch.setattr(near, "cut", counted)
    kept = {r.doc_id for r in simhash.one_of_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == {min(g) for g in chained(texts)} and max(counts) < 40 * len(rows)


@pytest.mark.parametrize("cut_at", [None, 70])
def test_close_sets(cut_at):
    """Links of two tiles connect what comparing all with all connects, and each of them is close and leads to another group."""
    rng = np.random.default_rng(16)
    base = np.unique(rng.integers(0, 1 << 63, 150).astype(np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, len(base) - int(rng.integers(3, 25)), replace=False), rng.integers(0, 1 << 63, int(rng.integers(1, 12))).astype(np.uint64)))) for _ in range(140)]
    given = np.array([i if i % 5 else -1 for i in range(140)])
    links = near.close_sets(sets, given, 0.8, cut_at)
    close = [(i, j) for i in range(140) for j in range(i + 1, 140) if near.similarity(sets[i], sets[j]) >= 0.8 and (cut_at is None or i < cut_at <= j)]
    ids, same = {i: None for i in range(140)}, [(0, i) for i in range(140) if i % 5 == 0]
    assert 0 < len(links) < 140 and set(links) <= set(close) and len(close) > 3 * len(links)
    assert {frozenset(g) for g in linked(ids, links + same)} == {frozenset(g) for g in linked(ids, close + same)}
    assert not any(given[i] == given[j] for i, j in links)


@pytest.mark.parametrize("wider", [0, 4])
def test_tiles(spark, monkeypatch, wider):
    """Tiles of a few texts, dealt by element or by what elements connect: with the groups given, all near copies of a bucket are connected."""
    monkeypatch.setattr(near, "WIDER", wider)
    rng = np.random.default_rng(17)
    texts = {i: changed([f"b{i // 60}x{j}" for j in range(120)], rng.uniform(0.02, 0.08), rng) for i in range(120)}
    own = {i: near.shingles(t) for i, t in texts.items()}
    sets = spark.createDataFrame([(i, len(s), bytearray(s.astype("<u8").tobytes())) for i, s in own.items()], "fp long, n int, set binary")
    large = spark.createDataFrame([(-1 - 7 * (i // 60) - x, i) for i in texts for x in range(3) if x == 0 or i % (x + 1)], "token long, fp long")
    roots = spark.createDataFrame([(i, 1) for i in range(1, 40)], "node long, root long")
    links = [(r.a, r.b) for r in near.tile_links(large, sets, roots, 0.8, tile=8).collect()]
    given = [(1, i) for i in range(1, 40)]
    close = [(a, b) for a in texts for b in range(a) if a // 60 == b // 60 and near.similarity(own[a], own[b]) >= 0.8]
    assert links and all(near.similarity(own[a], own[b]) >= 0.8 for a, b in links)
    assert {frozenset(g) for g in linked(texts, links + given)} == {frozenset(g) for g in linked(texts, close + given)}
