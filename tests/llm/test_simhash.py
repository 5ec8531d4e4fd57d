from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postlake.llm import components, simhash


def brute(fps: list[int], radius: int) -> list[int]:
    """The smallest index that each can reach."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain_fingerprint(text: str) -> int:
    import re

    words = [w for w in re.split("[ \t\n\r\x0b\x0c]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "One", "a b c", "A b C d", "x " * 100, "Été ÀB \x1f c\x85d e f g h", "a b c d e f a b c d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize(("tile", "bucket"), [(1024, 4096), (4, 8)])
def test_links_in_small_and_large_buckets(spark, tile, bucket):
    random.seed(5)
    fps = {0, 1}
    for _ in range(40):
        base = random.getrandbits(64)
        for _ in range(random.randrange(1, 8)):
            fps.add(base)
            base ^= sum(1 << random.randrange(64) for _ in range(random.randrange(1, 7))) & (1 << 64) - 1
    for i in range(60):  # one block in common
        fps.add(random.getrandbits(51) << 13 | 77)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    links = simhash.close_links(df, 4, tile, bucket)
    roots = {r.node: r.root for r in components.components(links).collect()}
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    groups, want = {}, {}
    for f, r in zip(signed, brute(fps, 4), strict=True):
        groups.setdefault(roots.get(f, f), set()).add(f)
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_documents(spark, docs):
    rows = simhash.simhash_components(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, brute(fps, 4), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want and len(rows) == len(ids)


def test_odd_rows(odd, empty):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == 10
    found = {r.doc_id: r for r in rows}
    assert found[None].component_id is None and found[5].component_id == 1 and found[4].component_id == 3 and found[8].component_id == 3
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "6", "7", "None"] + ["2"] * (found[2].component_id == 2))
    assert simhash.simhash_components(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components.components(links).collect()} == {0}


def test_unlike_texts_of_one_id_stay(spark):
    texts = ["a text of its own that nobody copies at all", "quite another one with other words inside of it"]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (7, texts[0]), (8, None), (None, texts[0])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(5, texts[0]), (5, texts[1]), (8, None), (None, texts[0])]))


def test_component_ids_with_ids_that_repeat(spark):
    """Each fingerprint's component is told by its own smallest doc_id, without an aggregate over the component."""
    texts = ["one text here that stands alone in all", "another text there that has copies too", "a third one of its own with more words"]
    rows = [(9, texts[0]), (4, texts[1]), (7, texts[1]), (4, texts[2]), (3, texts[2]), (None, texts[0]), (2, None), (1, "")]
    got = sorted(map(str, simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    want = {(9, 9), (4, 4), (7, 4), (4, 3), (3, 3), (None, None), (2, 1), (1, 1)}
    roots = brute([plain_fingerprint(t) for t in texts], 4)
    assert roots == [0, 1, 2] and got == sorted(f"Row(doc_id={a}, component_id={b})" for a, b in want)
