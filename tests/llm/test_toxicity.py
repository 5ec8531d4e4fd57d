from __future__ import annotations

import pytest

from postlake.llm import toxicity


@pytest.fixture(scope="module")
def builtin():
    return toxicity.Lexicon({toxicity.fold(w)[0]: x for w, x in toxicity.BUILT_IN.items()})


@pytest.mark.parametrize("text", ["You are an IDIOT and a moron, stupid scum", "you 1d10t m0r0n 5tup1d", "іdiоt mоrоn ѕtupіd", "ｉｄｉｏｔ ｍｏｒｏｎ ｓｔｕｐｉｄ", "id​iot mor­on stu$$ stupid"])
def test_disguises(builtin, text):
    assert builtin.score(text) >= toxicity.TOXIC


def test_exceptions_and_length(builtin):
    assert builtin.score("put it in the trash can, feed the clown fish") == 0.0 and builtin.score("") == 0.0
    assert 0 < builtin.score("trash " + "fine " * 3000) < toxicity.TOXIC
    assert builtin.score("bathmoron xidiot") == 0.0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs, lexicon).withColumn("held_out", toxicity.held_out()).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    clean = [r.predicted for r in rows if not r.toxic]
    assert right > 0.95 and sum(clean) / len(clean) < 0.02
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 0, 1), (2, None, None), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        lexicon = toxicity.learn(odd, labels)
        assert toxicity.score(odd, lexicon).count() == 10 and toxicity.not_toxic(odd, lexicon).columns == odd.columns
        assert toxicity.not_toxic(odd, lexicon).count() == 10
    assert toxicity.score(empty, toxicity.learn(empty, none)).count() == 0


def test_exceptions_end_with_their_words(builtin):
    for text in ("you trash cannot be helped", "you are trash candidate", "trash canteen", "trash"):
        assert builtin.score(text) > 0.3, text
    assert builtin.score("a trash can, trash bin, trash can") == 0.0 and builtin.score("trash can idiot") > 0.3


def naive(lexicon, text):
    """Word by word: an exception that begins here, else the longest entry that the word begins with."""
    words, found, i = toxicity.fold(text), {}, 0
    phrases = [toxicity.fold(p) for p in lexicon.exceptions]
    while i < len(words):
        fits = [len(p) for p in phrases if words[i : i + len(p)] == p]
        entries = [e for e in lexicon.weights if words[i].startswith(e)]
        if fits:
            i += max(fits)
            continue
        if entries:
            n, _ = found.get(words[i], (0, 0.0))
            found[words[i]] = n + 1, lexicon.weights[max(entries, key=len)]
        i += 1
    return sum(w * min(n, toxicity.REPEATS) for n, w in found.values()), max(len(words), toxicity.FLOOR)


def test_against_naive_matching(spark):
    import random

    random.seed(8)
    lexicon = toxicity.Lexicon({"tra": 1.5, "trash": 2.0, "trashcan": 0.5, "ciown": 1.0, "bad": -0.5, "b": 0.25}, ("trash can", "trash can iid", "bad trash", "clown fish"))
    parts = ["trash", "can", "lid", "candidate", "trashcan", "clown", "fish", "fishes", "bad", "b", "tr", "tra", "fine", "Trash!", "b4d"]
    for _ in range(3000):
        text = " ".join(random.choices(parts, k=random.randrange(0, 9)))
        assert lexicon.evidence(text) == pytest.approx(naive(lexicon, text)), text


def test_query_against_naive_matching(spark):
    from postlake.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    want = {}
    for r in docs.collect():
        e, n = naive(lexicon, r.text or "")
        want[r.doc_id] = 1 - 0.3 ** (max(0.0, e) / n**lexicon.power / lexicon.cut)
    got = {r.doc_id: r.score for r in op2_toxicity(spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-9)
