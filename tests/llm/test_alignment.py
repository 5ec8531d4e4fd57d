from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST, SECOND = open(A, "rb").read(), open(B, "rb").read()
ALIGNER = alignment.Aligner(FIRST, SECOND)


def plain(text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of a text encoded in one, found by walking both rows of tokens byte by byte."""
    if not text:
        return []
    a, b = ALIGNER.a.encode(" " + text, add_special_tokens=False).ids, ALIGNER.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(ALIGNER.bytes_a[i] for i in a) != raw or b"".join(ALIGNER.bytes_b[i] for i in b) != raw:
        return []
    ends = []
    for ids, tokens in ((a, ALIGNER.bytes_a), (b, ALIGNER.bytes_b)):
        at, here = 0, {}
        for i in ids:
            at += len(tokens[i])
            here[at] = i
        ends.append(here)
    groups, left, right = [], [], []
    for at in range(1, len(raw) + 1):
        if at in ends[0]:
            left.append(ends[0][at])
        if at in ends[1]:
            right.append(ends[1][at])
        if at in ends[0] and at in ends[1]:
            groups.append((left, right))
            left, right = [], []
    return groups


def said(groups) -> str:
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def by_words(text: str) -> str:
    (words,) = ALIGNER.words([text])
    return "" if any(ALIGNER.n[i] < 0 for i in words) else ";".join(ALIGNER.groups[i] for i in words)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \t\nabc'sé▁ \x1c<|>09.")), max_size=60))
def test_words_like_whole_texts(text):
    assert by_words(text) == said(plain(text))


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b   c", "<|endoftext|> <s> <0x41> <unk>", "it's ▁ x", "a▁ b", "x" * 3000, "中文 字🎈 é́", "a   b", "tab \t x", "﻿x y"])
def test_hard_texts(text):
    assert by_words(text) == said(plain(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=60))
def test_both_encoders_of_ascii(text):
    assert ALIGNER.fast(" " + text) == ALIGNER.a.encode(" " + text, add_special_tokens=False).ids


def test_other_orders_have_no_second_encoder():
    import json

    spec = json.loads(FIRST)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    assert alignment.ascii_encoder(json.dumps(spec).encode(), ALIGNER.bytes_a) is None


def brute(rows) -> list[tuple]:
    groups = [(i, plain(t)) for i, t in rows]
    links = Counter((a[-1], b[-1]) for _, g in groups for a, b in g)
    best: dict[int, int] = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, g in groups:
        counts = [(links[a[-1], b[-1]], best[b[-1]]) for a, b in g]
        digest = hashlib.sha256(said(g).encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(n == m for n, m in counts), sum(n for n, _ in counts), digest))
    return sorted(out, key=str)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r)[:-1] for r in df.collect()), key=str)


def test_documents(docs):
    some = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(alignment.align(docs, A, B)) == brute(some)


def test_forgetting_changes_nothing(docs, monkeypatch):
    some = docs.where("doc_id < 40")
    want = rows_of(alignment.align(some, A, B))
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "CHUNK", 2_000)
    assert rows_of(alignment.align(some, A, B)) == want


def test_pairs_stay_within_the_bound(docs):
    found = alignment.pair_counts(alignment.encoded(docs, FIRST, SECOND))
    most = alignment.most_pairs(ALIGNER.bytes_a, ALIGNER.bytes_b)
    assert 0 < found.count() <= most < 1_000_000
    assert found.count() == found.select("pair").distinct().count()
    for r in found.collect():
        a, b = ALIGNER.bytes_a[r.pair & 0xFFFFFFFF], ALIGNER.bytes_b[r.pair >> 32]
        assert a.endswith(b) or b.endswith(a)


def test_most_pairs_by_hand():
    assert alignment.most_pairs([b"ab", b"b"], [b"b", b"b", b"xab"]) == 2 + 2 + 1 + 1  # ab-b twice, b-b twice, ab-xab, b-xab


def test_runs_go_on_over_batches():
    batches = [pa.record_batch([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"]) for k, n in (([1, 1], [2, 3]), ([1], [4]), ([], []), ([2, 3, 3], [1, 1, 1]), ([4], [9]))]
    out = pa.Table.from_batches(alignment.run_lengths(iter(batches))).to_pydict()
    assert out == {"pair": [1, 2, 3, 4], "n": [9, 1, 2, 9]}
    assert list(alignment.run_lengths(iter([]))) == []


def test_shards():
    block = alignment.Shards.packed(np.array([2 << 32 | 5, 1 << 32 | 9, 2 << 32 | 3, 2 << 32 | 4]), np.array([7, 1, 7, 2]))
    shards = alignment.Shards(block)
    sums, best = shards.find(np.array([2 << 32 | 4, 2 << 32 | 3, 1 << 32 | 9]))
    assert sums.tolist() == [2, 7, 1] and best.tolist() == [False, True, True]
    with pytest.raises(ValueError):
        shards.find(np.array([7]))
    assert len(alignment.Shards(b"").find(np.zeros(0, np.int64))[0]) == 0


def test_odd_rows(odd, empty, spark):
    more = odd.withColumn("n_a", odd.n_words).withColumn("groups", odd.flags).withColumn("pair", odd.fp)
    assert rows_of(alignment.align(more, A, B)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert alignment.align(empty, A, B).count() == 0
    bare = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert [tuple(r)[1:8] for r in alignment.align(bare, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3
