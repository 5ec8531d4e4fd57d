from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postlake.llm import counts

PATH = public_tokenizers.path("word_bpe_49k.json")
SOURCE = open(PATH, "rb").read()
REAL = Tokenizer.from_file(PATH)
CUTTER = counts.Cutter(counts.checked(SOURCE))
LENGTHS = counts.Lengths(SOURCE, {"the": 1})


def count(text: str) -> int:
    added, pieces = CUTTER.pieces(text)
    return added + sum(map(LENGTHS.__getitem__, pieces))


def real(text: str) -> int:
    return len(REAL.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'sStTlLdD09<|>aé́ \u0085 \x1c\x0b")), max_size=60))
def test_like_the_library(text):
    assert count(text) == real(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "".join(map(chr, range(128))), "'S'T'RE'' 's''ll", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|>é", "é ́x ΣΑΣ İ K ﬁ ٣ ½ 中文字 🎈‍❄", "x" * 5000, "é" * 3000, "<|endof\ntext|>", "x y z\u0085"],
)
def test_hard_texts(text):
    assert count(text) == real(text)


def test_pieces_stand_for_themselves():
    assert CUTTER.pieces("It's 42, naïve!") == (0, ["it", "'s", "4", "2", ",", "naïve!"])
    assert CUTTER.pieces("<|endoftext|>") == (1, [])


def test_second_tier_is_bounded(monkeypatch):
    monkeypatch.setattr(counts, "REMEMBERED", 3)
    lengths = counts.Lengths(SOURCE, {"the": 1})
    for w in ("a", "b", "c", "d", "x" * 300):
        lengths[w]
    assert len(lengths) == 5  # no piece over the longest is kept
    lengths.trim()
    assert dict(lengths) == {"the": 1}


def test_first_tier_travels():
    assert counts.unpacked(*counts.packed([], [])) == {}
    assert counts.unpacked(*counts.packed(["a", "é'"], [1, 300])) == {"a": 1, "é'": 300}


@pytest.mark.parametrize("size", [0, 5, counts.FREQUENT])
def test_documents(docs, size):
    rows = counts.count_tokens(docs, PATH, size=size).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = real(texts[r.doc_id] or "")
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((texts[r.doc_id] or "").encode()), want > 2048)


def test_sampled_table(docs, monkeypatch):
    monkeypatch.setattr(counts, "SAMPLE", 20)
    words = counts.frequent_pieces(docs, CUTTER, 50)
    assert 0 < len(words) <= 50
    assert counts.count_tokens(docs, PATH).agg({"n_tokens": "sum"}).first()[0] == sum(real(r.text or "") for r in docs.collect())


def test_odd_rows(odd, empty):
    rows = counts.count_tokens(odd.withColumn("n_tokens", odd.n_words).withColumn("n_bytes", odd.fp), PATH).collect()
    assert len(rows) == 10 and {(r.n_tokens, r.n_bytes) for r in rows if r.doc_id in (3, 4)} == {(0, 0)}
    assert len({r.n_tokens for r in rows if r.doc_id in (1, 5, None)}) == 1
    assert [r.over_limit for r in rows if r.doc_id == 6] == [True] and [r.n_bytes for r in rows if r.doc_id == 8] == [4]
    assert counts.count_tokens(empty, PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        counts.checked(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
