from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)
BPE = bpe.Bpe(open(PATH, "rb").read())
WORDS = sorted({b" the", b"the", b" then", b" other", b"other", b"x", " été".encode()})
LEXICON = bpe.Lexicon(bpe.compile_lexicon(WORDS, {w: BPE.merge(w) for w in WORDS}))
ENCODER = bpe.Encoder(BPE, LEXICON)


def ids(text: str) -> list[int]:
    return np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_like_the_library(text):
    want = REAL.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert BPE.decode(ENCODER.encode([text])[0]).decode("utf-8", "replace") == REAL.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a" * 5000, "ab" * 700, " " * 300 + "x", "it's  we'LL <|endoftext|>\n\nend", "ﬁ㍿🎈‍❄ ١٢٣ ½", "x" * 47 + " " + "y" * 49])
def test_hard_texts(text):
    assert ids(text) == REAL.encode(text, add_special_tokens=False).ids


def test_lexicon():
    assert LEXICON.find([*WORDS, b"th", b"zz", b""]).tolist() == [*range(len(WORDS)), -1, -1, -1]
    assert bpe.Lexicon(bpe.compile_lexicon([], {})).find([b"a"]).tolist() == [-1]
    # suffixes are shared: " other" and "other" end in the same states
    assert len(LEXICON.final) < sum(map(len, WORDS))
    many = [b"%d" % i for i in range(1000)]
    found = bpe.Lexicon(bpe.compile_lexicon(many, {w: [1] for w in many}))
    assert found.find(sorted(many)).tolist() == list(range(1000)) and len(found.final) < 20


def test_documents(docs):
    rows = bpe.encode(docs, PATH, size=500).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        want = REAL.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = np.array(want, "<u4").tobytes()
        assert bytes(r.ids) == raw and r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(REAL.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, empty):
    rows = bpe.encode(odd, PATH).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert bpe.encode(empty, PATH).count() == 0
