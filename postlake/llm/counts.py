"""Token counts of whole texts by a two-tier lookup, without moving a pre-token.

A text is cut into pieces whose tokens don't depend on their neighbours: lower-cased ASCII pre-tokens, and stretches
between ASCII blanks that hold any other character. The first tier is a broadcast table of the lengths of frequent
pieces (``FREQUENT`` at most). The second is each worker's memory of the pieces that it met beside those, encoded by the
vocabulary's own library once and remembered up to a bound. Nothing is shuffled, and no count depends on what the
tiers hold.

The frequent pieces come from a random sample of about ``SAMPLE`` rows of any kind, source and language; each of its tasks
names ``NAMED`` pieces a sampled row at most, so the driver sees no more than ``SAMPLE * NAMED``. It fills a table and decides nothing else.

A null text is empty: 0 bytes, 0 tokens. A text that is long is counted piece by piece, so only a stretch without any blank is encoded in one.
Rows that repeat, ids that are null and columns of other names each keep their own row and don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Entries of the first tier, rows of the sample, pieces that a task names for each of its sampled rows and at most.
FREQUENT, SAMPLE, NAMED, NAMED_AT_MOST = 16_384, 4_096, 256, 8_192
#: Pieces that a worker remembers, the longest of them, bytes of text at once, and the context that counts are held against.
REMEMBERED, LONGEST, CHUNK, LIMIT = 400_000, 256, 1 << 20, 2048
#: What the vocabulary's file says about normalizing and splitting (fixed values).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split where all characters are ASCII and lower-cased.
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
BLANKS = re.compile(r"[\t-\r ]+")


def checked(source: bytes) -> list[str]:
    """The added tokens of a tokenizer file whose texts can be cut as this module does."""
    spec = json.loads(source)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if (spec.get("normalizer") or {}).get("normalizers") != NORMALIZERS or (steps[0].get("pattern") or {}).get("Regex") != SPLIT:
        raise ValueError("a vocabulary of lower-cased words is needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return [t["content"] for t in spec["added_tokens"]]


class Cutter:
    """Cuts texts into pieces."""

    def __init__(self, added: list[str]) -> None:
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """How many added tokens stand in a text, and the pieces of what lies between them."""
        if self.added is None or not self.added.search(text):
            return 0, self._between(text)
        parts = self.added.split(text)
        return len(parts) - 1, [w for p in parts for w in self._between(p)]

    @staticmethod
    def _between(text: str) -> list[str]:
        if text.isascii():
            return ASCII_PIECE.findall(text.lower())
        plain, wide = [], []
        for c in BLANKS.split(text):
            (plain if c.isascii() else wide).append(c)
        return ASCII_PIECE.findall(" ".join(plain).lower()) + wide


class Lengths(dict):
    """Tokens of each piece: frequent ones from the start, others once they were met."""

    def __init__(self, source: bytes, frequent: dict[str, int]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_buffer(source).encode
        self.frequent = frequent
        super().__init__(frequent)

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            self[piece] = n
        return n

    def trim(self) -> None:
        """Forget the second tier if it has outgrown its bound."""
        if len(self) > REMEMBERED + len(self.frequent):
            self.clear()
            self.update(self.frequent)


def packed(pieces: Iterable[str], lengths: Iterable[int]) -> tuple[bytes, bytes]:
    """The first tier as it travels: words, none of which holds a line end, and a 16-bit length each."""
    return "\n".join(pieces).encode(), np.fromiter(lengths, "<u2").tobytes()


def unpacked(words: bytes, lengths: bytes) -> dict[str, int]:
    n = np.frombuffer(lengths, "<u2").tolist()
    return dict(zip(words.decode().split("\n"), n, strict=True)) if n else {}


_built: dict[bytes, Lengths] = {}


def _lengths(source: bytes, words: bytes, lengths: bytes) -> Lengths:
    """One for each worker, vocabulary and first tier."""
    key = hashlib.sha256(source + words + lengths).digest()
    if key not in _built:
        _built.clear()
        _built[key] = Lengths(source, unpacked(words, lengths))
    return _built[key]


def frequent_pieces(docs: DataFrame, cutter: Cutter, size: int = FREQUENT) -> list[str]:
    """The most frequent pieces of a sample; ties go to the one that comes first in order of characters."""
    rows = docs.count()
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.sample(False, SAMPLE / rows, 7) if rows > SAMPLE else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        seen = 0
        for b in batches:
            for piece in slices(b, 0, CHUNK):
                seen += piece.num_rows
                for t in piece.column(0):
                    counts.update(w for w in cutter.pieces(t.as_py())[1] if len(w) <= LONGEST)
                if len(counts) > REMEMBERED:
                    counts = Counter(dict(counts.most_common(REMEMBERED // 2)))
        named = counts.most_common(min(NAMED_AT_MOST, NAMED * seen))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in named], pa.string()), pa.array([n for _, n in named], pa.int64())], ["piece", "n"])

    total: Counter[str] = Counter()
    for r in sample.mapInArrow(run, "piece string, n long").collect():
        total[r.piece] += r.n
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, size: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text.

    ``vocabulary`` is the path of a tokenizer file, read on the driver. ``over_limit`` says whether a text has more than
    ``limit`` tokens.
    """
    with open(vocabulary, "rb") as f:
        source = f.read()
    cutter = Cutter(checked(source))
    words = frequent_pieces(docs, cutter, size) if size else []
    first = Lengths(source, {})
    block = docs.sparkSession.sparkContext.broadcast((source, *packed(words, (first[w] for w in words))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(*block.value)
        get = lengths.__getitem__
        for b in batches:
            for part in slices(b, 2, CHUNK):
                counts = []
                for t in part.column(2):
                    added, pieces = cutter.pieces(t.as_py())
                    counts.append(added + sum(map(get, pieces)))
                lengths.trim()
                n = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
