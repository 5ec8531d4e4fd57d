"""How two tokenizers cut the same texts: groups of tokens that end together, and how usual each pair of tokens is.

Both vocabularies see a blank and the text. Where a single blank stands between two characters that are no white space, both
cut in front of it whatever lies around, so a text is a row of words that don't depend on each other; a worker encodes a new
word once, all new ones of a batch at a time, and remembers it. What comes of each text is written once; the rest works on that.

Two tokens are linked where they end at the same byte. A pair of ids is one 64-bit integer, ``b << 32 | a``. Each task
sums its own pairs (``np.unique``), the partial counts are dealt by range and sorted, and equal neighbours are summed in
one run through each sorted shard, which no pair leaves. Of two linked tokens one ends with all of the other's bytes, so the
vocabularies alone bound the number of pairs (``most_pairs``); so the shards fit into each worker's memory, where they
are mapped and searched by ``searchsorted``.

A text that is null or empty, or that either vocabulary does not give back byte by byte (as one with U+2581, which one of
them takes for a blank), has no tokens: zeros and an empty digest. Repeated rows count each; ids may be null; a
text is cut into words however long it is, so only a stretch without a lone blank is encoded in one.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_characters
from .common import cut, flat, slices

#: Words that a worker remembers, the longest of them (longer ones only for a batch), bytes of text and new words at once.
REMEMBERED, LONGEST, CHUNK, AT_ONCE = 200_000, 256, 1 << 20, 8_192
#: Shards of the sorted counts.
SHARDS = 8
#: Where a text falls into words, for both vocabularies.
JOINT = re.compile(r"(?<=\S) (?=\S)")
BLANK = "▁"


def byte_tokens(source: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    spec = json.loads(source)
    if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
    chars, vocab = byte_characters(), spec["model"]["vocab"]
    added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(chars[c] for c in token)
    return [added.get(i, t) for i, t in enumerate(out)]


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary."""
    pieces = [model.id_to_piece(i) for i in range(len(model))]
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("pieces that go on behind a blank are not supported")
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids there can be at all: one token's bytes are the last of the other's."""

    def held(of: list[bytes], by: list[bytes], shortest: int) -> int:
        n: dict[bytes, int] = {}
        for t in of:
            n[t] = n.get(t, 0) + 1
        return sum(n.get(t[i:], 0) for t in by for i in range(shortest, len(t)))

    return held(b, a, 0) + held(a, b, 1)  # equal ones count in the first


def ascii_encoder(source: bytes, tokens: list[bytes]) -> Callable[[str], list[int]] | None:
    """Another encoder for the same vocabulary, if its ids stand in the order of its merges; for ASCII texts, which all splitting rules see alike."""
    from tiktoken import Encoding

    spec = json.loads(source)
    vocab, added = spec["model"]["vocab"], {t["id"] for t in spec.get("added_tokens", [])}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    singles = [i for i in vocab.values() if i not in added and len(tokens[i]) == 1]
    if made != sorted(set(made)) or not made or max(singles) > made[0] or len(singles) + len(made) != len(set(vocab.values()) - added):
        return None
    return Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={tokens[i]: i for i in vocab.values() if i not in added}, special_tokens={}).encode_ordinary


class Aligner:
    """Encodes words with both vocabularies and remembers what came of it."""

    def __init__(self, first: bytes, second: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(first)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=second)
        self.bytes_a, self.bytes_b = byte_tokens(first), piece_tokens(self.b)
        self.fast = ascii_encoder(first, self.bytes_a)
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b)]
        self.forget()

        names = [[str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b)]
        #: Each id as it is written within a group and at its end.
        self.within, self.last = [[f"{i}," for i in n] for n in names], [[f"{i}{end}" for i in n] for n, end in zip(names, "|;", strict=True)]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        #: Of each word: its groups as text, how many tokens of both kinds, where its pairs begin and how many there are; -1 if it doesn't come back.
        self.groups: list[str] = []
        self.n_a, self.n_b, self.first, self.n = (np.zeros(0, np.int64) for _ in range(4))
        self.pairs = np.zeros(0, np.int64)
        self.long = False

    def _first(self, texts: list[str]) -> list[list[int]]:
        """The first vocabulary's ids; those of ASCII texts come from the faster encoder, if there is one."""
        if self.fast is None:
            return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        out: list = [self.fast(t) if t.isascii() else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.a.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, words: list[str]) -> None:
        """Encode new words and cut them into groups, all at once."""
        texts = [" " + w for w in words]
        ids = [self._first(texts), self.b.encode(words, num_threads=1)]
        raw = [t.encode() for t in texts]
        fine, stops = [True] * len(words), np.cumsum(list(map(len, raw)))
        for x, tokens, sizes in zip(ids, (self.bytes_a, self.bytes_b), self.sizes, strict=True):
            every = list(chain.from_iterable(x))
            at = np.concatenate(([0], np.cumsum(sizes[np.array(every, np.int64)])))[np.cumsum(list(map(len, x)))]
            if not np.array_equal(at, stops) or b"".join([tokens[i] for i in every]) != b"".join(raw):
                fine = [f and b"".join([tokens[i] for i in w]) == r for f, w, r in zip(fine, x, raw, strict=True)]
        base = len(self.groups)
        self.number.update(zip(words, range(base, base + len(words)), strict=True))
        self.long |= max(map(len, words)) > LONGEST
        self.groups += [""] * len(words)
        good = [i for i, f in enumerate(fine) if f]
        n_a, n_b, first, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), -1)
        if good:
            pairs = self._group(base, good, [raw[i] for i in good], [[x[i] for i in good] for x in ids], n_a, n_b, first, n)
            first += len(self.pairs)
            self.pairs = np.concatenate((self.pairs, pairs))
        self.n_a, self.n_b, self.first, self.n = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.first, first), (self.n, n)))

    def _group(self, base: int, good: list[int], raw: list[bytes], some: list[list[list[int]]], n_a: np.ndarray, n_b: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The pairs of words that both vocabularies give back; writes their groups and counts."""
        counts = [np.fromiter(map(len, x), np.int64, len(x)) for x in some]
        joined = [np.fromiter(chain.from_iterable(x), np.int64, int(c.sum())) for x, c in zip(some, counts, strict=True)]
        ends = [np.cumsum(sizes[x]) for sizes, x in zip(self.sizes, joined, strict=True)]
        joint, *at = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        pairs = joined[1][at[1]] << 32 | joined[0][at[0]]
        words_end = np.searchsorted(joint, np.cumsum(list(map(len, raw))), "right")  # groups up to each word's end
        # tokens in the order in which they are written: by group, those of the first vocabulary first
        group = [np.searchsorted(joint, e) for e in ends]
        order = np.argsort(np.concatenate((2 * group[0], 2 * group[1] + 1)), kind="stable").tolist()
        written = []
        for side in range(2):
            closes = np.zeros(len(joined[side]), bool)
            closes[at[side]] = True
            within, last = self.within[side], self.last[side]
            written += [last[i] if c else within[i] for i, c in zip(joined[side].tolist(), closes.tolist(), strict=True)]
        written = [written[i] for i in order]
        s = 0
        for i, e in zip(good, np.cumsum(counts[0] + counts[1]).tolist(), strict=True):
            self.groups[base + i] = "".join(written[s:e])[:-1]
            s = e
        n_a[good], n_b[good] = counts
        n[good] = np.diff(words_end, prepend=0)
        first[good] = words_end - n[good]
        return pairs

    def words(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's words."""
        cuts = [JOINT.split(t) if t else [] for t in texts]
        known = self.number
        new = list({w: None for c in cuts for w in c if w not in known})
        for i in range(0, len(new), AT_ONCE):
            self._learn(new[i : i + AT_ONCE])
        get = known.__getitem__
        return [list(map(get, c)) for c in cuts]

    def linked(self, numbers: np.ndarray) -> np.ndarray:
        """The pairs of words, one after the other."""
        n = self.n[numbers]
        return self.pairs[np.repeat(self.first[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def full(self) -> bool:
        return self.long or len(self.groups) > REMEMBERED


_built: dict[bytes, Aligner] = {}


def _aligner(first: bytes, second: bytes) -> Aligner:
    """One for each worker and pair of vocabularies."""
    key = hashlib.sha256(first).digest() + hashlib.sha256(second).digest()
    if key not in _built:
        _built.clear()
        _built[key] = Aligner(first, second)
    return _built[key]


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of equal neighbours in a sorted shard; a run may go on over batches."""
    held: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        pairs, n = (batch.column(i).to_numpy() for i in range(2))
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        keys, sums = pairs[first], np.add.reduceat(n, first)
        if held is not None:
            if held[0] == keys[0]:
                sums[0] += held[1]
            else:
                keys, sums = np.concatenate(([held[0]], keys)), np.concatenate(([held[1]], sums))
        held = int(keys[-1]), int(sums[-1])
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], ["pair", "n"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["pair", "n"])


def encoded(docs: DataFrame, first: bytes, second: bytes, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, groups_sha256, groups, pairs) of each row's whole text, with its pairs as 64-bit integers, written once."""
    sources = docs.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sources.value)
        for b in batches:
            for part in slices(b, 1, CHUNK):
                if aligner.full():
                    aligner.forget()
                texts = aligner.words(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                number = np.fromiter(chain.from_iterable(texts), np.int64, int(sizes.sum()))
                lost = np.unique(np.repeat(np.arange(len(texts)), sizes)[aligner.n[number] < 0])  # texts that don't come back
                for i in lost.tolist():
                    texts[i] = []
                number = number[~np.isin(np.repeat(np.arange(len(sizes)), sizes), lost)]
                sizes[lost] = 0
                ends = np.concatenate(([0], np.cumsum(sizes)))
                n_a, n_b, n = (np.diff(np.concatenate(([0], np.cumsum(x[number])))[ends]) for x in (aligner.n_a, aligner.n_b, aligner.n))
                said = [";".join([aligner.groups[i] for i in w]) for w in texts]
                digests = [hashlib.sha256(t.encode()).hexdigest() if w else "" for t, w in zip(said, texts, strict=True)]
                at = np.concatenate(([0], np.cumsum(8 * n)))
                pairs = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(aligner.linked(number).astype("<i8"))]).cast(pa.binary())
                columns = [pa.array(n_a), pa.array(n_b), pa.array(digests, pa.string()), pa.array(said if groups else [None] * len(said), pa.string()), pairs]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_a", "n_b", "groups_sha256", "groups", "pairs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut(texts.mapInArrow(run, "doc_id long, n_a long, n_b long, groups_sha256 string, groups string, pairs binary"))


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's own sum of each pair; their number is bounded by the vocabularies."""
    pairs = counts = np.zeros(0, np.int64)
    for b in batches:
        for part in slices(b, 0, 8 * CHUNK):
            new, n = np.unique(np.frombuffer(flat(part.column(0))[0], "<i8"), return_counts=True)
            pairs, at = np.unique(np.concatenate((pairs, new)), return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, np.concatenate((counts, n)))
            counts = sums
    for s in range(0, len(pairs), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 16)]) for x in (pairs, counts)], ["pair", "n"])


def pair_counts(texts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(pair, n): how many links of all ``encoded`` texts hold each pair of ids, as a table of sorted shards."""
    partial = cut(texts.select("pairs").mapInArrow(tallied, "pair long, n long"))  # dealing by range reads its input twice
    return cut(partial.repartitionByRange(shards, "pair").sortWithinPartitions("pair").mapInArrow(run_lengths, "pair long, n long"))


class Shards:
    """Sorted pairs with their counts and the highest count of each pair's second id, mapped into memory."""

    def __init__(self, block: bytes) -> None:
        self.n = len(block) // 24
        self.pairs = self.sums = self.best = np.zeros(0, np.int64)
        if self.n:
            with tempfile.TemporaryFile() as f:  # gone as soon as the mapping is
                f.write(block)
                f.flush()
                self.map = mmap.mmap(f.fileno(), len(block), access=mmap.ACCESS_READ)
            self.pairs, self.sums, self.best = (np.frombuffer(self.map, "<i8", self.n, 8 * self.n * i) for i in range(3))

    @staticmethod
    def packed(pairs: np.ndarray, sums: np.ndarray) -> bytes:
        order = np.argsort(pairs, kind="stable")
        pairs, sums = pairs[order], sums[order]
        ids = pairs >> 32
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
        best = np.repeat(np.maximum.reduceat(sums, first), np.diff(np.append(first, len(ids)))) if len(ids) else sums
        return b"".join(x.astype("<i8").tobytes() for x in (pairs, sums, best))

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair its count, and whether no pair with its second id has a higher one."""
        at = np.searchsorted(self.pairs, pairs)
        if len(pairs) and (at.max() >= self.n or not np.array_equal(self.pairs[at], pairs)):
            raise ValueError("a pair that was never counted: the texts have changed since")
        return self.sums[at], self.sums[at] == self.best[at]


_mapped: dict[bytes, Shards] = {}


def _shards(block: bytes) -> Shards:
    key = hashlib.sha256(block).digest()
    if key not in _mapped:
        _mapped.clear()
        _mapped[key] = Shards(block)
    return _mapped[key]


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def align(docs: DataFrame, first: str, second: str, groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of each row's whole text.

    ``first`` and ``second`` are the paths of a byte-level tokenizer file and of a piece model, read on the driver.
    ``groups`` (null unless asked for) lists the ids, as in ``a1,a2|b1;a3|b2,b3``. As two tokens end together exactly
    where a group does, there is one link to a group.
    """
    with open(first, "rb") as f, open(second, "rb") as g:
        texts = encoded(docs, f.read(), g.read(), groups)
    found = pair_counts(texts).toArrow()  # bounded by most_pairs of the vocabularies
    block = docs.sparkSession.sparkContext.broadcast(Shards.packed(*(found.column(i).to_numpy() for i in range(2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _shards(block.value)
        for b in batches:
            for part in slices(b, 5, 8 * CHUNK):
                data, at = flat(part.column(5))
                sums, best = shards.find(np.frombuffer(data, "<i8"))
                n, at = pa.array(np.diff(at // 8)), at // 8
                total, most = (np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[at] for x in (sums, best))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], n, n, pa.array(np.diff(most)), pa.array(np.diff(total)), *part.columns[3:5]], OUT.replace(",", "").split()[::2])

    return texts.select("doc_id", "n_a", "n_b", "groups_sha256", "groups", "pairs").mapInArrow(run, OUT)
